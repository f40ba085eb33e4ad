"""Pair counts, matches, count tables and estimators against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skytally.functions.geometry import chord
from skytally.functions.healpix import with_pixel
from skytally.operators import counts as C
from skytally.operators import estimators as E
from skytally.operators import match as MT
from skytally.operators import pairs as P
from skytally.operators import partition as PT

EDGES = [0.01, 0.05, 0.2, 0.5]


def xyz(df):
    t, p = np.pi / 2 - np.radians(df.dec.to_numpy()), np.radians(df.ra.to_numpy())
    return np.stack([np.cos(p) * np.sin(t), np.sin(p) * np.sin(t), np.cos(t)], -1)


def dist_sq(a, b):
    d = xyz(a)[:, None, :] - xyz(b)[None, :, :]
    return d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]


def hot_sky(seed, n=900, at=(150.0, 2.0)):
    """A third of all rows at one place, a third crowded round it, the rest spread out."""
    r = np.random.default_rng(seed)
    k = n // 3
    ra = np.concatenate([np.full(k, at[0]), at[0] + r.normal(0, 0.05, k), at[0] + r.uniform(-3, 3, n - 2 * k)])
    dec = np.concatenate([np.full(k, at[1]), at[1] + r.normal(0, 0.05, k), at[1] + r.uniform(-3, 3, n - 2 * k)])
    return pd.DataFrame({"id": np.arange(n), "ra": ra, "dec": dec})


def totals(counts):
    return [r.n for r in counts.groupBy("edge_idx").agg(F.sum("n").alias("n")).orderBy("edge_idx").collect()]


@pytest.mark.parametrize("leaf", [256, 8])
def test_hot_groups_count_exactly(spark, monkeypatch, leaf):
    monkeypatch.setattr(P, "LEAF", leaf)
    a, b = hot_sky(1), hot_sky(2, 600)
    got = totals(P.pair_count(spark.createDataFrame(a), spark.createDataFrame(b), EDGES, convention="symmetric"))
    d2 = dist_sq(a, b)
    assert got == [int((d2 <= chord(e) ** 2).sum()) for e in EDGES]


def test_pixel_convention(spark):
    a = hot_sky(3, 300)
    s = spark.createDataFrame(a)
    pix = with_pixel(s, 32).toPandas().sort_values("id").pix.to_numpy()
    order = a.index.to_numpy()
    d2 = dist_sq(a, a)[np.ix_(order, order)]
    keep = pix[:, None] <= pix[None, :]
    got = totals(P.pair_count(s, s, EDGES))
    assert got == [int(((d2 <= chord(e) ** 2) & keep).sum()) for e in EDGES]


def test_counts_do_not_depend_on_nside(spark):
    s = spark.createDataFrame(hot_sky(4, 300))
    got = [totals(P.pair_count(s, s, EDGES, nside=n, convention="symmetric")) for n in (8, 32)]
    assert got[0] == got[1]


def test_wrap_and_poles(spark):
    p = pd.DataFrame({"ra": [359.95, 0.05, 10.0, 190.0], "dec": [0.0, 0.0, 89.95, 89.95]})
    s = spark.createDataFrame(p)
    # each of the two close pairs once per order, at 0.1 degrees
    assert totals(P.pair_count(s, s, [0.01, 0.099, 0.101], convention="symmetric")) == [4, 4, 8]


def test_reach_is_checked(spark):
    s = spark.createDataFrame(hot_sky(5, 30))
    with pytest.raises(ValueError, match="leave the neighbour rings"):
        P.pair_count(s, s, [1.0, 20.0], P.pixel_pairs(spark, 32))
    with pytest.raises(ValueError, match="180"):
        P.pair_count(s, s, [1.0, 200.0])


def whole_sky(seed, n):
    r = np.random.default_rng(seed)
    ra = np.concatenate([r.uniform(0, 360, n), [0.0, 0.0, 180.0, 90.0, 359.999], np.full(20, 77.0)])
    dec = np.concatenate([np.degrees(np.arcsin(r.uniform(-1, 1, n))), [90.0, -90.0, 0.0, 0.0, 0.0], np.full(20, -33.0)])
    return pd.DataFrame({"id": np.arange(len(ra)), "ra": ra, "dec": dec})


@pytest.mark.parametrize("nside", [1, 4, 12, 32])
def test_any_angle_counts_exactly(spark, nside):
    """Over the whole sky, poles and the seam included, out to 180 degrees, in both conventions."""
    a, b = whole_sky(1, 250), whole_sky(2, 150)
    edges = [0.3, 5.0, 33.0, 90.0, 140.0, 180.0]
    s, t = spark.createDataFrame(a), spark.createDataFrame(b)
    d2, (pa, pb) = dist_sq(a, b), (with_pixel(x, nside).toPandas().sort_values("id").pix.to_numpy() for x in (s, t))
    got = totals(P.pair_count(s, t, edges, nside=nside))
    keep = pa[:, None] <= pb[None, :]
    assert got == [int(((d2 <= chord(e) ** 2) & keep).sum()) for e in edges]
    if nside == 4:
        got = totals(P.pair_count(s, t, edges, nside=nside, convention="symmetric"))
        assert got == [int((d2 <= chord(e) ** 2).sum()) for e in edges] and got[-1] >= len(a) * len(b) - 2


@pytest.mark.parametrize("nside", [1, 2, 8, 12, 32])
def test_pixels_know_their_centre_and_parent(spark, nside):
    from skytally.functions.healpix import centre_of, nested_id, npix, pixel_centres, pixel_corners, pixel_radius

    z, phi = centre_of(nside, "pix")
    p = pixel_centres(spark, nside).withColumns({"cz": z, "cphi": phi})
    apart = F.abs(F.col("z") - F.col("cz")) + F.abs(F.cos("cphi") - F.cos(F.radians("ra"))) + F.abs(F.sin("cphi") - F.sin(F.radians("ra")))
    assert p.where(apart > 1e-9).count() == 0
    n = p.select(nested_id(nside, F.col("cz"), F.col("cphi")).alias("n"))
    assert n.distinct().count() == npix(nside)
    if nside & (nside - 1) == 0:
        got = n.agg(F.min("n"), F.max("n")).first()
        assert tuple(got) == (0, npix(nside) - 1)
        # four children of a parent are neighbours: their centres are within the parent's radius of each other
        four = p.withColumn("up", F.shiftright(nested_id(nside, F.col("cz"), F.col("cphi")), 2)).groupBy("up").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), F.count("*").alias("k"))
        size = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
        if nside >= 2:
            assert four.where((F.col("k") != 4) | (size < 1 - np.radians(pixel_radius(nside)) ** 2)).count() == 0


def test_counts_below_the_reach_are_those_of_the_rings(spark):
    s = spark.createDataFrame(hot_sky(8, 400))
    ring = as_dict(P.pair_count(s, s, EDGES))
    tree = as_dict(P.pair_count(s, s, EDGES, P.pairs_within(with_pixel(s, 32), 32, EDGES[-1]), covered=EDGES[-1]))
    assert ring == tree
    few = P.pairs_within(with_pixel(s, 32), 32, EDGES[-1]).count()
    used = with_pixel(s, 32).select("pix").distinct().count()
    assert used <= few < used * 40


def test_match_hot_and_tied(spark, monkeypatch):
    monkeypatch.setattr(MT, "MATCH_LEAF", 8)
    a, b = hot_sky(6, 300), hot_sky(7, 300)
    b["flag"] = True
    got = MT.cross_match(spark.createDataFrame(a), spark.createDataFrame(b), 120.0).toPandas().sort_values("id")
    d2 = dist_sq(a, b)
    best = np.lexsort((np.broadcast_to(b.id.to_numpy(), d2.shape), d2), axis=1)[:, 0]
    near = d2[np.arange(len(a)), best] < chord(120 / 3600) ** 2
    want = np.where(near, b.id.to_numpy()[best], -1)
    assert got.id_join.fillna(-1).astype(int).tolist() == want.tolist()
    assert got.flag_join.tolist() == near.tolist() and 0 < near.sum() < len(a)


def table(spark, rows):
    return spark.createDataFrame(rows, "pix1 long, pix2 long, edge_idx int, n long")


def as_dict(df):
    return {(r.pix1, r.pix2, r.edge_idx): r.n for r in df.collect()}


def test_count_table_upserts(spark):
    m, d = table(spark, [(1, 2, 0, 5), (2, 2, 0, 1)]), table(spark, [(1, 2, 0, 7), (3, 1, 0, 2)])
    assert as_dict(C.add_counts(m, d)) == {(1, 2, 0): 12, (2, 2, 0): 1, (3, 1, 0): 2}
    assert as_dict(C.assign_counts(m, d)) == {(1, 2, 0): 7, (2, 2, 0): 1, (3, 1, 0): 2}
    with pytest.raises(Exception, match="repeated entries"):
        C.add_counts(m, d.union(d)).collect()
    b = C.balance(m.union(table(spark, [(2, 1, 0, 3)])))
    assert as_dict(b) == as_dict(C.balance(b)) == {(1, 2, 0): 8, (2, 2, 0): 1}
    assert C.clear(m).count() == 0


def test_regions_need_enough_pixels(spark):
    s = spark.createDataFrame([(i, (i + 1) / 55) for i in range(10)], "pix long, share double")
    r = E.jackknife_regions(s, 3).toPandas()
    assert r.groupby("region").size().min() >= 1 and abs(r.drop_duplicates("region").region_share.sum() - 1) < 1e-12
    assert r.set_index("pix").region[9] == 0 and r.set_index("pix").region[8] == 1
    with pytest.raises(Exception, match="only 10 pixels"):
        E.jackknife_regions(s, 11).collect()


def test_left_out_sums_equal_removal(spark):
    r = np.random.default_rng(0)
    rows = [(0, 0, "R0R0", int(i), int(j), e, int((e + 1) * r.integers(5, 50))) for i in range(8) for j in range(i, 8) for e in range(3)]
    counts = spark.createDataFrame(rows, "corr_id int, zbin int, term string, pix1 long, pix2 long, edge_idx int, n long")
    pops = spark.createDataFrame([(0, 0, "R0", p, 10 + p) for p in range(8)], "corr_id int, zbin int, catalog string, pix long, n long")
    regions = spark.createDataFrame([(0, 0, p, p % 4) for p in range(7)], "corr_id int, zbin int, pix long, region int")
    terms = E.expand_terms(spark.createDataFrame([(0, "auto")], "corr_id int, type string"))
    got = {(x.region, x.bin_idx): x.signal for x in E.leave_one_out(counts, pops, terms, regions, 4, ["corr_id", "zbin"], 3).collect()}
    reg = {p: p % 4 for p in range(7)}
    for k in (-1, 0, 1, 2, 3):
        ok = lambda p: k < 0 or reg.get(p) != k
        cum = [sum(n for *_, i, j, e, n in rows if e == b and ok(i) and ok(j)) for b in range(3)]
        pop = sum(10 + p for p in range(8) if ok(p))
        for b in range(2):
            assert got[k, b] == pytest.approx((cum[b + 1] - cum[b]) / pop ** 2, rel=1e-12)


def test_power_law_is_recovered(spark):
    pts = [(0, t, 0.7 * t ** -0.83, 0.1 * t) for t in (0.05, 0.1, 0.3, 0.6, 1.0)]
    f = E.fit_power_law(spark.createDataFrame(pts, "corr_id int, theta double, w double, err double"), ["corr_id"]).first()
    assert f.a == pytest.approx(0.7, abs=1e-4) and f.k == pytest.approx(-0.83, abs=1e-4)


def test_drawn_number_is_exact_in_a_hot_pixel(spark, monkeypatch):
    monkeypatch.setattr(PT, "RANK_BLOCK", 64)
    d = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("pix"))
    got = PT.draw_fraction(d, ["pix"], F.lit(0.37), PT.hash_order("id")).groupBy("pix").count().toPandas().set_index("pix")["count"]
    size = d.groupBy("pix").count().toPandas().set_index("pix")["count"]
    assert got.to_dict() == {p: int(np.floor(0.37 * n)) for p, n in size.items()}


def test_randoms_against_randoms_show_no_signal(spark):
    from skytally.plans.correlation import correlation_function
    r = np.random.default_rng(9)
    sky = lambda n, s: pd.DataFrame({"catalog": s, "ra": r.uniform(150, 160, n), "dec": r.uniform(-5, 5, n)})
    pts = pd.concat([sky(1500, "D0"), sky(1500, "R0")]).assign(corr_id=0, redshift=0.5)
    corrs = spark.createDataFrame([(0, "auto")], "corr_id int, type string")
    w = correlation_function(spark.createDataFrame(pts), corrs, [0.1, 0.4, 0.8], [0.3, 0.7], regions=6).toPandas()
    assert len(w) == 2 and w.w.abs().max() < 0.1 and (w.err > 0).all()


def test_absent_terms_count_as_no_pairs(spark):
    terms = E.expand_terms(spark.createDataFrame([(0, "auto"), (1, "cross")], "corr_id int, type string"))
    def w(corr, **signal):
        rows = [(corr, 0, term, float(v)) for term, v in signal.items()]
        return E.estimate(spark.createDataFrame(rows, "corr_id int, bin_idx int, term string, signal double"), terms, ["corr_id"]).first().w
    assert w(1, D1D2=3, D1R2=1, R1R2=1) == 3.0
    assert w(1, D1D2=3, D2R1=1, R1R2=1) == 3.0
    assert w(1, D1R2=1, D2R1=1, R1R2=1) == -1.0
    assert w(0, D0R0=1, R0R0=1) == -1.0
    assert w(0, D0D0=2, R0R0=1) == 3.0
    assert w(0, D0D0=2, D0R0=1) is None


def test_catalogs_without_redshift_go_into_every_bin(spark):
    pts = spark.createDataFrame([(0, "D0", 0.4), (0, "D0", None), (0, "R0", None), (1, "D0", 0.4), (1, "R0", 9.0)], "corr_id int, catalog string, redshift double")
    corrs = spark.createDataFrame([(0, "auto", True), (1, "auto", False)], "corr_id int, type string, use_zbins boolean")
    got = sorted((r.corr_id, r.catalog, r.zbin) for r in PT.split_by_correlation(pts, corrs, [0.3, 0.5, 0.7]).collect())
    assert got == [(0, "D0", 0), (0, "R0", 0), (0, "R0", 1), (1, "D0", 0), (1, "R0", 0)]
    bare = PT.split_by_correlation(pts.drop("redshift"), corrs, [0.3, 0.5, 0.7])
    assert bare.where("corr_id = 0").count() == 6 and bare.where("corr_id = 1").count() == 2


@pytest.mark.parametrize("k", [-3.6, 1.8, -11.0])
def test_steep_power_laws_are_found(spark, k):
    pts = [(0, t, 2.0 * t ** k, 0.1 * t ** k) for t in (0.05, 0.1, 0.3, 0.6, 1.0)]
    f = E.fit_power_law(spark.createDataFrame(pts, "corr_id int, theta double, w double, err double"), ["corr_id"]).first()
    assert f.a == pytest.approx(2.0, abs=1e-4) and f.k == pytest.approx(k, abs=1e-4)


def test_cell_pairs_don_t_grow_for_small_angles(spark):
    """Cell pairs of the first level follow the occupied pixels, not the angle."""
    from skytally.operators import pairs as P
    r = np.random.default_rng(5)
    df = spark.createDataFrame(pd.DataFrame({"ra": r.uniform(150, 160, 4000), "dec": r.uniform(-5, 5, 4000)}))
    met = {}
    for theta in (0.5, 0.01, 0.001):
        tree = P.CellTree(P._positions(df, [], 32, None), [], P.first_shift(theta, 32))
        met[theta] = tree.cells.count()
    assert met[0.01] == met[0.001] <= 2 * met[0.5]
    x = df.toPandas()
    a, d = np.radians(x.ra.to_numpy()), np.radians(x.dec.to_numpy())
    v = np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], 1)
    dist = 2 * np.arcsin(np.clip(np.linalg.norm(v[:, None] - v[None], axis=2) / 2, 0, 1))
    got = P.pair_count(df, df, [0.01, 0.05], convention="symmetric").groupBy("edge_idx").agg(F.sum("n").alias("n")).collect()
    assert {r.edge_idx: r.n for r in got} == {i: int((dist <= np.radians(e)).sum()) for i, e in enumerate((0.01, 0.05))}

"""Sources, runs, specifications, curves and fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytally.functions import cosmology as CO
from skytally.operators import curves as CV
from skytally.operators import histograms as H
from skytally.operators import model as B
from skytally.sources import catalog as S
from skytally.sources import runs as R
from skytally.sources import spec as SP


def test_append_continues_the_numbers(spark, tmp_path):
    path = str(tmp_path / "cat")
    d = spark.range(1000).withColumnRenamed("id", "v").repartition(7)
    S.append_indexed(d, path)
    S.append_indexed(d.limit(10), path)
    idx = sorted(r.row_idx for r in spark.read.parquet(path).collect())
    assert idx == list(range(1010)) and S.row_count(spark, path) == 1010


def test_write_flat_does_not_overwrite_unasked(spark, tmp_path):
    path = str(tmp_path / "flat")
    d = spark.range(3).withColumn("a", F.array(F.lit(1)))
    with pytest.warns(UserWarning, match="array columns: a"):
        S.write_flat(d, path)
    assert spark.read.parquet(path).columns == ["id"]
    with pytest.raises(Exception), pytest.warns(UserWarning):
        S.write_flat(d, path)
    with pytest.warns(UserWarning):
        S.write_flat(d, path, overwrite=True)


def test_runs_by_number_and_from_the_end(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert [R.save_run(spark.range(n), path) for n in (1, 2, 3)] == [0, 1, 2]
    assert R.load_run(spark, path).count() == 3 and R.load_run(spark, path, -3).count() == 1
    assert R.load_run(spark, path, 1).count() == 2


def test_spec_tables(spark):
    spec = {"abins": "0.1, 0.2", "zbins": [0.3, 0.5], "nside": 32, "correlations": [
        {"type": "auto", "str": "a", "use_zbins": "y", "D0": "d", "R0": "r"},
        {"type": "cross", "str": "c", "D1": "d1", "D2": "d2", "R1": "r1", "R2": "r2"}]}
    t = SP.correlation_spec(spark, spec)
    assert [r.term for r in t["terms"].orderBy("corr_id", "term").collect()] == ["D0D0", "D0R0", "R0R0", "D1D2", "D1R2", "D2R1", "R1R2"]
    assert t["catalogs"].count() == 6 and t["corrs"].first().D1 == "" and t["abins"].count() == 2
    spec["correlations"][0]["type"] = "other"
    with pytest.raises(ValueError, match="unknown type"):
        SP.correlation_spec(spark, spec)


def test_stored_meta_wins(spark):
    old = spark.createDataFrame([("a", 1, 5)], "catalog string, pix int, n int")
    new = spark.createDataFrame([("a", 1, 9), ("b", 1, 2)], "catalog string, pix int, n int")
    assert {tuple(r) for r in SP.merge_meta(old, new).collect()} == {("a", 1, 5), ("b", 1, 2)}
    assert SP.drop_empty(spark.createDataFrame([("a", 0), ("b", 1)], "catalog string, n int")).count() == 1


def test_interp_matches_numpy(spark):
    r = np.random.default_rng(3)
    xs, q = np.sort(r.uniform(0, 5, 40)), r.uniform(-1, 6, 500)
    ys = r.normal(size=40)
    curve = spark.createDataFrame([("c", float(a), float(b)) for a, b in zip(xs, ys)], "curve_id string, x double, y double")
    d = spark.createDataFrame([(i, "c", float(v)) for i, v in enumerate([*q, *xs])], "i int, curve_id string, v double")
    got = CV.interp(d, "v", curve, name="o").orderBy("i").toPandas().o
    assert np.allclose(got, np.interp([*q, *xs], xs, ys), atol=1e-12)


def test_bessel_and_distance(spark):
    x = spark.createDataFrame([(0.0, 1.0), (1.0, 0.7651976866), (2.4048255577, 0.0), (10.0, -0.2459357645)], "x double, j double")
    assert x.where(F.abs(CO.bessel_j0("x") - F.col("j")) > 2e-7).count() == 0
    d = CO.with_distance(spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "z double")).orderBy("z").toPandas().d_c
    assert d[0] == 0 and d[1] == pytest.approx(1888.6, abs=1.0) and d[2] == pytest.approx(3303.8, abs=1.0)


def test_bias_is_recovered_without_underflow(spark):
    pts = [(0, z, m * 1.5 ** 2 * (1 + z), 1e-3, m) for z in (0, 1) for m in np.linspace(1, 3, 400).tolist()]
    p = spark.createDataFrame(pts, "corr_id int, zbin int, w double, err double, model double")
    l = B.bias_likelihood(p, ["corr_id", "zbin"])
    best = {r.zbin: r.best for r in B.best_bias(l, ["corr_id", "zbin"]).collect()}
    assert best[0] == pytest.approx(1.5, abs=0.011) and best[1] == pytest.approx(1.5 * 2 ** 0.5, abs=0.011)
    area = l.groupBy("zbin").agg(F.sum("likelihood").alias("s")).toPandas().s * 8 / 399
    assert np.allclose(area, 1, atol=1e-6)


def test_last_bin_is_closed(spark):
    h = H.hist1d(spark.createDataFrame([(0.0,), (1.0,), (2.0,), (2.1,), (float("nan"),)], "v double"), "v", 0, 2, 2)
    assert {r.bin_idx: r.n for r in h.collect()} == {0: 1, 1: 2}


def test_stack_skips_empty_curves(spark):
    d = spark.createDataFrame([([0.0, 2.0, 0.0],), ([0.0, 0.0, 0.0],)], "p array<double>")
    assert [r.y for r in CV.stack_pdz(d, "p", 0.5).orderBy("i").collect()] == [0.0, 2.0, 0.0]


def test_spectra_count_without_a_curve(spark):
    d = spark.createDataFrame([([1.0, 1.0, 1.0], None), (None, 0.5), ([], 0.5)], "p array<double>, z double")
    got = [r.y for r in CV.stack_pdz(d, "p", 0.5, specz="z", spec_sigma=0.1).orderBy("i").collect()]
    top = 1 / (0.1 * np.sqrt(2 * np.pi))
    assert got[1] == pytest.approx(1.0 + 2 * top) and got[0] == pytest.approx(1.0, abs=1e-4)


def test_interp_on_a_log_grid_of_many_nodes(spark):
    xs = np.geomspace(1e-4, 50, 3000)
    ys, q = np.log(xs), np.random.default_rng(8).uniform(0, 60, 400)
    curve = spark.createDataFrame([("c", float(a), float(b)) for a, b in zip(xs, ys)], "curve_id string, x double, y double")
    d = spark.createDataFrame([(i, "c", float(v)) for i, v in enumerate(q)] + [(400, "none", 1.0), (401, "c", None)], "i int, curve_id string, v double")
    got = CV.interp(d, "v", curve, name="o").orderBy("i").toPandas().o
    assert np.allclose(got[:400], np.interp(q, xs, ys), atol=1e-12) and got[400:].isna().all()


def test_distances_reach_the_data(spark):
    d = CO.with_distance(spark.createDataFrame([(5.0,), (6.0,), (9.0,), (-1.0,), (None,), (float("nan"),)], "z double")).toPandas()
    by = d.set_index("z").d_c
    assert by[5.0] < by[6.0] - 400 and by[6.0] < by[9.0] - 400 and len(d) == 6
    assert d[~d.z.isin([5.0, 6.0, 9.0])].d_c.isna().all()


def test_distance_by_quadrature(spark):
    """Against fine trapezoids in the logarithm of 1 + z, from tiny redshifts to absurd ones, without grid, join or window."""
    zs = [0.0, 1e-8, 1e-3, 0.3, 2.0, 10.0, 1100.0, 1e9]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = dict(CO.with_distance(df).collect())
    for z in zs[1:]:
        t = np.linspace(0, np.log1p(z), 400_001)
        f = np.exp(t) / np.sqrt(0.3 * np.exp(3 * t) + 0.7)
        assert got[z] == pytest.approx(CO.LIGHT_KM_S / 70.0 * np.trapezoid(f, t), rel=1e-9)
    assert got[0.0] == 0
    plan = CO.with_distance(df)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Window" not in plan and "Exchange" not in plan
    assert [r.d_c for r in CO.with_distance(df, z_max=0.5).where("z > 0.5").collect()] == [None] * 4


def test_stored_counts_are_updated_in_place(spark, tmp_path):
    import os

    cols = "corr_id int, zbin int, term string, pix1 long, pix2 long, edge_idx int, n long"
    def rows(t):
        return {tuple(r)[:6]: r.n for r in t.select(*[c.split()[0] for c in cols.split(", ")]).collect()}
    old = {(c, z, t, p, p + 1, e): 10 * p + e for c in (0, 1) for z in (0, 1) for t in ("DD", "RR") for p in range(4) for e in (0, 1)}
    make = lambda d: spark.createDataFrame([(*k, n) for k, n in d.items()], cols)
    path = f"{tmp_path}/counts"
    R.update_counts(make(old), path)
    assert rows(R.load_counts(spark, path)) == old
    files = lambda: {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet") and not f.startswith(".")}
    before = files()
    delta = {(0, 1, "DD", 2, 3, 0): 5, (0, 1, "DD", 9, 9, 1): 7, (2, 0, "DD", 1, 1, 0): 1}
    R.update_counts(make(delta), path)
    want = {k: old.get(k, 0) + delta.get(k, 0) for k in {*old, *delta}}
    assert rows(R.load_counts(spark, path)) == want
    after = files()
    kept = {f for f in before if "corr_id=0/zbin=1/term=DD" not in f}
    assert kept and all(after.get(f) == before[f] for f in kept) and not {f for f in before if f not in kept} & set(after)
    R.update_counts(make(delta), path, "assign")
    assert rows(R.load_counts(spark, path)) == want | delta
    R.update_counts(make({}), path)
    assert rows(R.load_counts(spark, path)) == want | delta
    with pytest.raises(Exception, match="repeated entries"):
        R.update_counts(make(delta).union(make(delta)), path)
    assert rows(R.load_counts(spark, path)) == want | delta


def test_a_large_term_is_written_by_several_tasks(spark, tmp_path):
    import glob

    big = spark.range(400_000).select(F.lit(0).alias("corr_id"), F.lit(0).alias("zbin"), F.lit("DD").alias("term"), F.xxhash64("id").alias("pix1"), F.col("id").alias("pix2"), F.lit(0).alias("edge_idx"), F.col("id").alias("n"))
    held = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    try:
        R.save_counts(big.repartition(8), f"{tmp_path}/c")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", held)
    assert len(glob.glob(f"{tmp_path}/c/corr_id=0/zbin=0/term=DD/*.parquet")) > 1


def test_match_with_repeated_numbers_and_missing_positions(spark):
    from skytally.operators.match import cross_match

    left = spark.createDataFrame([(1, 10.0, 0.0), (2, None, None), (3, 200.0, 5.0), (4, None, 1.0)], "id int, ra double, dec double")
    right = spark.createDataFrame([(7, 10.0, 0.0001), (7, 70.0, 0.0), (8, None, None)], "id int, ra double, dec double")
    got = {r.id: (r.id_join, r.ra_join) for r in cross_match(left, right, 2.0).collect()}
    assert got == {1: (7, 10.0), 2: (None, None), 3: (None, None), 4: (None, None)}

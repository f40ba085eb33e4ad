"""Pair counts, count tables, estimators and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytally.functions.healpix import with_pixel
from skytally.lineage import cut
from skytally.operators import counts as M
from skytally.operators import estimators as E
from skytally.operators.histograms import count_by_group, top_pixels
from skytally.operators.pairs import by_cost, good_pairs, good_pixels, pair_count, pair_plan, pixel_pairs
from skytally.plans import correlation as C

from .base import ABINS, NSIDE, ZBINS, counted, ctes, d, pairs_sky, pixed, query, read, with_, xyzed
from .scalar_checks import Z_CASE

REGIONS = 16
AUTO = [(0, "auto", "galaxies", True)]
BOTH = [(0, "auto", "galaxies", True), (1, "cross", "quasars with galaxies", True)]
SLOT_TABLES = {"auto": {"D0": "galaxies", "R0": "randoms"},
               "cross": {"D1": "quasars", "D2": "galaxies", "R1": "quasar_randoms", "R2": "randoms"}}


def corr_table(spark, rows):
    return spark.createDataFrame(rows, "corr_id int, type string, str string, use_zbins boolean")


def corr_points(spark, sf, rows):
    """Every catalog of every correlation as one table."""
    out = None
    for corr_id, kind, *_ in rows:
        for slot, name in SLOT_TABLES[kind].items():
            part = read(spark, sf, name).select(
                F.lit(corr_id).alias("corr_id"), F.lit(slot).alias("catalog"), "ra", "dec", "redshift")
            out = part if out is None else out.unionByName(part)
    return out


def located(name, src, z=False):
    """CTEs adding pixel, x, y, z and optionally the redshift bin."""
    zc = f"{name}_0 AS (SELECT *, {Z_CASE} AS zbin FROM {src})" if z else f"{name}_0 AS (SELECT *, 0 AS zbin FROM {src})"
    return f"{zc},\n{pixed(name + '_p', name + '_0')},\n{xyzed(name, name + '_p')}"


def auto_ctes(z=False, keyed=None):
    keys = ("zbin",) if z or keyed else ()
    return ",\n".join([
        ctes("galaxies", "randoms"), located("g", "galaxies", z), located("r", "randoms", z), pairs_sky(NSIDE),
        "good AS (SELECT DISTINCT pix FROM g WHERE pix IN (SELECT pix FROM r))",
        "pp AS (SELECT pix1, pix2 FROM pixpairs WHERE pix1 IN (FROM good) AND pix2 IN (FROM good))",
        counted("dd", "g", "g", "pp", keys), counted("dr", "g", "r", "pp", keys), counted("rr", "r", "r", "pp", keys),
    ])


def cross_ctes(z=False, whole=()):
    """CTEs of a cross-correlation; catalogs in ``whole`` have no redshift and go into every bin."""
    keys = ("zbin",) if z else ()
    every = lambda name, src: (f"{name}_0 AS (SELECT t.*, cast(b.zbin AS int) AS zbin FROM {src} t, range({len(ZBINS) - 1}) b(zbin)),\n"
                               f"{pixed(name + '_p', name + '_0')},\n{xyzed(name, name + '_p')}")
    at = lambda name, src: every(name, src) if name in whole else located(name, src, z)
    return ",\n".join([
        ctes("galaxies", "randoms", "quasars", "quasar_randoms"), at("g", "galaxies"), at("r", "randoms"),
        at("q", "quasars"), at("s", "quasar_randoms"), pairs_sky(NSIDE),
        "good AS (SELECT pix FROM g INTERSECT SELECT pix FROM r INTERSECT SELECT pix FROM q INTERSECT SELECT pix FROM s)",
        "pp AS (SELECT pix1, pix2 FROM pixpairs WHERE pix1 IN (FROM good) AND pix2 IN (FROM good))",
        counted("dd", "q", "g", "pp", keys), counted("dr", "q", "r", "pp", keys), counted("rd", "g", "s", "pp", keys),
        counted("rr", "s", "r", "pp", keys),
    ])


# ---------------------------------------------------------------- pair counts


@query("j4_pair_count_auto", with_(ctes("galaxies"), located("g", "galaxies"), pairs_sky(NSIDE), counted("c", "g", "g")) +
       " SELECT pix1, pix2, edge_idx, n FROM c")
def _(spark, sf):
    g = read(spark, sf, "galaxies")
    return pair_count(g, g, ABINS, nside=NSIDE).withColumn("edge_idx", F.col("edge_idx").cast("long"))


WIDE = [2.0, 5.0, 11.0, 20.0]


@query("j4_pair_count_wide", with_(ctes("quasars"), located("q", "quasars"), "used AS (SELECT DISTINCT pix FROM q)",
                                   "met AS (SELECT a.pix AS pix1, b.pix AS pix2 FROM used a JOIN used b ON a.pix <= b.pix)",
                                   counted("c", "q", "q", "met", edges=WIDE)) +
       " SELECT pix1, pix2, edge_idx, n FROM c")
def _(spark, sf):
    q = read(spark, sf, "quasars")
    return pair_count(q, q, WIDE, nside=NSIDE).withColumn("edge_idx", F.col("edge_idx").cast("long"))


@query("j4_pair_count_by_zbin", with_(ctes("galaxies", "randoms"), located("g", "galaxies", True), located("r", "randoms", True),
                                       pairs_sky(NSIDE), counted("c", "g", "r", keys=("zbin",))) +
       " SELECT zbin, pix1, pix2, edge_idx, n FROM c")
def _(spark, sf):
    from skytally.operators.partition import split_by_z
    g, r = (split_by_z(read(spark, sf, t), ZBINS) for t in ("galaxies", "randoms"))
    c = pair_count(g, r, ABINS, nside=NSIDE, keys=["zbin"])
    return c.withColumn("edge_idx", F.col("edge_idx").cast("long"))


@query("j4_pair_count_symmetric", with_(ctes("galaxies", "randoms"), located("g", "galaxies"), located("r", "randoms")) + f"""
SELECT e AS edge_idx, count(*) AS n FROM g JOIN r ON abs(g.dec - r.dec) <= 0.51e0 AND floor(r.dec/0.51e0) BETWEEN floor(g.dec/0.51e0)-1 AND floor(g.dec/0.51e0)+1
 JOIN (VALUES {', '.join(f'({i}, {d(e)})' for i, e in enumerate(ABINS))}) t(e, th) ON (g.x-r.x)*(g.x-r.x)+(g.y-r.y)*(g.y-r.y)+(g.z-r.z)*(g.z-r.z)
 <= 4e0*sin(radians(th)/2e0)*sin(radians(th)/2e0) GROUP BY e""")
def _(spark, sf):
    c = pair_count(read(spark, sf, "galaxies"), read(spark, sf, "randoms"), ABINS, nside=NSIDE, convention="symmetric")
    return c.groupBy("edge_idx").agg(F.sum("n").alias("n"))


@query("a4_cumulative_pairs", with_(ctes("quasars", "galaxies"), located("q", "quasars"), located("g", "galaxies"), pairs_sky(NSIDE),
                                     counted("c", "q", "g")) +
       " SELECT edge_idx, cast(sum(n) AS bigint) AS n FROM c GROUP BY edge_idx")
def _(spark, sf):
    c = pair_count(read(spark, sf, "quasars"), read(spark, sf, "galaxies"), ABINS, nside=NSIDE)
    return c.groupBy(F.col("edge_idx").cast("long").alias("edge_idx")).agg(F.sum("n").alias("n"))


def _populations(spark, sf, rows, z=False):
    from skytally.operators.partition import split_by_z
    p = with_pixel(corr_points(spark, sf, rows), NSIDE)
    keys = ["corr_id", "catalog", "pix"]
    if z:
        p, keys = split_by_z(p, ZBINS), ["corr_id", "zbin", "catalog", "pix"]
    return p.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query("f7_good_pixels", with_(ctes("galaxies", "randoms", "quasars", "quasar_randoms"), *[
    pixed(a, b) for a, b in (("g", "galaxies"), ("r", "randoms"), ("q", "quasars"), ("s", "quasar_randoms"))]) + """
SELECT 0 AS corr_id, pix FROM (SELECT pix FROM g INTERSECT SELECT pix FROM r)
UNION ALL SELECT 1, pix FROM (SELECT pix FROM g INTERSECT SELECT pix FROM r INTERSECT SELECT pix FROM q INTERSECT SELECT pix FROM s)""")
def _(spark, sf):
    return good_pixels(_populations(spark, sf, BOTH), corr_table(spark, BOTH))


_PLAN_SQL = with_(ctes("galaxies", "randoms"), located("g", "galaxies", True), located("r", "randoms", True), pairs_sky(NSIDE)) + """,
good AS (SELECT DISTINCT pix FROM g WHERE pix IN (SELECT pix FROM r)),
pp AS (SELECT pix1, pix2 FROM pixpairs WHERE pix1 IN (FROM good) AND pix2 IN (FROM good)),
pop AS (SELECT 'D0' AS c, zbin, pix, count(*) AS n FROM g WHERE zbin IS NOT NULL GROUP BY ALL
 UNION ALL SELECT 'R0', zbin, pix, count(*) FROM r WHERE zbin IS NOT NULL GROUP BY ALL),
plan_ AS (SELECT t.term, a.zbin, pix1, pix2, a.n AS n1, b.n AS n2, a.n*b.n AS cost FROM pp,
 (VALUES ('D0D0','D0','D0'), ('D0R0','D0','R0'), ('R0R0','R0','R0')) t(term, f, s)
 JOIN pop a ON a.c = t.f AND a.pix = pix1 JOIN pop b ON b.c = t.s AND b.pix = pix2 AND b.zbin = a.zbin)"""


def _plan(spark, sf):
    corrs = corr_table(spark, AUTO)
    good = good_pixels(_populations(spark, sf, AUTO), corrs)
    return pair_plan(good_pairs(pixel_pairs(spark, NSIDE), good), _populations(spark, sf, AUTO, True), E.expand_terms(corrs))


@query("j6_pair_plan", _PLAN_SQL + " SELECT term, zbin, pix1, pix2, n1, n2, cost FROM plan_")
def _(spark, sf):
    return _plan(spark, sf).drop("corr_id")


@query("t1_by_cost", _PLAN_SQL + " SELECT row_number() OVER (ORDER BY cost DESC, term, zbin, pix1, pix2) - 1 AS rank, term, zbin, pix1, pix2, cost FROM plan_")
def _(spark, sf):
    return by_cost(_plan(spark, sf)).select("rank", "term", "zbin", "pix1", "pix2", "cost")


# ---------------------------------------------------------------- count tables

_GG = ",\n".join([ctes("galaxies"), located("g", "galaxies"), pairs_sky(NSIDE), counted("c", "g", "g")])
_GR = ",\n".join([ctes("galaxies", "randoms"), located("g", "galaxies"), located("r", "randoms"), pairs_sky(NSIDE),
                  counted("c", "g", "r"), counted("e", "r", "g")])


def _gr(spark, sf, a="galaxies", b="randoms"):
    return pair_count(read(spark, sf, a), read(spark, sf, b), ABINS, nside=NSIDE)


def _long(df):
    return df.withColumn("edge_idx", F.col("edge_idx").cast("long"))


@query("m1_add_counts", with_(_GR) + """
SELECT pix1, pix2, edge_idx, cast(sum(n) AS bigint) AS n FROM (FROM c UNION ALL FROM e) GROUP BY ALL""")
def _(spark, sf):
    return _long(M.add_counts(_gr(spark, sf), _gr(spark, sf, "randoms", "galaxies")))


@query("m2_assign_counts", with_(_GR) + """
SELECT pix1, pix2, edge_idx, coalesce(e.n, c.n) AS n FROM c FULL JOIN e USING (pix1, pix2, edge_idx)""")
def _(spark, sf):
    return _long(M.assign_counts(_gr(spark, sf), _gr(spark, sf, "randoms", "galaxies")))


_LOPSIDED = "(SELECT CASE WHEN (pix1+pix2) % 2 = 0 THEN pix2 ELSE pix1 END AS pix1, CASE WHEN (pix1+pix2) % 2 = 0 THEN pix1 ELSE pix2 END AS pix2, edge_idx, n FROM c UNION ALL FROM e)"


@query("m3_balance", with_(_GR) + f"""
SELECT least(pix1, pix2) AS pix1, greatest(pix1, pix2) AS pix2, edge_idx, cast(sum(n) AS bigint) AS n FROM {_LOPSIDED} GROUP BY ALL""")
def _(spark, sf):
    odd = (F.col("pix1") + F.col("pix2")) % 2 == 0
    c = _gr(spark, sf).select(F.when(odd, F.col("pix2")).otherwise(F.col("pix1")).alias("pix1"),
                              F.when(odd, F.col("pix1")).otherwise(F.col("pix2")).alias("pix2"), "edge_idx", "n")
    return _long(M.balance(c.unionByName(_gr(spark, sf, "randoms", "galaxies"))))


@query("m4_clear", with_(ctes("galaxies"), pixed("p", "galaxies")) +
       " SELECT 'before' AS stage, count(DISTINCT pix) AS n FROM p UNION ALL SELECT 'after', 0")
def _(spark, sf):
    c = with_pixel(read(spark, sf, "galaxies"), NSIDE).groupBy("pix").agg(F.count(F.lit(1)).alias("n"))
    return count_by_group(c, M.clear(c))


def _sides(spark, sf, a="galaxies", b="randoms"):
    side = lambda t, s: with_pixel(read(spark, sf, t), NSIDE).select(F.lit(s).alias("side"), "pix")
    return side(a, 1).unionByName(side(b, 2)).groupBy("side", "pix").agg(F.count(F.lit(1)).alias("n"))


def _crowded(spark, sf):
    """Pixels to leave out: those with the most galaxies."""
    c = with_pixel(read(spark, sf, "galaxies"), NSIDE).groupBy("pix").agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.desc("n"), "pix").limit(2)


_CUT = "cutp AS (SELECT pix FROM g GROUP BY pix ORDER BY count(*) DESC, pix LIMIT 2)"


@query("a3_population", with_(ctes("galaxies", "randoms"), pixed("g", "galaxies"), pixed("r", "randoms"), _CUT) + """
SELECT (SELECT count(*) FROM g WHERE pix NOT IN (FROM cutp)) AS pop1, (SELECT count(*) FROM r WHERE pix NOT IN (FROM cutp)) AS pop2""")
def _(spark, sf):
    return M.population(_sides(spark, sf), cut=_crowded(spark, sf))


@query("m5_pair_signal", with_(_GR, _CUT) + """,
s AS (SELECT edge_idx, cast(sum(n) AS bigint) AS n FROM c WHERE pix1 NOT IN (FROM cutp) AND pix2 NOT IN (FROM cutp) GROUP BY edge_idx),
l AS (SELECT edge_idx - 1 AS bin_idx, n - lag(n) OVER (ORDER BY edge_idx) AS pairs FROM s)
SELECT bin_idx, pairs, round(1e6*pairs/((SELECT count(*) FROM g WHERE pix NOT IN (FROM cutp))*cast((SELECT count(*) FROM r WHERE pix NOT IN (FROM cutp)) AS double)), 6) AS signal
FROM l WHERE pairs IS NOT NULL""")
def _(spark, sf):
    s = M.pair_signal(_gr(spark, sf), _sides(spark, sf), cut=_crowded(spark, sf))
    return s.select(F.col("bin_idx").cast("long").alias("bin_idx"), "pairs", F.round(F.col("signal") * 1e6, 6).alias("signal"))


@query("m6_pixel_share", with_(ctes("galaxies", "randoms"), pixed("g", "galaxies"), pixed("r", "randoms")) + """
SELECT 1 AS side, pix, round(count(*)/sum(count(*)) OVER (), 6) AS share FROM g GROUP BY pix
UNION ALL SELECT 2, pix, round(count(*)/sum(count(*)) OVER (), 6) FROM r GROUP BY pix""")
def _(spark, sf):
    return M.pixel_share(_sides(spark, sf)).select("side", "pix", F.round("share", 6).alias("share"))


@query("m7_dense_and_back", """
SELECT b AS x, cast(s AS int) AS y, n AS z FROM (SELECT p_brand AS b, p_size % 5 AS s, count(*) AS n FROM part GROUP BY ALL)""")
def _(spark, sf):
    coo = spark.read.parquet(f"{sf}/part.parquet").groupBy(F.col("p_brand").alias("x"), (F.col("p_size") % 5).alias("y")).agg(F.count(F.lit(1)).alias("z"))
    return M.to_coo(M.to_dense(coo, range(5)), "x", range(5))


@query("t2_top_pixels", with_(ctes("galaxies", "randoms"), pixed("g", "galaxies"), pixed("r", "randoms")) + """,
a AS (SELECT pix, count(*)/cast((SELECT count(*) FROM g) AS double) AS s FROM g GROUP BY pix), b AS (SELECT pix, count(*)/cast((SELECT count(*) FROM r) AS double) AS s FROM r GROUP BY pix)
SELECT pix, round(share, 6) AS share FROM (SELECT pix, (coalesce(a.s, 0e0)+coalesce(b.s, 0e0))/2e0 AS share FROM a FULL JOIN b USING (pix)) ORDER BY share DESC, pix DESC LIMIT """ + str(REGIONS))
def _(spark, sf):
    t = top_pixels(M.mean_share(_sides(spark, sf)), REGIONS)
    return t.select("pix", F.round("share", 6).alias("share"))


# ---------------------------------------------------------------- estimators

_SUM = """{n}_s AS (SELECT {k} edge_idx - 1 AS bin_idx, n - lag(n) OVER ({p} ORDER BY edge_idx) AS pairs
 FROM (SELECT {k} edge_idx, cast(sum(n) AS bigint) AS n FROM {n} GROUP BY ALL))"""


def _diffs(*names, keys=""):
    k = f"{keys}, " if keys else ""
    p = f"PARTITION BY {keys}" if keys else ""
    return ",\n".join(_SUM.format(n=n, k=k, p=p) for n in names)


@query("e1_landy_szalay_auto", with_(auto_ctes(), _diffs("dd", "dr", "rr")) + f""",
ng AS (SELECT cast(count(*) AS double) AS n FROM g), nr AS (SELECT cast(count(*) AS double) AS n FROM r),
ed AS (SELECT * FROM (VALUES {', '.join(f'({i}, {d(a)}, {d(b)})' for i, (a, b) in enumerate(zip(ABINS, ABINS[1:])))}) t(bin_idx, theta_lo, theta_hi))
SELECT bin_idx, theta_lo, theta_hi, dd_s.pairs AS dd, dr_s.pairs AS dr, rr_s.pairs AS rr,
 round((dd_s.pairs/(ng.n*ng.n) - 2e0*dr_s.pairs/(ng.n*nr.n) + rr_s.pairs/(nr.n*nr.n))/(rr_s.pairs/(nr.n*nr.n)), 6) AS w
FROM dd_s JOIN dr_s USING (bin_idx) JOIN rr_s USING (bin_idx) JOIN ed USING (bin_idx), ng, nr""")
def auto_signal(spark, sf):
    c = C.count_correlations(corr_points(spark, sf, AUTO), corr_table(spark, AUTO), ABINS, None, NSIDE)
    s = C.term_signals(c)
    terms = (("D0D0", "dd"), ("D0R0", "dr"), ("R0R0", "rr"))
    pick = lambda t, col, name: F.max(F.when(F.col("term") == t, F.col(col))).alias(name)
    p = s.groupBy("bin_idx").agg(*[pick(t, "pairs", n) for t, n in terms], *[pick(t, "signal", "s" + n) for t, n in terms])
    edge = lambda k: F.element_at(F.array(*[F.lit(e) for e in ABINS]), F.col("bin_idx") + k)
    w = E.landy_szalay_auto(F.col("sdd"), F.col("sdr"), F.col("srr"))
    return p.select("bin_idx", edge(1).alias("theta_lo"), edge(2).alias("theta_hi"), "dd", "dr", "rr", F.round(w, 6).alias("w"))


@query("e2_landy_szalay_cross", with_(cross_ctes(True), _diffs("dd", "dr", "rd", "rr", keys="zbin")) + """,
n AS (SELECT zbin, cast((SELECT count(*) FROM q WHERE q.zbin = z.zbin) AS double) AS d1, cast((SELECT count(*) FROM g WHERE g.zbin = z.zbin) AS double) AS d2,
 cast((SELECT count(*) FROM s WHERE s.zbin = z.zbin) AS double) AS r1, cast((SELECT count(*) FROM r WHERE r.zbin = z.zbin) AS double) AS r2 FROM range(4) z(zbin)),
w AS (SELECT zbin, bin_idx, rr_s.pairs/(r1*r2) AS rr, coalesce(dd_s.pairs, 0)/(d1*d2) AS dd, coalesce(dr_s.pairs, 0)/(d1*r2) AS dr, coalesce(rd_s.pairs, 0)/(d2*r1) AS rd
 FROM rr_s LEFT JOIN dd_s USING (zbin, bin_idx) LEFT JOIN dr_s USING (zbin, bin_idx) LEFT JOIN rd_s USING (zbin, bin_idx) JOIN n USING (zbin))
SELECT cast(zbin AS int) AS zbin, bin_idx, round(CASE WHEN rr = 0 THEN NULL ELSE (dd - dr - rd + rr)/rr END, 6) AS w FROM w WHERE rr IS NOT NULL""")
def _(spark, sf):
    rows = [r for r in BOTH if r[1] == "cross"]
    c = C.count_correlations(corr_points(spark, sf, rows), corr_table(spark, rows), ABINS, ZBINS, NSIDE)
    w = C.simple_correlation(C.term_signals(c), c.terms, ["corr_id", "zbin"])
    return w.select("zbin", F.col("bin_idx").cast("long").alias("bin_idx"), F.round("w", 6).alias("w"))


def regions_sql(num, key="zbin"):
    """Recursive CTE ``regions`` (key, pix, region) from ``share`` (key, pix, share)."""
    return f"""sd AS (SELECT {key}, pix, share, cast(row_number() OVER (PARTITION BY {key} ORDER BY share DESC, pix DESC) AS int) AS r FROM share),
rest AS (SELECT {key}, pix, share, cast(row_number() OVER (PARTITION BY {key} ORDER BY share, pix) AS int) AS j FROM sd WHERE r > {num}),
st AS (SELECT {key}, 0 AS j, list(share ORDER BY r) AS a, 0 AS k FROM sd WHERE r <= {num} GROUP BY {key}
 UNION ALL SELECT st.{key}, st.j + 1, list_transform(st.a, lambda v, i: CASE WHEN i = list_position(st.a, list_min(st.a)) THEN v + rest.share ELSE v END),
  cast(list_position(st.a, list_min(st.a)) AS int) FROM st JOIN rest ON rest.{key} = st.{key} AND rest.j = st.j + 1),
regions AS (SELECT {key}, pix, r - 1 AS region FROM sd WHERE r <= {num}
 UNION ALL SELECT rest.{key}, rest.pix, st.k - 1 FROM rest JOIN st ON st.{key} = rest.{key} AND st.j = rest.j AND st.j > 0)"""


_RSHARE = "share AS (SELECT zbin, pix, count(*)/cast(sum(count(*)) OVER (PARTITION BY zbin) AS double) AS share FROM r WHERE zbin IS NOT NULL GROUP BY zbin, pix)"


@query("e3_jackknife_regions", with_(ctes("randoms"), located("r", "randoms", True), _RSHARE, regions_sql(REGIONS)).replace("WITH ", "WITH RECURSIVE ", 1) +
       " SELECT zbin, pix, region FROM regions")
def _(spark, sf):
    from skytally.operators.partition import split_by_z
    r = with_pixel(split_by_z(read(spark, sf, "randoms"), ZBINS), NSIDE).groupBy("zbin", "pix").agg(F.count(F.lit(1)).alias("n"))
    both = r.select("zbin", "pix", "n", F.explode(F.array(F.lit(1), F.lit(2))).alias("side"))
    return E.jackknife_regions(M.mean_share(both, ["zbin"]), REGIONS, ["zbin"]).select("zbin", "pix", "region")


def _loo(term, a, b):
    """Signals of one term with each region left out (k) and whole (k = -1)."""
    return f"""{term}_k AS (SELECT zbin, k, edge_idx - 1 AS bin_idx, (n - lag(n) OVER (PARTITION BY zbin, k ORDER BY edge_idx)) /
  (cast((SELECT count(*) FROM {a} a LEFT JOIN regions x ON x.zbin = a.zbin AND x.pix = a.pix WHERE a.zbin = t.zbin AND (x.region IS NULL OR x.region <> k)) AS double)
   * (SELECT count(*) FROM {b} b LEFT JOIN regions x ON x.zbin = b.zbin AND x.pix = b.pix WHERE b.zbin = t.zbin AND (x.region IS NULL OR x.region <> k))) AS s
 FROM (SELECT c.zbin, k, edge_idx, sum(CASE WHEN coalesce(u.region, -2) <> k AND coalesce(v.region, -2) <> k THEN n ELSE 0 END) AS n
  FROM {term} c LEFT JOIN regions u ON u.zbin = c.zbin AND u.pix = c.pix1 LEFT JOIN regions v ON v.zbin = c.zbin AND v.pix = c.pix2, ks GROUP BY ALL) t)"""


_ESTIMATED = """SELECT zbin, cast(bin_idx AS bigint) AS bin_idx, round(any_value(w0), 5) AS w,
 round(sqrt(sum(rr/rr0*(w-w0)*(w-w0))), 5) AS err, round(avg(w), 5) AS w_mean, round(stddev_pop(w), 5) AS w_std
FROM (SELECT zbin, bin_idx, w AS w0, rr AS rr0 FROM wk WHERE k = -1) JOIN (SELECT zbin, bin_idx, w, rr FROM wk WHERE k >= 0) USING (zbin, bin_idx) GROUP BY zbin, bin_idx"""

_KS = f"ks AS (SELECT cast(k - 1 AS int) AS k FROM range({REGIONS + 1}) t(k))"


def _recursive(sql):
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


_WK_AUTO = """,
wk AS (SELECT r.zbin, r.k, r.bin_idx, (coalesce(dd_k.s, 0e0) - 2e0*coalesce(dr_k.s, 0e0) + r.s)/r.s AS w, r.s AS rr FROM rr_k r LEFT JOIN dd_k USING (zbin, k, bin_idx)
 LEFT JOIN dr_k USING (zbin, k, bin_idx) WHERE r.s > 0)
"""
_WK_CROSS = """,
wk AS (SELECT r.zbin, r.k, r.bin_idx, (coalesce(dd_k.s, 0e0) - coalesce(dr_k.s, 0e0) - coalesce(rd_k.s, 0e0) + r.s)/r.s AS w, r.s AS rr FROM rr_k r LEFT JOIN dd_k USING (zbin, k, bin_idx)
 LEFT JOIN dr_k USING (zbin, k, bin_idx) LEFT JOIN rd_k USING (zbin, k, bin_idx) WHERE r.s > 0)
"""
_SRSHARE = """sh AS (SELECT zbin, pix, count(*)/cast(sum(count(*)) OVER (PARTITION BY zbin) AS double) AS v FROM s WHERE zbin IS NOT NULL GROUP BY zbin, pix
 UNION ALL SELECT zbin, pix, count(*)/cast(sum(count(*)) OVER (PARTITION BY zbin) AS double) FROM r WHERE zbin IS NOT NULL GROUP BY zbin, pix),
share AS (SELECT zbin, pix, sum(v)/2e0 AS share FROM sh GROUP BY zbin, pix)"""


def _auto_jackknife(z):
    return _recursive(with_(auto_ctes(z, True), _RSHARE, regions_sql(REGIONS), _KS, _loo("dd", "g", "g"), _loo("dr", "g", "r"), _loo("rr", "r", "r"))) + _WK_AUTO + _ESTIMATED


def _cross_jackknife(whole=()):
    return _recursive(with_(cross_ctes(True, whole), _SRSHARE, regions_sql(REGIONS), _KS, _loo("dd", "q", "g"), _loo("dr", "q", "r"),
                            _loo("rd", "g", "s"), _loo("rr", "s", "r"))) + _WK_CROSS + _ESTIMATED


def _estimates(w, *ids):
    return w.where("w is not null").select(*ids, "zbin", F.col("bin_idx").cast("long").alias("bin_idx"),
                                           *[F.round(c, 5).alias(c) for c in ("w", "err", "w_mean", "w_std")])


@query("e4_e5_jackknife_auto", _auto_jackknife(True))
def _(spark, sf):
    return _estimates(C.correlation_function(corr_points(spark, sf, AUTO), corr_table(spark, AUTO), ABINS, ZBINS, NSIDE, REGIONS))


CROSS = [r for r in BOTH if r[1] == "cross"]


@query("e4_e5_jackknife_cross", _cross_jackknife())
def _(spark, sf):
    return _estimates(C.correlation_function(corr_points(spark, sf, CROSS), corr_table(spark, CROSS), ABINS, ZBINS, NSIDE, REGIONS))


# one correlation that is not split by redshift, and one whose first random catalog has no redshift
FLAGGED = [(0, "auto", "galaxies", False), (1, "cross", "quasars with galaxies", True)]


@query("e6_correlation_function", f"SELECT 0 AS corr_id, * FROM ({_auto_jackknife(False)}) UNION ALL SELECT 1, * FROM ({_cross_jackknife(('s',))})")
def _(spark, sf):
    points = corr_points(spark, sf, FLAGGED).withColumn("redshift", F.when(F.col("catalog") != "R1", F.col("redshift")))
    return _estimates(C.correlation_function(points, corr_table(spark, FLAGGED), ABINS, ZBINS, NSIDE, REGIONS), "corr_id")


_PARTS = _auto_jackknife(True).replace("round(any_value(w0), 5)", "any_value(w0)").replace("rr/rr0*(w-w0)*(w-w0))), 5)", "rr/rr0*(w-w0)*(w-w0))), 12)")


@query("s10_correlation_summary", f"""SELECT 0 AS corr_id, zbin, 'galaxies | z [' || printf('%.2f', z0) || ', ' || printf('%.2f', z1) || ') | D0=' || d0 || ' R0=' || r0 || ' | ' || t AS text
FROM (SELECT zbin, string_agg(printf('%.3f+-%.3f', w, err), ' ' ORDER BY bin_idx) AS t FROM ({_PARTS}) GROUP BY zbin)
JOIN (VALUES {', '.join(f'({i}, {a}, {b})' for i, (a, b) in enumerate(zip(ZBINS, ZBINS[1:])))}) e(zbin, z0, z1) USING (zbin)
JOIN ({with_(ctes('galaxies'))} SELECT {Z_CASE} AS zbin, count(*) AS d0 FROM galaxies GROUP BY 1) USING (zbin)
JOIN ({with_(ctes('randoms'))} SELECT {Z_CASE} AS zbin, count(*) AS r0 FROM randoms GROUP BY 1) USING (zbin)""")
def _(spark, sf):
    corrs = corr_table(spark, AUTO)
    c = C.count_correlations(corr_points(spark, sf, AUTO), corrs, ABINS, ZBINS, NSIDE)
    c.counts = cut(c.counts)
    rr = c.populations.where("catalog = 'R0'").select(
        "corr_id", "zbin", "pix", "n", F.explode(F.array(F.lit(1), F.lit(2))).alias("side"))
    parts = E.jackknife_regions(M.mean_share(rr, ["corr_id", "zbin"]), REGIONS, ["corr_id", "zbin"])
    sig = E.jackknife(E.leave_one_out(c.counts, c.populations, c.terms, parts, REGIONS, ["corr_id", "zbin"], c.edges), c.terms, ["corr_id", "zbin"])
    return C.correlation_summary(sig, c.populations, corrs, ZBINS)

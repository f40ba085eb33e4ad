"""Sources, matches, curves, theory tables, fits and figure tables."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from skytally.functions.cosmology import LIGHT_KM_S, Cosmology
from skytally.lineage import cut, shared_folder
from skytally.operators import counts as M
from skytally.operators import curves as CV
from skytally.operators import estimators as E
from skytally.operators import histograms as H
from skytally.operators import masks as K
from skytally.operators import model as B
from skytally.operators.match import cross_match, match_by_id, match_histogram_edges
from skytally.plans import figures as G
from skytally.plans.bias import corr_bias
from skytally.plans.correlation import with_angle
from skytally.sources import catalog as S
from skytally.sources import runs as R
from skytally.sources import spec as SP

from .base import ABINS, NSIDE, PI, ZBINS, ctes, d, pixed, query, read, with_, xyzed
from .scalar_checks import POWER_SQL, Z_CASE, _DIST, power_table
from .sky_checks import _BEST, _GAL_OK, _LOW, BAD, PATCH, SPOTS


def _new_path(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


# ---------------------------------------------------------------- sources and runs


@query("s1_read_catalog", "SELECT l_orderkey, l_quantity AS ra, l_tax AS dec, l_discount AS redshift FROM lineitem")
def _(spark, sf):
    return S.read_catalog(spark, f"{sf}/lineitem.parquet", "l_quantity", "l_tax", "l_discount", extra=("l_orderkey",))


@query("s2_flatten_schema", "SELECT vec_id, label FROM embeddings")
def _(spark, sf):
    return S.flatten_schema(spark.read.parquet(f"{sf}/embeddings.parquet"))


@query("s3_append_indexed", """
SELECT 'first' AS part, count(*) AS n, 0 AS lo, count(*) - 1 AS hi, count(*) AS different FROM orders
UNION ALL SELECT 'second', count(*), (SELECT count(*) FROM orders), (SELECT count(*) FROM orders) + count(*) - 1, count(*) FROM customer""")
def _(spark, sf):
    path = _new_path(spark)
    pos = lambda t, k, name: spark.read.parquet(f"{sf}/{t}.parquet").select(F.lit(name).alias("part"), F.col(k).alias("id"))
    S.append_indexed(pos("orders", "o_orderkey", "first").repartition(5, "id"), path)
    S.append_indexed(pos("customer", "c_custkey", "second"), path)
    return spark.read.parquet(path).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("lo"), F.max("row_idx").alias("hi"),
        F.count_distinct("row_idx").alias("different"))


@query("s4_copy_columns", with_(ctes("randoms")) + " SELECT round(ra, 6) AS ra, round(dec, 6) AS dec FROM randoms")
def _(spark, sf):
    path = _new_path(spark)
    S.copy_columns(read(spark, sf, "randoms"), path)
    return spark.read.parquet(path).select(F.round("ra", 6).alias("ra"), F.round("dec", 6).alias("dec"))


@query("s5_row_count", "SELECT count(*) AS n FROM lineitem")
def _(spark, sf):
    n = S.row_count(spark, f"{sf}/lineitem.parquet")
    return spark.read.parquet(f"{sf}/lineitem.parquet").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n)


@query("s6_expand_terms", """
SELECT s_suppkey AS corr_id, t[1] AS term, t[2] AS first, t[3] AS second FROM (SELECT s_suppkey, unnest(CASE WHEN s_nationkey % 2 = 0
 THEN [['D0D0','D0','D0'],['D0R0','D0','R0'],['R0R0','R0','R0']]
 ELSE [['D1D2','D1','D2'],['D1R2','D1','R2'],['D2R1','D2','R1'],['R1R2','R1','R2']] END) AS t FROM supplier)""")
def _(spark, sf):
    c = spark.read.parquet(f"{sf}/supplier.parquet").select(
        F.col("s_suppkey").alias("corr_id"), F.when(F.col("s_nationkey") % 2 == 0, "auto").otherwise("cross").alias("type"))
    return E.expand_terms(c).drop("role")


@query("s7_merge_meta", """
WITH old AS (SELECT c_mktsegment AS catalog, c_nationkey AS pix, count(*) AS n FROM customer GROUP BY 1, 2),
new AS (SELECT CASE WHEN c_nationkey < 12 THEN c_mktsegment ELSE 'C' || c_nationkey END AS catalog, c_nationkey AS pix, count(*) AS n
 FROM customer WHERE c_acctbal > 0 GROUP BY 1, 2)
FROM old UNION ALL FROM new WHERE catalog NOT IN (SELECT catalog FROM old)""")
def _(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").withColumn("pix", F.col("c_nationkey"))
    pop = lambda df: df.groupBy("catalog", "pix").agg(F.count(F.lit(1)).alias("n"))
    named = F.when(F.col("c_nationkey") < 12, F.col("c_mktsegment")).otherwise(F.concat(F.lit("C"), F.col("c_nationkey").cast("string")))
    new = c.where("c_acctbal > 0").withColumn("catalog", named)
    return SP.merge_meta(pop(c.withColumn("catalog", F.col("c_mktsegment"))), pop(new))


@query("s8_save_load_run", "SELECT o_orderpriority, count(*) AS n, 1 AS run_id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def _(spark, sf):
    path = _new_path(spark)
    o = spark.read.parquet(f"{sf}/orders.parquet")
    for status in ("O", "F", "P"):
        R.save_run(o.where(F.col("o_orderstatus") == status).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")), path)
    return R.load_run(spark, path, -2)


@query("t4_nth_latest_run", """
SELECT run_id, event_type, n FROM (SELECT user_id AS run_id, event_type, count(*) AS n, dense_rank() OVER (ORDER BY user_id DESC) AS r FROM events GROUP BY 1, 2) WHERE r = 3""")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.col("user_id").alias("run_id"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return R.pick_run(e, -3)


@query("s9_save_load_counts", with_(ctes("galaxies"), pixed("p", "galaxies")) + f"""
SELECT 0 AS corr_id, zbin, 'D0D0' AS term, pix, n FROM (SELECT {Z_CASE} AS zbin, pix, count(*) AS n FROM p GROUP BY ALL) WHERE zbin = 2""")
def _(spark, sf):
    path = _new_path(spark)
    from skytally.operators.partition import split_by_pixel, split_by_z
    g = split_by_pixel(split_by_z(read(spark, sf, "galaxies"), ZBINS), NSIDE)
    c = g.groupBy("zbin", "pix").agg(F.count(F.lit(1)).alias("n")).withColumns({"corr_id": F.lit(0), "term": F.lit("D0D0")})
    R.save_counts(c, path)
    return R.load_counts(spark, path, corr_id=0, zbin=2, term="D0D0")


# pixels of the galaxies as stored counts; those of the quasars are added where both have a term, bin 1 is then assigned anew
@query("s9_update_counts", with_(ctes("galaxies", "quasars"), pixed("g", "galaxies"), pixed("q", "quasars")) + f""",
gc AS (SELECT {Z_CASE} AS zbin, pix, count(*) AS n FROM g GROUP BY ALL), qc AS (SELECT {Z_CASE} AS zbin, pix, count(*) AS n FROM q GROUP BY ALL)
SELECT zbin, pix AS pix1, CASE WHEN zbin = 1 THEN coalesce(qc.n, gc.n) ELSE coalesce(gc.n, 0) + coalesce(qc.n, 0) END AS n
FROM gc FULL JOIN qc USING (zbin, pix) WHERE zbin < 4 AND zbin IS NOT NULL""")
def _(spark, sf):
    path = _new_path(spark)
    from skytally.operators.partition import split_by_pixel, split_by_z

    def counted_in(name):
        t = split_by_pixel(split_by_z(read(spark, sf, name), ZBINS), NSIDE)
        c = t.groupBy("zbin", F.col("pix").alias("pix1")).agg(F.count(F.lit(1)).alias("n"))
        return c.withColumns({"corr_id": F.lit(0), "term": F.lit("D0D0"), "pix2": F.col("pix1"), "edge_idx": F.lit(0)})

    R.save_counts(counted_in("galaxies").select(*R.PARTS, *R.CELL, "n"), path)
    more = cut(counted_in("quasars"))
    R.update_counts(more.where("zbin <> 1"), path)
    R.update_counts(more.where("zbin = 1"), path, "assign")
    return R.load_counts(spark, path, corr_id=0, term="D0D0").select("zbin", "pix1", "n")


# ---------------------------------------------------------------- matches

def _matched(left, right, arcsec):
    lim = 2 * math.sin(math.radians(arcsec / 3600 / 2))
    cell = arcsec / 3600 * 1.01
    return f"""{xyzed('l', left)}, {xyzed('rt', right)},
lc AS (SELECT l.*, cast(floor(dec/{d(cell)}) AS bigint) + o AS cell FROM l, (VALUES (-1), (0), (1)) v(o)),
rc AS (SELECT *, cast(floor(dec/{d(cell)}) AS bigint) AS cell FROM rt),
cand AS (SELECT lc.id AS lid, rc.id AS rid, (lc.x-rc.x)*(lc.x-rc.x)+(lc.y-rc.y)*(lc.y-rc.y)+(lc.z-rc.z)*(lc.z-rc.z) AS d2 FROM lc JOIN rc USING (cell)),
best AS (SELECT lid, rid, d2 FROM (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY d2, rid) AS r FROM cand WHERE d2 < {d(lim * lim)}) WHERE r = 1)"""


@query("j1_cross_match", with_(ctes("quasars", "moved"), _matched("quasars", "moved", 200)) + """
SELECT q.id, rid AS id_join, round(m.mag, 2) AS mag_join, coalesce(m.bright, false) AS bright_join, round(sqrt(d2)*1e4, 5) AS dist
FROM quasars q LEFT JOIN best ON lid = q.id LEFT JOIN moved m ON m.id = rid""")
def _(spark, sf):
    j = cross_match(read(spark, sf, "quasars"), read(spark, sf, "moved"), 200.0, distance="dist")
    return j.select("id", "id_join", F.round("mag_join", 2).alias("mag_join"), "bright_join", F.round(F.col("dist") * 1e4, 5).alias("dist"))


@query("j2_match_distances", with_(ctes("galaxies", "moved"), _matched("galaxies", "moved", 2)) + f"""
SELECT cast(least(floor(sqrt(d2)/{d(0.0002424 / 2 / 499)}), 498) AS int) AS bin_idx, count(*) AS n FROM best GROUP BY 1""")
def _(spark, sf):
    j = cross_match(read(spark, sf, "galaxies"), read(spark, sf, "moved"), 2.0, distance="dist")
    top = match_histogram_edges()[-1]
    return H.hist1d(j, "dist", 0.0, top, 499).select("bin_idx", "n")


# ---------------------------------------------------------------- curves

_CAT = """cat AS (SELECT galaxies.*, pdz FROM galaxies JOIN curves ON object_id = id WHERE NOT isnan(pdz[1]))"""
_FLAT = """fl AS (SELECT id, redshift, unnest(range(64)) AS i, cast(unnest(pdz) AS double) AS v FROM cat),
ar AS (SELECT id, (sum(abs(v)) - (max(CASE WHEN i = 0 THEN abs(v) END) + max(CASE WHEN i = 63 THEN abs(v) END))/2e0)*0.05e0 AS area FROM fl GROUP BY id)"""


def _cat(spark, sf):
    curves = read(spark, sf, "curves").withColumn("pdz", F.transform("pdz", lambda v: F.abs(v)))
    g = read(spark, sf, "galaxies").withColumn("object_id", F.col("id"))
    return match_by_id(g, curves)


@query("a9_gauss_sum", with_(ctes("quasars")) + f""", q AS (SELECT *, {_BEST} FROM quasars)
SELECT cast(i AS int) AS i, round(sum(exp(-((4e0*i/499-zb)*(4e0*i/499-zb))/(2e0*zs*zs))/(zs*sqrt(2e0*{PI}))), 4) AS y FROM q, range(500) t(i) GROUP BY i""")
def _(spark, sf):
    q = G.with_best_redshift(read(spark, sf, "quasars"))
    return CV.gauss_sum(q, "z", "z_sigma").select("i", F.round("y", 4).alias("y"))


@query("a10_stack_pdz", with_(ctes("galaxies", "curves"), _CAT, _FLAT) + """
SELECT cast(i AS int) AS i, round(sum(abs(v)/area), 5) AS y FROM fl JOIN ar USING (id) GROUP BY i""")
def _(spark, sf):
    return CV.stack_pdz(_cat(spark, sf), "pdz", 0.05).select("i", F.round("y", 5).alias("y"))


# per label, the mean curve of the vectors on an even grid
_LABEL = "lab AS (SELECT label, 0.05e0*i AS x, avg(abs(v)) AS y FROM (SELECT label, unnest(range(64)) AS i, cast(unnest(pdz) AS double) AS v FROM curves) GROUP BY label, i)"


def _label_curves(spark, sf):
    c = read(spark, sf, "curves").select("label", F.posexplode("pdz").alias("i", "v"))
    return c.groupBy("label", "i").agg(F.avg(F.abs(F.col("v").cast("double"))).alias("y")).select(
        "label", (F.lit(0.05) * F.col("i")).alias("x"), "y")


@query("a11_normalize_curve", with_(ctes("curves"), _LABEL) + """,
s AS (SELECT label, (x-lag(x) OVER w)*(y+lag(y) OVER w)/2e0 AS a FROM lab WINDOW w AS (PARTITION BY label ORDER BY x)),
t AS (SELECT label, sum(a) AS area FROM s GROUP BY label)
SELECT label, round(x, 4) AS x, round(y/area, 6) AS y FROM lab JOIN t USING (label)""")
def _(spark, sf):
    return CV.normalize_curve(_label_curves(spark, sf), ["label"]).select("label", F.round("x", 4).alias("x"), F.round("y", 6).alias("y"))


@query("a12_weighted_mean_std", """SELECT l_returnflag, round(m, 3) AS mean, round(sqrt(q - m*m), 3) AS std FROM
(SELECT l_returnflag, sum(l_quantity*l_discount)/sum(l_quantity) AS m, sum(l_quantity*l_discount*l_discount)/sum(l_quantity) AS q FROM lineitem GROUP BY 1)""")
def _(spark, sf):
    m = E.weighted_mean_std(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_returnflag"], "l_discount", "l_quantity")
    return m.select("l_returnflag", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"))


@query("w2_w3_edge_difference", """
SELECT event_type, cast(b AS bigint) AS bin_idx, n AS pairs FROM (SELECT event_type, cast(floor(value/20e0) AS int) - 1 AS b, count(*) AS n,
 row_number() OVER (PARTITION BY event_type ORDER BY floor(value/20e0)) AS r FROM events GROUP BY 1, floor(value/20e0)) WHERE r > 1""")
def _(spark, sf):
    from pyspark.sql import Window as W
    e = spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type", F.floor(F.col("value") / 20.0).cast("long").alias("edge_idx")).agg(F.count(F.lit(1)).alias("c"))
    run = F.sum("c").over(W.partitionBy("event_type").orderBy("edge_idx").rowsBetween(W.unboundedPreceding, 0))
    return M.difference_edges(e.select("event_type", "edge_idx", run.alias("n")), ["event_type"])


# ---------------------------------------------------------------- signals as tables

# measured values per correlation, redshift bin and angle, from whole catalogs
_SIG = f"""sig AS (SELECT 0 AS corr_id, {Z_CASE} AS zbin, cast(floor(extendedness*8e0) AS int) AS bin_idx, 0.05e0*(1e0+floor(extendedness*8e0)) AS theta,
 avg(imag)/20e0 AS w, 0.02e0+avg(abs(z_std)) AS err FROM galaxies WHERE {Z_CASE} IS NOT NULL GROUP BY ALL
UNION ALL SELECT 1, {Z_CASE}, cast(floor(p_t1*8e0) AS int), 0.05e0*(1e0+floor(p_t1*8e0)), avg(gmag)/20e0, 0.02e0+avg(conf)*0.1e0
 FROM quasars WHERE {Z_CASE} IS NOT NULL GROUP BY ALL)"""
_SIG_FROM = with_(ctes("galaxies", "quasars"), _SIG)
CORRS = [(0, "auto", 0), (1, "cross", 0)]


def _sig(spark, sf):
    def one(corr, t, by, w, err):
        g = read(spark, sf, t).selectExpr(f"{corr} as corr_id", f"{Z_CASE} as zbin", f"cast(floor({by}*8e0) as int) as bin_idx", *[w, err])
        names = [w.split(" as ")[1], err.split(" as ")[1]]
        return g.where("zbin is not null").groupBy("corr_id", "zbin", "bin_idx").agg(*[F.avg(n).alias(n) for n in names])
    a = one(0, "galaxies", "extendedness", "imag as a", "abs(z_std) as b")
    b = one(1, "quasars", "p_t1", "gmag as a", "conf*0.1e0 as b")
    return a.unionByName(b).select(
        "corr_id", "zbin", "bin_idx", (F.lit(0.05) * (F.lit(1.0) + F.col("bin_idx"))).alias("theta"),
        (F.col("a") / 20.0).alias("w"), (F.lit(0.02) + F.col("b")).alias("err"))


def _corrs(spark):
    return spark.createDataFrame(CORRS, "corr_id int, type string, auto_id int")


@query("f13_fit_range", _SIG_FROM + """ SELECT corr_id, zbin, bin_idx, round(w - 1e0, 6) AS w, round(CASE WHEN bin_idx = 4 THEN 1e0 ELSE err END, 6) AS err
FROM sig WHERE bin_idx >= 3 AND w > 1e0""")
def _(spark, sf):
    s = _sig(spark, sf).withColumns({"w": F.col("w") - 1.0, "err": F.when(F.col("bin_idx") == 4, F.lit(0.0)).otherwise(F.col("err"))})
    return E.positive_points(E.fit_range(s, 3)).select("corr_id", "zbin", "bin_idx", F.round("w", 6).alias("w"), F.round("err", 6).alias("err"))


def _fit_sql(w):
    """Least squares over exponents from -8 to 6 in steps of 0.05, refined twice round the best."""
    at = lambda k: (f"sum({w}/(err*err)*power(theta, {k})) AS sxy, sum(power(theta, {k})*power(theta, {k})/(err*err)) AS sxx, sum({w}*{w}/(err*err)) AS syy")
    step = [0.05, 0.05 * 2 / 80, 0.05 * 4 / 6400]
    out = f"""g0 AS (SELECT corr_id, zbin, -8e0+0.05e0*i AS k, {at("-8e0+0.05e0*i")} FROM sig, range(281) t(i) GROUP BY ALL),
b0 AS (SELECT corr_id, zbin, arg_min(k, syy - sxy*sxy/sxx) AS k0 FROM g0 GROUP BY ALL)"""
    for n in (1, 2):
        k = f"k0 - {d(step[n - 1])} + {d(step[n])}*i"
        out += f""",
g{n} AS (SELECT corr_id, zbin, {k} AS k, {at(k)} FROM sig JOIN b{n - 1} USING (corr_id, zbin), range(81) t(i) GROUP BY corr_id, zbin, k0, i),
b{n} AS (SELECT corr_id, zbin, arg_min(k, syy - sxy*sxy/sxx) AS k0 FROM g{n} GROUP BY ALL)"""
    return _SIG_FROM + f""", {out}
SELECT corr_id, zbin, round(arg_min(sxy/sxx, syy - sxy*sxy/sxx), 3) AS a, round(arg_min(k, syy - sxy*sxy/sxx), 3) AS k FROM g2 GROUP BY ALL"""


def _fitted(signals):
    return E.fit_power_law(signals, ["corr_id", "zbin"]).select("corr_id", "zbin", F.round("a", 3).alias("a"), F.round("k", 3).alias("k"))


@query("e7_fit_power_law", _fit_sql("w"))
def _(spark, sf):
    return _fitted(_sig(spark, sf))


@query("e7_fit_steep_power_law", _fit_sql("(w*power(theta, CASE WHEN corr_id = 0 THEN -3.2e0 ELSE 2.7e0 END))"))
def _(spark, sf):
    bent = F.pow("theta", F.when(F.col("corr_id") == 0, F.lit(-3.2)).otherwise(F.lit(2.7)))
    return _fitted(_sig(spark, sf).withColumn("w", F.col("w") * bent))


_WIDE = [0.01 * 1.7 ** i for i in range(9)]


@query("x12_with_angle", _SIG_FROM + " SELECT corr_id, zbin, bin_idx, round(" + "CASE bin_idx " + " ".join(
    f"WHEN {i} THEN {(a + b) / 2!r}e0" for i, (a, b) in enumerate(zip(_WIDE, _WIDE[1:]))) + " END, 6) AS theta FROM sig")
def _(spark, sf):
    s = _sig(spark, sf).drop("theta")
    return with_angle(s, _WIDE).select("corr_id", "zbin", "bin_idx", F.round("theta", 6).alias("theta"))


# ---------------------------------------------------------------- theory tables

THETAS = [0.02, 0.05, 0.1, 0.2, 0.4, 0.8]
_H0 = Cosmology().h0 / LIGHT_KM_S
# J0 by its integral, 256 midpoints
_KTAB = f"""{_DIST},
pw AS (SELECT z, k, p, coalesce((k - lag(k) OVER w)/2e0, 0e0) + coalesce((lead(k) OVER w - k)/2e0, 0e0) AS wt FROM power WINDOW w AS (PARTITION BY z ORDER BY k)),
pd AS (SELECT pw.*, d0.dc + (z/0.001e0 - floor(z/0.001e0))*(d0.dn - d0.dc) AS chi FROM pw JOIN dz d0 ON d0.i = cast(floor(z/0.001e0) AS bigint)),
th AS (SELECT * FROM (VALUES {', '.join(f'({i}, {t!r}e0)' for i, t in enumerate(THETAS))}) v(t, theta)),
kt AS (SELECT z, t, theta, sum(wt*k*p/(2e0*{PI}*{PI})*j0) AS value FROM (SELECT z, k, wt, p, t, theta, avg(cos(k*radians(theta)*chi*sin({PI}*(m+0.5e0)/256e0))) AS j0
 FROM pd, th, range(256) r(m) GROUP BY ALL) GROUP BY z, t, theta)"""


def _ktab(spark, sf):
    return B.k_integral_table(power_table(spark, sf), THETAS)


@query("b1_k_integral_table", with_(POWER_SQL, _KTAB) + " SELECT round(z, 4) AS z, t, round(value, 5) AS value FROM kt")
def _(spark, sf):
    return _ktab(spark, sf).select(F.round("z", 4).alias("z"), "t", F.round("value", 5).alias("value"))


@query("b2_load_or_build", with_(POWER_SQL) + " SELECT round(z, 4) AS z, count(*) AS n, round(sum(p), 6) AS total FROM power GROUP BY z")
def _(spark, sf):
    path = _new_path(spark)
    R.load_or_build(spark, path, lambda: power_table(spark, sf))
    t = R.load_or_build(spark, path, lambda: power_table(spark, sf).limit(0))
    return t.groupBy("z").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("total")).select(
        F.round("z", 4).alias("z"), "n", F.round("total", 6).alias("total"))


# redshift curves of both samples: counts in 20 even bins, by sample and redshift bin of the correlation
_PDZ = f"""pdz AS (SELECT s || zbin AS curve_id, 0.2e0+0.05e0*(b+0.5e0) AS x, cast(count(*) AS double) AS y FROM (
 SELECT 'g' AS s, b AS zbin, cast(floor((redshift-0.2e0)/0.05e0) AS int) AS b0, redshift FROM galaxies, range(4) t(b)
 UNION ALL SELECT 'q', b, cast(floor((redshift-0.2e0)/0.05e0) AS int), redshift FROM quasars, range(4) t(b)) v(s, zbin, b, redshift)
 WHERE abs(redshift-(0.4e0+0.2e0*zbin)) < 0.25e0 GROUP BY s, zbin, b),
pa AS (SELECT curve_id, sum(a) AS area FROM (SELECT curve_id, (x-lag(x) OVER w)*(y+lag(y) OVER w)/2e0 AS a FROM pdz WINDOW w AS (PARTITION BY curve_id ORDER BY x)) GROUP BY 1),
pn AS (SELECT curve_id, x, y/area AS y FROM pdz JOIN pa USING (curve_id)),
ps AS (SELECT curve_id, x AS a, y AS ya, lead(x) OVER w AS b, lead(y) OVER w AS yb FROM pn WINDOW w AS (PARTITION BY curve_id ORDER BY x)),
pr AS (SELECT curve_id, min(x) AS x0, max(x) AS x1, arg_min(y, x) AS y0, arg_max(y, x) AS y1 FROM pn GROUP BY 1),
zw AS (SELECT z, coalesce((z - lag(z) OVER w)/2e0, 0e0) + coalesce((lead(z) OVER w - z)/2e0, 0e0) AS wt FROM (SELECT DISTINCT z FROM kt) WINDOW w AS (ORDER BY z)),
pv AS (SELECT pr.curve_id, z, CASE WHEN z <= x0 THEN y0 WHEN z >= x1 THEN y1 ELSE ya+(z-a)/(b-a)*(yb-ya) END AS p FROM pr CROSS JOIN zw
 LEFT JOIN ps ON ps.curve_id = pr.curve_id AND z >= a AND z < b),
sa AS (SELECT c AS corr_id, cast(zb AS int) AS zbin, CASE c WHEN 0 THEN 'g' ELSE 'q' END || zb AS curve1, 'g' || zb AS curve2 FROM range(4) t(zb), (VALUES (0), (1)) v(c)),
mod AS (SELECT corr_id, zbin, t, theta, sum({PI}*wt*u.p*v.p*{_H0!r}e0*sqrt(0.3e0*power(1e0+zw.z,3)+0.7e0)*value) AS w
 FROM sa JOIN pv u ON u.curve_id = curve1 JOIN pv v ON v.curve_id = curve2 AND v.z = u.z JOIN zw ON zw.z = u.z JOIN kt ON kt.z = u.z GROUP BY ALL)"""


def _pdz(spark, sf):
    out = None
    for tag, name in (("g", "galaxies"), ("q", "quasars")):
        p = read(spark, sf, name).select("redshift", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("zbin"))
        p = p.where(F.abs(F.col("redshift") - (F.lit(0.4) + F.lit(0.2) * F.col("zbin"))) < 0.25)
        p = p.groupBy(F.concat(F.lit(tag), F.col("zbin").cast("string")).alias("curve_id"),
                      F.floor((F.col("redshift") - 0.2) / 0.05).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("y"))
        p = p.select("curve_id", (F.lit(0.2) + F.lit(0.05) * (F.col("b") + 0.5)).alias("x"), "y")
        out = p if out is None else out.unionByName(p)
    return out


def _samples(spark, sf):
    """Curves of each correlation and redshift bin, through the sample table."""
    pairs = spark.createDataFrame([(0, "g", "g"), (1, "q", "g")], "corr_id int, sample1 string, sample2 string")
    curves = _pdz(spark, sf).select("curve_id").distinct().select(
        F.substring("curve_id", 1, 1).alias("sample"), F.substring("curve_id", 2, 9).cast("int").alias("zbin"), "curve_id")
    bins = pairs.select("corr_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("zbin"))
    return B.attach_curves(bins, pairs, curves).select("corr_id", "zbin", "curve1", "curve2")


@query("j9_attach_curves", with_(ctes("galaxies", "quasars"), POWER_SQL, _KTAB, _PDZ) + " SELECT corr_id, zbin, curve1, curve2 FROM sa")
def _(spark, sf):
    return _samples(spark, sf)


@query("b3_limber_model", with_(ctes("galaxies", "quasars"), POWER_SQL, _KTAB, _PDZ) +
       " SELECT corr_id, zbin, t, round(w*1e6, 2) AS w FROM mod")
def _(spark, sf):
    c = CV.normalize_curve(_pdz(spark, sf), ["curve_id"])
    m = B.limber_model(c, c, _ktab(spark, sf), _samples(spark, sf))
    return m.select("corr_id", "zbin", "t", F.round(F.col("w") * 1e6, 2).alias("w"))


# a smooth stand-in model for the fits: half of each bin's mean signal
_FIT = """pt AS (SELECT s.*, 0.5e0*a/theta AS model FROM sig s JOIN (SELECT corr_id, zbin, avg(w*theta) AS a FROM sig GROUP BY ALL) USING (corr_id, zbin)),
lk AS (SELECT corr_id, zbin, i, 8e0*i/399 AS b, sum((w-64e0*i*i/159201e0*model)*(w-64e0*i*i/159201e0*model)/(err*err)) AS chi2 FROM pt, range(400) t(i) GROUP BY ALL),
ll AS (SELECT *, exp((min(chi2) OVER (PARTITION BY corr_id, zbin) - chi2)/2e0) AS l FROM lk),
lb AS (SELECT *, l/(sum(l*CASE WHEN i IN (0, 399) THEN 0.5e0 ELSE 1e0 END) OVER (PARTITION BY corr_id, zbin)*8e0/399) AS lh FROM ll),
bb AS (SELECT corr_id, zbin, b AS best, chi2 FROM (SELECT *, row_number() OVER (PARTITION BY corr_id, zbin ORDER BY lh DESC, i) AS r FROM lb) WHERE r = 1)"""
_FIT_FROM = with_(ctes("galaxies", "quasars"), _SIG, _FIT)


def _points(spark, sf):
    s = _sig(spark, sf)
    a = s.groupBy("corr_id", "zbin").agg(F.avg(F.col("w") * F.col("theta")).alias("a"))
    return s.join(a, ["corr_id", "zbin"]).withColumn("model", F.lit(0.5) * F.col("a") / F.col("theta"))


@query("b4_bias_likelihood", _FIT_FROM + " SELECT corr_id, zbin, cast(i AS int) AS i, round(b, 5) AS b, round(lh, 5) AS likelihood FROM lb")
def _(spark, sf):
    l = B.bias_likelihood(_points(spark, sf), ["corr_id", "zbin"])
    return l.select("corr_id", "zbin", "i", F.round("b", 5).alias("b"), F.round("likelihood", 5).alias("likelihood"))


@query("t3_best_bias", _FIT_FROM + " SELECT corr_id, zbin, round(best, 5) AS best, round(chi2, 3) AS chi2 FROM bb")
def _(spark, sf):
    b = B.best_bias(B.bias_likelihood(_points(spark, sf), ["corr_id", "zbin"]), ["corr_id", "zbin"])
    return b.select("corr_id", "zbin", F.round("best", 5).alias("best"), F.round("chi2", 3).alias("chi2"))


@query("a15_b5_chi_square", _FIT_FROM + " SELECT corr_id, zbin, round(sum((w-model)*(w-model)/(err*err)), 3) AS chi2 FROM pt GROUP BY ALL")
def _(spark, sf):
    return B.chi_square(_points(spark, sf), ["corr_id", "zbin"]).select("corr_id", "zbin", F.round("chi2", 3).alias("chi2"))


@query("b5_chi_square_matrix", _FIT_FROM + """, c AS (SELECT corr_id, zbin, round(sum((w-model)*(w-model)/(err*err)), 3) AS chi2 FROM pt GROUP BY ALL)
SELECT zbin, max(CASE WHEN corr_id = 0 THEN chi2 END) AS "0", max(CASE WHEN corr_id = 1 THEN chi2 END) AS "1" FROM c GROUP BY zbin""")
def _(spark, sf):
    c = B.chi_square(_points(spark, sf), ["corr_id", "zbin"]).withColumn("chi2", F.round("chi2", 3))
    return B.chi_square_matrix(c, "zbin", "corr_id", [0, 1])


@query("j10_deproject_bias", _FIT_FROM + """
SELECT x.corr_id, x.zbin, cast(x.i AS int) AS i, round(CASE x.corr_id WHEN 0 THEN x.b ELSE x.b*x.b/a.best END, 4) AS bias
FROM lb x JOIN bb a ON a.corr_id = 0 AND a.zbin = x.zbin""")
def _(spark, sf):
    keys = ["corr_id", "zbin"]
    l = B.bias_likelihood(_points(spark, sf), keys)
    return B.deproject_bias(l, B.best_bias(l, keys), _corrs(spark), "b").select("corr_id", "zbin", "i", F.round("bias", 4).alias("bias"))


@query("b6_corr_bias", with_(ctes("galaxies", "quasars"), POWER_SQL, _KTAB, _PDZ, _SIG) + """,
ms AS (SELECT corr_id, zbin, theta AS a, w*1e4 AS ya, lead(theta) OVER w AS b, lead(w*1e4) OVER w AS yb FROM mod WINDOW w AS (PARTITION BY corr_id, zbin ORDER BY theta)),
pt AS (SELECT s.corr_id, s.zbin, s.w, s.err, ya+(s.theta-a)/(b-a)*(yb-ya) AS model FROM sig s JOIN ms ON ms.corr_id = s.corr_id AND ms.zbin = s.zbin AND s.theta >= a AND s.theta < b WHERE bin_idx >= 3),
lk AS (SELECT corr_id, zbin, i, 8e0*i/399 AS b, sum((w-64e0*i*i/159201e0*model)*(w-64e0*i*i/159201e0*model)/(err*err)) AS chi2 FROM pt, range(400) t(i) GROUP BY ALL)
,
top AS (SELECT corr_id, zbin, arg_min(b, chi2) AS best, min(chi2) AS chi2 FROM lk GROUP BY ALL)
SELECT t.corr_id, t.zbin, round(t.best, 5) AS best, round(CASE t.corr_id WHEN 0 THEN t.best ELSE t.best*t.best/a.best END, 4) AS bias, round(t.chi2, 1) AS chi2
FROM top t JOIN top a ON a.corr_id = 0 AND a.zbin = t.zbin""")
def _(spark, sf):
    # the table's power is in arbitrary units; scaled so that biases fall on the grid
    k = _ktab(spark, sf).withColumn("value", F.col("value") * 1e4)
    fit = corr_bias(_sig(spark, sf), _corrs(spark), _samples(spark, sf), _pdz(spark, sf), k)
    return fit.best.select("corr_id", "zbin", F.round("best", 5).alias("best"), F.round("bias", 4).alias("bias"), F.round("chi2", 1).alias("chi2"))


# ---------------------------------------------------------------- figure tables

_Q = f"q AS (SELECT *, {_BEST} FROM quasars)"


def _cell(x, lo, hi, n):
    return f"cast(least(floor(({x}-{d(lo)})/{d((hi - lo) / n)}), {n - 1}) AS int)"


@query("g1_color_redshift", with_(ctes("quasars"), _Q) + f"""
SELECT {_cell('zb', 0.0, 4.0, 150)} AS ix, {_cell('gmag-w2', 0.0, 12.0, 800)} AS iy, count(*) AS n FROM q
WHERE zb BETWEEN 0e0 AND 4e0 AND gmag-w2 BETWEEN 0e0 AND 12e0 GROUP BY 1, 2""")
def _(spark, sf):
    return G.color_redshift(G.with_best_redshift(read(spark, sf, "quasars")), "gmag", "w2", "z", (0.0, 12.0), (0.0, 4.0))


@query("g2_color_color", with_(ctes("quasars")) + f"""
SELECT {_cell('gmag-imag', -5.0, 8.0, 40)} AS ix, {_cell('w2-w3', -1.0, 9.0, 40)} AS iy, count(*) AS n FROM quasars
WHERE gmag-imag BETWEEN -5e0 AND 8e0 AND w2-w3 BETWEEN -1e0 AND 9e0 GROUP BY 1, 2""")
def _(spark, sf):
    return G.color_color(read(spark, sf, "quasars"), ("gmag", "imag"), ("w2", "w3"), (-5.0, 8.0), (-1.0, 9.0), (40, 40))


@query("g2_color_color_zbin", with_(ctes("quasars")) + f"""
SELECT {Z_CASE} AS zbin, {_cell('gmag-imag', -5.0, 8.0, 10)} AS ix, {_cell('w2-w3', -1.0, 9.0, 10)} AS iy, count(*) AS n FROM quasars
WHERE gmag-imag BETWEEN -5e0 AND 8e0 AND w2-w3 BETWEEN -1e0 AND 9e0 AND {Z_CASE} IS NOT NULL GROUP BY 1, 2, 3""")
def _(spark, sf):
    return G.color_color(read(spark, sf, "quasars"), ("gmag", "imag"), ("w2", "w3"), (-5.0, 8.0), (-1.0, 9.0), (10, 10), "redshift", ZBINS)


def _gauss_sql(src, mu, sigma, num=500):
    return (f"SELECT cast(i AS int) AS i, round(sum(exp(-((4e0*i/{num - 1}-{mu})*(4e0*i/{num - 1}-{mu}))/(2e0*{sigma}*{sigma}))/({sigma}*sqrt(2e0*{PI}))), 4) AS y "
            f"FROM {src}, range({num}) t(i) GROUP BY i")


@query("g3_agn_pseudo_pdz", with_(ctes("quasars"), _Q) + ", s AS (SELECT * FROM q WHERE z_match IS NOT NULL AND p_t1 > 0.5e0 AND zb >= 0.3e0 AND zb < 1.1e0) " +
       _gauss_sql("s", "zb", "zs"))
def _(spark, sf):
    return G.agn_pseudo_pdz(read(spark, sf, "quasars"), 0.3, 1.1, 1).select("i", F.round("y", 4).alias("y"))


@query("g3_galaxy_pseudo_pdz", with_(ctes("galaxies")) + f", s AS (SELECT * FROM galaxies WHERE {_GAL_OK}) " + _gauss_sql("s", "redshift", "greatest(z_std, 0.02e0)", 200))
def _(spark, sf):
    g = read(spark, sf, "galaxies").where(K.galaxy_quality_cut(0.3, 1.1, SPOTS, BAD, PATCH))
    g = g.withColumn("s", F.greatest("z_std", F.lit(0.02)))
    return CV.gauss_sum(g, "redshift", "s", num=200).select("i", F.round("y", 4).alias("y"))


@query("g3_spec_only_pdz", with_(ctes("quasars")) + ", s AS (SELECT * FROM quasars WHERE specz > 0.3e0 AND specz < 1.1e0 AND NOT isnan(specz)) " +
       _gauss_sql("s", "specz", "0.01e0"))
def _(spark, sf):
    q = G.with_best_redshift(read(spark, sf, "quasars"))
    return G.spec_only_pdz(q, "specz", 0.3, 1.1).select("i", F.round("y", 4).alias("y"))


@query("g4_agn_stacked_pdz", with_(ctes("quasars", "curves"), _Q) + f""",
s AS (SELECT q.*, pdz FROM q JOIN curves ON object_id = id WHERE conf > 0.5e0 AND zb >= 0.2e0 AND zb < 1.2e0 AND NOT ({_LOW})),
fl AS (SELECT id, CASE WHEN isnan(specz) THEN NULL ELSE specz END AS sz, unnest(range(64)) AS i, abs(cast(unnest(pdz) AS double)) AS v FROM s),
ar AS (SELECT id, (sum(v) - (max(CASE WHEN i = 0 THEN v END) + max(CASE WHEN i = 63 THEN v END))/2e0)*0.05e0 AS area FROM fl GROUP BY id)
SELECT cast(i AS int) AS i, round(sum(CASE WHEN sz IS NULL THEN v/area ELSE exp(-((0.05e0*i-sz)*(0.05e0*i-sz))/(2e0*0.0001e0))/(0.01e0*sqrt(2e0*{PI})) END), 4) AS y
FROM fl JOIN ar USING (id) GROUP BY i""")
def _(spark, sf):
    curves = read(spark, sf, "curves").select(F.col("object_id").alias("id"), F.transform("pdz", lambda v: F.abs(v)).alias("pdz"))
    q = read(spark, sf, "quasars").join(curves, "id")
    return G.agn_stacked_pdz(q, 0.2, 1.2, 0, step=0.05).select("i", F.round("y", 4).alias("y"))


@query("g5_galaxy_matched_pdz", with_(ctes("galaxies", "curves"), _CAT.replace("WHERE", f"WHERE {_GAL_OK} AND"), _FLAT) + """
SELECT cast(i AS int) AS i, round(sum(abs(v)/area), 5) AS y FROM fl JOIN ar USING (id) GROUP BY i""")
def _(spark, sf):
    c = _cat(spark, sf).where(K.galaxy_quality_cut(0.3, 1.1, SPOTS, BAD, PATCH))
    return CV.stack_pdz(c, "pdz", 0.05).select("i", F.round("y", 5).alias("y"))


@query("g6_luminosity_histogram", with_(ctes("quasars"), _Q) + f""",
k AS (SELECT *, unnest(CASE WHEN p_t1 > 0.5e0 AND p_t2 > 0.5e0 THEN [1, 2] WHEN p_t1 > 0.5e0 THEN [1] WHEN p_t2 > 0.5e0 THEN [2] ELSE [] END) AS kind FROM q)
SELECT kind, {Z_CASE.replace('redshift', 'zb')} AS zbin, {_cell('lum', 42.0, 47.0, 50)} AS bin_idx, count(*) AS n FROM k
WHERE {Z_CASE.replace('redshift', 'zb')} IS NOT NULL AND lum BETWEEN 42e0 AND 47e0 GROUP BY 1, 2, 3""")
def _(spark, sf):
    return G.luminosity_histogram(read(spark, sf, "quasars"), ZBINS).select("kind", "zbin", "bin_idx", "n")


@query("g7_error_contours", with_(ctes("galaxies")) + f""", h AS (SELECT {Z_CASE} AS zbin, {_cell('imag', 19.0, 25.0, 20)} AS ix, {_cell('z_std', 0.0, 0.1, 20)} AS iy, count(*) AS n
 FROM galaxies WHERE imag BETWEEN 19e0 AND 25e0 AND z_std BETWEEN 0e0 AND 0.1e0 AND {Z_CASE} IS NOT NULL GROUP BY 1, 2, 3)
SELECT zbin, ix, iy, n, cast(n >= 0.1e0*p AS int) + cast(n >= 0.3e0*p AS int) + cast(n >= 0.6e0*p AS int) AS level
FROM h JOIN (SELECT zbin, max(n) AS p FROM h GROUP BY zbin) USING (zbin)""")
def _(spark, sf):
    from skytally.functions.scalars import zbin_index
    g = read(spark, sf, "galaxies").withColumn("zbin", zbin_index("redshift", ZBINS)).where("zbin is not null")
    return G.error_contours(g, "imag", "z_std", (19.0, 25.0), (0.0, 0.1), keys=["zbin"])


@query("g8_joint_histogram", with_(ctes("galaxies", "quasars")) + f""",
b AS (SELECT s AS sample, {_cell('z', 0.2, 1.2, 20)} AS ix, {_cell('m', 18.0, 25.0, 20)} AS iy FROM (SELECT 'galaxies' AS s, redshift AS z, imag AS m FROM galaxies
 UNION ALL SELECT 'quasars', redshift, imag FROM quasars) WHERE z BETWEEN 0.2e0 AND 1.2e0 AND m BETWEEN 18e0 AND 25e0)
SELECT sample, ix, iy, count(*) AS n FROM b GROUP BY GROUPING SETS ((sample, ix, iy), (sample, ix), (sample, iy))""")
def _(spark, sf):
    part = lambda t: read(spark, sf, t).select(F.lit(t).alias("sample"), "redshift", "imag")
    both = part("galaxies").unionByName(part("quasars"))
    return H.joint_histogram(both, "sample", "redshift", "imag", (0.2, 1.2), (18.0, 25.0), (20, 20))

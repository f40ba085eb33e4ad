"""Column expressions over the sky tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from skytally.functions import cosmology as C
from skytally.functions import geometry as G
from skytally.functions import scalars as S
from skytally.functions.healpix import with_pixel
from skytally.operators.curves import interp
from skytally.operators.footprint import not_null_visits
from skytally.operators.model import matter_power

from .base import ABINS, PI, ZBINS, ctes, d, pixed, query, read, with_

Z_CASE = ("CASE WHEN redshift >= 0.3e0 AND redshift < 0.5e0 THEN 0 WHEN redshift >= 0.5e0 AND redshift < 0.7e0 THEN 1 "
          "WHEN redshift >= 0.7e0 AND redshift < 0.9e0 THEN 2 WHEN redshift >= 0.9e0 AND redshift < 1.1e0 THEN 3 END")


@query("x1_unit_vector", with_(ctes("galaxies")) + f"""
SELECT id, round(cos(radians(ra))*sin({PI}/2-radians(dec)), 6) AS x, round(sin(radians(ra))*sin({PI}/2-radians(dec)), 6) AS y,
 round(sin(radians(dec)), 6) AS z FROM galaxies""")
def _(spark, sf):
    g = G.with_unit_vector(read(spark, sf, "galaxies"))
    return g.select("id", *[F.round(c, 6).alias(c) for c in "xyz"])


@query("x2_chord", with_(ctes("moved")) + """
SELECT id, round(2e0*sin(radians(abs(dec))/2e0), 6) AS chord FROM moved""")
def _(spark, sf):
    return read(spark, sf, "moved").select("id", F.round(G.chord_col(F.abs("dec")), 6).alias("chord"))


@query("x3_ang2pix", with_(ctes("galaxies"), pixed("p", "galaxies", 32), pixed("q", "p", 1024, pix="fine")) +
       " SELECT id, pix, fine FROM q")
def _(spark, sf):
    g = with_pixel(with_pixel(read(spark, sf, "galaxies"), 32), 1024, name="fine")
    return g.select("id", "pix", "fine")


def _rotation_sql(i):
    r = G.GALACTIC_ROTATION[i]
    return (f"({r[0]!r}e0*cos(radians(ra))*cos(radians(dec)) + {r[1]!r}e0*sin(radians(ra))*cos(radians(dec)) "
            f"+ {r[2]!r}e0*sin(radians(dec)))")


@query("x4_to_galactic", with_(ctes("quasars")) + f"""
SELECT id, round(degrees(atan2({_rotation_sql(1)}, {_rotation_sql(0)})) + CASE WHEN {_rotation_sql(1)} < 0 THEN 360e0 ELSE 0e0 END, 5) AS l,
 round(degrees(asin({_rotation_sql(2)})), 5) AS b FROM quasars""")
def _(spark, sf):
    lon, lat = G.to_galactic("ra", "dec")
    return read(spark, sf, "quasars").select("id", F.round(lon, 5).alias("l"), F.round(lat, 5).alias("b"))


@query("x5_best_redshift", with_(ctes("quasars")) + """
SELECT id, round(CASE WHEN specz IS NULL OR isnan(specz) THEN redshift ELSE specz END, 6) AS z,
 round(CASE WHEN specz IS NULL OR isnan(specz) THEN (abs(z_up-redshift)+abs(redshift-z_lo))/2e0 ELSE 0.01e0 END, 6) AS sigma FROM quasars""")
def _(spark, sf):
    z, s = S.best_redshift("redshift", "specz", "z_up", "z_lo")
    return read(spark, sf, "quasars").select("id", F.round(z, 6).alias("z"), F.round(s, 6).alias("sigma"))


@query("x6_sym_error", with_(ctes("quasars")) +
       " SELECT id, round(((z_up-redshift)+(redshift-z_lo))/2e0, 6) AS err FROM quasars")
def _(spark, sf):
    q = read(spark, sf, "quasars")
    return q.select("id", F.round(S.sym_error(F.col("z_up") - F.col("redshift"), F.col("redshift") - F.col("z_lo")), 6).alias("err"))


@query("x7_color", with_(ctes("quasars")) + " SELECT id, round(gmag-w2, 6) AS g_w2, round(w2-w3, 6) AS w2_w3 FROM quasars")
def _(spark, sf):
    return read(spark, sf, "quasars").select(
        "id", F.round(S.color("gmag", "w2"), 6).alias("g_w2"), F.round(S.color("w2", "w3"), 6).alias("w2_w3"))


@query("x8_gauss", with_(ctes("galaxies")) + f"""
SELECT id, round(exp(-((0.7e0-redshift)*(0.7e0-redshift))/(2e0*z_std*z_std))/(z_std*sqrt(2e0*{PI})), 5) AS p FROM galaxies""")
def _(spark, sf):
    g = read(spark, sf, "galaxies")
    return g.select("id", F.round(S.gauss(0.7, "redshift", "z_std"), 5).alias("p"))


@query("x9_zbin_index", with_(ctes("galaxies")) + f" SELECT id, {Z_CASE} AS zbin FROM galaxies")
def _(spark, sf):
    return read(spark, sf, "galaxies").select("id", S.zbin_index("redshift", ZBINS).alias("zbin"))


@query("x10_in_range", """
SELECT o_orderkey AS id, (v >= 100 AND v < 200) AS left_closed, (v >= 100 AND v <= 200) AS both_closed, (v > 100 AND v < 200) AS open
FROM (SELECT o_orderkey, floor(o_totalprice / 1000e0) AS v FROM orders)""")
def _(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice") / 1000.0).cast("double").alias("v"))
    return o.select("id", S.in_range("v", 100, 200, "left").alias("left_closed"),
                    S.in_range("v", 100, 200, "both").alias("both_closed"), S.in_range("v", 100, 200, "neither").alias("open"))


@query("x11_all_any", with_(ctes("galaxies")) + """
SELECT id, (imag < 22e0 AND extendedness > 0.3e0 AND z_std > 0e0) AS all_ok, (imag < 22e0 OR extendedness > 0.3e0 OR z_std > 0e0) AS any_ok FROM galaxies""")
def _(spark, sf):
    m = [F.col("imag") < 22.0, F.col("extendedness") > 0.3, F.col("z_std") > 0.0]
    return read(spark, sf, "galaxies").select("id", S.all_of(*m).alias("all_ok"), S.any_of(*m).alias("any_ok"))


_LOG = S.edges_log(0.01, 1.0, 9)
_LIN = S.edges_linear(0.2, 1.2, 11)


@query("x12_edges_midpoints", with_(ctes("galaxies")) + f"""
SELECT b AS bin_idx, round(0.2e0 + (b + 0.5e0) * 0.1e0, 6) AS mid, round(power(10e0, -2e0 + 0.25e0 * (b % 8)), 6) AS log_edge, count(*) AS n
FROM (SELECT cast(floor((redshift - 0.2e0) / 0.1e0) AS int) AS b FROM galaxies WHERE redshift >= 0.2e0 AND redshift < 1.2e0) GROUP BY ALL""")
def _(spark, sf):
    g = read(spark, sf, "galaxies").where("redshift >= 0.2e0 and redshift < 1.2e0")
    g = g.withColumn("bin_idx", F.floor((F.col("redshift") - 0.2) / 0.1).cast("int")).groupBy("bin_idx").agg(F.count(F.lit(1)).alias("n"))
    grid = S.edge_table(spark, _LIN).select("bin_idx", "mid")
    log = F.element_at(F.array(*[F.lit(v) for v in _LOG]), F.col("bin_idx") % 8 + 1)
    return g.join(grid, "bin_idx").select("bin_idx", F.round("mid", 6).alias("mid"), F.round(log, 6).alias("log_edge"), "n")


@query("x13_dither", with_(ctes("galaxies")) + " SELECT count(*) AS n, true AS within, true AS spread FROM galaxies")
def _(spark, sf):
    g = read(spark, sf, "galaxies").withColumn("e", S.dither("redshift", 0.01, seed=7) - F.col("redshift"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.abs("e") <= 0.005 + 1e-12).alias("within"),
                 (F.max("e") - F.min("e") > 0.008).alias("spread"))


@query("x14_clip_lower_error", with_(ctes("galaxies")) + """
SELECT id, round(CASE WHEN 10e0*abs(z_std) > redshift THEN redshift*(1e0-0.0001e0) ELSE 10e0*abs(z_std) END, 6) AS lower, round(10e0*abs(z_std), 6) AS upper FROM galaxies""")
def _(spark, sf):
    lo, up = S.clip_lower_error("redshift", F.abs("z_std") * F.lit(10.0))
    return read(spark, sf, "galaxies").select("id", F.round(lo, 6).alias("lower"), F.round(up, 6).alias("upper"))


# a grid of steps of 0.001, each by Simpson's rule
_DIST = f"""grid AS (SELECT i, 1e0/({C.Cosmology().h0 / C.LIGHT_KM_S!r}e0*sqrt(0.3e0*power(1e0+i*0.0005e0,3)+0.7e0)) AS f FROM range(10001) t(i)),
dist AS (SELECT i, sum(s) OVER (ORDER BY i) AS dc FROM (SELECT i // 2 AS i, i % 2 AS odd, coalesce((f + 4e0*lag(f) OVER (ORDER BY i) + lag(f, 2) OVER (ORDER BY i))*0.001e0/6e0, 0e0) AS s FROM grid) WHERE odd = 0),
dz AS (SELECT i, dc, lead(dc) OVER (ORDER BY i) AS dn FROM dist)"""


def _distances(table):
    """Simpson's rule over 200 parts of each row's own range of redshifts."""
    f = f"1e0/({C.Cosmology().h0 / C.LIGHT_KM_S!r}e0*sqrt(0.3e0*power(1e0+redshift*k/200e0,3)+0.7e0))"
    return f"""far AS (SELECT id, redshift, sum({f}*CASE WHEN k IN (0, 200) THEN 1e0 WHEN k % 2 = 1 THEN 4e0 ELSE 2e0 END)*redshift/600e0 AS dc
FROM {table}, range(201) t(k) GROUP BY id, redshift)"""


@query("x15_comoving_scale", with_(ctes("galaxies"), _distances("galaxies")) + """
SELECT id, round(dc*tan(radians(0.1e0)), 4) AS scale FROM far""")
def _(spark, sf):
    g = C.with_distance(read(spark, sf, "galaxies"), "redshift")
    return g.select("id", F.round(C.comoving_scale(F.lit(0.1), "d_c"), 4).alias("scale"))


@query("x16_comoving_distance", with_(ctes("quasars"), _distances("quasars")) + f"""
SELECT t.id, round(dc, 3) AS d_c, round({C.Cosmology().h0 / C.LIGHT_KM_S!r}e0*sqrt(0.3e0*power(1e0+t.redshift,3)+0.7e0)*1e4, 5) AS h_over_c
FROM far t""")
def _(spark, sf):
    q = C.with_distance(read(spark, sf, "quasars"), "redshift")
    return q.select("id", F.round("d_c", 3).alias("d_c"), F.round(C.hubble_over_c("redshift") * F.lit(1e4), 5).alias("h_over_c"))


# J0(x) by its integral over [0, pi], 64 midpoints: independent of the polynomials
@query("x17_bessel_j0", with_(ctes("galaxies")) + f"""
SELECT id, round(avg(cos(20e0*redshift*sin({PI}*(k+0.5e0)/64e0))), 3) AS j0 FROM galaxies, range(64) t(k) GROUP BY id""")
def _(spark, sf):
    return read(spark, sf, "galaxies").select("id", F.round(C.bessel_j0(F.col("redshift") * F.lit(20.0)), 3).alias("j0"))


@query("x18_deg_to_rad", with_(ctes("randoms")) + f" SELECT id, round({PI}*ra/180e0, 6) AS r FROM randoms")
def _(spark, sf):
    return read(spark, sf, "randoms").select("id", F.round(G.deg_to_rad("ra"), 6).alias("r"))


@query("x19_power_law", with_(ctes("galaxies")) + " SELECT id, round(2.5e0*power(redshift, -0.8e0), 6) AS y FROM galaxies")
def _(spark, sf):
    return read(spark, sf, "galaxies").select("id", F.round(S.power_law("redshift", F.lit(2.5), F.lit(-0.8)), 6).alias("y"))


@query("x20_band_letter", with_(ctes("visits")) + " SELECT visit_id, left(filter, 1) AS band FROM visits WHERE NOT is_null")
def _(spark, sf):
    return not_null_visits(read(spark, sf, "visits")).select("visit_id", S.band_letter("filter").alias("band"))


@query("x21_arcmin", "SELECT p_partkey AS id, round(p_size/17e0*60e0, 2) AS arcmin FROM part")
def _(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select(F.col("p_partkey").alias("id"), G.arcmin(F.col("p_size") / F.lit(17.0)).alias("arcmin"))


# a power table from the vectors: mean absolute value per label (redshift row) and place (wavenumber)
POWER_SQL = """power AS (SELECT 0.2e0 + 0.1e0*label AS z, 0.05e0*j AS k, avg(v) AS p FROM (SELECT label, unnest(range(64)) AS j,
  abs(cast(unnest(embedding) AS double)) AS v FROM embeddings) GROUP BY label, j)"""


def power_table(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("label", F.posexplode("embedding").alias("j", "v"))
    return e.groupBy("label", "j").agg(F.avg(F.abs(F.col("v").cast("double"))).alias("p")).select(
        (F.lit(0.2) + F.lit(0.1) * F.col("label")).alias("z"), (F.lit(0.05) * F.col("j")).alias("k"), "p")


@query("x22_matter_power", with_(ctes("galaxies"), POWER_SQL) + """,
q AS (SELECT id, greatest(0e0, least(9e0, (redshift-0.2e0)/0.1e0)) AS u, greatest(0e0, least(63e0, 3e0*extendedness/0.05e0)) AS v FROM galaxies),
g AS (SELECT cast(round((z-0.2e0)/0.1e0) AS bigint) AS i, cast(round(k/0.05e0) AS bigint) AS j, p FROM power),
c AS (SELECT id, u, v, least(cast(floor(u) AS bigint), 8) AS i, least(cast(floor(v) AS bigint), 62) AS j FROM q)
SELECT c.id, round((1-(u-c.i))*((1-(v-c.j))*a.p+(v-c.j)*b.p)+(u-c.i)*((1-(v-c.j))*e.p+(v-c.j)*f.p), 5) AS p
FROM c JOIN g a ON a.i=c.i AND a.j=c.j JOIN g b ON b.i=c.i AND b.j=c.j+1 JOIN g e ON e.i=c.i+1 AND e.j=c.j JOIN g f ON f.i=c.i+1 AND f.j=c.j+1""")
def _(spark, sf):
    g = read(spark, sf, "galaxies").select("id", F.col("redshift").alias("z"), (F.lit(3.0) * F.col("extendedness")).alias("k"))
    return matter_power(g, power_table(spark, sf)).select("id", F.round("p", 5).alias("p"))


@query("a14_interp", with_(ctes("galaxies", "quasars")) + """,
nodes AS (SELECT k, zb, avg(redshift) AS x, avg(lum) AS y FROM (SELECT cast(p_t1 > 0.5e0 AS int) AS k, cast(floor(redshift/0.1e0) AS int) AS zb, redshift, lum FROM quasars) GROUP BY k, zb),
seg AS (SELECT k, x AS a, y AS ya, lead(x) OVER w AS b, lead(y) OVER w AS yb FROM nodes WINDOW w AS (PARTITION BY k ORDER BY x)),
r AS (SELECT k, min(x) AS x0, max(x) AS x1, arg_min(y, x) AS y0, arg_max(y, x) AS y1 FROM nodes GROUP BY k)
SELECT id, round(CASE WHEN redshift <= x0 THEN y0 WHEN redshift >= x1 THEN y1 ELSE ya + (redshift-a)/(b-a)*(yb-ya) END, 5) AS y
FROM galaxies JOIN r ON r.k = wise_flag LEFT JOIN seg ON seg.k = wise_flag AND redshift >= a AND redshift < b""")
def _(spark, sf):
    q = read(spark, sf, "quasars").groupBy(
        (F.col("p_t1") > 0.5).cast("int").alias("curve_id"), F.floor(F.col("redshift") / 0.1).alias("zb")
    ).agg(F.avg("redshift").alias("x"), F.avg("lum").alias("y"))
    curve = q.select("curve_id", "x", "y")
    g = read(spark, sf, "galaxies").withColumn("curve_id", F.col("wise_flag"))
    return interp(g, "redshift", curve).select("id", F.round("y", 5).alias("y"))

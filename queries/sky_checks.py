"""Pixel counts, histograms, splits, random catalogs, masks and footprints."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from skytally.functions.healpix import pixel_centres, with_pixel
from skytally.functions.scalars import edges_linear
from skytally.operators import footprint as FP
from skytally.operators import histograms as H
from skytally.operators import masks as M
from skytally.operators import partition as P
from skytally.operators.match import match_by_id
from skytally.operators.pairs import pixel_pairs
from skytally.plans.correlation import prepare_pair

from .base import (NSIDE, PI, ZBINS, ctes, near_sky, pairs_sky, pix_steps, pixed, query, read, sky, with_, xyzed)
from .scalar_checks import Z_CASE

# ---------------------------------------------------------------- counts and histograms


@query("a1_count_per_pixel", with_(ctes("galaxies"), pixed("p", "galaxies")) + " SELECT pix, count(*) AS n FROM p GROUP BY pix")
def _(spark, sf):
    return H.count_per_pixel(read(spark, sf, "galaxies"), NSIDE)


@query("a2_pixel_stats", with_(ctes("galaxies"), pixed("p", "galaxies")) +
       " SELECT count(*) AS total, count(DISTINCT pix) AS occupied FROM p")
def _(spark, sf):
    return H.pixel_stats(H.count_per_pixel(read(spark, sf, "galaxies"), NSIDE))


_Z29 = "least(cast(floor((redshift-0.3e0)/((1.1e0-0.3e0)/29)) AS int), 28)"


@query("a5_z_histogram", with_(ctes("galaxies")) + f""", h AS (SELECT {_Z29} AS bin_idx, count(*) AS n FROM galaxies
 WHERE redshift >= 0.3e0 AND redshift <= 1.1e0 GROUP BY 1)
SELECT bin_idx, n, round(n/(sum(n) OVER ()*0.8e0/29), 6) AS density FROM h""")
def _(spark, sf):
    h = H.z_histogram(read(spark, sf, "galaxies"), ZBINS[0], ZBINS[-1])
    return h.select("bin_idx", "n", F.round("density", 6).alias("density"))


@query("a6_hist1d", "SELECT cast(least(floor(value/5e0), 39) AS int) AS bin_idx, count(*) AS n FROM events WHERE value >= 0 AND value <= 200 GROUP BY 1")
def _(spark, sf):
    return H.hist1d(spark.read.parquet(f"{sf}/events.parquet"), "value", 0.0, 200.0, 40).select("bin_idx", "n")


@query("a7_hist2d", with_(ctes("galaxies")) + """
SELECT cast(least(floor((redshift-0.2e0)/0.05e0), 19) AS int) AS ix, cast(least(floor((imag-19e0)/0.25e0), 23) AS int) AS iy, count(*) AS n
FROM galaxies WHERE redshift BETWEEN 0.2e0 AND 1.2e0 AND imag BETWEEN 19e0 AND 25e0 GROUP BY 1, 2""")
def _(spark, sf):
    return H.hist2d(read(spark, sf, "galaxies"), "redshift", "imag", (0.2, 1.2), (19.0, 25.0), (20, 24))


@query("a8_contour_levels", with_(ctes("galaxies")) + """, h AS (
SELECT cast(least(floor((redshift-0.2e0)/0.05e0), 19) AS int) AS ix, cast(least(floor((imag-19e0)/0.3e0), 19) AS int) AS iy, count(*) AS n
FROM galaxies WHERE redshift BETWEEN 0.2e0 AND 1.2e0 AND imag BETWEEN 19e0 AND 25e0 GROUP BY 1, 2), m AS (SELECT max(n) AS p FROM h)
SELECT ix, iy, n, cast(n >= 0.1e0*p AS int) + cast(n >= 0.3e0*p AS int) + cast(n >= 0.6e0*p AS int) AS level FROM h, m""")
def _(spark, sf):
    return H.contour_levels(H.hist2d(read(spark, sf, "galaxies"), "redshift", "imag", (0.2, 1.2), (19.0, 25.0), (20, 20)))


@query("a13_count_by_group", with_(ctes("visits")) + """
SELECT 'before' AS stage, count(*) AS n FROM visits WHERE NOT is_null
UNION ALL SELECT 'after', count(DISTINCT pntgid) FROM visits WHERE NOT is_null""")
def _(spark, sf):
    v = FP.not_null_visits(read(spark, sf, "visits"))
    return H.count_by_group(v, FP.first_per_pointing(v))


@query("a16_dense_pixel_map", with_(ctes("galaxies"), pixed("p", "galaxies")) +
       """ SELECT i AS pix, count(p.pix) AS n FROM range(12288) t(i) LEFT JOIN p ON p.pix = i GROUP BY i""")
def _(spark, sf):
    return H.dense_pixel_map(H.count_per_pixel(read(spark, sf, "galaxies"), NSIDE), NSIDE)


# ---------------------------------------------------------------- pixel pairs and splits


@query("j5_pixel_pairs", with_(ctes("galaxies"), pixed("p", "galaxies"), "occ AS (SELECT DISTINCT pix FROM p)", pairs_sky(NSIDE)) +
       " SELECT pix1, pix2, ring FROM pixpairs WHERE pix1 IN (FROM occ) AND pix2 IN (FROM occ)")
def _(spark, sf):
    occ = H.count_per_pixel(read(spark, sf, "galaxies"), NSIDE)
    return pixel_pairs(spark, NSIDE, occ)


@query("p1_split_by_pixel", with_(ctes("randoms"), pixed("p", "randoms", 8)) + " SELECT id, pix FROM p")
def _(spark, sf):
    return P.split_by_pixel(read(spark, sf, "randoms"), 8).select("id", "pix")


@query("p2_split_by_z", with_(ctes("galaxies")) + f" SELECT id, {Z_CASE} AS zbin FROM galaxies WHERE {Z_CASE} IS NOT NULL")
def _(spark, sf):
    return P.split_by_z(read(spark, sf, "galaxies"), ZBINS).select("id", "zbin")


@query("j8_replicate_per_bin", with_(ctes("moved")) + " SELECT id, cast(b AS int) AS zbin FROM moved, range(4) t(b)")
def _(spark, sf):
    return P.split_by_z(read(spark, sf, "moved"), ZBINS).select("id", "zbin")


_ORDER = "(id*0.6180339887498949e0 - floor(id*0.6180339887498949e0))"
_DRAW = f""", nd AS (SELECT pix, count(*) AS n FROM gp GROUP BY pix), nr AS (SELECT pix, count(*) AS n FROM rp GROUP BY pix),
f0 AS (SELECT nr.pix, nr.n AS n_random, coalesce(nd.n, 0) AS n_data, (coalesce(nd.n, 0)/cast((SELECT max(n) FROM nd) AS double))
 /(nr.n/cast((SELECT max(n) FROM nr) AS double)) AS f FROM nr LEFT JOIN nd USING (pix)),
fr AS (SELECT pix, n_data, n_random, f/(SELECT max(f) FROM f0) AS fraction FROM f0),
kept AS (SELECT * FROM (SELECT rp.*, fraction, row_number() OVER (PARTITION BY pix ORDER BY {_ORDER}, id) AS r, count(*) OVER (PARTITION BY pix) AS c
 FROM rp JOIN fr USING (pix)) WHERE r <= floor(fraction*c))"""


@query("n1_normalize_random", with_(ctes("galaxies", "randoms"), pixed("gp", "galaxies", 8), pixed("rp", "randoms", 8)) + _DRAW +
       " SELECT id, round(ra, 6) AS ra, round(dec, 6) AS dec FROM kept")
def _(spark, sf):
    r = P.normalize_random(read(spark, sf, "galaxies"), read(spark, sf, "randoms"), 8, F.expr(_ORDER))
    return r.select("id", F.round("ra", 6).alias("ra"), F.round("dec", 6).alias("dec"))


@query("n2_draw_fraction", with_(ctes("randoms"), pixed("rp", "randoms", 8)) + f"""
SELECT id, pix FROM (SELECT *, row_number() OVER (PARTITION BY pix ORDER BY {_ORDER}, id) AS r, count(*) OVER (PARTITION BY pix) AS c FROM rp)
WHERE r <= floor(0.3e0*c)""")
def _(spark, sf):
    r = with_pixel(read(spark, sf, "randoms"), 8)
    return P.draw_fraction(r, ["pix"], F.lit(0.3), F.expr(_ORDER)).select("id", "pix")


_EVEN = ("id * 2654435761 % 4294967296 / 4294967296e0", "id * 2246822519 % 4294967291 / 4294967291e0")


@query("n3_random_catalog", with_(ctes("galaxies"), pixed("gp", "galaxies", 16)) + f""",
p AS (SELECT id, {_EVEN[0]} * 360e0 AS ra, degrees(asin(2e0*({_EVEN[1]}) - 1e0)) AS dec FROM range(20 * (SELECT count(*) FROM events)) t(id)),
{pixed("pp", "p", 16)} SELECT id, round(ra, 6) AS ra, round(dec, 6) AS dec FROM pp WHERE pix IN (SELECT pix FROM gp)""")
def _(spark, sf):
    g = H.count_per_pixel(read(spark, sf, "galaxies"), 16)
    n = spark.read.parquet(f"{sf}/events.parquet").count() * 20
    return P.random_catalog(spark, n, g, 16, even=lambda c, k: F.expr(_EVEN[k])).select("id", F.round("ra", 6).alias("ra"), F.round("dec", 6).alias("dec"))


@query("p3_prepare_pair", with_(ctes("galaxies", "randoms"), pixed("gp", "galaxies", 8), pixed("rp", "randoms", 8)) + _DRAW + f""",
both_ AS (SELECT 'D' AS catalog, pix, {Z_CASE} AS zbin FROM gp UNION ALL SELECT 'R', pix, {Z_CASE} FROM kept)
SELECT catalog, zbin, pix, count(*) AS n FROM both_ WHERE zbin IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    p = prepare_pair(read(spark, sf, "galaxies"), read(spark, sf, "randoms"), ZBINS, 8, normalize=True, order=F.expr(_ORDER))
    return p.by_bin


@query("p3_fit_randoms", with_(ctes("galaxies", "randoms"), pixed("gp", "galaxies", 8), pixed("rp", "randoms", 8)) + _DRAW + """
SELECT 0 AS corr_id, 'R0' AS catalog, id FROM kept UNION ALL SELECT 0, 'D0', id FROM galaxies
UNION ALL SELECT 1, 'R0', id FROM randoms UNION ALL SELECT 1, 'D0', id FROM galaxies""")
def _(spark, sf):
    both = read(spark, sf, "galaxies").select(F.lit("D0").alias("catalog"), "id", "ra", "dec").unionByName(
        read(spark, sf, "randoms").select(F.lit("R0").alias("catalog"), "id", "ra", "dec"))
    p = both.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("corr_id"))
    corrs = spark.createDataFrame([(0, "auto", True), (1, "auto", False)], "corr_id int, type string, normalize boolean")
    return P.fit_randoms(p, corrs, 8, F.expr(_ORDER)).select("corr_id", "catalog", "id")


@query("p3_prepare_populations", with_(ctes("galaxies", "randoms"), pixed("gp", "galaxies", 8), pixed("rp", "randoms", 8)) + _DRAW + """
SELECT 'before' AS stage, 'D' AS catalog, pix, count(*) AS n FROM gp GROUP BY pix UNION ALL SELECT 'before', 'R', pix, count(*) FROM rp GROUP BY pix
UNION ALL SELECT 'after', 'D', pix, count(*) FROM gp GROUP BY pix UNION ALL SELECT 'after', 'R', pix, count(*) FROM kept GROUP BY pix""")
def _(spark, sf):
    p = prepare_pair(read(spark, sf, "galaxies"), read(spark, sf, "randoms"), ZBINS, 8, normalize=True, order=F.expr(_ORDER))
    stage = lambda df, name: df.select(F.lit(name).alias("stage"), "catalog", "pix", "n")
    return stage(p.before, "before").unionByName(stage(p.after, "after"))


# ---------------------------------------------------------------- masks and cuts

SPOTS = [(139.0, 140.0, -1.0, 0.5), (142.0, 142.6, -3.0, 3.0)]
BAD = [(136.0, 136.5, 0.0, 2.0)]
PATCH = (130.0, 150.0, -4.5, 4.5)


def _in(boxes):
    return " OR ".join(f"(ra > {a}e0 AND ra < {b}e0 AND dec > {c}e0 AND dec < {e}e0)" for a, b, c, e in boxes)


@query("f1_in_boxes", with_(ctes("galaxies")) + f" SELECT id FROM galaxies WHERE NOT ({_in(SPOTS)})")
def _(spark, sf):
    return read(spark, sf, "galaxies").where(~M.in_boxes("ra", "dec", SPOTS)).select("id")


_BOXES = "SELECT ra - 0.3e0 - 0.001e0*(id % 100) AS ra0, ra + 0.2e0 AS ra1, dec - 0.1e0 AS dec0, dec + 0.25e0 AS dec1 FROM quasars"


@query("f1_box_mask_table", with_(ctes("galaxies", "quasars")) + f""", b AS ({_BOXES})
SELECT id FROM galaxies g WHERE NOT EXISTS (SELECT 1 FROM b WHERE g.ra > ra0 AND g.ra < ra1 AND g.dec > dec0 AND g.dec < dec1)""")
def _(spark, sf):
    b = read(spark, sf, "quasars").selectExpr(
        "ra - 0.3e0 - 0.001e0*(id % 100) as ra0", "ra + 0.2e0 as ra1", "dec - 0.1e0 as dec0", "dec + 0.25e0 as dec1")
    return M.box_mask(read(spark, sf, "galaxies"), b, cell_deg=0.5).select("id")


@query("f2_outside_patch", with_(ctes("galaxies")) + f" SELECT id, NOT ({_in([PATCH])}) AS outside, false AS off FROM galaxies")
def _(spark, sf):
    return read(spark, sf, "galaxies").select(
        "id", M.outside_patch("ra", "dec", PATCH).alias("outside"), M.outside_patch("ra", "dec", PATCH, False).alias("off"))


# a polygon per quasar: a cap round it cut by the outside of a smaller cap
_CAPS = f"""qx AS (SELECT id, cos(radians(ra))*cos(radians(dec)) AS x, sin(radians(ra))*cos(radians(dec)) AS y, sin(radians(dec)) AS z FROM quasars),
caps AS (SELECT id AS polygon_id, x, y, z, 1e0-cos(radians(0.25e0)) AS cm FROM qx
 UNION ALL SELECT id, x, y, z, -(1e0-cos(radians(0.05e0))) FROM qx)"""
_INSIDE = "CASE WHEN cm >= 0 THEN 1e0-(c.x*g.x+c.y*g.y+c.z*g.z) < cm ELSE 1e0-(c.x*g.x+c.y*g.y+c.z*g.z) > -cm END"


def _caps(spark, sf):
    q = read(spark, sf, "quasars").selectExpr(
        "id as polygon_id", "cos(radians(ra))*cos(radians(dec)) as x", "sin(radians(ra))*cos(radians(dec)) as y", "sin(radians(dec)) as z")
    big = q.withColumn("one_minus_cos", F.lit(1 - math.cos(math.radians(0.25))))
    small = q.withColumn("one_minus_cos", F.lit(-(1 - math.cos(math.radians(0.05)))))
    return big.unionByName(small)


@query("f3_polygon_flag", with_(ctes("randoms", "quasars"), _CAPS, f"""g AS (SELECT id, cos(radians(ra))*cos(radians(dec)) AS x,
 sin(radians(ra))*cos(radians(dec)) AS y, sin(radians(dec)) AS z, dec FROM randoms)""") + f""",
hit AS (SELECT DISTINCT id FROM (SELECT g.id, polygon_id, bool_and({_INSIDE}) AS inside FROM g, caps c GROUP BY ALL) WHERE inside)
SELECT id, id NOT IN (FROM hit) AS mask_ok FROM randoms""")
def _(spark, sf):
    return M.polygon_flag(read(spark, sf, "randoms"), _caps(spark, sf), frame="given").select("id", "mask_ok")


def _gal(i, t):
    from skytally.functions.geometry import GALACTIC_ROTATION as R
    return f"({R[i][0]!r}e0*{t}.x + {R[i][1]!r}e0*{t}.y + {R[i][2]!r}e0*{t}.z)"


# the same polygons in galactic axes: a point is inside where it is inside unrotated
@query("f3_polygon_mask_galactic", with_(ctes("galaxies", "quasars"), _CAPS, """g AS (SELECT id, cos(radians(ra))*cos(radians(dec)) AS x,
 sin(radians(ra))*cos(radians(dec)) AS y, sin(radians(dec)) AS z FROM galaxies)""") + f""",
hit AS (SELECT DISTINCT id FROM (SELECT g.id, polygon_id, bool_and({_INSIDE}) AS inside FROM g, caps c GROUP BY ALL) WHERE inside)
SELECT id FROM galaxies WHERE id NOT IN (FROM hit)""")
def _(spark, sf):
    caps = _caps(spark, sf).alias("c").selectExpr(
        "polygon_id", *[f"{_gal(i, 'c')} as {n}" for i, n in enumerate("xyz")], "one_minus_cos")
    return M.polygon_mask(read(spark, sf, "galaxies"), caps).select("id")


_GAL_OK = (f"NOT ({_in(SPOTS)}) AND NOT ({_in(BAD)}) AND ({_in([PATCH])}) AND wise_flag > 0 AND z_std > 0 AND redshift > 0.3e0 "
           "AND redshift < 1.1e0 AND extendedness > 0.3e0 AND imag <= 24e0")


@query("f4_galaxy_quality_cut", with_(ctes("galaxies")) + f" SELECT id FROM galaxies WHERE {_GAL_OK}")
def _(spark, sf):
    return read(spark, sf, "galaxies").where(M.galaxy_quality_cut(0.3, 1.1, SPOTS, BAD, PATCH)).select("id")


_BEST = ("CASE WHEN specz IS NULL OR isnan(specz) THEN redshift ELSE specz END AS zb, "
         "CASE WHEN specz IS NULL OR isnan(specz) THEN (abs(z_up-redshift)+abs(redshift-z_lo))/2e0 ELSE 0.01e0 END AS zs")


@query("f5_agn_quality_cut", with_(ctes("quasars")) + f""", q AS (SELECT *, {_BEST} FROM quasars)
SELECT id, (conf > 0.5e0 AND zb >= 0.3e0 AND zb < 1.1e0) AS every,
 (p_t1 > 0.5e0 AND conf > 0.5e0 AND zb >= 0.3e0 AND zb < 1.1e0) AS type1,
 (p_t2 > 0.5e0 AND conf > 0.5e0 AND zb >= 0.3e0 AND zb < 1.1e0) AS type2,
 (specz IS NOT NULL AND NOT isnan(specz) AND conf > 0.5e0 AND zb >= 0.3e0 AND zb < 1.1e0) AS spec,
 (z_match IS NOT NULL AND zb >= 0.3e0 AND zb < 1.1e0) AS matched FROM q""")
def _(spark, sf):
    from skytally.plans.figures import with_best_redshift
    q = with_best_redshift(read(spark, sf, "quasars"))
    cut = lambda kind, **kw: F.coalesce(M.agn_quality_cut(0.3, 1.1, kind, **kw), F.lit(False))
    return q.select("id", cut(0).alias("every"), cut(1).alias("type1"), cut(2).alias("type2"), cut(3).alias("spec"),
                    cut(0, matched=True, confidence=None).alias("matched"))


_LOW = " OR ".join(f"(zb > {a}e0 AND zb < {b}e0 AND lum < {t}e0)" for a, b, t in zip(
    (0.3, 0.4, 0.5, 0.6, 0.7), (0.4, 0.5, 0.6, 0.7, 0.8), (43.70, 44.15, 44.35, 44.45, 44.55)))


@query("f6_cut_by_bin", with_(ctes("quasars")) + f""", q AS (SELECT *, {_BEST} FROM quasars), p AS (SELECT id, NOT ({_LOW}) AS ok FROM q)
SELECT id, NULL AS fraction FROM p WHERE ok UNION ALL SELECT NULL, round(avg(cast(ok AS int)), 6) FROM p""")
def _(spark, sf):
    from skytally.plans.figures import LUM_CUTS, LUM_Z_EDGES, with_best_redshift
    kept, part = M.cut_by_bin(with_best_redshift(read(spark, sf, "quasars")), "lum", "z", LUM_Z_EDGES, LUM_CUTS)
    return kept.select("id").unionByName(part.select(F.round("fraction", 6).alias("fraction")), allowMissingColumns=True)


@query("f8_not_null_visits", with_(ctes("visits")) + " SELECT visit_id, pntgid FROM visits WHERE NOT is_null")
def _(spark, sf):
    return FP.not_null_visits(read(spark, sf, "visits")).select("visit_id", "pntgid")


@query("w1_first_per_pointing", with_(ctes("visits")) + """
SELECT visit_id, pntgid, filter FROM (SELECT *, row_number() OVER (PARTITION BY pntgid ORDER BY visit_id) AS r FROM visits WHERE NOT is_null) WHERE r = 1""")
def _(spark, sf):
    return FP.first_per_pointing(FP.not_null_visits(read(spark, sf, "visits"))).select("visit_id", "pntgid", "filter")


COVER_NS, COVER_R = 1024, 0.75
_VIS = f"v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pntgid ORDER BY visit_id) AS r FROM visits WHERE NOT is_null) WHERE r = 1)"
_CHORD = 2 * math.sin(math.radians(COVER_R / 2))
# centres of the rings that a strip of declination round each visit meets, and of these the slots round its right ascension;
# all visits lie in the belt of equal rings, within 41 degrees of the equator
_COVER = f"""{_VIS}, {xyzed('vx', 'v')},
strip AS (SELECT *, unnest(range(cast(floor({2 * COVER_NS} - {1.5 * COVER_NS}e0*(z + {_CHORD!r}e0)) AS bigint) - 1, cast(ceil({2 * COVER_NS} - {1.5 * COVER_NS}e0*(z - {_CHORD!r}e0)) AS bigint) + 2)) AS ring FROM vx),
slots AS (SELECT visit_id, filter, x, y, z, ring, unnest(range(cast(floor((radians(ra) - 1.05e0*{_CHORD!r}e0/cos(radians(dec)))*{2 * COVER_NS}e0/{PI}) AS bigint) - 1,
  cast(ceil((radians(ra) + 1.05e0*{_CHORD!r}e0/cos(radians(dec)))*{2 * COVER_NS}e0/{PI}) AS bigint) + 2)) AS slot FROM strip),
cen AS (SELECT visit_id, filter, x, y, z, {2 * COVER_NS * (COVER_NS - 1)} + (ring - {COVER_NS})*{4 * COVER_NS} + ((slot % {4 * COVER_NS}) + {4 * COVER_NS}) % {4 * COVER_NS} AS pix,
  ({2 * COVER_NS} - ring)*2e0/{3 * COVER_NS}e0 AS cz, (slot + CASE WHEN (ring - {COVER_NS}) % 2 = 0 THEN 0.5e0 ELSE 0e0 END)*{PI}/{2 * COVER_NS}e0 AS phi FROM slots),
cov AS (SELECT visit_id, left(filter, 1) AS band, pix FROM cen WHERE (x-sqrt(1e0-cz*cz)*cos(phi))*(x-sqrt(1e0-cz*cz)*cos(phi))
 + (y-sqrt(1e0-cz*cz)*sin(phi))*(y-sqrt(1e0-cz*cz)*sin(phi)) + (z-cz)*(z-cz) <= {_CHORD ** 2!r}e0)"""
_DEEP = "deep AS (SELECT pix, band FROM cov GROUP BY pix, band HAVING count(*) >= CASE WHEN band IN ('g', 'r') THEN 4 ELSE 6 END)"
_FULL = "full_ AS (SELECT pix FROM deep GROUP BY pix HAVING count(*) = 5)"


def _visits(spark, sf):
    return FP.first_per_pointing(FP.not_null_visits(read(spark, sf, "visits")))


@query("j7_disc_coverage", with_(ctes("visits"), _COVER) + " SELECT visit_id, pix FROM cov")
def _(spark, sf):
    return FP.disc_coverage(_visits(spark, sf), COVER_R, COVER_NS).select("visit_id", "pix")


@query("f9_band_depth", with_(ctes("visits"), _COVER) + " SELECT pix, band, count(*) AS n FROM cov GROUP BY pix, band")
def _(spark, sf):
    return FP.band_depth(_visits(spark, sf))


@query("f9_full_depth_footprint", with_(ctes("visits"), _COVER, _DEEP, _FULL) + " SELECT pix FROM full_")
def _(spark, sf):
    return FP.full_depth_footprint(_visits(spark, sf))


_AREA = f"count(*) AS pixels, round(129600/{PI}*count(*)/{12 * COVER_NS ** 2}e0, 6) AS area"


@query("f10_footprint_area", with_(ctes("visits"), _COVER, _DEEP, _FULL) + f"""
SELECT band, {_AREA} FROM deep GROUP BY band UNION ALL SELECT 'all' AS band, {_AREA} FROM full_""")
def _(spark, sf):
    deep = FP.deep_pixels(FP.band_depth(_visits(spark, sf)))
    area = FP.footprint_area(deep, COVER_NS, ["band"])
    both = FP.footprint_area(FP.full_depth(deep), COVER_NS).select(F.lit("all").alias("band"), "pixels", "area")
    return area.unionByName(both).select("band", "pixels", F.round("area", 6).alias("area"))


# places where galaxies crowd, and what connects over edges to the fullest of them
_CROWD = f"""{pixed('p', 'galaxies', 64)}, m AS (SELECT pix FROM p GROUP BY pix HAVING count(*) >= 2),
seed AS (SELECT pix FROM p GROUP BY pix ORDER BY count(*) DESC, pix LIMIT 3)"""


@query("f11_contiguous_region", with_(ctes("galaxies"), _CROWD, sky(64)).replace("WITH ", "WITH RECURSIVE ", 1) + """,
mc AS (SELECT pix, corners.cx, corners.cy, corners.cz FROM corners JOIN m USING (pix)),
en AS (SELECT a.pix, b.pix AS near FROM mc a JOIN mc b USING (cx, cy, cz) WHERE a.pix <> b.pix GROUP BY ALL HAVING count(*) = 2),
reg AS (SELECT pix FROM seed UNION SELECT en.near FROM reg JOIN en ON en.pix = reg.pix)
SELECT pix FROM reg""")
def _(spark, sf):
    c = H.count_per_pixel(read(spark, sf, "galaxies"), 64)
    seeds = c.orderBy(F.desc("n"), "pix").limit(3)
    return FP.contiguous_region(c.where("n >= 2").select("pix"), seeds, 64)


@query("f12_in_footprint", with_(ctes("randoms", "galaxies"), pixed("gp", "galaxies", 64), pixed("rp", "randoms", 64)) +
       " SELECT id FROM rp WHERE pix IN (SELECT pix FROM gp)")
def _(spark, sf):
    mask = H.count_per_pixel(read(spark, sf, "galaxies"), 64)
    return M.in_footprint(read(spark, sf, "randoms"), mask, 64).select("id")


@query("u3_union_of_masks", with_(ctes("galaxies", "quasars"), pixed("gp", "galaxies", 64), pixed("qp", "quasars", 64)) +
       " SELECT pix FROM gp UNION SELECT pix FROM qp")
def _(spark, sf):
    a = H.count_per_pixel(read(spark, sf, "galaxies"), 64).select("pix")
    return a.union(H.count_per_pixel(read(spark, sf, "quasars"), 64).select("pix")).distinct()


@query("j3_match_by_id", with_(ctes("curves")) + """
SELECT o_orderkey AS object_id, round(o_totalprice, 2) AS price, round(cast(pdz[1] AS double), 6) AS head FROM orders JOIN curves ON object_id = o_orderkey""")
def _(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("object_id"), F.round("o_totalprice", 2).alias("price"))
    j = match_by_id(o, read(spark, sf, "curves"))
    return j.select("object_id", "price", F.round(F.element_at("pdz", 1).cast("double"), 6).alias("head"))

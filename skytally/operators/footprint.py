"""Survey footprints: depth by visits, area, and connected regions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.healpix import ang2pix, disc_pixels, edge_neighbours, npix
from ..functions.scalars import band_letter
from ..lineage import cut

# Exposures each band needs, and field centres in degrees.
FULL_DEPTH = {"g": 4, "r": 4, "i": 6, "z": 6, "y": 6}
FIELD_CENTRES = {
    "AEGIS": (215.0, 52.5), "HECTOMAP": (240.0, 43.0), "GAMA09H": (137.0, 1.0), "WIDE12H": (180.0, 0.0),
    "GAMA15H": (220.0, 0.0), "VVDS": (336.0, 1.0), "XMM": (34.0, -4.0),
}


def not_null_visits(visits: DataFrame, flag: str = "is_null") -> DataFrame:
    return visits.where(~F.col(flag))


def first_per_pointing(visits: DataFrame, key: str = "pntgid", order: str = "visit_id") -> DataFrame:
    """One visit per pointing: the one that comes first."""
    others = F.struct(order, *[c for c in visits.columns if c not in (key, order)])
    best = visits.groupBy(key).agg(F.min_by(others, F.col(order)).alias("v"))
    return best.select(key, "v.*").select(*visits.columns)


def disc_coverage(points: DataFrame, radius_deg: float, nside: int, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """Each row repeated for the pixels whose centre it covers."""
    return disc_pixels(points, radius_deg, nside, ra, dec)


def band_depth(visits: DataFrame, radius_deg: float = 0.75, nside: int = 1024) -> DataFrame:
    """``pix, band, n``: visits that cover each pixel, per band."""
    v = visits.select("ra", "dec", band_letter("filter").alias("band"))
    return disc_pixels(v, radius_deg, nside).groupBy("pix", "band").agg(F.count(F.lit(1)).alias("n"))


def deep_pixels(depth: DataFrame, need: dict[str, int] = FULL_DEPTH) -> DataFrame:
    """``pix, band`` where a band has its exposures."""
    ok = F.lit(False)
    for band, n in need.items():
        ok = ok | ((F.col("band") == band) & (F.col("n") >= n))
    return depth.where(ok).select("pix", "band")


def full_depth(deep: DataFrame, need: dict[str, int] = FULL_DEPTH) -> DataFrame:
    """``pix`` where every band is deep; ``deep`` is :func:`deep_pixels`."""
    return deep.groupBy("pix").agg(F.count(F.lit(1)).alias("bands")).where(F.col("bands") == len(need)).select("pix")


def full_depth_footprint(visits: DataFrame, need: dict[str, int] = FULL_DEPTH, radius_deg: float = 0.75,
                         nside: int = 1024) -> DataFrame:
    """``pix`` where every band has its exposures."""
    return full_depth(deep_pixels(band_depth(visits, radius_deg, nside), need), need)


def footprint_area(mask: DataFrame, nside: int, keys=()) -> DataFrame:
    """``*keys, pixels, area``: square degrees of a mask table."""
    g = mask.groupBy(*keys).agg(F.count(F.lit(1)).alias("pixels"))
    return g.withColumn("area", F.lit(129600 / math.pi) * F.col("pixels") / F.lit(float(npix(nside))))


def seed_pixels(spark: SparkSession, nside: int, seeds=FIELD_CENTRES) -> DataFrame:
    rows = [(name, float(ra), float(dec)) for name, (ra, dec) in dict(seeds).items()]
    return spark.createDataFrame(rows, "field string, ra double, dec double").select(
        "field", ang2pix(nside, "ra", "dec").alias("pix"))


def connected_labels(edges: DataFrame) -> DataFrame:
    """``pix, label``: the lowest pixel of each connected part of ``pix, near``.

    Alternating star contraction (Kiveris et al. 2014): the number of rounds grows
    with the logarithm of the size of a part, not with its width.
    """
    e = cut(edges.where("pix > near").select(F.col("pix").alias("u"), F.col("near").alias("v")).distinct())
    before = None
    while True:
        # large star: point every larger neighbour at the smallest one
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: link a pixel's smaller neighbours, and itself, to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(low, "u")
        small = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            j.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = cut(small)
        state = e.agg(F.count(F.lit(1)), F.sum("v"), F.sum(F.xxhash64("u", "v") % F.lit(1000003))).first()
        if state == before:
            break
        before = state
    return e.select(F.col("u").alias("pix"), F.col("v").alias("label"))


def contiguous_region(mask: DataFrame, seeds: DataFrame, nside: int) -> DataFrame:
    """``pix`` of the mask that connect to a seed pixel over whole edges.

    A seed outside the mask is an error, raised when the result is read.
    """
    m = cut(mask.select("pix").distinct())
    near = edge_neighbours(mask.sparkSession, nside, m)
    labels = connected_labels(near)
    # a part's lowest pixel, and a pixel without neighbours, stand for themselves
    own = m.join(labels, "pix", "left").select("pix", F.coalesce("label", "pix").alias("label"))
    at_seed = seeds.select("pix").distinct().join(own, "pix", "left")
    wanted = at_seed.select(
        F.when(F.col("label").isNull(), F.raise_error(F.lit("a seed lies outside the mask")))
        .otherwise(F.col("label")).cast("long").alias("label")
    ).distinct()
    return own.join(wanted, "label", "left_semi").select("pix")

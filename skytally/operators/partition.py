"""Splitting catalogs by sky and redshift, and fitting random catalogs to data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.healpix import with_pixel
from ..functions.scalars import zbin_index
from .histograms import count_per_pixel
from .masks import in_footprint

# rows ranked together when an exact number is drawn from a pixel
RANK_BLOCK = 4096


def split_by_pixel(df: DataFrame, nside: int, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """Rows with their pixel; write with ``partitionBy('pix')`` for one folder per pixel."""
    return with_pixel(df, nside, ra, dec)


def split_by_z(df: DataFrame, edges, z: str | None = "redshift", use_zbins: bool = True) -> DataFrame:
    """Rows with their redshift bin, the redshift dropped, rows outside all bins left out.

    Without bins everything is bin 0; a catalog without redshift (``z=None`` or no such
    column) goes whole into every bin.
    """
    has = z is not None and z in df.columns
    if not use_zbins:
        out = df.withColumn("zbin", F.lit(0))
    elif not has:
        return replicate_per_bin(df, len(edges) - 1)
    else:
        out = df.withColumn("zbin", zbin_index(z, edges)).where("zbin is not null")
    return out.drop(z) if has else out


def replicate_per_bin(df: DataFrame, bins: int) -> DataFrame:
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("zbin"))


def split_by_correlation(points: DataFrame, corrs: DataFrame, zbins) -> DataFrame:
    """Points of many correlations with their ``zbin``, the redshift dropped.

    A catalog of a correlation that has no redshift at all goes whole into every bin; in
    others a missing redshift is outside all bins. Correlations whose ``use_zbins`` is
    False (``corrs`` may lack the column) have bin 0 only, as all have without ``zbins``.
    """
    if zbins is None:
        return points.drop("redshift").withColumn("zbin", F.lit(0))
    p = points if "redshift" in points.columns else points.withColumn("redshift", F.lit(None).cast("double"))
    # one row per catalog and correlation
    kinds = p.groupBy("corr_id", "catalog").agg(F.bool_or(F.col("redshift").isNotNull()).alias("_has"))
    use = F.coalesce("use_zbins", F.lit(True)) if "use_zbins" in corrs.columns else F.lit(True)
    kinds = kinds.join(corrs.select("corr_id", use.alias("_use")), "corr_id")
    own = zbin_index("redshift", zbins)
    bins = (F.when(~F.col("_use"), F.array(F.lit(0))).when(~F.col("_has"), F.sequence(F.lit(0), F.lit(len(zbins) - 2)))
            .when(own.isNotNull(), F.array(own)).otherwise(F.array().cast("array<int>")))
    # a row a catalog, sent to the points: dealt by so few keys, a whole catalog would be sorted in one task
    return p.join(F.broadcast(kinds), ["corr_id", "catalog"]).withColumn("zbin", F.explode(bins)).drop("redshift", "_has", "_use")


def hash_order(key: str, seed: int = 0) -> Column:
    """A repeatable even number in [0, 1) for each key."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(2 ** 53))


def draw_fraction(df: DataFrame, keys, keep: Column, order: Column, key: str = "id") -> DataFrame:
    """Exactly ``floor(keep * n)`` rows of each group of n, without replacement.

    ``order`` is an even number in [0, 1) per row; the rows with the smallest are
    drawn, ties by ``key``. A group is ranked in blocks of its order value, so a
    group with most of the rows is not sorted in one place. ``keep`` may use the
    columns of ``df`` (constant within a group).
    """
    keys = list(keys)
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(keep).alias("_f"))
    d = df.withColumn("_u", order).join(size, keys)
    blocks = F.ceil(F.col("_n") / F.lit(RANK_BLOCK))
    d = d.withColumn("_b", F.least(F.floor(F.col("_u") * blocks), blocks - 1))
    d = d.withColumn("_want", F.floor(F.col("_f") * F.col("_n")))
    before = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_in"))
    w = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    before = before.select(*keys, "_b", F.coalesce(F.sum("_in").over(w), F.lit(0)).alias("_before"))
    d = d.join(before, [*keys, "_b"])
    rank = F.row_number().over(W.partitionBy(*keys, "_b").orderBy("_u", key))
    return d.withColumn("_r", rank).where(F.col("_before") + F.col("_r") <= F.col("_want")).select(*df.columns)


def random_fractions(data: DataFrame, randoms: DataFrame, keys=()) -> DataFrame:
    """``*keys, pix, n_data, n_random, fraction``: the part of each pixel's randoms to keep.

    ``data`` and ``randoms`` are count tables ``*keys, pix, n``. The fraction follows data over
    randoms, each relative to its fullest pixel, scaled to at most 1; 0 where undefined.
    """
    keys = list(keys)
    d = data.select(*keys, "pix", F.col("n").alias("n_data"))
    r = randoms.select(*keys, "pix", F.col("n").alias("n_random"))
    # one row per pixel, a number fixed by nside, so whole-sky maxima are a window
    sky = W.partitionBy(*(keys or [F.lit(0)]))
    j = r.join(d, [*keys, "pix"], "full").na.fill(0, ["n_data", "n_random"])
    j = j.withColumns({"_d": F.max("n_data").over(sky), "_r": F.max("n_random").over(sky)}).where("n_random > 0")
    f = F.try_divide(F.try_divide(F.col("n_data").cast("double"), F.col("_d")),
                     F.try_divide(F.col("n_random").cast("double"), F.col("_r")))
    j = j.withColumn("_f", F.coalesce(f, F.lit(0.0))).withColumn("_top", F.max("_f").over(sky))
    return j.select(
        *keys, "pix", "n_data", "n_random", F.coalesce(F.try_divide(F.col("_f"), F.col("_top")), F.lit(0.0)).alias("fraction"))


def normalize_random(data: DataFrame, randoms: DataFrame, nside: int = 8, order: Column | None = None,
                     key: str = "id") -> DataFrame:
    """Random rows thinned per pixel to follow the data's large-scale density."""
    r = with_pixel(randoms.where("ra is not null and dec is not null"), nside, name="_pix")
    fr = random_fractions(count_per_pixel(data.drop("pix"), nside), count_per_pixel(randoms.drop("pix"), nside))
    r = r.join(fr.select(F.col("pix").alias("_pix"), "fraction"), "_pix")
    u = order if order is not None else hash_order(key)
    return draw_fraction(r, ["_pix"], F.col("fraction"), u, key).select(*randoms.columns)


def fit_randoms(points: DataFrame, corrs: DataFrame, nside: int = 8, order: Column | None = None, key: str = "id") -> DataFrame:
    """Points whose random catalogs follow their data catalog, in correlations whose ``normalize`` is set.

    Catalog ``R0`` follows ``D0``, ``R1`` follows ``D1`` and so on; all catalogs are fitted in one pass.
    """
    if "normalize" not in corrs.columns:
        return points
    wanted = corrs.where("normalize").select("corr_id")
    rest = points.join(wanted, "corr_id", "left_anti").unionByName(points.join(wanted, "corr_id", "left_semi").where("catalog like 'D%'"))
    p = with_pixel(points.join(wanted, "corr_id", "left_semi").where("ra is not null and dec is not null"), nside, name="_pix")
    p = p.withColumn("_slot", F.substring("catalog", 2, 9))
    keys = ["corr_id", "_slot"]
    n = lambda kind: p.where(F.col("catalog").startswith(kind)).groupBy(*keys, F.col("_pix").alias("pix")).agg(F.count(F.lit(1)).alias("n"))
    fr = random_fractions(n("D"), n("R"), keys)
    r = p.where("catalog like 'R%'").join(fr.select(*keys, F.col("pix").alias("_pix"), "fraction"), [*keys, "_pix"])
    drawn = draw_fraction(r, [*keys, "_pix"], F.col("fraction"), order if order is not None else hash_order(key), key)
    return rest.unionByName(drawn.select(*points.columns))


def random_catalog(spark: SparkSession, n: int, mask: DataFrame | None, nside: int, seed: int = 0, even=None) -> DataFrame:
    """``id, ra, dec``: even points on the sphere, kept inside a footprint if one is given.

    ``even(id, k)`` gives the k-th even number in [0, 1) of a row, hashes by default.
    """
    even = even or (lambda c, k: hash_order(c, seed + k))
    p = spark.range(n).select(
        "id",
        (even("id", 0) * F.lit(360.0)).alias("ra"),
        F.degrees(F.asin(F.lit(2.0) * even("id", 1) - F.lit(1.0))).alias("dec"),
    )
    return p if mask is None else in_footprint(p, mask, nside)

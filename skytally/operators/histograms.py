"""Counts per pixel, bin and cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.healpix import npix, with_pixel
from ..functions.scalars import known


def count_per_pixel(df: DataFrame, nside: int, ra: str = "ra", dec: str = "dec", keys=()) -> DataFrame:
    p = df if "pix" in df.columns else with_pixel(df.where(F.col(ra).isNotNull() & F.col(dec).isNotNull()), nside, ra, dec)
    return p.groupBy(*keys, "pix").agg(F.count(F.lit(1)).alias("n"))


def pixel_stats(counts: DataFrame, keys=()) -> DataFrame:
    """``*keys, total, occupied``."""
    return counts.where("n > 0").groupBy(*keys).agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("occupied"))


def dense_pixel_map(counts: DataFrame, nside: int) -> DataFrame:
    """Every pixel of the sky, 0 where there is no data."""
    sky = counts.sparkSession.range(npix(nside)).withColumnRenamed("id", "pix")
    return sky.join(counts.select("pix", "n"), "pix", "left").select("pix", F.coalesce("n", F.lit(0)).alias("n"))


def even_bin(x: Column | str, lo: float, hi: float, bins: int) -> Column:
    """Bin number 0..bins-1 of an even histogram, the last bin closed; NULL outside."""
    x = known(x)
    i = F.floor((x - F.lit(float(lo))) / F.lit((hi - lo) / bins)).cast("int")
    inside = (x >= F.lit(float(lo))) & (x <= F.lit(float(hi)))
    return F.when(inside, F.least(i, F.lit(bins - 1)))


def hist1d(df: DataFrame, x: str, lo: float, hi: float, bins: int, keys=()) -> DataFrame:
    """``*keys, bin_idx, lo, hi, n`` of the occupied bins."""
    width = (hi - lo) / bins
    h = df.withColumn("bin_idx", even_bin(x, lo, hi, bins)).where("bin_idx is not null")
    h = h.groupBy(*keys, "bin_idx").agg(F.count(F.lit(1)).alias("n"))
    at = lambda k: F.lit(float(lo)) + (F.col("bin_idx") + F.lit(k)) * F.lit(width)
    return h.select(*keys, "bin_idx", at(0).alias("lo"), at(1).alias("hi"), "n")


def z_histogram(df: DataFrame, lo: float, hi: float, bins: int = 29, z: str = "redshift", keys=()) -> DataFrame:
    """The same with ``density`` = n / (N * width) over the whole set."""
    h = hist1d(df, z, lo, hi, bins, keys)
    total = F.sum("n").over(W.partitionBy(*(keys or [F.lit(0)])))
    density = F.col("n") / (total * F.lit((hi - lo) / bins))
    return h.select(*keys, "bin_idx", "lo", "hi", "n", density.alias("density"))


def hist2d(df: DataFrame, x: str, y: str, x_range, y_range, bins, keys=()) -> DataFrame:
    """``*keys, ix, iy, n`` of the occupied cells."""
    c = df.withColumns({"ix": even_bin(x, *x_range, bins[0]), "iy": even_bin(y, *y_range, bins[1])})
    return c.where("ix is not null and iy is not null").groupBy(*keys, "ix", "iy").agg(F.count(F.lit(1)).alias("n"))


def joint_histogram(df: DataFrame, sample: str, x: str, y: str, x_range, y_range, bins) -> DataFrame:
    """Counts and both marginals of several samples on shared edges, in one pass.

    A marginal row has NULL in the other axis.
    """
    c = df.withColumns({"ix": even_bin(x, *x_range, bins[0]), "iy": even_bin(y, *y_range, bins[1])})
    c = c.where("ix is not null and iy is not null").select(F.col(sample).alias("sample"), "ix", "iy")
    cells = c.groupBy("sample", "ix", "iy").agg(F.count(F.lit(1)).alias("n"))
    sets = [[F.col("sample"), F.col("ix"), F.col("iy")], [F.col("sample"), F.col("ix")], [F.col("sample"), F.col("iy")]]
    return cells.groupingSets(sets, "sample", "ix", "iy").agg(F.sum("n").alias("n"))


def contour_levels(cells: DataFrame, fractions=(0.1, 0.3, 0.6), keys=()) -> DataFrame:
    """Cells with ``level``: how many of the given fractions of the peak they reach."""
    # cells are few: their number is fixed by the bins
    c = cells.withColumn("peak", F.max("n").over(W.partitionBy(*(keys or [F.lit(0)]))))
    level = sum(((F.col("n") >= F.lit(float(f)) * F.col("peak")).cast("int") for f in fractions), F.lit(0))
    return c.withColumn("level", level).drop("peak")


def count_by_group(before: DataFrame, after: DataFrame) -> DataFrame:
    """``stage, n``: rows before and after a step."""
    stage = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
    return stage(before, "before").unionByName(stage(after, "after"))


def top_pixels(shares: DataFrame, num: int) -> DataFrame:
    """The ``num`` pixels of largest share; fewer occupied pixels than that is an error."""
    top = shares.where("share > 0").orderBy(F.desc("share"), F.desc("pix")).limit(num)
    out = top.withColumn("have", F.count(F.lit(1)).over(W.partitionBy(F.lit(0))))
    safe = F.when(F.col("have") < num, F.raise_error(F.lit("fewer occupied pixels than asked for"))).otherwise(F.col("pix"))
    return out.select(safe.cast("long").alias("pix"), "share")

"""Redshift distributions and other curves kept as rows ``curve_id, x, y``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import gauss, linear_grid
from ..lineage import wide_tasks


def gauss_sum(df: DataFrame, mu: str, sigma: str, lo: float = 0.0, hi: float = 4.0, num: int = 500, keys=()) -> DataFrame:
    """``*keys, i, x, y``: sum of each row's normal density on an even grid.

    The grid is unrolled row by row inside the map-side aggregation, so only the two
    numbers of a row and the grid points are shuffled. Rows are dealt evenly before: a
    file read by one task holds many densities.
    """
    g = df.where(F.col(mu).isNotNull() & (F.col(sigma) > 0))
    g = g.select(*keys, F.col(mu).alias("mu"), F.col(sigma).alias("sigma")).repartition(wide_tasks(df))
    g = g.select(*keys, "mu", "sigma", F.explode(linear_grid(lo, hi, num)).alias("g"))
    s = g.groupBy(*keys, F.col("g.i").alias("i")).agg(
        F.sum(gauss(F.col("g.x"), F.col("mu"), F.col("sigma"))).alias("y"))
    step = (hi - lo) / (num - 1)
    return s.select(*keys, "i", (F.lit(float(lo)) + F.col("i") * F.lit(step)).alias("x"), "y")


def trapz_even(ys: Column, step: float) -> Column:
    """Trapezoid area of an array on an even grid."""
    total = F.aggregate(ys, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    ends = (F.element_at(ys, 1).cast("double") + F.element_at(ys, -1).cast("double")) / F.lit(2.0)
    return (total - ends) * F.lit(step)


def stack_pdz(df: DataFrame, pdz: str, step: float, lo: float = 0.0, keys=(), specz: str | None = None,
              spec_sigma: float = 0.01) -> DataFrame:
    """``*keys, i, x, y``: sum of each row's curve divided by its own area.

    Rows with a value in ``specz`` add a narrow normal density instead, whether they have a
    curve or not. A curve of zero area adds nothing.
    """
    x = F.lit(float(lo)) + F.col("i") * F.lit(step)
    d = df.withColumn("_area", trapz_even(F.col(pdz), step))
    own = d.where(F.col(specz).isNull()) if specz else d
    s = own.select(*keys, "_area", F.posexplode(pdz).alias("i", "p")).select(*keys, "i", F.try_divide(F.col("p").cast("double"), F.col("_area")).alias("y"))
    if specz:
        # the grid is that of the longest curve, also for rows that have none themselves
        points = df.agg(F.max(F.size(pdz)).alias("n")).select(F.greatest("n", F.lit(0)).alias("n")).scalar()
        narrow = df.where(F.col(specz).isNotNull()).select(*keys, F.col(specz).alias("_s"), points.alias("_n")).where("_n > 0")
        narrow = narrow.select(*keys, "_s", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("i"))
        s = s.unionByName(narrow.select(*keys, "i", gauss(x, F.col("_s"), F.lit(spec_sigma)).alias("y")))
    s = s.groupBy(*keys, "i").agg(F.sum("y").alias("y"))
    return s.select(*keys, "i", x.alias("x"), "y")


def curve_area(curve: DataFrame, keys) -> DataFrame:
    """``*keys, area``: trapezoid area of each curve of ``*keys, x, y``."""
    w = W.partitionBy(*keys).orderBy("x")
    slab = (F.col("x") - F.lag("x").over(w)) * (F.col("y") + F.lag("y").over(w)) / F.lit(2.0)
    return curve.select(*keys, slab.alias("slab")).groupBy(*keys).agg(F.sum("slab").alias("area"))


def normalize_curve(curve: DataFrame, keys) -> DataFrame:
    """Each curve divided by its area."""
    return curve.join(curve_area(curve, keys), list(keys)).withColumn(
        "y", F.try_divide(F.col("y"), F.col("area"))).drop("area")


NODES = 256


def sorted_place(array: str, q: Column) -> Column:
    """How many elements of a sorted array lie at or below ``q``, less one: the segment that holds it."""
    return F.greatest(F.size(F.filter(F.col(array), lambda v: v <= q)) - 1, F.lit(0))


def interp(df: DataFrame, x: str, curve: DataFrame, key: str = "curve_id", name: str = "y") -> DataFrame:
    """Value of each row's curve at ``x``, linear between nodes and flat beyond the ends.

    ``df`` carries the curve's key. A curve is cut into blocks of 256 nodes by rank, whatever
    their spacing. A row finds its block among the curve's block starts (one short
    array for each curve) and joins it by curve and block; in the block's array
    it meets the one segment that holds it.
    """
    by = W.partitionBy(key).orderBy("x")
    nodes = curve.select(key, "x", "y", F.floor((F.row_number().over(by) - 1) / NODES).cast("int").alias("_block"),
                         F.lead("x").over(by).alias("_nx"), F.lead("y").over(by).alias("_ny"))
    # the first node of the next block closes a block
    blocks = nodes.groupBy(key, "_block").agg(
        F.array_sort(F.collect_list(F.struct("x", "y"))).alias("_p"), F.min("x").alias("_b0"),
        F.max(F.struct("x", "_nx", "_ny")).alias("_e"))
    closing = F.when(F.col("_e._nx").isNotNull(), F.array(F.struct(F.col("_e._nx").alias("x"), F.col("_e._ny").alias("y")))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
    plain = F.transform("_p", lambda v: F.struct(v.x.cast("double").alias("x"), v.y.cast("double").alias("y")))
    blocks = blocks.select(key, "_block", "_b0", F.concat(plain, F.transform(closing, lambda v: F.struct(v.x.cast("double").alias("x"), v.y.cast("double").alias("y")))).alias("_p"))
    starts = blocks.groupBy(key).agg(F.array_sort(F.collect_list("_b0")).alias("_starts"))
    d = df.join(starts, key, "left").withColumn("_block", sorted_place("_starts", F.col(x).cast("double"))).drop("_starts")
    d = d.join(blocks.drop("_b0"), [key, "_block"], "left")
    q = F.greatest(F.element_at("_p", 1)["x"], F.least(F.element_at("_p", -1)["x"], F.col(x).cast("double")))
    at = F.greatest(F.size(F.filter("_p", lambda v: v.x <= F.col("_q"))), F.lit(1))
    d = d.withColumn("_q", q).withColumn("_at", at)
    d = d.withColumn("_a", F.try_element_at("_p", F.col("_at"))).withColumn("_b", F.coalesce(F.try_element_at("_p", F.col("_at") + 1), F.col("_a")))
    part = F.coalesce(F.try_divide(F.col("_q") - F.col("_a.x"), F.col("_b.x") - F.col("_a.x")), F.lit(0.0))
    value = F.col("_a.y") + part * (F.col("_b.y") - F.col("_a.y"))
    return d.select(*df.columns, F.when(F.col(x).isNotNull(), value).alias(name))

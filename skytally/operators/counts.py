"""Keyed pair counts: one long table instead of a matrix per angle.

A count table holds ``*keys, pix1, pix2, edge_idx, n`` with n cumulative over
angles. A population table holds ``*keys, side, pix, n``, side 1 or 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELL = ("pix1", "pix2", "edge_idx")


def add_counts(counts: DataFrame, delta: DataFrame, keys=()) -> DataFrame:
    """Add ``delta`` onto ``counts``; a repeated key on either side is an error."""
    both = counts.withColumn("_s", F.lit(0)).unionByName(delta.withColumn("_s", F.lit(1)))
    most = F.greatest(F.count_if(F.col("_s") == 0), F.count_if(F.col("_s") == 1))
    out = both.groupBy(*keys, *CELL).agg(F.sum("n").alias("n"), most.alias("_most"))
    safe = F.when(F.col("_most") > 1, F.raise_error(F.lit("repeated entries for a pixel pair"))).otherwise(F.col("n"))
    return out.select(*keys, *CELL, safe.cast("long").alias("n"))


def assign_counts(counts: DataFrame, delta: DataFrame, keys=()) -> DataFrame:
    """Overwrite the entries that ``delta`` has."""
    on = [*keys, *CELL]
    return counts.join(delta.select(*on), on, "left_anti").select(*on, "n").unionByName(delta.select(*on, "n"))


def balance(counts: DataFrame, keys=()) -> DataFrame:
    """Fold entries below the diagonal onto their mirror image."""
    return counts.select(
        *keys, F.least("pix1", "pix2").alias("pix1"), F.greatest("pix1", "pix2").alias("pix2"), "edge_idx", "n"
    ).groupBy(*keys, *CELL).agg(F.sum("n").alias("n"))


def clear(counts: DataFrame) -> DataFrame:
    return counts.limit(0)


def population(pops: DataFrame, keys=(), cut: DataFrame | None = None) -> DataFrame:
    """``*keys, pop1, pop2``: objects on each side, without the pixels of ``cut``."""
    p = pops if cut is None else pops.join(cut.select("pix"), "pix", "left_anti")
    sides = [F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0)).alias(f"pop{s}") for s in (1, 2)]
    return p.groupBy(*keys).agg(*sides)


def difference_edges(sums: DataFrame, keys=()) -> DataFrame:
    """``*keys, bin_idx, pairs`` from cumulative ``edge_idx, n``: bin i lies between edges i and i+1."""
    by = [F.lit(0)] if not keys else list(keys)
    w = W.partitionBy(*by).orderBy("edge_idx")
    d = sums.withColumn("pairs", F.col("n") - F.lag("n").over(w)).where("pairs is not null")
    return d.select(*keys, (F.col("edge_idx") - 1).alias("bin_idx"), "pairs")


def pair_signal(counts: DataFrame, pops: DataFrame, keys=(), cut: DataFrame | None = None) -> DataFrame:
    """``*keys, bin_idx, pairs, signal``: pairs per angle over the product of the populations.

    Pairs touching a cut pixel are left out; populations are over all other pixels.
    """
    c = counts
    if cut is not None:
        for end in ("pix1", "pix2"):
            c = c.join(cut.select(F.col("pix").alias(end)), end, "left_anti")
    sums = c.groupBy(*keys, "edge_idx").agg(F.sum("n").alias("n"))
    d = difference_edges(sums, keys)
    # a few rows per key: the populations are laid beside the angles
    both = d.unionByName(population(pops, keys, cut), allowMissingColumns=True)
    w = W.partitionBy(*(keys or [F.lit(0)]))
    d = both.withColumns({p: F.max(p).over(w) for p in ("pop1", "pop2")}).where("bin_idx is not null")
    norm = F.col("pop1").cast("double") * F.col("pop2")
    return d.select(*keys, "bin_idx", "pairs", F.try_divide(F.col("pairs").cast("double"), norm).alias("signal"))


def pixel_share(pops: DataFrame, keys=()) -> DataFrame:
    """``*keys, side, pix, share``: each pixel's part of its side's total."""
    total = pops.groupBy(*keys, "side").agg(F.sum("n").alias("total"))
    return pops.join(total, [*keys, "side"]).select(
        *keys, "side", "pix", F.try_divide(F.col("n").cast("double"), F.col("total")).alias("share")
    )


def mean_share(pops: DataFrame, keys=()) -> DataFrame:
    """``*keys, pix, share``: mean of both sides' shares, occupied pixels only."""
    s = pixel_share(pops, keys)
    out = s.groupBy(*keys, "pix").agg(
        ((F.coalesce(F.sum(F.when(F.col("side") == 1, F.col("share"))), F.lit(0.0))
          + F.coalesce(F.sum(F.when(F.col("side") == 2, F.col("share"))), F.lit(0.0))) / F.lit(2.0)).alias("share")
    )
    return out.where("share > 0")


def to_coo(dense: DataFrame, row: str, columns) -> DataFrame:
    """``x, y, z`` of the entries above zero of a table with one column per y."""
    pairs = F.explode(F.array(*[F.struct(F.lit(int(c)).alias("y"), F.col(str(c)).alias("z")) for c in columns]))
    return dense.select(F.col(row).alias("x"), pairs.alias("e")).select("x", "e.y", "e.z").where("z > 0")


def to_dense(coo: DataFrame, columns) -> DataFrame:
    """One row per x and one column per y of a known list; absent entries are 0."""
    wide = coo.groupBy("x").pivot("y", list(columns)).agg(F.sum("z"))
    return wide.na.fill(0)

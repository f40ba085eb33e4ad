"""Mixing sources to target weights by capped water-filling.

Sources get shares of a budget of words by weight. A source whose share would
exceed its cap (so many epochs of its words) stops there, and what is left over
is shared again by weight among the rest until no source is above its cap.
In order of size per weight the capped sources come first, so one pass over the
sources, sorted so, finds the level; comparisons are in whole numbers.

A source's target is met by whole repetitions of all its documents and, for
the fraction, by documents in the order of a seeded hash. The hash range is
cut into 4096 cells a source, whose sizes are pre-aggregated: cells below the
target are taken whole, and only documents of the cells where it is reached
are ordered. There, documents that would exceed the rest are passed over for
later smaller ones, so that the sum ends close below the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytally.lineage import stash

WEIGHTS = (5, 2, 1)
EPOCHS = 2
SHARE_PERCENT = 150
SEED = "mix"
CELL_BITS = 12
EDGE_DOCUMENTS = 512
PASSES = 4
_KEY = ["mix_none", "mix_name", "mix_cell"]


def words(text: Column) -> Column:
    """Number of runs of characters other than space and 09 to 0D; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place(doc_id: Column, seed: str = SEED) -> Column:
    """A document's place in seeded order: the first 60 bits of an MD5."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, epochs: int = EPOCHS) -> DataFrame:
    """`mix_none, mix_name, source_size, target` from one row `mix_none, mix_name, source_size` for each source.

    The windows hold one short row for each source.
    """
    by_name, filled = Window.orderBy("mix_none", "mix_name"), Window.orderBy("fill", "mix_none", "mix_name")
    whole = Window.partitionBy()
    below = filled.rowsBetween(Window.unboundedPreceding, -1)
    onward = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    common = 1
    for w in weights:
        common *= w
    choice = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    s = sizes.withColumn("w", choice).withColumn("cap", epochs * F.col("source_size")).withColumn("total", F.sum("source_size").over(whole))
    s = s.withColumn("fill", F.col("source_size") * (F.lit(common).cast("long") / F.col("w")).cast("long"))
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(below), F.lit(0))).withColumn("rest", F.sum("w").over(onward))
    # a share of the budget above the cap, in hundredths of a word
    s = s.withColumn("capped", F.col("w") * (share_percent * F.col("total") - 100 * F.col("before")) >= 100 * F.col("cap") * F.col("rest"))
    s = (s.withColumn("spent", F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(whole))
         .withColumn("open", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(whole)))
    share = (F.col("w") * (share_percent * F.col("total") - 100 * F.col("spent"))).cast("double") / (100 * F.col("open")).cast("double")
    return s.select("mix_none", "mix_name", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mixture(docs: DataFrame, sized: DataFrame, seed: str = SEED, weights=WEIGHTS, share_percent: int = SHARE_PERCENT,
            epochs: int = EPOCHS) -> DataFrame:
    """`docs` with `size, source_size, target, copies` of each row.

    `docs` has `doc_id, source` and columns to carry, none named `size`,
    `source_size`, `target`, `copies` or beginning with `mix_`; `sized` has the
    rows' `doc_id, source, size`. A NULL source is a source of its own, a NULL
    doc_id a document like others; an empty table gives no rows, a source
    without words a target of 0. Repeated rows count each; which of equal rows
    is taken doesn't show.
    """
    def keyed(df):
        return (df.withColumn("mix_none", F.col("source").isNull()).withColumn("mix_name", F.coalesce("source", F.lit("")))
                .withColumn("mix_place", place(F.col("doc_id"), seed))
                .withColumn("mix_cell", F.shiftright("mix_place", 60 - CELL_BITS).cast("int")))

    cells = stash(keyed(sized).groupBy(*_KEY).agg(F.sum("size").alias("s"), F.count("*").alias("n")), "cells")
    goal = targets(cells.groupBy("mix_none", "mix_name").agg(F.sum("s").alias("source_size")), weights, share_percent, epochs)
    run = Window.partitionBy("mix_none", "mix_name").orderBy("mix_cell")
    first = Window.partitionBy("mix_none", "mix_name")
    cells = (cells.withColumn("upto", F.sum("s").over(run)).withColumn("count", F.sum("n").over(run))
             .join(goal, ["mix_none", "mix_name"])
             .withColumn("mix_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
             .withColumn("cut", F.col("target") - F.col("mix_whole") * F.col("source_size"))
             .withColumn("edge", F.min(F.when(F.col("upto") > F.col("cut"), F.struct("mix_cell", F.col("count") - F.col("n"), F.col("upto") - F.col("s")))).over(first)))
    # one short row for each source, written first so that its size is known when the join is planned
    near = F.when((F.col("mix_cell") >= F.col("edge")["mix_cell"]) & (F.col("count") - F.col("n") < F.col("edge")["col2"] + EDGE_DOCUMENTS), F.col("mix_cell"))
    limits = stash(cells.groupBy("mix_none", "mix_name").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("mix_whole").alias("mix_whole"),
        F.first(F.col("cut") - F.col("edge")["col3"]).alias("mix_rest"), F.first(F.col("edge")["mix_cell"]).alias("mix_from"), F.max(near).alias("mix_upto")), "limits")

    rows = keyed(docs).join(limits, ["mix_none", "mix_name"])
    at_edge = F.coalesce(F.col("mix_cell").between(F.col("mix_from"), F.col("mix_upto")), F.lit(False))
    below = F.col("mix_from").isNull() | (F.col("mix_cell") < F.col("mix_from"))
    plain = rows.filter(~at_edge).withColumn("mix_more", below.cast("int"))
    edge = rows.filter(at_edge).withColumn("mix_more", F.lit(0))
    group = Window.partitionBy("mix_none", "mix_name")
    order = group.orderBy("mix_place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for _ in range(PASSES):
        fits = (F.col("mix_more") == 0) & (F.col("size") <= F.col("mix_rest"))
        edge = edge.withColumn("mix_sum", F.sum(F.when(fits, F.col("size")).otherwise(0)).over(order))
        taken = fits & (F.col("mix_sum") <= F.col("mix_rest"))
        edge = edge.withColumn("mix_new", F.when(taken, 1).otherwise(0))
        edge = (edge.withColumn("mix_rest", F.col("mix_rest") - F.sum(F.col("mix_new") * F.col("size")).over(group))
                .withColumn("mix_more", F.col("mix_more") + F.col("mix_new")))
    edge = edge.select(*plain.columns)
    out = plain.unionByName(edge).withColumn("copies", (F.col("mix_whole") + F.col("mix_more")).cast("int"))
    return out.drop(*[c for c in out.columns if c.startswith("mix_")])


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """`doc_id, size, source_size, target, taken` of each row: `taken` counts the words that the mix takes of it."""
    sized = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size")), "sized")
    return mixture(sized, sized, **options).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken, with the columns of `docs`."""
    sized = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", words(F.col("text")).alias("size"))
    lean = stash(sized.select("doc_id", "source", "size"), "sized")
    out = mixture(sized, lean, **options).filter("copies > 0")
    return out.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")

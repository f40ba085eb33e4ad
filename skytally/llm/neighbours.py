"""Embedding near-duplicates by p-stable hashing of normalised vectors.

A table hashes a vector with several projections on Gaussian directions,
shifted and cut into steps; vectors with equal codes in a table share a bucket.
The number of projections grows with the logarithm of the number of vectors,
so that buckets of unrelated vectors stay small, and the number of tables then follows
from the recall wanted at the threshold.

Equal vectors are merged first and weigh by their number. Buckets are compared
in tiles of bounded size, in double precision. A pair that shares several
tables is counted in the first one only, so the sums over tables are exact
numbers of links. A tile puts out one count for each vector and the edges of a
spanning forest, never its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytally.lineage import stash
from skytally.llm.components import components
from skytally.llm.tiles import whole_groups

THRESHOLD = 0.95
STEP = 2.0
RECALL = 0.999
TILE = 512
SEED = 11


def same_step(distance: float, step: float = STEP) -> float:
    """Chance that one projection puts two vectors at this distance into the same step."""
    r = step / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(vectors: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Projections a table and tables for so many vectors.

    Unrelated vectors are at right angles; a bucket is to hold about a hundred
    of them. At the threshold itself, where it is lowest, recall is as asked.
    """
    far, near = same_step(math.sqrt(2)), same_step(math.sqrt(2 - 2 * threshold))
    projections = max(4, math.ceil(math.log(max(vectors, 100) / 100) / -math.log(far)))
    return projections, math.ceil(math.log(1 - recall) / math.log(1 - near**projections))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled by the largest part first, so that squares neither overflow nor vanish
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _tiles(rows: DataFrame, tables: int, threshold: float) -> DataFrame:
    """`node, links, other` from `table, bucket, x, y, mine, node, copies, codes, vector`, sorted by tile."""
    def one(table, block, mine, node, copies, codes, unit):
        """Links of a tile: (node, weight of partners found here first), and forest edges."""
        inner = block[0] == block[1]
        left = np.arange(len(node)) if inner else np.flatnonzero(mine == block[0])
        right = left if inner else np.flatnonzero(mine == block[1])
        if not len(left) or not len(right):
            return None
        near = unit[left] @ unit[right].T >= threshold
        if inner:
            near &= node[left][:, None] != node[right][None, :]
        i, j = np.nonzero(near)
        i, j = left[i], right[j]
        first = np.ones(len(i), bool)
        for t in range(table):
            first &= codes[i, t] != codes[j, t]
        links = np.bincount(i[first], copies[j[first]], len(node))
        if not inner:
            links += np.bincount(j[first], copies[i[first]], len(node))
        # minimum over neighbours until nothing changes: the smallest node of each part of the tile
        low = node.copy()
        while len(i):
            new = low.copy()
            np.minimum.at(new, i, low[j])
            np.minimum.at(new, j, low[i])
            if (new == low).all():
                break
            low = new
        told = (links > 0) | (low != node)
        return node[told], links[told].astype(np.int64), low[told]

    def run(batches):
        for data, groups in whole_groups(batches, 4):
            x, y, mine, node, copies = (data.column(c).to_numpy() for c in range(2, 7))
            t = data.column(0).to_numpy()
            codes, unit = _matrix(data.column(7)), _unit(_matrix(data.column(8)))
            found = [one(t[lo], (x[lo], y[lo]), mine[lo:hi], node[lo:hi], copies[lo:hi], codes[lo:hi], unit[lo:hi]) for lo, hi in groups]
            found = [f for f in found if f is not None]
            cols = [np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["node", "links", "other"])

    return rows.mapInArrow(run, "node long, links long, other long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, step: float = STEP) -> DataFrame:
    """`vec_id, n_links, component_id, kept` for each row of `vectors(vec_id, embedding, ...)`.

    Two vectors are linked when their cosine in double precision reaches the
    threshold. A vector that is NULL, empty, zero, or holds NULL or non-finite
    components is linked with nothing, nor are vectors of different lengths.
    Rows that repeat a vec_id are vectors of their own that share the id: each counts as a link of
    the others. A NULL vec_id is compared with nothing; its component is NULL
    and it is kept. Other columns are not read; an empty table gives no rows.
    """
    # single precision is carried as it is; all sums are in double precision
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    sound = (F.coalesce(F.size("v") > 0, F.lit(False)) & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
             & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull())
    rows = stash(rows.select("vec_id", F.when(sound, F.col("v")).alias("v"), F.when(sound, F.xxhash64("v")).alias("h1"), F.when(sound, F.xxhash64("v", F.lit(1))).alias("h2")), "vectors")
    sound_rows = rows.filter("v is not null")
    classes = stash(sound_rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first(F.size("v")).alias("size")), "classes")
    # a repeated vec_id can lead several classes; nodes are numbered by their hash then
    plans = {r["size"]: r["n"] for r in classes.groupBy("size").agg(F.count("*").alias("n")).collect()}
    units = sound_rows.join(classes.withColumnRenamed("node", "vec_id"), ["vec_id", "h1", "h2"]).dropDuplicates(["h1", "h2"])
    units = stash(units.select(F.col("h1").alias("node"), "copies", "v", "size"), "units")

    found = None
    for size, n in sorted(plans.items()):
        projections, tables = plan(n, threshold, recall)
        rng = np.random.default_rng(SEED)
        direction, shift = rng.standard_normal((size, projections * tables)), rng.random(projections * tables) * step
        weight = rng.integers(-(1 << 62), 1 << 62, projections, dtype=np.int64)
        shared = vectors.sparkSession.sparkContext.broadcast((direction, shift, weight))

        def hashed(batches, tables=tables, shared=shared):
            direction, shift, weight = shared.value
            for batch in batches:
                if batch.num_rows:
                    cells = np.floor((_unit(_matrix(batch.column(2))) @ direction + shift) / step).astype(np.int64)
                    with np.errstate(over="ignore"):
                        codes = (cells.reshape(batch.num_rows, tables, -1) * weight).sum(axis=2)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, tables), pa.int32()), pa.array(codes.ravel()))
                    yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["node", "copies", "v", "codes"])

        coded = stash(units.filter(F.col("size") == size).select("node", "copies", "v").mapInArrow(hashed, f"node long, copies long, v {kind}, codes array<long>"), "coded")
        spread = coded.select("*", F.posexplode("codes").alias("t", "bucket"))
        several = (spread.groupBy("t", "bucket").agg(F.count("*").alias("n")).filter("n > 1")
                   .select("t", "bucket", F.ceil(F.col("n") / TILE).cast("int").alias("blocks")))
        tiled = (spread.join(several, ["t", "bucket"]).withColumn("mine", F.pmod(F.xxhash64("node", "t"), F.col("blocks")).cast("int"))
                 .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                 .select("t", "bucket", F.least("mine", "o").alias("x"), F.greatest("mine", "o").alias("y"), "mine", "node", "copies", "codes", "v")
                 .repartition("t", "bucket", "x", "y").sortWithinPartitions("t", "bucket", "x", "y"))
        part = _tiles(tiled, tables, threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "node long, links long, other long")
    found = stash(found, "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    # edges between classes become edges between their smallest ids
    ids = classes.select(F.col("h1").alias("node"), F.col("node").alias("id"))
    edges = (found.filter("node <> other").select("node", "other").distinct()
             .join(ids.withColumnRenamed("id", "a"), "node").join(ids.select(F.col("node").alias("other"), F.col("id").alias("b")), "other").select("a", "b"))
    same = rows.filter("v is not null").groupBy("vec_id").agg(F.min(F.struct("h1")).alias("x"), F.max(F.struct("h1")).alias("y")).filter("x <> y")
    twice = rows.join(same.select("vec_id"), "vec_id", "left_semi").join(classes, ["h1", "h2"]).select(F.col("vec_id").alias("a"), F.col("node").alias("b"))
    labels = components(edges.unionByName(twice))
    per = (classes.join(links.withColumnRenamed("node", "h1"), "h1", "left").join(labels, "node", "left")
           .select("h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id")))
    out = rows.select("vec_id", "h1", "h2").join(per, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))

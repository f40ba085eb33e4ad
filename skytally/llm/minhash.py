"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification.

1. Each text becomes its number of distinct 5-word shingles, a fingerprint of
   the set, and 128 MinHash values of 16 bits, kept as 32 bands of four. Texts
   with equal sets form a class; only its smallest document goes on.
2. Representatives that share a band are candidates. A candidate pair's
   signatures are compared 32 values at a time; after each batch the pair is
   dropped when the posterior probability of reaching the threshold, under a
   uniform prior, is below the miss probability.
3. Survivors are verified on the full shingle sets, and links join components.

Pairs within a band are never written out. First each document is tried with
one partner, the smallest document of the band it shares most often; what this
joins needs no further test. Bands that still hold several components are
compared in tiles of bounded size: a first pass tells which documents have a
surviving pair there, a second one brings their texts and verifies the pairs, best
first, putting out only links that join components. So no candidate is capped,
and a group of thousands of copies costs about one row for each member.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytally.lineage import stash
from skytally.llm.components import components
from skytally.llm.tiles import whole_groups
from skytally.llm.words import linked, randoms, shingle_sets

HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
BATCH = 32
SHARE = 75
MISS = 1e-4
TILE = 256
_FACTOR = (randoms(HASHES, 77) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFT = (randoms(HASHES, 78) >> np.uint64(32)).astype(np.uint32)
_ODD = np.uint32(0x9E3779B1)
_SALT = randoms(BANDS, 4321)


def signature(shingles: np.ndarray) -> np.ndarray:
    """128 MinHash values cut to 16 bits, as 32 unsigned longs of four values."""
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    low = np.empty(HASHES, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(HASHES):
            h = x * _FACTOR[i]
            h += _SHIFT[i]
            low[i] = h.min()
        return ((low * _ODD) >> np.uint32(16)).astype(np.uint16).view(np.uint64)


@lru_cache
def least_matches(share: int = SHARE, miss: float = MISS) -> tuple[int, ...]:
    """For each batch the fewest matches that keep a pair.

    With a uniform prior the similarity after m matches of n has a
    Beta(m + 1, n - m + 1) posterior; its tail at the threshold equals the
    chance of at most m successes in n + 1 trials of that probability.
    """
    t, least = share / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss and m < n:
            m += 1
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        least.append(m)
    return tuple(least)


def survivors(a: np.ndarray, b: np.ndarray, share: int = SHARE, miss: float = MISS) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the paired signatures (n x 32 unsigned longs) that are kept, and their matches."""
    a, b = a.view(np.uint16), b.view(np.uint16)
    keep, found = np.arange(len(a)), np.zeros(len(a), np.int64)
    for step, least in enumerate(least_matches(share, miss)):
        cols = slice(step * BATCH, (step + 1) * BATCH)
        found = found + (a[keep, cols] == b[keep, cols]).sum(axis=1)
        ok = found >= least
        keep, found = keep[ok], found[ok]
    return keep, found


def _as_bytes(column: pa.Array) -> list[bytes]:
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


_PROFILE = "doc_id long, n_shingles long, f1 long, f2 long, sig array<long>"


def profiles(docs: DataFrame) -> DataFrame:
    """`doc_id, n_shingles, f1, f2, sig` of each document; no signature without words."""
    def run(batches):
        for batch in batches:
            ids, out_n, f1, f2, sigs = batch.column(0), [], [], [], []
            with np.errstate(over="ignore"):
                for s in shingle_sets(_as_bytes(batch.column(1))):
                    out_n.append(len(s))
                    f1.append(s.sum(dtype=np.uint64))
                    f2.append((s * (s >> np.uint64(17))).sum(dtype=np.uint64))
                    sigs.append(signature(s) if len(s) else None)
            has = np.array([s is not None for s in sigs], bool)
            flat = np.concatenate([s for s in sigs if s is not None]) if has.any() else np.zeros(0, np.uint64)
            offsets = pa.array([None if not h else o for h, o in zip(has, np.cumsum(has) * BANDS - BANDS)] + [len(flat)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(out_n, pa.int64()), pa.array(np.array(f1, np.uint64).view(np.int64)),
                 pa.array(np.array(f2, np.uint64).view(np.int64)),
                 pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64)))],
                names=["doc_id", "n_shingles", "f1", "f2", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PROFILE)


def _signatures(column: pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.ascontiguousarray(values.flatten().to_numpy(zero_copy_only=False)).view(np.uint64).reshape(-1, BANDS)


def _verified(pairs: DataFrame, texts: DataFrame, share: int, miss: float) -> DataFrame:
    """The pairs `a, b` that are linked: signatures in batches, then whole sets."""
    def run(batches):
        for batch in batches:
            keep, _ = survivors(_signatures(batch.column(2)), _signatures(batch.column(3)), share, miss)
            part = batch.take(pa.array(keep))
            # pairs come in runs with the same second document, whose set is made once
            left, right, last, ok = _as_bytes(part.column(4)), _as_bytes(part.column(5)), None, []
            for x, sa in zip(right, shingle_sets(left)):
                if last is None or last[0] != x:
                    last = (x, next(shingle_sets([x])))
                ok.append(linked(sa, last[1], share))
            part = part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
            yield part

    both = (pairs.select("a", "b")
            .join(texts.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb"), F.col("text").alias("tb")), "b"))
    return both.select("a", "b", "sa", "sb", "ta", "tb").mapInArrow(run, "a long, b long")


def _tile_pairs(table: pa.Table, lo: int, hi: int, share: int, miss: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i, j of the open pairs of one tile that survive, and their matches.

    A tile is two blocks of a band, or one block with itself. A pair is tried
    in the first band that it shares only.
    """
    band, x, y = (table.column(c)[lo].as_py() for c in range(3))
    mine, ids, comp, size = (table.column(c).to_numpy()[lo:hi] for c in (3, 4, 5, 6))
    sig = _signatures(table.column(7).slice(lo, hi - lo))
    if x == y:
        i, j = np.triu_indices(len(ids), 1)
    else:
        left, right = np.flatnonzero(mine == x), np.flatnonzero(mine == y)
        i, j = np.repeat(left, len(right)), np.tile(right, len(left))
    # of sets that differ too much in size no signature need be compared
    ok = (comp[i] != comp[j]) & (100 * np.minimum(size[i], size[j]) >= share * np.maximum(size[i], size[j]))
    i, j = i[ok], j[ok]
    first, rest = np.full(len(i), -1), np.arange(len(i))
    for k in range(BANDS):
        same = sig[i[rest], k] == sig[j[rest], k]
        first[rest[same]] = k
        rest = rest[~same]
    hit = np.flatnonzero(first >= 0)
    hit = hit[(sig[i[hit], first[hit]] ^ _SALT[first[hit]]).view(np.int64) == band]
    i, j = i[hit], j[hit]
    keep, m = survivors(sig[i], sig[j], share, miss)
    return i[keep], j[keep], m


def _open_links(shared: DataFrame, labels: DataFrame, texts: DataFrame, share: int, miss: float) -> DataFrame:
    """Links `a, b` that join different components, out of all candidate pairs between them."""
    rows = (shared.select("band", "doc_id").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("band", "doc_id", F.coalesce("component", "doc_id").alias("component")))
    mixed = (rows.groupBy("band").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
             .filter("lo < hi").select("band", F.ceil(F.col("n") / TILE).cast("long").alias("blocks")))
    tile = ["band", "x", "y"]
    rows = (rows.join(mixed, "band").join(texts.select("doc_id", "n_shingles", "sig"), "doc_id")
            .withColumn("mine", F.pmod(F.xxhash64("doc_id", "band"), F.col("blocks")))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            .select("band", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "doc_id", "component", "n_shingles", "sig"))

    def open_rows(batches):
        """The documents of a tile that have a surviving pair there."""
        for table, groups in whole_groups(batches, 3):
            some = np.zeros(len(table), bool)
            for lo, hi in groups:
                i, j, _ = _tile_pairs(table, lo, hi, share, miss)
                some[lo + i] = some[lo + j] = True
            yield from table.filter(pa.array(some)).to_batches()

    rows = rows.repartition(*tile).sortWithinPartitions(*tile)
    rows = rows.mapInArrow(open_rows, rows.schema)
    rows = rows.join(texts.select("doc_id", "text"), "doc_id").select(*tile, "mine", "doc_id", "component", "n_shingles", "sig", "text")

    def verified(batches):
        for table, groups in whole_groups(batches, 3):
            links = []
            for lo, hi in groups:
                i, j, m = _tile_pairs(table, lo, hi, share, miss)
                if not len(i):
                    continue
                ids, comp = (table.column(c).to_numpy()[lo:hi] for c in (4, 5))
                sets = list(shingle_sets(_as_bytes(table.column(8).slice(lo, hi - lo).combine_chunks())))
                # what a link found here has joined needs no further test
                leader = {c: c for c in comp.tolist()}

                def lead(c):
                    while leader[c] != c:
                        leader[c] = c = leader[leader[c]]
                    return c

                for k in np.argsort(-m, kind="stable").tolist():
                    p, q = lead(int(comp[i[k]])), lead(int(comp[j[k]]))
                    if p != q and linked(sets[i[k]], sets[j[k]], share):
                        leader[max(p, q)] = min(p, q)
                        links.append((ids[i[k]], ids[j[k]]))
            yield pa.RecordBatch.from_arrays([pa.array([l[c] for l in links], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return rows.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(verified, "a long, b long")


def near_duplicates(docs: DataFrame, share: int = SHARE, miss: float = MISS) -> DataFrame:
    """`doc_id, n_shingles, component_id, kept` for each row of `docs(doc_id, text, ...)`.

    Documents are linked when 100 * intersection >= share * union of their sets
    of 5-word shingles; `component_id` is the smallest document reachable. A
    text that is NULL, empty or without words has no shingles and is linked
    with nothing. Rows that repeat a doc_id count as one document and share its
    component. A NULL doc_id can't be linked: it gets a NULL component and is
    kept. Other columns, whatever their names, are not read. Given `share` under
    75, more bands than the fixed 32 of four rows would be needed.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prof = stash(profiles(docs), "profiles")
    filled = prof.filter("n_shingles > 0 and doc_id is not null")
    # written first, so that a class with very many copies can be split in the join
    classes = stash(filled.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    classes = stash(filled.select("doc_id", "f1", "f2", "n_shingles").join(classes, ["f1", "f2", "n_shingles"]).select("doc_id", "rep"), "classes")
    reps = classes.filter("doc_id = rep").select("doc_id").distinct()
    reps = filled.select("doc_id", "sig").join(reps, "doc_id", "left_semi")

    salt = F.array(*[F.lit(int(v)) for v in _SALT.view(np.int64)])
    bands = reps.select("doc_id", F.explode(F.zip_with("sig", salt, lambda s, r: s.bitwiseXOR(r))).alias("band"))
    several = (bands.groupBy("band").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("most"))
               .filter("pivot < most").select("band", "pivot"))
    shared = stash(bands.join(several, "band"), "shared")
    needed = shared.select("doc_id").distinct()
    texts = stash(filled.select("doc_id", "sig", "n_shingles").join(needed, "doc_id", "left_semi").join(docs, "doc_id"), "texts")
    # each document with the smallest of the band it shares most often
    tried = (shared.filter("doc_id <> pivot").groupBy("doc_id", "pivot").agg(F.count("*").alias("n"))
             .groupBy("doc_id").agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("b")).select(F.col("doc_id").alias("a"), "b"))
    edges = stash(_verified(tried, texts, share, miss), "links")
    labels = components(edges)
    more = stash(_open_links(shared, labels, texts, share, miss), "links")
    if not more.isEmpty():
        labels = components(edges.unionByName(more))
    found = (classes.distinct().join(labels.withColumnRenamed("node", "rep"), "rep", "left")
             .select("doc_id", F.coalesce("component", "rep").alias("found")))
    # a repeated doc_id with different texts belongs to both classes; its smallest component holds
    found = found.groupBy("doc_id").agg(F.min("found").alias("found"))
    out = prof.select("doc_id", "n_shingles").join(found, "doc_id", "left").withColumn("component_id", F.coalesce("found", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))

"""Sharding by extendible hashing, with DataFrame functions only.

A document's 60-bit hash is read bit by bit. The directory starts with one
bucket; a bucket whose documents exceed the byte limit splits on the next bit,
others stay, until every bucket fits. Buckets' sizes come from sums by
prefix: 16 bits in the first round, then 8 more only for the prefixes
that are still too large, so a round handles sums and not documents.

No bit separates documents with one and the same id. Where those exceed the limit
together they overflow into numbered pages of their bucket, each within the
limit; a document that is itself above the limit stays alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytally.lineage import stash

LIMIT_BYTES = 1 << 20
BITS = 60
FIRST, NEXT = 16, 8


def hash_bits(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id; a NULL id hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def directory(keys: DataFrame, limit: int = LIMIT_BYTES) -> tuple[DataFrame, list[int]]:
    """The buckets, and the depths of the rounds that made them.

    `keys` has a row `key, bytes` for each document. A bucket is `round, depth,
    prefix, bucket_bytes, bucket_docs, largest, alike`: the documents whose
    hash begins with the `depth` bits of `prefix`; `alike` if they share one hash.
    """
    found, rounds, low, unfit = None, [], 0, None
    while low < BITS:
        high = min(low + (NEXT if rounds else FIRST), BITS)
        rows = keys
        if unfit is not None:
            rows = keys.withColumn("prefix", F.shiftright("key", BITS - low)).join(unfit, "prefix", "left_semi")
        sums = rows.groupBy(F.shiftright("key", BITS - high).alias("cell")).agg(
            F.sum("bytes").alias("b"), F.count("*").alias("n"), F.max("bytes").alias("largest"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        first = 0 if not rounds else low + 1
        nodes = (sums.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(high))))
                 .withColumn("prefix", F.call_function("shiftright", F.col("cell"), F.lit(high) - F.col("depth")))
                 .groupBy("depth", "prefix").agg(F.sum("b").alias("bucket_bytes"), F.sum("n").alias("bucket_docs"), F.max("largest").alias("largest"),
                                                 (F.min("lo") == F.max("hi")).alias("alike"))
                 .withColumn("fits", (F.col("bucket_bytes") <= limit) | F.col("alike")))
        nodes = stash(nodes, "nodes")
        parents = nodes.filter("fits").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        fit = (nodes.filter("fits").withColumn("parent", F.shiftright("prefix", 1)).join(parents, ["depth", "parent"], "left_anti")
               .select(F.lit(len(rounds)).alias("round"), "depth", "prefix", "bucket_bytes", "bucket_docs", "largest", "alike"))
        found = fit if found is None else found.unionByName(fit)
        rounds.append(high)
        unfit = nodes.filter(f"depth = {high} and not fits").select("prefix")
        if unfit.isEmpty():
            break
        low = high
    return stash(found, "directory"), rounds


def sharded(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """`docs` with `shard_id, shard_depth, shard_page, shard_bytes, shard_docs`.

    `shard_id` is the depth and the prefix as `depth/prefix`, with `+page` on
    overflow pages. Bytes are those of the text in UTF-8 (NULL: 0). Columns of
    `docs` are carried, also if others are named alike, but for the five
    above. Repeated rows go to one bucket, a NULL id is hashed as an empty
    one, an empty table gives no shard.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("row"), hash_bits(F.col("doc_id")).alias("shard_key"),
                        F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("shard_size"))
    keys = stash(keyed.select(F.col("shard_key").alias("key"), F.col("shard_size").alias("bytes")), "keys")
    buckets, rounds = directory(keys, limit)

    # each distinct hash meets the buckets of a round under that round's number of bits
    rest, parts = keys.select(F.col("key").alias("shard_key")).distinct(), []
    for r, high in enumerate(rounds):
        cells = (buckets.filter(F.col("round") == r)
                 .withColumn("span", F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(high) - F.col("depth")))
                 .withColumn("cell", F.explode(F.sequence(F.col("prefix") * F.col("span"), F.col("prefix") * F.col("span") + F.col("span") - 1)))
                 .drop("span", "round"))
        both = rest.withColumn("cell", F.shiftright("shard_key", BITS - high)).join(cells, "cell", "left").drop("cell")
        if r + 1 < len(rounds):
            both = stash(both, "found")
            rest = both.filter("depth is null").select("shard_key")
        parts.append(both.filter("depth is not null"))
    where = parts[0]
    for p in parts[1:]:
        where = where.unionByName(p)
    rows = keyed.join(where, "shard_key")
    over = (F.col("bucket_bytes") > limit) & (F.col("bucket_docs") > 1)
    plain = rows.filter(~over).withColumn("shard_page", F.lit(0).cast("long")).withColumnRenamed("bucket_bytes", "shard_bytes").withColumnRenamed("bucket_docs", "shard_docs")
    if not buckets.filter(over).isEmpty():
        # rows of one hash: numbered within the pieces of a written table, after the totals of the pieces before
        many = stash(rows.filter(over).withColumn("shard_at", F.monotonically_increasing_id()), "overflow").withColumn("shard_piece", F.shiftright("shard_at", 33))
        piece = Window.partitionBy("shard_key").orderBy("shard_piece").rowsBetween(Window.unboundedPreceding, -1)
        starts = (many.groupBy("shard_key", "shard_piece").agg(F.sum("shard_size").alias("s"), F.count("*").alias("c"))
                  .withColumn("shard_s", F.coalesce(F.sum("s").over(piece), F.lit(0))).withColumn("shard_c", F.coalesce(F.sum("c").over(piece), F.lit(0)))
                  .drop("s", "c"))
        within = Window.partitionBy("shard_key", "shard_piece").orderBy("shard_at").rowsBetween(Window.unboundedPreceding, -1)
        many = (many.withColumn("shard_s0", F.coalesce(F.sum("shard_size").over(within), F.lit(0))).withColumn("shard_c0", F.count("*").over(within))
                .join(starts, ["shard_key", "shard_piece"]))
        # rows that begin within `limit - largest` bytes fit together
        many = many.withColumn("shard_page", F.when(F.col("largest") * 2 > limit, F.col("shard_c") + F.col("shard_c0"))
                               .otherwise(F.floor((F.col("shard_s") + F.col("shard_s0")) / (F.lit(limit) - F.col("largest")))))
        pages = many.groupBy("shard_key", "shard_page").agg(F.sum("shard_size").alias("shard_bytes"), F.count("*").alias("shard_docs"))
        many = many.drop("bucket_bytes", "bucket_docs").join(pages, ["shard_key", "shard_page"])
        plain = plain.unionByName(many.select(*plain.columns))
    name = F.concat_ws("/", F.col("depth").cast("string"), F.col("prefix").cast("string"))
    return plain.select("row.*", F.when(F.col("shard_page") > 0, F.concat_ws("+", name, F.col("shard_page").cast("string"))).otherwise(name).alias("shard_id"),
                        F.col("depth").cast("int").alias("shard_depth"), "shard_page", "shard_bytes", "shard_docs")

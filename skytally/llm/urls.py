"""URL filters by a cascade of Bloom filters.

A rule is a host and a path prefix; it becomes the key `host + path`. A URL has
as keys the suffixes of its host with as many labels as some rule's host, with every prefix of its path that
is as long as some rule's. The keys of all URLs together are the universe
over which a cascade is exact: its first filter encodes the listed keys, the
second the keys of the universe that the first accepts wrongly, the third the
listed keys that the second accepts, and so on until nothing is left to
correct. A key is listed if the first filter to refuse it is an even one, or
none does and the number of filters is odd. URLs are so judged without a join.

Filters are built in Spark from bit positions and are as large as their keys
need; keys are split into parts whose filters stay below a fixed size,
which are sent to the executors one after the other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytally.lineage import stash

BITS_PER_KEY = 10
PROBES = 7
PART_KEYS = 1 << 25
_LOW = (1 << 40) - 1
BLOCK, ALLOW = "block", "allow"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


RULES = (Rule(BLOCK, "net", "/"), Rule(ALLOW, "example.net", "/en/"), Rule(BLOCK, "example.com", "/de/"), Rule(ALLOW, "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path of a URL; both empty without `://` or if NULL."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def url_keys(host: Column, path: Column, lengths: list[int], labels: list[int]) -> Column:
    """The keys of a URL that a rule can have, given the lengths of the rules' paths and the numbers of labels of their hosts."""
    has = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    suffixes = F.filter(F.array(*[F.when(has >= n, F.substring_index(host, ".", -n)) for n in sorted(set(labels))]), lambda s: s.isNotNull())
    fitting = F.filter(F.array(*[F.lit(n) for n in sorted(set(lengths))]), lambda n: n <= F.length(path))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.concat(s, F.substring(path, F.lit(1), n)))))


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit(7))


@dataclass
class Cascade:
    """Filters of one part, each as words of 64 bits."""

    levels: list[np.ndarray]

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether keys of the universe, given by their two hashes, are listed."""
        listed, open_ = np.zeros(len(h1), bool), np.arange(len(h1))
        for depth, words in enumerate(self.levels):
            inside = _inside(words, depth, h1[open_], h2[open_])
            listed[open_[~inside]] = depth % 2 == 1
            open_ = open_[inside]
        listed[open_] = len(self.levels) % 2 == 1
        return listed


def _inside(words: np.ndarray, depth: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    # each filter reads other bits of the hashes, so keys that a small filter can't tell apart part in the next
    turn = depth * 5 % 24
    size, ok, a, b = len(words) * 64, np.ones(len(h1), bool), (h1 >> turn) & _LOW, (h2 >> turn) & _LOW
    for i in range(PROBES):
        at = (a + b * np.int64(depth * PROBES + i + 1)) % np.int64(size)
        ok &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    return ok


def _filter(keys: DataFrame, count: int, depth: int) -> np.ndarray:
    """The words of a filter of `count` keys `h1, h2`; only set words reach the driver, at most the filter's size."""
    words = max(1, -(-count * BITS_PER_KEY // 64))
    probe = F.explode(F.array(*[F.lit(depth * PROBES + i + 1).cast("long") for i in range(PROBES)])).alias("i")
    # sums wrap as they do in numpy: the low 64 bits, by try_ free arithmetic on the bits
    turn = depth * 5 % 24
    at = F.expr(f"((shiftright(h1, {turn}) & {_LOW}L) + (shiftright(h2, {turn}) & {_LOW}L) * i) % {words * 64}L")
    rows = (keys.select("h1", "h2", probe).select(at.alias("at")).select(F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("b"))
            .groupBy("w").agg(F.bit_or("b").alias("b")).collect())
    out = np.zeros(words, np.int64)
    for r in rows:
        out[r.w] = r.b
    return out.view(np.uint64)


def _passing(keys: DataFrame, words: np.ndarray, depth: int) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                ok = _inside(shared.value, depth, batch.column(0).to_numpy(), batch.column(1).to_numpy())
                yield batch.filter(pa.array(ok))

    return keys.mapInArrow(run, keys.schema)


def cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """A cascade that tells listed keys from all others of the universe; both `h1, h2`."""
    mine = stash(listed.select("h1", "h2").distinct(), "listed")
    n = mine.count()
    if not n:
        return Cascade([])
    levels = [_filter(mine, n, 0)]
    others = stash(_passing(universe.select("h1", "h2"), levels[0], 0).join(mine, ["h1", "h2"], "left_anti"), "accepted")
    while n := others.count():
        levels.append(_filter(others, n, len(levels)))
        mine, others = others, stash(_passing(mine, levels[-1], len(levels) - 1), "accepted")
    return Cascade(levels)


def judge(pages: DataFrame, rules=RULES, default: str = ALLOW) -> DataFrame:
    """`page_id, host, path, rule, verdict` for each row of `pages(page_id, url, ...)`.

    A rule fits its host and all subdomains if the path begins with the
    rule's path. The longest rule wins (of equally long ones that with the
    longer host; of the same key listed twice, the last given, and in a table the allowing one).
    `rules` are `Rule`s or a table `verdict, host, path`, whose keys stay in Spark; rows of it with a NULL are left out. Without a rule
    `rule` is NULL and the verdict is the default. A NULL url, or one without
    `://`, has an empty host and path. Repeated rows and NULL ids are kept;
    other columns are not read.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    if not isinstance(rules, DataFrame):
        last = {r.host + r.path: r for r in rules}
        rules = spark.createDataFrame([(r.verdict, r.host, r.path) for r in last.values()], "verdict string, host string, path string")
    rules = rules.select("host", "path", "verdict").dropna()
    rules = stash(rules.groupBy(F.concat("host", "path").alias("key")).agg(F.min("verdict").alias("verdict"), F.first("host").alias("host"), F.first("path").alias("path")), "rules")
    count = rules.count()
    if not count:
        return rows.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    # as many as rules differ in length, not as there are rules
    dots = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit("")))
    lengths, labels = ([r[0] for r in rules.select(c.alias("c")).distinct().collect()] for c in (F.length("path"), dots + 1))
    h1, h2 = _hashes(F.col("key"))
    # a key's partition of the filters is fixed by its hash, so that parts are independent cascades
    universe = stash(rows.select(F.explode(F.array_distinct(url_keys(F.col("host"), F.col("path"), lengths, labels))).alias("key")).distinct()
                     .select(h1.alias("h1"), h2.alias("h2")), "universe")
    parts = -(-count // PART_KEYS)
    keys = url_keys(F.col("host"), F.col("path"), lengths, labels)
    found = rows.withColumn("keys", keys).withColumn("hit", F.lit(None).cast("string")).withColumn("verdict", F.lit(None).cast("string"))
    for verdict in (BLOCK, ALLOW):
        listed = rules.filter(F.col("verdict") == verdict).select(h1.alias("h1"), h2.alias("h2"))
        for part in range(parts):
            of = F.pmod(F.col("h2"), F.lit(parts)) == part
            found = _matched(found, spark.sparkContext.broadcast(cascade(listed.filter(of), universe.filter(of))), verdict, part, parts)
    return found.select("page_id", "host", "path", F.col("hit").alias("rule"), F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _matched(rows: DataFrame, shared, verdict: str, part: int, parts: int) -> DataFrame:
    """`hit` and `verdict` replaced where this cascade lists a longer key of the row."""
    columns = ["page_id", "host", "path", "keys", "hit", "verdict"]
    schema = rows.select(columns).schema

    def run(batches):
        for batch in batches:
            keys, hit, said = batch.column(3), batch.column(4).to_pylist(), batch.column(5).to_pylist()
            h1, h2 = (batch.column(c).flatten().to_numpy() for c in (6, 7))
            row = np.repeat(np.arange(batch.num_rows), keys.value_lengths().to_numpy())
            mine = np.flatnonzero(h2 % parts == part)
            mine = mine[shared.value.has(h1[mine], h2[mine])]
            for r, key in zip(row[mine].tolist(), keys.flatten().take(pa.array(mine)).to_pylist()):
                if hit[r] is None or (len(key), key.find("/")) > (len(hit[r]), hit[r].find("/")):
                    hit[r], said[r] = key, verdict
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(hit, pa.string()), pa.array(said, pa.string())], names=columns)

    hashes = [F.transform("keys", lambda k: F.xxhash64(k)), F.transform("keys", lambda k: F.xxhash64(k, F.lit(7)))]
    return rows.select(*columns, *hashes).mapInArrow(run, schema)

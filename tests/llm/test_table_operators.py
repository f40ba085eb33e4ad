"""Embeddings, archives, mixing, sharding, URL filters and the pipeline."""

import hashlib
import io
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytally.llm import mixing as X
from skytally.llm import neighbours as V
from skytally.llm import sharding as S
from skytally.llm import urls as U
from skytally.llm import warc as A

# ---------------------------------------------------------------- embeddings


def brute_vectors(rows, threshold=0.95):
    ids, x = [], []
    for i, v in rows:
        if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v):
            ids.append(i)
            x.append(np.array(v, float) / np.abs(v).max())
    near = [[len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold for b in x] for a in x]
    lead = {i: i for i, _ in rows if i is not None}

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for p in range(len(x)):
        for q in range(p):
            if near[p][q]:
                a, b = find(ids[p]), find(ids[q])
                lead[max(a, b)] = min(a, b)
    links = [(i, sum(n) - 1) for i, n in zip(ids, near)]
    return links, {i: find(i) for i in lead}


def test_vectors_equal_brute_force(spark, clashing, monkeypatch):
    monkeypatch.setattr(V, "TILE", 16)
    rng = np.random.default_rng(4)
    rows = []
    for g in range(30):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 12)):
            noise = rng.choice([0.0, 0.02, 0.1, 0.2])
            rows.append((len(rows), (base * rng.uniform(0.1, 9) if noise else base) + noise * rng.standard_normal(16)))
    rows = [(i, v.tolist()) for i, v in rows]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0, float("nan")] * 8), (904, [1.0, None] * 8), (905, [float("inf")] * 16), (906, [1.0]), (907, [2.0]),
             (908, [1e300] * 16), (909, [2e-300] * 16), (None, rows[0][1]), (3, rows[3][1])]
    out = V.near_vectors(clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), recall=0.99999).collect()
    links, comp = brute_vectors(rows)
    assert len(out) == len(rows)
    want = sorted((i, n, comp[i]) for i, n in links) + [(i, 0, i) for i in range(900, 906)]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out if r.vec_id is not None) == sorted(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    assert V.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_recall_follows_the_plan():
    for n in (100, 10_000, 10**8):
        k, tables = V.plan(n)
        assert 1 - (1 - V.same_step(math.sqrt(0.1)) ** k) ** tables >= V.RECALL
        assert n * V.same_step(math.sqrt(2)) ** k <= 101


# ---------------------------------------------------------------- archives


def test_pages_survive_the_round_trip(spark, clashing, monkeypatch):
    rng = random.Random(3)
    long = "".join(rng.choice("abc <>é") for _ in range(300000))
    body = "same " * 40
    rows = [(i, f"http://h/{i}", f"<p>{rng.random()} some text of page {i} é</p>" * 5) for i in range(60)]
    rows += [(70, None, body), (65, "http://h/x y\r\nEvil: 1", body), (66, "", body), (80, "u", None), (81, "u", ""), (82, "u", "short"), (83, "u", "short"), (84, "u", long),
             (85, "u", long), (None, "u", body), (66, "", body), (90, "u", "\r\n\r\n" * 30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = A.round_trip(clashing(pages)).collect()
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = min((j for j, _, g in rows if j is not None and g == h), default=None)
        again = len(b) >= 100 and i is not None and first is not None and i > first
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert A.round_trip(pages.limit(0)).collect() == []


def test_archive_frames():
    import zstandard

    records = [A.record(i, f"http://h/{i}", (f"payload {i} " * 30).encode(), "d", None, 1) for i in range(200)]
    data = A.archive(records)
    assert list(A.read_archive(io.BytesIO(data))) == records and list(A.read_archive(io.BytesIO(A.archive(records[:1])))) == records[:1]
    magic, size = np.frombuffer(data[:8], "<u4")
    assert magic == 0x184D2A5D and size > 0
    # each record is a frame of its own, read with the embedded dictionary alone
    words = zstandard.ZstdCompressionDict(data[8:8 + size])
    first = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
    assert first.decompress(data[8 + size:]) == records[0] and first.unused_data
    with pytest.raises(ValueError):
        list(A.read_archive(io.BytesIO(data[:-3])))


# ---------------------------------------------------------------- mixing


def filled(sizes, weights=(5, 2, 1)):
    """Targets by sharing again until no source is above its cap."""
    names = sorted(sizes, key=lambda n: (n is None, n or ""))
    w = {n: weights[k % 3] for k, n in enumerate(names)}
    left, open_, goal = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {n: left * w[n] / sum(w[m] for m in open_) for n in open_}
        over = {n for n in open_ if share[n] >= 2 * sizes[n]}
        if not over:
            goal |= share
            break
        for n in over:
            goal[n] = 2.0 * sizes[n]
            left -= goal[n]
        open_ -= over
    return goal


@pytest.mark.parametrize("edge", [4, 512])
def test_mix_meets_targets(make_docs, clashing, edge, monkeypatch):
    monkeypatch.setattr(X, "EDGE_DOCUMENTS", edge)
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(1, 60), None, rng.choice(["a", "b", "é", "Z", None, "big", "big", "big"])) for i in range(900)]
    rows += [(1000, None, None, "a"), (1001, "", None, "none"), (1002, "\x1fx\ty  z", None, "b"), (1003, "w " * 50000, None, "big"), (None, "w w", None, "a"), rows[0]]
    docs = make_docs(*rows)
    out = X.mix_sizes(docs).collect()
    assert len(out) == len(rows) and sorted(map(tuple, out), key=str) == sorted(map(tuple, X.mix_sizes(docs.repartition(7)).collect()), key=str)
    sizes, source = {}, {}
    for i, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").replace("\t", " ").split(" ")) - (t or "").replace("\t", " ").split(" ").count("")
        source[i] = s
    goal, taken = filled(sizes), {}
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(goal[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(0 <= goal[s] - taken[s] <= (60 if s != "big" else 50060) for s in goal)
    docs = clashing(docs)
    mixed = X.mixed(docs)
    assert mixed.columns == docs.columns
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    for i in {r.doc_id for r in out if r.size}:
        assert sum(r.taken for r in out if r.doc_id == i) == got.get(i, 0) * next(r.size for r in out if r.doc_id == i and r.size)
    assert X.mix_sizes(make_docs()).collect() == [] and X.mixed(make_docs()).collect() == []


# ---------------------------------------------------------------- sharding


def test_shards_fit_their_limit(make_docs, clashing):
    rng = random.Random(8)
    rows = [(i, "é" * rng.randrange(50)) for i in range(3000)] + [(7, "x" * 99)] * 400 + [(9000, "y" * 5000), (9001, None), (9002, ""), (None, "n" * 10)]
    docs = clashing(make_docs(*rows))
    out = S.sharded(docs, 2000)
    assert out.columns[:len(docs.columns)] == docs.columns
    out = out.collect()
    assert len(out) == len(rows)
    shards = {}
    for r in out:
        shards.setdefault(r.shard_id, []).append(r)
    for name, rs in shards.items():
        size = sum(len((r.text or "").encode()) for r in rs)
        assert (size, len(rs)) == (rs[0].shard_bytes, rs[0].shard_docs) and (size <= 2000 or len(rs) == 1)
    # prefixes part the hashes: no bucket lies within another, and a parent would not have fitted
    leaves = {(r.shard_depth, int(r.shard_id.split("+")[0].split("/")[1])) for r in out}
    for d, p in leaves:
        assert not any((e, p >> (d - e)) in leaves for e in range(d))
    whole = {}
    for r in out:
        d, p = r.shard_depth, int(r.shard_id.split("+")[0].split("/")[1])
        whole[d, p] = whole.get((d, p), 0) + len((r.text or "").encode())
    for d, p in leaves:
        if d:
            assert sum(v for (e, q), v in whole.items() if e >= d - 1 and q >> (e - d + 1) == p >> 1) > 2000
    assert [r.shard_id for r in S.sharded(docs.limit(5), 1 << 30).collect()] == ["0/0"] * 5
    assert S.sharded(make_docs(), 2000).collect() == []


# ---------------------------------------------------------------- urls


def judged(url, rules, default):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (len(r.host + r.path), len(r.host)), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else default


def test_urls_equal_brute_force(spark, clashing):
    rng = random.Random(2)
    hosts = ["net", "example.net", "a.example.net", "Sub.EXAMPLE.com", "example.com", "x.org", "org", "notexample.net", "net.com", "", "ÄÖ.net", "a..net", "h:80", *(f"h{i}.net" for i in range(300))]
    urls = [f"http{rng.choice(['', 's'])}://{h}{p}" for h in hosts for p in ("", "/", "/en/", "/en/x?y=1", "/de/q#z", "/fr", "/fr/#/en/", "?/en/", "#x")]
    urls += [None, "", "net/en/", "://", "a://b://c", "HTTP://EXAMPLE.NET/EN/", "http://example.net/en/" + "x" * 100000]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, urls[0]), (0, urls[0])]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string"))
    more = (*U.RULES, *(U.Rule(rng.choice([U.BLOCK, U.ALLOW]), f"h{i}.net", rng.choice(["/", "/e", "/en/x", ""])) for i in range(0, 300, 2)))
    for rules in (U.RULES, more, ()):
        out = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, rules).collect()), key=str)
        assert out == sorted(((i, *judged(u, rules, U.ALLOW)) for i, u in rows), key=str)
    assert U.judge(pages.limit(0)).collect() == []


def test_rules_from_a_table_and_hosts_of_many_labels(spark):
    urls = ["http://" + "a." * 20000 + "net/x", "http://b.c.example.com/de/", "http://example.com/de", "no"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame([("block", "net", "/"), ("block", "example.com", "/de/"), ("block", None, "/")], "verdict string, host string, path string")
    assert sorted((r.page_id, r.rule, r.verdict) for r in U.judge(pages, rules).collect()) == [(0, "net/", "block"), (1, "example.com/de/", "block"), (2, None, "allow"), (3, None, "allow")]


def test_cascade_is_exact_on_its_universe(spark, monkeypatch):
    monkeypatch.setattr(U, "BITS_PER_KEY", 6)  # many wrong positives, so several filters
    keys = spark.range(2000).select(F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit(7)).alias("h2"), (F.col("id") % 7 == 0).alias("mine"))
    c = U.cascade(keys.filter("mine"), keys)
    rows = keys.toPandas()
    assert len(c.levels) > 1 and (c.has(rows.h1.to_numpy(), rows.h2.to_numpy()) == rows.mine.to_numpy()).all()


# ---------------------------------------------------------------- pipeline


def test_stages_follow_each_other(spark, tmp_path):
    import corpus_pipeline as P
    from tests_pipeline_data import documents

    docs, bench, expect = documents()
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert [name for name, _ in P.STAGES] == ["language", "near_dedup", "decontamination", "mixing", "sharding"]
    df = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = df.columns, []
    for name, stage in P.STAGES[:-1]:
        df = stage(spark, df, folder)
        assert df.columns == columns
        df.write.parquet(f"{folder}/{name}")
        df = spark.read.parquet(f"{folder}/{name}")
        seen.append({r.doc_id for r in df.select("doc_id").collect()})
    for got, (kept, gone) in zip(seen, expect):
        assert kept <= got and not got & gone
    out = P.run(spark, folder).collect()
    assert {r.doc_id for r in out} == seen[-1] and len(out) == df.count() and all(r.shard_id for r in out)
    empty = str(tmp_path / "none")
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"{empty}/benchmark.parquet")
    assert P.run(spark, empty).collect() == []

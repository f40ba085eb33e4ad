"""BPE encoding, whitening and fill-in-the-middle."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytally.llm import bpe as B
from skytally.llm import fim as M
from skytally.llm import whiten as W
from skytally.llm.chunks import chunk_ends

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b", "the", " ", "  ", "\n", "\t", "'re", "'", "'l", "l", "5", "12", "!", "...", "漢", "字", "é", "é", "　", "😀", "՘", "<|endoftext|>",
          "<|endof", "text|>", " " * 30, "a" * 200, "\n" * 40, "ß", "Ω", "ж", " ", "\x00", "<P>", "<S", ">"]


@pytest.fixture(scope="module")
def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def odd_texts(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 3, 10, 60, 200]))) for _ in range(n)]


def test_chunks_follow_content():
    rng = random.Random(1)
    body = bytes(rng.choice(b"abcdefgh \n") for _ in range(20000))
    a, b = chunk_ends(body), chunk_ends(b"something else stands before it. " + body)
    assert a[-1] == len(body) and all(x < y for x, y in zip(a, a[1:]))
    # after the first common cut all are common
    moved = {e - 33 for e in b}
    first = next(i for i, e in enumerate(a) if e in moved)
    assert first < 5 and all(e in moved for e in a[first:])
    text = ("漢字" * 9000).encode()
    ends = chunk_ends(text)
    assert max(np.diff([0, *ends])) <= 4096 and all(text[x:y].decode() for x, y in zip([0, *ends], ends))
    assert chunk_ends(b"") == [] and chunk_ends(b"x") == [1]


@pytest.mark.parametrize("size", [(2, 1, 8), (3, 4, 16), (5, 16, 64), (9, 128, 4096)])
def test_joined_chunks_equal_the_library(library, size):
    coder = B.Coder(B.read_spec(PATH), *size)
    for s in odd_texts(400, size[0]):
        ids = coder.whole(s, {})
        want = library.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, s
        assert B.text_of(ids, B.read_spec(PATH)) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("size", [(2, 1, 8), (3, 4, 16), (5, 16, 64)])
def test_lent_and_own_chunks_equal_the_library(library, size):
    coder, rng = B.Coder(B.read_spec(PATH), *size), random.Random(3)
    for s in odd_texts(200, 7 + size[0]):
        chunks = [c.decode() for part in coder.parts(s) if isinstance(part, list) for c in part]
        for share in (0.1, 0.5, 1.0):
            known = {k: coder.chunk(c) for k, c in enumerate(chunks) if rng.random() < share}
            assert np.frombuffer(coder.whole(s, known), "<u4").tolist() == library.encode(s, add_special_tokens=False).ids, s


def test_ascii_words_are_the_published_ones():
    coder, rng = B.Coder(B.read_spec(PATH)), random.Random(4)
    pool = [*map(chr, range(128)), *"  ''stremld\n\t\x0b\x0c\r\x1c\x1f"]
    for _ in range(4000):
        s = "".join(rng.choices(pool, k=rng.randint(0, 20)))
        assert coder.words(s) == [s[a:b] for _, (a, b) in coder.library.pre_tokenizer.pre_tokenize_str(s)]


def test_own_text_is_encoded_without_joins_and_frequent_words_once(library, monkeypatch):
    """op11: a text that shares no chunk has no join; a word that comes often outlives a full memory."""
    coder, text = B.Coder(B.read_spec(PATH)), " ".join(f"word{i} often" for i in range(900))
    assert len(coder.parts(text)[0]) > 5
    with monkeypatch.context() as m:
        m.setattr(B.Coder, "_meet", lambda *_: pytest.fail("a join"))
        assert np.frombuffer(coder.whole(text, {}), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(B, "KNOWN_WORDS", 4)
    asked = []

    class Model:
        def tokenize(self, letters):
            asked.append(letters)
            return coder.model.tokenize(letters)

    known = B._Known(Model())
    for i in range(50):
        assert known["often"] == coder.encode("often") and known[f"w{i}"] == coder.encode(f"w{i}") and len(known) + len(known.older) <= 8
    assert asked.count("often") == 1


def test_words_of_any_length(library):
    coder = B.Coder(B.read_spec(PATH))
    for s in ("a" * 300_000, " " * 300_000 + "x", "1" * 50_000 + "b", "漢" * 50_000):
        assert np.frombuffer(coder.whole(s, {}), "<u4").tolist() == library.encode(s, add_special_tokens=False).ids


def test_every_code_point_is_classed_like_the_library(library):
    coder = B.Coder(B.read_spec(PATH))
    points = [c for c in range(0, 0x40000, 3) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 4000):
        s = "".join(f"\na{chr(c)}a\n1{chr(c)}1\n!{chr(c)}!" for c in points[lo:lo + 4000])
        assert coder.words(s) == [s[x:y] for _, (x, y) in library.pre_tokenizer.pre_tokenize_str(s)]


def test_encoding_of_documents(library, make_docs, clashing):
    rng = random.Random(8)
    words = ["stone", "river", "größe", "the", "of", "\n", "漢字", "  "]
    passage = " ".join(rng.choice(words) for _ in range(900))
    texts = odd_texts(60) + [passage, passage, "before " + passage, passage + "!", "x" * 3000 + passage + "y" * 5000, None, "", passage * 3]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "another text"), (60, passage), (60, passage)]
    docs = clashing(make_docs(*rows)).repartition(5)
    spec = B.read_spec(PATH)

    def want(t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    got = B.digests(docs, spec).collect()
    assert sorted(map(repr, got)) == sorted(repr(type(got[0])("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")(i, *want(t))) for i, t in rows)
    ids = {r.doc_id: r.ids for r in B.encoded(docs, spec).filter("doc_id >= 60").collect()}
    assert np.frombuffer(ids[62], "<u4").tolist() == library.encode("before " + passage, add_special_tokens=False).ids
    assert B.encoded(make_docs(), spec).collect() == []


def test_shared_chunks_are_encoded_by_one_text(make_docs, monkeypatch, spark):
    """The chunks that `encodings` lends stand in several texts, and each is made once."""
    rng = random.Random(2)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2000))
    docs = make_docs(*((i, f"{i} " * 40 + passage + f" {i}") for i in range(12)))
    written = {}

    def keep(df, name="stash"):
        from skytally.lineage import stash
        written[name] = stash(df, name)
        return written[name]

    monkeypatch.setattr(B, "stash", keep)
    B.encodings(docs, B.read_spec(PATH)).collect()
    owners = written["uses"].filter("own").count()
    assert written["shared"].count() == owners and owners >= 15
    # the passage's first and last chunk reach beyond it and may be shared by fewer
    counts = sorted(r["n"] for r in written["uses"].groupBy("c1", "c2").agg(F.count("*").alias("n")).collect())
    assert len(counts) == owners and counts[0] >= 2 and counts[2:] == [12] * (owners - 2)
    assert written["pieces"].count() - written["uses"].count() < 12 * 6


def test_tokenizers_of_other_kinds_are_refused():
    with pytest.raises(ValueError):
        B.Coder(B.read_spec(public_tokenizers.path("word_bpe_49k.json")))


# ---------------------------------------------------------------- whitening


def test_counts_and_leading_eigenvalues():
    rng = np.random.default_rng(1)
    for d in (1, 2, 3, 8, 40):
        for rep in range(12):
            a = rng.standard_normal((d, int(max(1, rng.integers(1, 2 * d + 1)))))
            a = a @ a.T
            if rep % 4 == 0:
                a = np.diag(np.repeat(rng.random((d + 1) // 2), 2)[:d])
            if rep % 7 == 0:
                a = np.eye(d)
            w = np.linalg.eigvalsh(a)[::-1]
            shift = float(rng.random() * w[0])
            assert W.above(a, shift) == (w >= shift).sum()
            e, v = W.leading(a, 4)
            assert len(e) == min(4, (w > 1e-10 * w[0]).sum())
            assert np.allclose(e, w[:len(e)], rtol=1e-11) and np.abs(v @ v.T - np.eye(len(e))).max() < 1e-10
            assert np.abs(a @ v.T - v.T * e).max() < 1e-11 * w[0]
    assert len(W.leading(np.zeros((3, 3)), 4)[0]) == 0


VECTORS = "vec_id long, embedding array<float>, label int"


def brute_whitening(rows):
    kept = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows]
    x = np.unique(np.array([v for _, v in kept]), axis=0)
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    return {i: (sum((n * int(a) - int(b)) ** 2 for a, b in zip(w, s)), ((w - s / n) @ v[:, :4]) / np.sqrt(e[:4])) for i, w in kept}, e[:4] / e.sum(), n


def test_whitening_equals_a_full_decomposition(spark, clashing):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 9)) @ np.diag([5, 4, 3, 2, 1, 1, 1, .5, .1])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, v) for i, v in rows[:40]] + [rows[5], (None, rows[7][1])]
    bad = [(2000, None), (2001, [None] * 9), (2002, [float("nan")] * 9), (2003, [float("inf")] + [0.0] * 8), (2004, []), (2005, [1.0, 2.0])]
    df = clashing(spark.createDataFrame([(i, v, 1) for i, v in rows + bad], VECTORS)).repartition(4)
    got = W.components(df).collect()
    want, share, n = brute_whitening([(i, v) for i, v in rows if i is not None])
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    sign = {}
    for r in got:
        if r.vec_id is None:
            continue
        d, y = want[r.vec_id]
        assert r.deviation == d and abs(r.explained / share[r.component - 1] - 1) < 1e-10
        k = r.component - 1
        if abs(y[k]) > 1e-3:
            assert sign.setdefault(k, np.sign(r.whitened * y[k])) == np.sign(r.whitened * y[k])
        assert abs(abs(r.whitened) - abs(y[k])) < 1e-8
    assert W.components(spark.createDataFrame([], VECTORS)).collect() == []
    assert W.components(spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], VECTORS)).collect() == []
    two = W.components(spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [3.0, 2.0], 1)], VECTORS)).collect()
    assert [(r.component, r.n, r.deviation, abs(round(r.whitened, 9)), r.explained) for r in two] == [(1, 2, 512 ** 2, 1.0, 1.0)] * 2


def test_deviations_stay_exact_beyond_64_bits():
    w = W.Whitening(10**9, [10**15 + 1, -7], np.zeros(0), np.zeros((0, 2)), 0.0)
    x = np.array([[10**6, 0], [10**6 + 100, 5]])
    assert w.deviations(x) == [1 + 49, None]


# ---------------------------------------------------------------- fill in the middle


def brute_fim(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_texts():
    rng = random.Random(4)
    lines = ["stone", "größe 漢字", "", "\r", "<P", "S>", "😀 x", "long " * 80]
    return ["\n".join(rng.choice(lines) for _ in range(rng.choice([1, 2, 9, 300]))) for _ in range(80)] + [None, "", "\n", "\n\n", "no end", "x<P>y", "a" * 126 + "<P>" + "b" * 400, "<" + "\n" * 9000]


@pytest.mark.parametrize("size", [(2, 1, 8), (9, 128, 4096)])
def test_layout_equals_splitting(size):
    memo = M.Memo(4096)
    for i, t in enumerate(fim_texts() * 2):
        n, form, p, m, out = brute_fim(i, t)
        h = hashlib.sha256(f"7:{i}".encode()).hexdigest()
        got = M.transformed((t or "").encode(), tuple(int(h[8 * k:8 * k + 8], 16) for k in range(4)), memo=memo, size=size)
        assert got == (n, form, p, m, out.encode())


def test_fill_in_middle_and_back(make_docs, clashing):
    rows = [(i, t) for i, t in enumerate(fim_texts())] + [(None, "no\nid"), (3, "again\n3"), (1, fim_texts()[1])]
    docs = clashing(make_docs(*rows)).repartition(3)
    for rate, spm in ((100, 50), (40, 0)):
        made = M.fill_in_middle(docs, rate, spm).withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
        assert sorted(map(repr, (tuple(r)[:6] for r in made))) == sorted(repr((i, *brute_fim(i, t, 7, rate, spm))) for i, t in rows)
        assert sorted(((r.doc_id, r.back) for r in made), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert M.fill_in_middle(make_docs()).collect() == []

import random
import re
from collections import defaultdict

import numpy as np

from skytally.llm.components import components
from skytally.llm.minhash import least_matches, near_duplicates, signature, survivors
from skytally.llm.words import linked, shingle_sets

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """Component and number of shingles of each document, all pairs compared."""
    sets = defaultdict(list)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i].append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    lead = {i: i for i in sets}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and any(s and t and 100 * len(s & t) >= 75 * len(s | t) for s in sets[i] for t in sets[j]):
                a, b = find(i), find(j)
                lead[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}, {i: [len(s) for s in v] for i, v in sets.items()}


def words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def corpus():
    rng, rows = random.Random(4), []
    for g in range(40):
        base = words(rng, rng.choice([3, 6, 30, 80, 300]))
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randrange(6)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(999)}"
            rows.append((len(rows), rng.choice([" ", "\n", "\t "]).join(copy).upper()))
    shared = words(rng, 60)  # a passage that many documents share, some of them short
    for k in range(60):
        rows.append((len(rows), " ".join(words(rng, rng.randrange(30)) + shared)))
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(make_docs):
    rows = corpus()
    comp, sizes = brute(rows)
    out = near_duplicates(make_docs(*rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.component_id, [r.n_shingles], r.kept) == (comp[r.doc_id], sizes[r.doc_id], comp[r.doc_id] == r.doc_id)


def test_defined_cases(make_docs, clashing):
    long = " ".join(words(random.Random(1), 60000))
    rows = [(9, "one two three four five six"), (4, "ONE two  three\nfour five six"), (5, None), (6, ""), (7, " \t\n"), (8, "one two"),
            (3, "One Two"), (2, long), (1, long + " tail"), (None, "one two"), (9, "one two three four five six")]
    out = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_duplicates(clashing(make_docs(*rows))).collect()}
    assert out == {(9, 2): (4, False), (4, 2): (4, True), (5, 0): (5, True), (6, 0): (6, True), (7, 0): (7, True), (8, 1): (3, False), (3, 1): (3, True),
                   (2, 59996): (1, False), (1, 59997): (1, True), (None, 1): (None, True)}
    assert near_duplicates(make_docs()).collect() == []


def test_tiles_keep_every_link(make_docs, monkeypatch):
    """Blocks of a few rows give the same components."""
    import skytally.llm.minhash as m

    monkeypatch.setattr(m, "TILE", 4)
    rows = corpus()
    comp, _ = brute(rows)
    assert {r.doc_id: r.component_id for r in near_duplicates(make_docs(*rows)).collect()} == comp


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 1 << 63, 2000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:1600], rng.integers(0, 1 << 63, 200).astype(np.uint64)]))
    same = (signature(a).view(np.uint16) == signature(b).view(np.uint16)).mean()
    assert abs(same - 1600 / 2200) < 0.15
    assert list(least_matches()) == sorted(least_matches()) and least_matches()[-1] < 96
    keep, found = survivors(np.stack([signature(a)] * 2), np.stack([signature(a), signature(a[:10])]))
    assert keep.tolist() == [0] and found.tolist() == [128]


def test_long_words_with_swapped_blocks_differ():
    a, b = b"a" * 2048 + b"b" * 2048, b"c" * 4096
    first, second, again = shingle_sets([a + b, b + a, a + b])
    assert first[0] == again[0] != second[0]


def test_words_are_runs_without_blanks():
    a, b = shingle_sets(["Äb c d e f\x1fg\x0bh".encode(), "äb c d e f\x1fg h".encode()])
    assert len(a) == 1 and not linked(a, b) and linked(a, a)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(1, 300)]
    star = [(1000, k) for k in range(1001, 1400)]
    out = dict(components(spark.createDataFrame(chain + star + [(5, 5), (None, 3), (7, 6)], "a long, b long")).collect())
    assert out == {**{i: 1 for i in range(1, 301)}, **{k: 1000 for k in range(1000, 1400)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []

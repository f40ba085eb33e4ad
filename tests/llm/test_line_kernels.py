"""Shingle sets and bands of lines against plain Python sets."""

import random

import numpy as np

from skytally.llm import lines as N


def plain_set(line):
    return {line[i:i + 8] for i in range(max(1, len(line) - 7))}


def some_lines():
    rng = random.Random(3)
    kinds = ["ab", "abcdefgh ", "äß漢字😀x", "\x00a"]
    made = ["".join(rng.choice(rng.choice(kinds)) for _ in range(n)) for n in [1, 2, 7, 8, 9, 15, 16, 40, 41, 300] for _ in range(20)]
    # longer than a chunk, and one character repeated
    return made + ["abc" * (N.CHUNK // 2), "-" * 20, "-" * 500, "a", "a\x00", "a" * 7, "a" * 8]


def test_sets_equal_plain_sets():
    lines = some_lines()
    found = list(N._sets(lines))
    assert [len(s) for s in found] == [len(plain_set(t)) for t in lines]
    assert all((s[1:] > s[:-1]).all() for s in found)
    rng = random.Random(4)
    for _ in range(2000):
        i, j = rng.randrange(len(lines)), rng.randrange(len(lines))
        assert len(np.intersect1d(found[i], found[j])) == len(plain_set(lines[i]) & plain_set(lines[j]))


def test_equal_sets_have_equal_bands_and_every_line_has_one():
    lines = some_lines()
    bands = [set() for _ in lines]
    for lo, hi in N._chunks(lines):
        for line, band in zip(*(a.tolist() for a in N._bands_of(lines[lo:hi]))):
            bands[lo + line].add(band)
    assert all(bands)
    by_set = {}
    for t, b in zip(lines, bands):
        assert by_set.setdefault(frozenset(plain_set(t)), b) == b
    assert bands[lines.index("-" * 20)] == bands[lines.index("-" * 500)]

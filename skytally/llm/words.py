"""Word shingles of whole texts as sets of 64-bit hashes, vectorised over many texts.

Words are runs of bytes other than space and 09 to 0D, with A-Z lower-cased, so
that they equal the matches of `[^\\x20\\x09-\\x0D]+` in the lower-cased text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHINGLE = 5
CHUNK_BYTES = 1 << 21
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_TABLE = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def randoms(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * _GOLD)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 32
_BYTE = randoms(256, 1000)[_LOWER]
_PLACE = randoms(_TABLE, 5000) | np.uint64(1)
_ORDER = randoms(SHINGLE + 1, 9000) | np.uint64(1)


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and hash of each word."""
    inside = ~_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    lengths = ends - starts
    letters = data[inside]
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    factor = _PLACE[np.minimum(place, _TABLE - 1)]
    # factors beyond the table follow the same rule, so that none repeats in a word of any length
    far = np.flatnonzero(place >= _TABLE)
    with np.errstate(over="ignore"):
        if len(far):
            factor[far] = mix((place[far].astype(np.uint64) + np.uint64(5001)) * _GOLD) | np.uint64(1)
        sums = np.add.reduceat(_BYTE[letters] * factor, first)
        return starts, mix(sums + lengths.astype(np.uint64) * _GOLD)


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its 5-word shingles.

    A text of 1 to 4 words gives one hash of the whole sequence, one without
    words an empty array. Texts are taken together up to about 2 MB; a longer
    text is taken alone.
    """
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) < CHUNK_BYTES):
            size += len(texts[upto]) + 1
            upto += 1
        part = texts[at:upto]
        data = np.frombuffer(b"\n".join(part), np.uint8)
        starts, words = _word_hashes(data)
        offsets = np.cumsum([0] + [len(t) + 1 for t in part])
        cuts = np.searchsorted(starts, offsets)
        n = len(words)
        with np.errstate(over="ignore"):
            if n >= SHINGLE:
                rolled = sum((words[j:n - SHINGLE + 1 + j] * _ORDER[j] for j in range(1, SHINGLE)), words[:n - SHINGLE + 1] * _ORDER[0])
                rolled = mix(rolled)
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi - lo >= SHINGLE:
                    yield np.unique(rolled[lo:hi - SHINGLE + 1])
                elif hi > lo:
                    few = words[lo:hi] * _ORDER[:hi - lo]
                    yield mix(np.atleast_1d(few.sum(dtype=np.uint64)) + np.uint64(hi - lo) * _ORDER[SHINGLE])
                else:
                    yield np.zeros(0, np.uint64)
        at = upto


def linked(a: np.ndarray, b: np.ndarray, share: int = 75) -> bool:
    """Whether 100 * intersection >= share * union of two sorted sets, neither empty."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < share * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= share * (len(a) + len(b) - both)

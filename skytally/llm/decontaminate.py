"""Benchmark decontamination by the q-gram lemma in diagonal bands.

Benchmark items are cut into overlapping segments of 64 normalised characters.
A region of a document within k edits of a segment of length L shares at least
L - q + 1 - q * k of its q-grams, and all of them lie on diagonals (document
position less segment position) that span at most k. Shared q-grams are
counted in overlapping bands of 2 * k diagonals, every k diagonals; bands that
reach the bound are verified by a banded alignment that may begin and end
anywhere in the document.

Texts are normalised alike on both sides: letters and digits in lower case,
any other run as one blank. Segments begin every 8 characters and at the end of
an item, so a passage of 64 normalised characters or more from anywhere in an item is at most
4 characters off a segment. That costs at most 4 of its 6 edits, so that
verbatim passages are always found; of an item under 64 characters all of it is.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytally.llm.rows import keep_rows

Q = 8
SEGMENT, STEP = 64, 8
SHORTEST = 24
EDIT_SHARE = 0.1
BLOCK_CHARS = 1 << 20
PIECE = 1 << 20
#: Pairs of a position and a segment's q-gram that are held at once.
POSTINGS = 1 << 22
_OVERLAP = 4 * SEGMENT
_WALL = np.uint32(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22
_FAR = 100


@lru_cache
def _plain() -> np.ndarray:
    """The normalised code point of each code point; 32 for what is neither letter nor digit."""
    table = np.full(0x110000, 32, np.uint32)
    for cp in range(0x30000):
        c = chr(cp)
        if c.isalnum():
            table[cp] = ord(c.lower()[0])
    table[1] = _WALL
    return table


def normalised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts with a wall after each, and where each text begins (and the end)."""
    raw = np.frombuffer("".join((t or "") + "\x01" for t in texts).encode("utf-32-le", "replace"), np.uint32)
    codes = _plain()[raw]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    ends = np.cumsum([0] + [len(t or "") + 1 for t in texts])
    return codes[keep], np.concatenate([[0], np.cumsum(keep)])[ends]


def grams(codes: np.ndarray) -> np.ndarray:
    """Hashes of the runs of eight codes."""
    if len(codes) < Q:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = codes.astype(np.uint64)
        for width, factor in ((1, _BASE), (2, _BASE * _BASE), (4, _BASE * _BASE * _BASE * _BASE)):
            h = h[:-width] * factor + h[width:]
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Index:
    """The q-grams of a block of benchmark items."""

    ids: list[int | None]   # item_id of each item
    items: np.ndarray       # items of the segments, those of one segment together
    upto: np.ndarray        # how many of them belong to the segments before each, and the number of all
    codes: np.ndarray       # distinct segments x 64, padded with 0
    lengths: np.ndarray
    budget: np.ndarray      # edits allowed
    least: np.ndarray       # q-grams that a region must share
    hashes: np.ndarray      # distinct q-grams, sorted
    first: np.ndarray       # their first posting, and the number of postings at the end
    segment: np.ndarray     # postings
    place: np.ndarray
    bitmap: np.ndarray


def index(items: list[tuple[int, str | None]]) -> Index | None:
    """None when no item is long enough to be looked for (24 normalised characters)."""
    ids, at_item, at_part, owners, parts = [], {}, {}, [], []
    for item, text in items:
        codes = normalised([text])[0][:-1]
        codes = codes[codes != _WALL]
        a, b = (1 if len(codes) and codes[0] == 32 else 0), (len(codes) - 1 if len(codes) and codes[-1] == 32 else len(codes))
        codes = codes[a:b]
        if len(codes) < SHORTEST:
            continue
        # an item without id is told apart by its text
        which = at_item.setdefault(text if item is None else item, len(ids))
        if which == len(ids):
            ids.append(item)
        last = max(len(codes) - SEGMENT, 0)
        for at in sorted({*range(0, last + 1, STEP), last}):
            # equal segments, of one item or several, are looked for once
            k = at_part.setdefault(codes[at:at + SEGMENT].tobytes(), len(parts))
            if k == len(parts):
                parts.append(codes[at:at + SEGMENT])
                owners.append([])
            owners[k].append(which)
    if not parts:
        return None
    lengths = np.array([len(p) for p in parts])
    budget = np.minimum((lengths * EDIT_SHARE).astype(int), (lengths - Q) // Q)
    table = np.zeros((len(parts), SEGMENT), np.uint32)
    for r, p in enumerate(parts):
        table[r, :len(p)] = p
    found = [grams(p) for p in parts]
    segment = np.repeat(np.arange(len(parts)), [len(g) for g in found])
    place = np.concatenate([np.arange(len(g)) for g in found])
    h = np.concatenate(found)
    order = np.argsort(h, kind="stable")
    hashes, first = np.unique(h[order], return_index=True)
    bitmap = np.zeros(1 << _BITS, bool)
    bitmap[hashes >> np.uint64(64 - _BITS)] = True
    return Index(ids, np.concatenate([np.array(o) for o in owners]), np.cumsum([0] + [len(o) for o in owners]), table, lengths, budget, lengths - Q + 1 - Q * budget, hashes, np.append(first, len(h)),
                 segment[order], place[order], bitmap)


def _bands(ix: Index, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments and first diagonals of the bands that share enough q-grams."""
    h = grams(codes)
    at = np.flatnonzero(ix.bitmap[h >> np.uint64(64 - _BITS)])
    row = np.minimum(np.searchsorted(ix.hashes, h[at]), len(ix.hashes) - 1)
    same = ix.hashes[row] == h[at]
    at, row = at[same], row[same]
    counts = ix.first[row + 1] - ix.first[row]
    # positions are taken in slices whose postings are bounded, however often the q-grams repeat
    upto = np.cumsum(counts)
    edges = [0, *np.unique(np.searchsorted(upto, np.arange(POSTINGS, upto[-1] if len(upto) else 0, POSTINGS), "right")).tolist(), len(at)]
    found = [_cells(ix, at[a:b], row[a:b], counts[a:b]) for a, b in zip(edges, edges[1:]) if a < b]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    n = np.bincount(back, np.concatenate([m for _, m in found]), len(keys)).astype(np.int64)
    total = n.copy()
    beside = np.flatnonzero(keys[1:] == keys[:-1] + 1)
    total[beside] += n[beside + 1]
    seg = (keys >> 32).astype(np.int64)
    # a band may also hold its second cell only: its first cell is then the one before
    ok = total >= ix.least[seg]
    seg, cell = seg[ok], keys[ok] & 0xFFFFFFFF
    return seg, cell * np.maximum(ix.budget[seg], 1) - SEGMENT


def _cells(ix: Index, at: np.ndarray, row: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells (segment, diagonal) that q-grams at these positions fall into, and how many fall there."""
    post = np.repeat(ix.first[row] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    seg = ix.segment[post]
    width = np.maximum(ix.budget[seg], 1)
    # diagonals are counted from -64, so that none is negative
    cell = (np.repeat(at, counts) - ix.place[post] + SEGMENT) // width
    return np.unique((seg.astype(np.int64) << 32) | cell, return_counts=True)


def _aligned(ix: Index, codes: np.ndarray, seg: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edits of the best alignment in each band, and the position where it ends."""
    edits, ends = np.full(len(seg), _FAR), np.zeros(len(seg), np.int64)
    for length in np.unique(ix.lengths[seg]):
        for rows in np.array_split(np.flatnonzero(ix.lengths[seg] == length), 1 + len(seg) // 20000):
            if not len(rows):
                continue
            k = int(ix.budget[seg[rows[0]]])
            reach = 2 * max(k, 1) + 2 * k + 1
            start = diagonal[rows] - k
            window = start[:, None] + np.arange(length + reach)
            text = np.where((window >= 0) & (window < len(codes)), codes[np.clip(window, 0, len(codes) - 1)], _WALL)
            wall = text == _WALL
            # passing a wall costs more than any budget
            beyond = wall * np.int16(_FAR)
            cost = np.zeros((len(rows), length + reach + 1), np.int16)
            np.cumsum(np.maximum(beyond, np.int16(1)), axis=1, out=cost[:, 1:])
            best = np.zeros((len(rows), reach), np.int16)
            for i in range(1, length + 1):
                step = best + (text[:, i - 1:i - 1 + reach] != ix.codes[seg[rows], i - 1][:, None])
                step += beyond[:, i - 1:i - 1 + reach]
                step[:, :-1] = np.minimum(step[:, :-1], best[:, 1:] + np.int16(1))
                c = cost[:, i:i + reach]
                best = np.minimum.accumulate(step - c, axis=1) + c
            d = best.argmin(axis=1)
            edits[rows] = best[np.arange(len(rows)), d]
            ends[rows] = start + length + d
    return edits, ends


def find(ix: Index, texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Rows `text, item, segments, edits, first, last` for each text that holds part of an item, `item` by its place in `ix.ids`.

    `first` and `last` delimit the region in the normalised text. Texts are
    taken whole, about a million characters at a time with an overlap.
    """
    rows, at = [], 0

    def lowest(doc, seg, edits, first, last):
        """One row for each text and segment."""
        order = np.lexsort((seg, doc))
        doc, seg = doc[order], seg[order]
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (seg[1:] != seg[:-1])])
        return doc[new], seg[new], np.minimum.reduceat(edits[order], new), np.minimum.reduceat(first[order], new), np.maximum.reduceat(last[order], new)

    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto] or "") < PIECE):
            size += len(texts[upto] or "") + 1
            upto += 1
        codes, begin = normalised(texts[at:upto])
        for lo in range(0, len(codes), PIECE):
            part = codes[lo:lo + PIECE + _OVERLAP]
            seg, diagonal = _bands(ix, part)
            if not len(seg):
                continue
            edits, ends = _aligned(ix, part, seg, diagonal)
            ok = edits <= ix.budget[seg]
            if not ok.any():
                continue
            seg, edits, ends = seg[ok], edits[ok], ends[ok] + lo
            doc = np.searchsorted(begin, ends - 1, "right") - 1
            doc, seg, edits, first, last = lowest(doc, seg, edits, np.maximum(ends - ix.lengths[seg] - begin[doc], 0), ends - begin[doc])
            many = ix.upto[seg + 1] - ix.upto[seg]
            place = np.repeat(ix.upto[seg] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            rows.append(np.stack([np.repeat(doc + at, many), ix.items[place], place, *(np.repeat(c, many) for c in (edits, first, last))], axis=1))
        at = upto
    if not rows:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    r = np.concatenate(rows)
    r = r[np.lexsort((r[:, 2], r[:, 1], r[:, 0]))]
    new = np.flatnonzero(np.r_[True, (r[1:, :2] != r[:-1, :2]).any(axis=1)])
    fresh = np.r_[True, (r[1:, :3] != r[:-1, :3]).any(axis=1)]
    return (r[new, 0], r[new, 1], np.add.reduceat(fresh.astype(np.int64), new), np.minimum.reduceat(r[:, 3], new),
            np.minimum.reduceat(r[:, 4], new), np.maximum.reduceat(r[:, 5], new))


def _blocks(benchmark: DataFrame):
    """The items in blocks of about BLOCK_CHARS characters, so that what is sent to the executors is bounded."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_CHARS)
    for b in range(blocks):
        ix = index([(r.item_id, r.text) for r in items.filter(F.pmod(F.when(F.col("item_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("item_id")), F.lit(blocks)) == b).collect()])
        if ix is not None:
            yield benchmark.sparkSession.sparkContext.broadcast(ix)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`doc_id, item_id, segments, edits, first, last`: documents that hold a passage of an item.

    A NULL, empty or short text holds nothing, nor does an item of fewer than
    24 normalised characters; an empty benchmark gives no rows. Repeated rows
    of `docs` give repeated rows, ties are all kept. Items without an id are found like others, each text as an item of its own with NULL item_id. `first` and `last` delimit the
    region in the document's normalised text.
    """
    schema = "doc_id long, item_id long, segments long, edits long, first long, last long"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for shared in _blocks(benchmark):
        def run(batches, shared=shared):
            for batch in batches:
                text, item, *rest = find(shared.value, batch.column(1).to_pylist())
                ids = pa.array(shared.value.ids, pa.int64()).take(pa.array(item))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), ids, *(pa.array(c.astype(np.int64)) for c in rest)],
                                                 names=["doc_id", "item_id", "segments", "edits", "first", "last"])

        part = docs.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose text holds no passage of an item, whether that has an id or not; without a shuffle.

    A NULL or empty text holds none, so it stays; repeated rows are decided
    alike; an empty benchmark keeps all, an empty table gives no rows.
    """
    for shared in _blocks(benchmark):
        def keep(texts, shared=shared):
            ok = np.ones(len(texts), bool)
            ok[find(shared.value, texts)[0]] = False
            return ok

        docs = keep_rows(docs, keep)
    return docs

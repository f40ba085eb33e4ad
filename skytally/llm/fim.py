"""Fill-in-the-middle by lines, with content-defined chunk memoization.

A rolling hash cuts each text into chunks. What a chunk adds is summarised
once: its line ends, its characters, whether it holds a mark, and the two bytes
at either end for a mark that a joint parts. Summaries are kept by the chunk's
content itself in a cache of bounded size in each Python worker, so that chunks shared by
documents are looked at once there and a wrong one can't be found. Running sums
of the summaries give the number of lines of a text and the chunk in which a
cut lies; only that chunk's line ends are then looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytally.llm.chunks import BITS, LEAST, MOST, chunk_ends

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
SEED, RATE, SPM = 7, 100, 50
CACHE_BYTES = 1 << 24


def _chars(data: bytes) -> int:
    return int(((np.frombuffer(data, np.uint8) & 0xC0) != 0x80).sum())


@dataclass(frozen=True)
class Summary:
    lines: int          # line ends
    chars: int
    marked: bool
    first: bytes
    last: bytes


class Memo:
    """Summaries by content; when a half is full, the older half goes."""

    def __init__(self, most: int = CACHE_BYTES):
        self.young, self.old, self.most, self.held = {}, {}, most // 2, 0

    def of(self, chunk: bytes) -> Summary:
        found = self.young.get(chunk)
        if found is None:
            found = self.old.get(chunk)
            if found is None:
                found = Summary(chunk.count(b"\n"), _chars(chunk), any(m in chunk for m in _MARKS), chunk[:2], chunk[-2:])
            if self.held + len(chunk) > self.most:
                self.young, self.old, self.held = {}, self.young, 0
            self.young[chunk] = found
            self.held += len(chunk)
        return found


_memo = Memo()


class Layout:
    """A text as chunks with running sums."""

    def __init__(self, data: bytes, memo: Memo | None = None, size=(BITS, LEAST, MOST)):
        ends = chunk_ends(data, *size)
        self.data, self.begins = data, [0, *ends]
        self.lines, self.chars, self.marked, tail = [0], [0], False, b""
        memo = memo or _memo
        for a, b in zip(self.begins, ends):
            s = memo.of(data[a:b])
            self.lines.append(self.lines[-1] + s.lines)
            self.chars.append(self.chars[-1] + s.chars)
            self.marked |= s.marked or any(m in tail + s.first for m in _MARKS)
            tail = (tail + s.last)[-2:] if b - a < 2 else s.last
        self.n = self.lines[-1] + (bool(data) and not data.endswith(b"\n"))

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and characters of the first `units` lines."""
        if units > self.lines[-1]:
            return len(self.data), self.chars[-1]
        if not units:
            return 0, 0
        k = int(np.searchsorted(self.lines, units)) - 1
        chunk = np.frombuffer(self.data[self.begins[k]:self.begins[k + 1]], np.uint8)
        within = int(np.flatnonzero(chunk == 10)[units - self.lines[k] - 1]) + 1
        return self.begins[k] + within, self.chars[k] + _chars(chunk[:within].tobytes())


def transformed(data: bytes, h: tuple[int, int, int, int], rate: int = RATE, spm: int = SPM, memo: Memo | None = None, size=(BITS, LEAST, MOST)) -> tuple:
    """`n, form, prefix_chars, middle_chars, output` of one text."""
    at = Layout(data, memo, size)
    if not data or at.marked or h[2] % 100 >= rate:
        return at.n, "plain", None, None, data
    (a, before), (b, upto) = (at.cut(u) for u in sorted((h[0] % (at.n + 1), h[1] % (at.n + 1))))
    p, s, m = _MARKS
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h[3] % 100 < spm:
        return at.n, "spm", before, upto - before, s + suffix + p + prefix + m + middle
    return at.n, "psm", before, upto - before, p + prefix + s + suffix + m + middle


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """`doc_id, n, form, prefix_chars, middle_chars, output` for each row of `docs(doc_id, text, ...)`.

    Of each hundred texts `rate` are parted, and of these `spm` have their suffix first; both
    and the two cuts follow from a hash of seed and doc_id, so reruns agree and
    repeated rows are parted alike. A text that is empty (NULL counts as empty)
    or holds a mark stays plain. A NULL doc_id is hashed as an empty one. Other columns are
    not read; an empty table gives no rows.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))).cast("binary"), 256)
    parts = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"), *parts)

    def run(batches):
        for batch in batches:
            h = zip(*(batch.column(c).to_pylist() for c in range(2, 6)))
            out = [transformed(t, k, rate, spm) for t, k in zip(batch.column(1).to_pylist(), h)]
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())))],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    out = rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of."""
    def upto(mark):
        return F.locate(mark, output)

    def between(a, b):
        return F.substring(output, a + 3, b - a - 3)

    m, end = upto(MIDDLE), F.length(output) + 1
    psm = F.concat(between(F.lit(1), upto(SUFFIX)), between(m, end), between(upto(SUFFIX), m))
    spm = F.concat(between(upto(PREFIX), m), between(m, end), between(F.lit(1), upto(PREFIX)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)

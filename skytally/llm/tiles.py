"""Groups of rows in Arrow batches that come sorted by their leading key columns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables of complete groups, with the bounds of the groups of two rows or more.

    A group is the rows equal in the first `keys` columns (numbers); one that goes on in the next batch is held back until it ends.
    """
    held: list[pa.RecordBatch] = []

    def told():
        table = pa.Table.from_batches(held).combine_chunks()
        cols = [table.column(c).to_numpy() for c in range(keys)]
        new = np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols])])
        return table, [(int(lo), int(hi)) for lo, hi in zip(new, np.r_[new[1:], len(table)]) if hi - lo > 1]

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in range(keys)]
        differs = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in cols]))
        start = int(differs[-1]) + 1 if len(differs) else 0
        goes_on = bool(held) and all(held[-1].column(k)[held[-1].num_rows - 1].as_py() == c[0] for k, c in enumerate(cols))
        if held and not goes_on:
            yield told()
            held = []
        if start:
            held.append(batch.slice(0, start))
            yield told()
            held = []
        held.append(batch.slice(start))
    if held:
        yield told()

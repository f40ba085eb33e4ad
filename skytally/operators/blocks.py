"""Counting the object pairs of two bounded blocks of positions."""

from __future__ import annotations

# positions of a block whose box is tried as one; positions of the other side tried at once
TILE, CHUNK = 64, 512


def near_points(limit):
    """For ``mapInArrow``: keeps of each row's ``pts1`` those whose nearest possible squared distance to ``box2`` is within a limit.

    Rows that keep none are left out.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            pts, box = b.column("pts1"), b.column("box2")
            off, p = pts.offsets.to_numpy(), pts.values
            p = p.slice(off[0], off[-1] - off[0])
            size = np.diff(off)
            total = np.zeros(len(p))
            for c in "xyz":
                v, lo, hi = (a.to_numpy(zero_copy_only=False) for a in (p.field(c), box.field(f"lo{c}"), box.field(f"hi{c}")))
                gap = np.maximum(0.0, np.maximum(np.repeat(lo, size) - v, v - np.repeat(hi, size)))
                total = total + gap * gap
            keep = total <= limit
            upto = np.concatenate([[0], np.cumsum(keep)])[off - off[0]].astype(np.int32)
            left = pa.ListArray.from_arrays(pa.array(upto), p.filter(pa.array(keep)))
            names = [n for n in b.schema.names if n != "box2"]
            out = pa.RecordBatch.from_arrays([left if n == "pts1" else b.column(n) for n in names], names)
            yield out.filter(pa.array(np.diff(upto) > 0))

    return run


def block_counter(limits, group):
    """For ``mapInArrow``: rows ``*group, pts1, pts2`` become ``*group, bucket, n``.

    ``limits`` are squared distances in rising order; the bucket of a pair is the number of limits its squared
    distance exceeds, pairs beyond the last have none. Positions are ordered along a curve and taken in
    runs; two runs whose nearest and farthest distances fall between the same limits count as a
    product, of the others each pair is tried. Sums are in the order of
    :func:`~skytally.functions.geometry.chord_sq`, so no pair changes sides by rounding.
    """
    limits, group, tile, chunk = [float(v) for v in limits], list(group), TILE, CHUNK

    def runs(v, w):
        import numpy as np

        if len(v) <= 2 * tile:
            return v, w, np.array([0]), np.array([len(v)]), v.min(0)[None], v.max(0)[None], w.sum(keepdims=True)
        lo = v.min(0)
        q = ((v - lo) * (1023.0 / (float((v.max(0) - lo).max()) or 1.0))).astype(np.int64)
        code = np.zeros(len(v), np.int64)
        for bit in range(10):
            for axis in range(3):
                code |= ((q[:, axis] >> bit) & 1) << (3 * bit + axis)
        at = np.argsort(code, kind="stable")
        v, w = v[at], w[at]
        first = np.arange(0, len(v), tile)
        size = np.diff(np.append(first, len(v)))
        return v, w, first, size, np.minimum.reduceat(v, first), np.maximum.reduceat(v, first), np.add.reduceat(w, first)

    def counts(v1, w1, v2, w2):
        """Cumulative numbers of pairs, one for each limit."""
        import numpy as np

        v1, w1, first, size, lo1, hi1, n1 = runs(v1, w1)
        v2, w2, _, wide, lo2, hi2, n2 = runs(v2, w2)
        single = w1.min() == w1.max() == 1 and w2.min() == w2.max() == 1
        near, far = np.zeros((len(n1), len(n2))), np.zeros((len(n1), len(n2)))
        for c in range(3):
            gap = np.maximum(0.0, np.maximum(lo2[None, :, c] - hi1[:, None, c], lo1[:, None, c] - hi2[None, :, c]))
            span = np.maximum(hi1[:, None, c] - lo2[None, :, c], hi2[None, :, c] - lo1[:, None, c])
            near, far = near + gap * gap, far + span * span
        b0, b1 = np.searchsorted(limits, near), np.searchsorted(limits, far)
        open_ = (b0 < b1) & (b0 < len(limits))
        found = [n1 @ (((b1 <= k) & ~open_) @ n2) for k in range(len(limits))]
        for i in np.flatnonzero(open_.any(1)):
            at = slice(first[i], first[i] + size[i])
            x, y, z, u = v1[at, 0, None], v1[at, 1, None], v1[at, 2, None], w1[at]
            # below low no pair counts, from top on all do
            low, top = int(b0[i][open_[i]].min()), int(min(b1[i][open_[i]].max(), len(limits)))
            for k in range(top, len(limits)):
                found[k] += n1[i] * n2[open_[i]].sum()
            mine = np.repeat(open_[i], wide)
            o, ow = v2[mine], w2[mine]
            for j in range(0, len(o), chunk):
                d2 = x - o[None, j:j + chunk, 0]
                d2 *= d2
                for c, p in ((1, y), (2, z)):
                    d = p - o[None, j:j + chunk, c]
                    d *= d
                    d2 += d
                for k in range(low, top):
                    within = d2 <= limits[k]
                    found[k] += np.count_nonzero(within) if single else u @ (within @ ow[j:j + chunk])
        return found

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            sides = []
            for name in ("pts1", "pts2"):
                p = b.column(name).values
                v = np.stack([p.field(c).to_numpy(zero_copy_only=False) for c in "xyz"], 1)
                sides.append((b.column(name).offsets.to_numpy(), v, p.field("n").to_numpy(zero_copy_only=False)))
            (o1, v1, w1), (o2, v2, w2) = sides
            row, bucket, n = [], [], []
            for i in range(b.num_rows):
                s, t = slice(o1[i], o1[i + 1]), slice(o2[i], o2[i + 1])
                before = 0
                for k, c in enumerate(counts(v1[s], w1[s], v2[t], w2[t])):
                    if c != before:
                        row.append(i), bucket.append(k), n.append(c - before)
                    before = c
            own = [b.column(g).take(pa.array(row, pa.int64())) for g in group]
            n = n if w1.dtype == object else np.asarray(n, w1.dtype)
            yield pa.RecordBatch.from_arrays([*own, pa.array(bucket, pa.int32()), pa.array(n)], [*group, "bucket", "n"])

    return run

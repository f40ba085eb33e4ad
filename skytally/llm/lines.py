"""Fuzzy line deduplication by MinHash.

Lines are compared in lower case without blanks around them. Equal lines form a
class, told apart by two 64-bit hashes of the line. A line's signature is a
one-permutation MinHash sketch of its 8-character shingles: hashes fall into 42
ranges, and the smallest of each counts. Three neighbouring ranges make a band,
so there are 14. Small sets have runs of neighbours in the sorted list of all
their hashes as bands instead: runs of three, and of two besides in the
smallest. Lines that share a band are candidates; they are linked when the
Jaccard similarity of their shingle sets is 0.75 or more. Of each component the
first line in order of doc_id and line number is kept.

Sets of at most 32 shingles lose no pair: d differing hashes split the c common
ones into at most d + 1 runs, and 3 d <= c at a similarity of 0.75. So there is
a run of three where c > 6, and one of two where c > 1; with c <= 6 both sets
have at most 8 hashes. Of larger sets about one pair in two thousand is lost at 0.75, fewer above.

A class is first tried with one partner, the smallest class of the band it
shares most often. Bands that still hold several components are compared in
tiles of bounded size. A pair goes on to the exact test only if enough of the two
sketches agree, which misses about one pair in a million. The classes of a tile
that have such a partner meet again in tiles with their texts, where all shared
shingles are counted at once. A tile writes a link for each component at most, so the
rows between the steps grow with the classes of a band times its tiles a side and
not with its pairs, and no pair of a band is left out. Texts are not shuffled but
for classes of shared bands, which fetch theirs by the place where the line occurs
first.

Shingles are hashed and compared in numpy over Arrow batches. A form with
DataFrame functions alone stays far above the limits (figures in the README):
array functions make a shingle in about a microsecond, and each set twice or
more. Grouping, joins and components are DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytally.lineage import stash
from skytally.llm.components import components
from skytally.llm.tiles import whole_groups
from skytally.llm.words import mix, randoms

SHINGLE = 8
RUN, BANDS = 3, 14
RANGES = RUN * BANDS
#: Ranges of the sketches that pairs are compared by, a byte each.
FINE = 128
#: Sets of up to so many hashes have runs as bands; those of more than half as many have ranges too, to meet larger sets.
SMALL = 32
#: Up to so many hashes, runs of two are bands too.
FEW = 16
SIMILARITY = 0.75
#: Rows of a tile's side, and how many standard deviations below the expected number of equal ranges a pair still goes on to the exact test.
TILE, SURE = 256, 4.75
#: Pairs of a tile compared by sketches at once, and shingles of a tile counted at once.
PAIRS, COUNTED = 1 << 16, 1 << 13
#: Tiles of up to so many rows are counted together, in runs of so many characters.
FEW_ROWS, FEW_CHARS = 8, 1 << 16
#: Characters of the texts of a tile's side, on average; a longer line is taken alone.
TILE_CHARS = 1 << 21
#: Candidates whose places are sent to every executor at most (about 100 MB); more are joined by a shuffle.
SENT_LINES = 2_000_000
#: Characters hashed together, few enough to stay in a core's cache; a longer line is taken alone.
CHUNK = 1 << 16
_PAIR, _FOUR, _EIGHT, _SIZE = (int(v) | 1 for v in randoms(4, 31))
_ORDER = randoms(RUN + 2, 32) | np.uint64(1)
_SALT = randoms(BANDS, 33)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def plain(line: Column) -> Column:
    return F.trim(F.lower(line))


def _shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 8-character shingles of filled lines, and how many each line has.

    A line of fewer than eight characters is a shingle by itself.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    # so that a window begins at each character
    c = np.zeros(len(codes) + SHINGLE - 1, np.uint64)
    c[:len(codes)] = codes
    c[:len(codes)] += np.uint64(1)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    two = c[:-1] * np.uint64(_PAIR)
    two += c[1:]
    four = two[:-2] * np.uint64(_FOUR)
    four += two[2:]
    h = four[:-4] * np.uint64(_EIGHT)
    h += four[4:]
    inside = np.ones(len(h), bool)
    for k in range(1, SHINGLE):
        inside[(ends - k)[sizes >= k]] = False
    short = np.flatnonzero(sizes < SHINGLE)
    if len(short):
        at, n = begins[short], sizes[short]
        own = n.astype(np.uint64) * np.uint64(_SIZE)
        for k in range(SHINGLE):
            own = own * np.uint64(_PAIR) + np.where(k < n, c[at + k], np.uint64(0))
        h[at] = own
        inside[at] = True
    return mix(h[inside]), np.maximum(sizes - (SHINGLE - 1), 1)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of lines that are hashed together."""
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= CHUNK):
            size += len(texts[upto])
            upto += 1
        yield at, upto
        at = upto


def _sets(texts: list[str]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each line."""
    for lo, hi in _chunks(texts):
        h, sizes = _shingles(texts[lo:hi])
        for part in np.split(h, np.cumsum(sizes)[:-1]):
            part.sort()
            yield part[np.r_[True, part[1:] != part[:-1]]]


def _sketch(h: np.ndarray, sizes: np.ndarray, ranges: int) -> np.ndarray:
    """The smallest hash of each range, a row a line; all ones where a range has none."""
    low = np.full(len(sizes) * ranges, _NONE)
    at = h >> np.uint64(32)
    at *= np.uint64(ranges)
    at >>= np.uint64(32)
    at = at.view(np.int64)
    at += np.repeat(np.arange(len(sizes)) * ranges, sizes)
    np.minimum.at(low, at, h)
    return low.reshape(-1, ranges)


def _bands_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Line and band, in order of lines; a line may have a band twice."""
    h, sizes = _shingles(texts)
    low = _sketch(h, sizes, RANGES)
    filled = low != _NONE
    # a set of few hashes fills few ranges
    maybe = filled.sum(axis=1) <= SMALL
    few = np.flatnonzero(maybe)
    begins, ends = np.cumsum(sizes) - sizes, np.cumsum(sizes[few])
    owner = np.repeat(few, sizes[few])
    v = h[np.arange(len(owner)) + np.repeat(begins[few] - ends + sizes[few], sizes[few])]
    order = np.lexsort((v, owner))
    owner, v = owner[order], v[order]
    new = np.ones(len(v), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (v[1:] != v[:-1])
    owner, v = owner[new], v[new]
    n = np.bincount(owner, minlength=len(sizes))
    n[~maybe] = len(h) + SMALL + 1
    lines, bands = [], []

    def runs(run: int, most: int):
        i = np.arange(max(len(v) - run + 1, 0))
        i = i[(owner[i] == owner[i + run - 1]) & (n[owner[i]] <= most)]
        lines.append(owner[i])
        bands.append(mix(sum((v[i + k] * _ORDER[k] for k in range(run)), np.full(len(i), _ORDER[RUN + run - 2]))))

    runs(RUN, SMALL)
    runs(2, FEW)
    one = np.flatnonzero(n[owner] == 1)
    lines.append(owner[one])
    bands.append(mix(v[one] * _ORDER[0] + np.uint64(1)))
    wide = np.flatnonzero(n > SMALL // 2)
    triples, some = low[wide].reshape(-1, BANDS, RUN), filled[wide].reshape(-1, BANDS, RUN).any(axis=2)
    of = mix((triples * _ORDER[:RUN]).sum(axis=2, dtype=np.uint64) + _SALT)
    lines.append(np.repeat(wide, BANDS)[some.ravel()])
    bands.append(of[some])
    line, band = np.concatenate(lines), np.concatenate(bands)
    order = np.argsort(line, kind="stable")
    return line[order], band[order]


def lines_of(docs: DataFrame) -> DataFrame:
    """`doc_id, line_no, line` of all lines; a NULL text has none."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("line_no", "line"))


def _keys(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(line, F.lit(1)).alias("h2")]


def _signed(lines: DataFrame) -> DataFrame:
    """`doc_id, line_no, h1, h2, blank, bands` of `lines(doc_id, line_no, h1, h2, text)`.

    Bands are NULL for blank lines, and for all but one of the equal lines of a batch.
    """
    def run(batches):
        for batch in batches:
            names, blank = batch.column(2).to_numpy(), pc.equal(batch.column(4), "").to_numpy(zero_copy_only=False)
            filled = np.flatnonzero(~blank)
            at = np.sort(filled[np.unique(names[filled], return_index=True)[1]])
            texts, counts, bands = batch.column(4).take(pa.array(at)).to_pylist(), np.zeros(len(names), np.int64), []
            for lo, hi in _chunks(texts):
                line, band = _bands_of(texts[lo:hi])
                counts[at[lo:hi]] = np.bincount(line, minlength=hi - lo)
                bands.append(band)
            offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
            none = np.ones(len(names), bool)
            none[at] = False
            values = np.concatenate(bands) if bands else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)), mask=pa.array(none))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(blank), lists], names=["doc_id", "line_no", "h1", "h2", "blank", "bands"])

    columns = lines.select("doc_id", "line_no", "h1", "h2", "text")
    return stash(columns.mapInArrow(run, "doc_id long, line_no int, h1 long, h2 long, blank boolean, bands array<long>"), "lines")


def _exploded(signed: DataFrame) -> DataFrame:
    return signed.filter("bands is not null").select(F.col("h1").alias("name"), F.explode("bands").alias("band"))


def _bands(lines: DataFrame) -> DataFrame:
    """`name, band` of the lines `doc_id, line_no, h1, h2, text`; equal lines of one batch once."""
    return _exploded(_signed(lines))


def _with_sketch(texts: DataFrame) -> DataFrame:
    """`name, text, sketch`: a byte of the smallest hash of each range, 0 where a range has none."""
    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in _chunks(texts):
                low = _sketch(*_shingles(texts[lo:hi]), FINE)
                low = np.where(low == _NONE, 0, low % np.uint64(255) + np.uint64(1)).astype(np.uint8)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([row.tobytes() for row in low], pa.binary())], names=["name", "text", "sketch"])

    return texts.mapInArrow(run, "name long, text string, sketch binary")


def _shared(bands: DataFrame) -> DataFrame:
    """`band, name, pivot` of the bands that several classes share; `pivot` is a band's smallest class."""
    # one shuffle serves the bands' classes and their rows, which are not sorted
    dealt = bands.repartition("band")
    pivots = dealt.groupBy("band").agg(F.min("name").alias("pivot"), F.max("name").alias("most")).filter("pivot < most").select("band", "pivot")
    return stash(dealt.join(pivots.hint("shuffle_hash"), "band").select("band", "name", "pivot").distinct(), "shared")


def _once(rows: DataFrame) -> DataFrame:
    """`rows(band, name, ...)`, each name once a band, without bands that hold the same names as another one.

    Near copies share many bands. Sets of names are told apart by their size and 128 bits.
    """
    held = (rows.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("name")).alias("x"), F.bit_xor(F.xxhash64("name", F.lit(1))).alias("y"))
            .groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band"))
    return rows.join(held, "band", "left_semi")


def _texts(names: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """`name, text, sketch` of the classes in `names`, read where each occurs first."""
    places = classes.select(F.col("h1").alias("name"), F.col("first.doc_id").alias("at_doc"), F.col("first.line_no").alias("at_line"))
    needed = stash(places.join(names, "name", "left_semi"), "needed")
    if needed.count() <= SENT_LINES:
        needed = F.broadcast(needed)
    # the first of equal lines may be in a document without an id
    place = (F.col("line_no") == F.col("at_line")) & F.col("doc_id").eqNullSafe(F.col("at_doc"))
    found = lines_of(docs).join(needed, place).select("name", plain(F.col("line")).alias("text"))
    # documents of one id may have other lines there
    found = found.filter(F.xxhash64("text") == F.col("name"))
    # equal lines of one document in repeated rows have one text
    return stash(_with_sketch(found.groupBy("name").agg(F.min("text").alias("text"))), "texts")


def _rows(sketches: pa.Array) -> np.ndarray:
    """Sketches as an array, a row a line."""
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(-1, FINE)


def _likely(one: np.ndarray, other: np.ndarray, share: float) -> np.ndarray:
    """Whether enough of the sketches in equal rows of two tables agree."""
    agree = np.count_nonzero((one == other) & (one != 0), axis=1)
    most = np.maximum(np.count_nonzero(one, axis=1), np.count_nonzero(other, axis=1))
    return agree >= share * most - SURE * np.sqrt(share * (1 - share) * most)


def _linked(pairs: DataFrame, texts: DataFrame, share: float) -> DataFrame:
    """The pairs `a, b` whose shingle sets reach the similarity."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.filter(pa.array(_likely(_rows(batch.column(4)), _rows(batch.column(5)), share)))
            texts = [t for pair in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()) for t in pair]
            ok = np.zeros(batch.num_rows, bool)
            # each pair is a tile by itself
            for run_ in _few_runs([(k, k + 2) for k in range(0, len(texts), 2)], pa.array(texts, pa.string())):
                lo, n = run_[0][0], len(run_)
                first, _ = _few_links(texts[lo:lo + 2 * n], np.repeat(np.arange(n), 2), np.tile([0, 1], n), share)
                ok[(lo + first) // 2] = True
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    left, right = (texts.select(F.col("name").alias(c), F.col("text").alias("t" + c), F.col("sketch").alias("s" + c)) for c in "ab")
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb", "sa", "sb").mapInArrow(run, "a long, b long")


def _tiled(rows: DataFrame) -> DataFrame:
    """`band, x, y, mine, ...` of `rows(band, name, blocks, ...)`: each two blocks of a band meet in one tile, each block with itself too."""
    rest = [c for c in rows.columns if c not in ("band", "blocks")]
    tile = ["band", "x", "y"]
    return (rows.withColumn("mine", F.pmod(F.xxhash64("name", "band"), F.col("blocks")))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            .select("band", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", *rest)
            .repartition(*tile).sortWithinPartitions(*tile))


def _pairs_of(groups: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i < j of all pairs within the groups, a bounded number at once."""
    i = np.concatenate([np.arange(lo, hi) for lo, hi in groups])
    n = np.concatenate([np.arange(hi - lo - 1, -1, -1) for lo, hi in groups])
    ends, at = np.cumsum(n), 0
    while at < len(i):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        left = np.repeat(i[at:upto], n[at:upto])
        yield left, left + 1 + np.arange(len(left)) - np.repeat(ends[at:upto] - n[at:upto] - (ends[at - 1] if at else 0), n[at:upto])
        at = upto


def _open_rows(shared: DataFrame, labels: DataFrame, texts: DataFrame, share: float) -> DataFrame:
    """`band, name, component` of the classes that share the band with one of another component whose sketch agrees enough."""
    rows = shared.join(labels.withColumnRenamed("node", "name"), "name", "left").select("band", "name", F.coalesce("component", "name").alias("component")).repartition("band")
    mixed = (rows.groupBy("band").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
             .filter("lo < hi").select("band", F.ceil(F.col("n") / TILE).cast("long").alias("blocks")))
    open_ = rows.join(mixed, "band").join(texts.select("name", "sketch"), "name")

    def run(batches):
        for table, groups in whole_groups(batches, 3):
            if not groups:
                continue
            band, x, y, mine, name, component = (table.column(c).to_numpy() for c in range(6))
            sketch, found = _rows(table.column(6)), np.zeros(len(name), bool)
            for i, j in _pairs_of(groups):
                # between two blocks only from the one to the other
                maybe = (component[i] != component[j]) & ((x[i] == y[i]) | (mine[i] != mine[j]))
                i, j = i[maybe], j[maybe]
                ok = _likely(sketch[i], sketch[j], share)
                found[i[ok]] = found[j[ok]] = True
            yield pa.RecordBatch.from_arrays([pa.array(v[found]) for v in (band, name, component)], names=["band", "name", "component"])

    return stash(_tiled(open_.select("band", "name", "component", "sketch", "blocks")).mapInArrow(run, "band long, name long, component long").distinct(), "open")


def _shared_counts(texts: list[str], first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set sizes of the lines, and how many shingles each line in `first` has in common with each in `second`."""
    sets = list(_sets(texts))
    sizes = np.array([len(s) for s in sets])
    owner, h = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    order = np.argsort(h, kind="stable")
    owner, h = owner[order], h[order]
    same = h[1:] == h[:-1]
    several = np.r_[False, same] | np.r_[same, False]
    owner, column = owner[several], (np.cumsum(np.r_[True, ~same]) - 1)[several]
    column = np.cumsum(np.r_[False, column[1:] != column[:-1]]) if len(column) else column
    counts = np.zeros((len(first), len(second)))
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COUNTED):
        part = slice(*np.searchsorted(column, [lo, lo + COUNTED]))
        has = np.zeros((len(sets), min(COUNTED, int(column[-1]) + 1 - lo)), np.float32)
        has[owner[part], column[part] - lo] = 1
        counts += has[first] @ has[second].T
    return sizes, counts


def _tile_links(texts: list[str], first: np.ndarray, second: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Lines i, j of a tile, i in `first` and j in `second`, whose sets reach the similarity."""
    sizes, n = _shared_counts(texts, first, second)
    i, j = np.nonzero(n >= share * (sizes[first][:, None] + sizes[second] - n))
    return first[i], second[j]


def _few_links(texts: list[str], tile: np.ndarray, place: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Lines i, j whose sets reach the similarity, of many tiles with up to eight lines each.

    `tile` tells each line's tile, from 0 on in order, and `place` its position there.
    """
    parts = [_shingles(texts[lo:hi]) for lo, hi in _chunks(texts)]
    owner = np.repeat(np.arange(len(texts)), np.concatenate([sizes for _, sizes in parts]))
    tiles, most = int(tile[-1]) + 1, int(place.max()) + 1
    # tile, hash and place in one number, which sorts several times faster than an order; the more tiles, the fewer shingles has each
    bits = np.uint64(max(tiles - 1, 1).bit_length())
    top, low = tile.astype(np.uint64) << (np.uint64(64) - bits), place.astype(np.uint64)
    key = np.concatenate([h for h, _ in parts]) >> bits & ~np.uint64(FEW_ROWS - 1) | (top | low)[owner]
    key.sort()
    shingle = key & ~np.uint64(FEW_ROWS - 1)
    begins = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
    lines = np.bitwise_or.reduceat(np.uint8(1) << (key & np.uint64(FEW_ROWS - 1)).astype(np.uint8), begins)
    of = (key[begins] >> (np.uint64(64) - bits)).astype(np.int64)
    has = [of[lines >> p & 1 == 1] for p in range(most)]
    sizes = [np.bincount(h, minlength=tiles) for h in has]
    at = np.searchsorted(tile, np.arange(tiles))
    several = lines & (lines - 1) != 0
    lines, of = lines[several], of[several]
    i, j = [], []
    for p in range(most):
        for q in range(p):
            both = np.uint8(1 << p | 1 << q)
            n = np.bincount(of[lines & both == both], minlength=tiles)
            linked = np.flatnonzero((n > 0) & (n >= share * (sizes[p] + sizes[q] - n)))
            i.append(at[linked] + q)
            j.append(at[linked] + p)
    return np.concatenate(i), np.concatenate(j)


def _leaders(rows: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of the rows the smallest that links i, j lead to."""
    root = np.arange(rows)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _few_runs(groups: list[tuple[int, int]], texts: pa.Array | pa.ChunkedArray) -> Iterator[list[tuple[int, int]]]:
    """Runs of groups with a bounded number of characters; a longer group is taken alone."""
    ends = np.r_[0, np.cumsum(pc.utf8_length(texts).to_numpy())]
    held, size = [], 0
    for lo, hi in groups:
        chars = int(ends[hi] - ends[lo])
        if held and size + chars > FEW_CHARS:
            yield held
            held, size = [], 0
        held.append((lo, hi))
        size += chars
    if held:
        yield held


def _open_links(open_: DataFrame, texts: DataFrame, share: float) -> DataFrame:
    """Links `a, b` between components that the exact links within each band join; one for each component of a tile at most."""
    sizes = (open_.select("band", "name").join(texts.select("name", F.length("text").alias("size")), "name").groupBy("band")
             .agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("size") / TILE_CHARS)).cast("long").alias("blocks")))
    rows = open_.join(sizes, "band").join(texts.select("name", "text"), "name").select("band", "name", "component", "text", "blocks")

    def run(batches):
        for table, groups in whole_groups(batches, 3):
            x, y, mine, _, component = (table.column(c).to_numpy() for c in range(1, 6))
            texts = table.column(6)
            few = [(lo, hi) for lo, hi in groups if hi - lo <= FEW_ROWS and x[lo] == y[lo]]
            many = [(lo, hi) for lo, hi in groups if hi - lo > FEW_ROWS or x[lo] != y[lo]]
            i, j = [], []
            for run_ in _few_runs(few, texts):
                at = np.concatenate([np.arange(lo, hi) for lo, hi in run_])
                sizes = [hi - lo for lo, hi in run_]
                p, q = _few_links(texts.take(pa.array(at)).to_pylist(), np.repeat(np.arange(len(run_)), sizes), at - np.repeat([lo for lo, _ in run_], sizes), share)
                i.append(at[p])
                j.append(at[q])
            for lo, hi in many:
                at = np.arange(hi - lo)
                first, second = (at, at) if x[lo] == y[lo] else (np.flatnonzero(mine[lo:hi] == b) for b in (x[lo], y[lo]))
                p, q = _tile_links(texts.slice(lo, hi - lo).to_pylist(), first, second, share)
                i.append(lo + p)
                j.append(lo + q)
            if i:
                # what one component holds already needs no link
                known, node = np.unique(component, return_inverse=True)
                root = _leaders(len(known), node[np.concatenate(i)], node[np.concatenate(j)])
                led = np.flatnonzero(root < np.arange(len(root)))
                yield pa.RecordBatch.from_arrays([pa.array(known[root[led]]), pa.array(known[led])], names=["a", "b"])

    return _tiled(rows).mapInArrow(run, "a long, b long")


def fuzzy_lines(docs: DataFrame, share: float = SIMILARITY) -> DataFrame:
    """`doc_id, line_no, kept, keeper_doc, keeper_line` for each line of `docs(doc_id, text, ...)`.

    `keeper` is the first line, by doc_id and line number, of the line's
    component, and `kept` tells whether it is that line itself. Lines without anything but
    blanks are all kept, with a NULL keeper. A NULL text has no lines, an
    empty one has one empty line; a NULL doc_id comes first in order. Repeated rows
    have their lines kept alike. Other columns are not read.
    """
    line = plain(F.col("line"))
    lines = lines_of(docs).select("doc_id", "line_no", line.alias("text")).select("doc_id", "line_no", "text", *_keys(F.col("text")))
    signed = _signed(lines)
    lean = signed.select("doc_id", "line_no", "h1", "h2", "blank")
    classes = lean.filter("not blank").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n"))
    classes = stash(classes, "classes")
    shared = _shared(_exploded(signed))
    tried = (shared.filter("name <> pivot").groupBy("name", "pivot").agg(F.count("*").alias("n"))
             .groupBy("name").agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("b")).select(F.col("name").alias("a"), "b"))
    texts = _texts(shared.select("name").distinct(), docs, classes)
    edges = stash(_linked(tried, texts, share), "links")
    labels = components(edges)
    more = stash(_open_links(_once(_open_rows(_once(shared.select("band", "name")), labels, texts, share)), texts, share), "links")
    if not more.isEmpty():
        labels = components(edges.unionByName(more))

    # lines that stand alone need no keeper to be looked up
    named = classes.select("h1", "h2", "first", "n").join(labels.withColumnRenamed("node", "h1"), "h1", "left")
    groups = named.filter("n > 1 or component is not null").select("h1", "h2", "first", F.coalesce("component", "h1").alias("component"))
    keepers = groups.groupBy("component").agg(F.min("first").alias("keeper"))
    groups = groups.join(keepers, "component").select("h1", "h2", "keeper")
    out = lean.join(stash(groups, "groups"), ["h1", "h2"], "left")
    own = F.struct("doc_id", "line_no")
    keeper = F.when(~F.col("blank"), F.coalesce("keeper", own))
    return out.select("doc_id", "line_no", (F.col("blank") | F.col("keeper").isNull() | F.col("keeper").eqNullSafe(own)).alias("kept"),
                      keeper["doc_id"].alias("keeper_doc"), keeper["line_no"].alias("keeper_line"))


def without_repeats(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """`docs` with only the kept lines in each text; for documents whose ids differ."""
    kept = (lines_of(docs).join(decided.filter("not kept").select("doc_id", "line_no"), ["doc_id", "line_no"], "left_anti")
            .groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l")).select("doc_id", F.array_join("l.line", "\n").alias("kept_text")))
    text = F.when(F.col("text").isNotNull(), F.coalesce("kept_text", F.lit("")))
    return docs.join(kept, "doc_id", "left").withColumn("text", text).select(*docs.columns)

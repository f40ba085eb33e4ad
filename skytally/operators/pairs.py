"""Which pixels meet, and how many object pairs lie within each angle.

``pair_count`` is the heart of the library. It joins two catalogs on the sky,
but never lists the pairs of a crowded region: objects are first summed into
cells of space, whole pixels to begin with, and a pair of cells whose nearest and farthest possible
distances fall between the same two edges is counted as a product. Only cell
pairs that straddle an edge are opened, and crowded ones are split first. An opened pair
sends the positions of one cell that lie near the other, and is counted in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import chord, chord_sq, with_unit_vector
from ..functions.healpix import centre_of, neighbours, nested_id, npix, pixel_radius, with_pixel
from ..lineage import cut, stash, wide_tasks
from ..sources.catalog import number_rows
from .blocks import block_counter, near_points

# most distinct positions a cell may hold before it is split
LEAF = 16_384
# object pairs that one task tries, where they are rows and where they are blocks; positions sent to a task
TASK_PAIRS, BLOCK_PAIRS, TASK_POINTS = 20_000_000, 1_000_000_000, 2_000_000
# cells are cubes with sides of 2**(shift - GRID_BITS)
GRID_BITS = 50
# one cube holds the whole sky, so that a cell is a pixel
WHOLE = GRID_BITS + 2


def rings_for(nside: int) -> int:
    """Neighbour rings searched: two for small pixels, one for large ones."""
    return 2 if nside > 16 else 1


def reach(nside: int) -> float:
    """Angle in degrees that the searched rings cover for certain."""
    side = math.degrees(math.sqrt(4 * math.pi / npix(nside)))
    return 0.6 * side * rings_for(nside)


_SKY_PAIRS: dict[tuple[str, int], DataFrame] = {}


def _sky_pairs(spark: SparkSession, nside: int) -> DataFrame:
    """All pixel pairs of the sky, made once per session.

    The table's size depends on ``nside`` alone (160 thousand rows at nside 32).
    """
    key = (spark.sparkContext.applicationId, nside)
    if key in _SKY_PAIRS:
        return _SKY_PAIRS[key]
    near = neighbours(spark, nside)
    if rings_for(nside) == 2:
        near = cut(near)
    own = spark.range(npix(nside)).select(
        F.col("id").alias("pix1"), F.col("id").alias("pix2"), F.lit(0).alias("ring")
    )
    one = near.where("pix < near").select(
        F.col("pix").alias("pix1"), F.col("near").alias("pix2"), F.lit(1).alias("ring")
    )
    out = own.unionByName(one)
    if rings_for(nside) == 2:
        far = near.select(F.col("pix").alias("near"), F.col("near").alias("far"))
        two = near.join(far, "near").where("pix < far").select(
            F.col("pix").alias("pix1"), F.col("far").alias("pix2"), F.lit(2).alias("ring")
        )
        out = out.unionByName(two)
    out = cut(out.groupBy("pix1", "pix2").agg(F.min("ring").alias("ring")))
    _SKY_PAIRS[key] = out
    return out


def pixel_pairs(spark: SparkSession, nside: int, pixels: DataFrame | None = None) -> DataFrame:
    """``pix1, pix2, ring`` with pix1 <= pix2: each pixel with itself and its rings.

    ``pixels`` (a column ``pix``) keeps pairs with both ends in a set; ring two is
    still found through pixels outside the set.
    """
    out = _sky_pairs(spark, nside)
    if pixels is not None:
        keep = pixels.select("pix").distinct()
        for end in ("pix1", "pix2"):
            out = out.join(keep.withColumnRenamed("pix", end), end, "left_semi")
    return out.select("pix1", "pix2", "ring")


def pairs_within(pixels: DataFrame, nside: int, theta_deg: float) -> DataFrame:
    """``pix1, pix2`` with pix1 <= pix2: all pairs of given pixels that can hold objects within an angle, up to 180 degrees.

    ``pixels`` has a column ``pix``. The pixels form a tree by their nested numbers, from the
    twelve faces down; each node has the box round the centres below it. A pair of nodes is
    opened only while its boxes are within the angle and two pixel radii, so work follows
    the pairs that come out and the table of the whole sky is never made.
    """
    z, phi = centre_of(nside, "pix")
    at = pixels.select("pix").where("pix >= 0").distinct().select("pix", z.alias("z"), phi.alias("phi"))
    at = at.select("pix", nested_id(nside, F.col("z"), F.col("phi")).alias("nest"), "z", "phi", F.sqrt((F.lit(1.0) - F.col("z")) * (F.lit(1.0) + F.col("z"))).alias("s"))
    at = cut(at.select("pix", "nest", (F.col("s") * F.cos("phi")).alias("x"), (F.col("s") * F.sin("phi")).alias("y"), "z"))
    # a hair more than the chord, so that rounding never closes a pair
    far_sq = chord(min(180.0, theta_deg + 2 * pixel_radius(nside))) ** 2 + 1e-9
    depth = max(nside - 1, 0).bit_length()
    met, above = None, depth
    for up in [*range(depth, 0, -2), 0]:
        box = [f(c).alias(f"{tag}{c}") for c in "xyz" for f, tag in ((F.min, "lo"), (F.max, "hi"))]
        nodes = at.groupBy(F.shiftright("nest", 2 * up).alias("node")).agg(F.min("pix").alias("pix"), *box)
        # twelve faces meet at most; below them only children of pairs that met
        nodes = nodes.withColumn("parent", F.shiftright("node", 2 * (above - up)) if met is not None else F.lit(0).cast("long"))
        a, b = (nodes.select(*[F.col(c).alias(f"{c}{i}") for c in nodes.columns]) for i in "12")
        j = a.join(b, F.col("parent1") == F.col("parent2")) if met is None else met.join(a, "parent1").join(b, "parent2")
        gap = F.lit(0.0)
        for c in "xyz":
            apart = F.greatest(F.lit(0.0), F.col(f"lo{c}2") - F.col(f"hi{c}1"), F.col(f"lo{c}1") - F.col(f"hi{c}2"))
            gap = gap + apart * apart
        j = j.where((gap <= F.lit(far_sq)) & (F.col("node1") <= F.col("node2")))
        met, above = j.select(F.col("node1").alias("parent1"), F.col("node2").alias("parent2"), F.col("pix1").alias("p"), F.col("pix2").alias("q")), up
    return met.select(F.least("p", "q").alias("pix1"), F.greatest("p", "q").alias("pix2"))


def good_pixels(populations: DataFrame, corrs: DataFrame) -> DataFrame:
    """``corr_id, pix`` holding objects of every catalog of the correlation.

    ``populations`` has one row ``corr_id, catalog, pix, n`` per catalog and pixel, over whole catalogs;
    ``corrs`` has ``corr_id, type`` ('auto' needs 2 catalogs, 'cross' 4).
    """
    need = corrs.select(
        "corr_id", F.when(F.col("type") == "auto", F.lit(2)).otherwise(F.lit(4)).alias("need")
    )
    have = (
        populations.where("n > 0").groupBy("corr_id", "pix")
        .agg(F.count(F.lit(1)).alias("have"))
    )
    return have.join(need, "corr_id").where("have = need").select("corr_id", "pix")


def good_pairs(pairs: DataFrame, good: DataFrame) -> DataFrame:
    """``corr_id, pix1, pix2`` whose two pixels are both good for the correlation."""
    g1 = good.withColumnRenamed("pix", "pix1")
    g2 = good.withColumnRenamed("pix", "pix2")
    return pairs.join(g1, "pix1").join(g2, ["corr_id", "pix2"], "left_semi").select(
        "corr_id", "pix1", "pix2"
    )


def pair_plan(pairs: DataFrame, populations: DataFrame, terms: DataFrame) -> DataFrame:
    """Work list ``corr_id, term, zbin, pix1, pix2, n1, n2, cost``.

    ``pairs`` is :func:`good_pairs`; ``populations`` has ``corr_id, zbin, catalog,
    pix, n``; ``terms`` has ``corr_id, term, first, second``. The first catalog is
    read in pix1, the second in pix2; pairs with an empty side drop out.
    """
    side1 = populations.select("corr_id", "zbin", F.col("catalog").alias("first"), F.col("pix").alias("pix1"), F.col("n").alias("n1"))
    side2 = populations.select("corr_id", "zbin", F.col("catalog").alias("second"), F.col("pix").alias("pix2"), F.col("n").alias("n2"))
    return (
        pairs.join(terms, "corr_id")
        .join(side1, ["corr_id", "first", "pix1"])
        .join(side2, ["corr_id", "second", "pix2", "zbin"])
        .select("corr_id", "term", "zbin", "pix1", "pix2", "n1", "n2", (F.col("n1") * F.col("n2")).alias("cost"))
    )


def by_cost(plan: DataFrame) -> DataFrame:
    """The work list with ``rank`` from 0, the most costly pixel pair first; rows are never brought together."""
    order = [c for c in ("corr_id", "term", "zbin", "pix1", "pix2") if c in plan.columns]
    return number_rows(plan.orderBy(F.desc("cost"), *order), name="rank")


def _positions(df: DataFrame, keys, nside: int, weight: str | None) -> DataFrame:
    """Distinct positions with their number of objects: copies collapse map-side."""
    d = df.where(F.col("ra").isNotNull() & F.col("dec").isNotNull())
    if "pix" not in d.columns:
        d = with_pixel(d, nside)
    # a position that is not a number is near to nothing
    d = with_unit_vector(d).where(~(F.isnan("x") | F.isnan("y") | F.isnan("z")))
    n = F.sum(weight) if weight else F.count(F.lit(1))
    # the shuffle key is the position itself, so no pixel or catalog weighs on one task
    return d.groupBy(*keys, "pix", "x", "y", "z").agg(n.alias("n")).where("n is not null")


def _node(level: int, shift: int) -> Column:
    side = float(2 ** GRID_BITS)
    axis = lambda c: F.shiftright(F.floor((F.col(c) + 1.0) * side).cast("long"), shift)
    return F.struct(F.lit(level).alias("lev"), axis("x").alias("a"), axis("y").alias("b"), axis("z").alias("c"))


def _summary(points: DataFrame, keys, last: bool, leaf: int) -> DataFrame:
    """One row per cell: objects, distinct positions and bounding box."""
    box = [f(c).alias(f"{tag}{c}") for c in "xyz" for f, tag in ((F.min, "lo"), (F.max, "hi"))]
    s = points.groupBy(*keys, "pix", "node", "up").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("m"), *box
    )
    return s.withColumn("leaf", F.lit(True) if last else F.col("m") <= F.lit(leaf))


class CellTree:
    """Cells of one or more keyed catalogs, level by level; each object ends in one small leaf.

    ``below`` is the size of cells on the second level, a quarter of the first if not given. ``stored`` tells that
    the points are a table, which is read again rather than copied.
    """

    def __init__(self, points: DataFrame, keys, shift: int, leaf: int | None = None, below: int | None = None, stored: bool = False):
        self.keys, self.shift, self.level = list(keys), shift, 0
        self.leaf, self.below, self.stored = leaf or LEAF, below, stored
        self.open = points.withColumns({"node": _node(0, shift), "up": F.lit(None).cast("int")})
        self.cells = _summary(self.open, keys, shift == 0, self.leaf)
        if stored:
            self.cells = cut(self.cells)
        self.leaves: list[DataFrame] = []

    def split(self) -> None:
        """Go one level down where cells are crowded; leaves stay as they are."""
        on = [*self.keys, "pix", "node"]
        hot = self.cells.where(~F.col("leaf")).select(*on)
        # a table of known size: Spark sends it to the points if it is small
        hot = stash(hot) if self.stored else hot
        keep = stash if self.stored else cut
        settled = self.cells.where("leaf").withColumn("up", F.col("node"))
        calm = self.open.join(hot, on, "left_anti").drop("up")
        self.leaves.append(calm if self.stored else cut(calm))
        rest = self.open.join(hot, on, "left_semi")
        self.shift = self.below if self.level == 0 and self.below is not None else max(self.shift - 2, 0)
        self.level += 1
        self.open = keep(
            rest.withColumn("up", F.col("node")).withColumn("node", _node(self.level, self.shift))
        )
        self.cells = cut(_summary(self.open, self.keys, self.shift == 0, self.leaf).unionByName(settled))

    def packed(self) -> DataFrame:
        """One row per leaf with its few positions."""
        pts = self.open.drop("up")
        for part in self.leaves:
            pts = pts.unionByName(part)
        own = [c for c in pts.columns if c not in (*self.keys, "pix", "node")]
        return pts.groupBy(*self.keys, "pix", "node").agg(F.collect_list(F.struct(*own)).alias("pts"))


class Side:
    """One end of the pairs: a tree, with its key columns named for this end."""

    def __init__(self, tree: CellTree, tag: str, rename: dict[str, str] | None = None):
        self.tree, self.tag, self.rename = tree, tag, rename or {}

    def _named(self, df: DataFrame) -> DataFrame:
        return df.select(*[
            F.col(c).alias(self.rename.get(c, c) if c in self.tree.keys else c + self.tag) for c in df.columns
        ])

    def cells(self) -> DataFrame:
        c = self.tree.cells
        return self._named(c if self.tree.level else c.drop("up"))

    def packed(self) -> DataFrame:
        return self._named(self.tree.packed())


def _natural(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, [c for c in right.columns if c in left.columns])


def _bucket(d2: Column, limits) -> Column:
    """How many edges a squared distance exceeds."""
    out = F.lit(0)
    for e in limits:
        out = out + (d2 > F.lit(e)).cast("int")
    return out


def meet_cells(pairs: DataFrame, a: Side, b: Side, limits, box: bool = False) -> DataFrame:
    """Cell pairs one level down, with the buckets of their nearest and farthest points, and the second's ``box2`` if asked for.

    ``pairs`` holds pixel pairs at first and then the opened cell pairs. Box bounds and
    pair distances are summed in the same order, and rounding keeps order, so a bound
    is never on the wrong side of an edge.
    """
    cb = b.cells()
    j = _natural(pairs, a.cells())
    # few bytes, much work: keep the number of tasks from shrinking with the bytes
    j = j.repartition(wide_tasks(pairs), *[c for c in cb.columns if c in j.columns])
    j = _natural(j, cb)
    near, far, used = F.lit(0.0), F.lit(0.0), ["up1", "up2"]
    for c in "xyz":
        lo1, hi1, lo2, hi2 = (F.col(f"{t}{c}{s}") for s in "12" for t in ("lo", "hi"))
        gap = F.greatest(F.lit(0.0), lo2 - hi1, lo1 - hi2)
        span = F.greatest(hi1 - lo2, hi2 - lo1)
        near, far = near + gap * gap, far + span * span
        used += [f"{t}{c}{s}" for s in "12" for t in ("lo", "hi")]
    if box:
        j = j.withColumn("box2", F.struct(*[F.col(f"{t}{c}2").alias(f"{t}{c}") for c in "xyz" for t in ("lo", "hi")]))
    # the one comparison that becomes part of the join; all else is worked out for survivors
    j = j.withColumns({"near": near, "far": far}).drop(*used).where(F.col("near") <= F.lit(limits[-1]))
    return j.withColumns({"b0": _bucket(F.col("near"), limits), "b1": _bucket(F.col("far"), limits)})


def opened_pairs(met: DataFrame) -> DataFrame:
    """Cell pairs as the parents of the next level."""
    facts = {f"{c}{i}" for c in ("node", "n", "m", "leaf") for i in "12"} | {"near", "far", "b0", "b1", "box2"}
    keep = [c for c in met.columns if c not in facts]
    return met.select(*keep, F.col("node1").alias("up1"), F.col("node2").alias("up2"))


def pending(met: DataFrame) -> tuple[bool, int]:
    """Whether a cell must be split, and over how many tasks to open the leaf pairs."""
    leaves = F.col("leaf1") & F.col("leaf2")
    crowded, work = met.agg(
        F.coalesce(F.bool_or(~leaves), F.lit(False)),
        F.coalesce(F.sum(F.when(leaves, F.col("m1").cast("double") * F.col("m2"))), F.lit(0.0)),
    ).first()
    return crowded, max(met.sparkSession.sparkContext.defaultParallelism, math.ceil(work / TASK_PAIRS))


def leaf_objects(met: DataFrame, a: Side, b: Side, keep, tasks: int) -> DataFrame:
    """``*keep, p, q``: every object pair of pairs of leaves, inside one generated loop.

    The work is large for few bytes, so it is spread over a number of tasks that
    follows the pairs to try, not the size of the rows.
    """
    pb = b.packed()
    j = _natural(met, a.packed())
    j = j.repartition(tasks, *[c for c in pb.columns if c in j.columns])
    j = _natural(j, pb)
    j = j.select(*keep, "pts2", F.explode("pts1").alias("p"))
    return j.select(*keep, "p", F.explode("pts2").alias("q"))


def point_distance_sq() -> Column:
    return chord_sq(tuple(F.col(f"p.{c}") for c in "xyz"), tuple(F.col(f"q.{c}") for c in "xyz"))


def first_shift(theta_deg: float, nside: int | None = None) -> int:
    """Cells of half to all of the largest separation on a side.

    With ``nside`` never less than a quarter of a pixel's side, so that the cell
    pairs of the first level are bounded by the occupied pixels however small the
    separation; crowded cells are split further on their way down.
    """
    side = chord(theta_deg)
    if nside is not None:
        side = max(side, math.sqrt(4 * math.pi / npix(nside)) / 4)
    return min(GRID_BITS, max(0, GRID_BITS + math.floor(math.log2(side))))


def _block_tasks(met: DataFrame) -> tuple[bool, int]:
    """Whether a cell must be split, and over how many tasks to count the pairs of leaves."""
    leaves = F.col("leaf1") & F.col("leaf2")
    crowded, work, sent = met.agg(
        F.coalesce(F.bool_or(~leaves), F.lit(False)),
        F.coalesce(F.sum(F.col("m1").cast("double") * F.col("m2")), F.lit(0.0)),
        F.coalesce(F.sum(F.col("m1").cast("double") + F.col("m2")), F.lit(0.0)),
    ).first()
    return crowded, max(wide_tasks(met), math.ceil(work / BLOCK_PAIRS), math.ceil(sent / TASK_POINTS))


def _count(pairs: DataFrame, a: Side, b: Side, out_keys, limits) -> DataFrame:
    """``*out_keys, pix1, pix2, bucket, n`` summed over cell pairs and opened leaves."""
    counted = []
    group = [*out_keys, "pix1", "pix2"]
    straddle = F.col("b0") < F.col("b1")
    while True:
        met = cut(meet_cells(pairs, a, b, limits, box=True))
        counted.append(met.where(~straddle).select(*group, F.col("b0").alias("bucket"), (F.col("n1") * F.col("n2")).alias("n")))
        crowded, tasks = _block_tasks(met.where(straddle))
        if not crowded:
            break
        # pairs of two leaves wait: a leaf is its own child on the next level
        pairs = opened_pairs(met.where(straddle))
        for t in {id(s.tree): s.tree for s in (a, b)}.values():
            t.split()
    box = met.where(straddle).select(*opened_pairs(met).drop("up1", "up2").columns, "node1", "node2", "box2")
    # only what lies near the other cell is sent
    j = _natural(box, a.packed())
    j = j.mapInArrow(near_points(limits[-1]), j.drop("box2").schema)
    pb = b.packed()
    j = _natural(j.repartition(tasks, *[c for c in pb.columns if c in j.columns]), pb).select(*group, "pts1", "pts2")
    kinds = dict(j.select(*group, F.col("pts1")[0]["n"].alias("n")).dtypes)
    schema = ", ".join([*(f"`{g}` {kinds[g]}" for g in group), f"bucket int, n {kinds['n']}"])
    j = j.mapInArrow(block_counter(limits, group), schema)
    # a row a pixel pair and bucket, kept once whatever reads it
    counted.append(cut(j.groupBy(*group, "bucket").agg(F.sum("n").alias("n"))))
    total = counted[0]
    for part in counted[1:]:
        total = total.unionByName(part)
    return total


def _per_edge(total: DataFrame, out_keys, edges, convention: str) -> DataFrame:
    """Cumulative counts, one row per pixel pair and edge."""
    if convention == "symmetric":
        total = total.withColumns({"pix1": F.least("pix1", "pix2"), "pix2": F.greatest("pix1", "pix2")})
    per_edge = [
        F.sum(F.when(F.col("bucket") <= i, F.col("n")).otherwise(0)).alias(f"e{i}") for i in range(len(edges))
    ]
    wide = total.groupBy(*out_keys, "pix1", "pix2").agg(*per_edge)
    return wide.select(
        *out_keys, "pix1", "pix2", F.posexplode(F.array(*[f"e{i}" for i in range(len(edges))])).alias("edge_idx", "n")
    )


def _checked(edges_deg, covered: float, convention: str) -> list[float]:
    edges = [float(e) for e in edges_deg]
    if edges != sorted(edges) or edges[-1] > 180.0:
        raise ValueError("edges must ascend, to 180 degrees at most")
    if edges[-1] > covered:
        raise ValueError(f"pairs out to {edges[-1]} deg leave the neighbour rings or other pairs given, which cover {covered} deg")
    if convention not in ("pixel", "symmetric"):
        raise ValueError(f"unknown convention {convention!r}")
    return edges


def _tree(points: DataFrame, keys, shift: int) -> CellTree:
    """Pixels as cells, split into cubes of a size where they are crowded; the positions are stored once."""
    return CellTree(stash(points, "positions"), keys, WHOLE, below=shift, stored=True)


def both_ways(pairs: DataFrame) -> DataFrame:
    """Pixel pairs in both orientations."""
    others = [c for c in pairs.columns if c not in ("pix1", "pix2")]
    turned = pairs.where("pix1 < pix2").select(*others, F.col("pix2").alias("pix1"), F.col("pix1").alias("pix2"))
    return pairs.select(*others, "pix1", "pix2").unionByName(turned)


def pair_count(
    left: DataFrame,
    right: DataFrame,
    edges_deg,
    pairs: DataFrame | None = None,
    nside: int = 32,
    keys=(),
    convention: str = "pixel",
    weight: str | None = None,
    covered: float | None = None,
) -> DataFrame:
    """Cumulative pair counts ``*keys, pix1, pix2, edge_idx, n`` per pixel pair.

    A pair counts for edge e when its distance is at most ``2 sin(e/2)``; objects
    paired with themselves count when both sides are one catalog (they cancel when
    edges are differenced). Inputs need ``ra, dec`` in degrees, the ``keys`` columns
    (only rows with equal keys meet) and optionally ``pix``. ``pairs`` limits the
    pixel pairs and may itself carry key columns; they must cover the largest angle, and are
    taken for the neighbour rings unless ``covered`` tells an angle. Without ``pairs``
    any angle up to 180 degrees will do. Pixel pairs without any object
    pair have no rows.

    ``convention='pixel'`` takes the left object in pix1 and the right one in pix2
    (pix1 <= pix2), so a pixel with itself yields both orders and two pixels one
    orientation. ``'symmetric'`` counts both orientations everywhere.
    """
    edges = _checked(edges_deg, 180.0 if pairs is None else covered or reach(nside), convention)
    keys = list(keys)
    if pairs is None and edges[-1] <= reach(nside):
        # the meeting of cells keeps only the pixels that hold objects
        pairs = pixel_pairs(left.sparkSession, nside)
    elif pairs is None:
        place = lambda df: (df if "pix" in df.columns else with_pixel(df, nside)).select("pix")
        pairs = pairs_within(place(left) if right is left else place(left).unionByName(place(right)), nside, edges[-1])
    pairs = pairs.select(*[c for c in pairs.columns if c in (*keys, "pix1", "pix2")])
    if convention == "symmetric":
        pairs = both_ways(pairs)
    shift = first_shift(edges[-1], nside)
    ta = _tree(_positions(left, keys, nside, weight), keys, shift)
    tb = ta if right is left else _tree(_positions(right, keys, nside, weight), keys, shift)
    total = _count(pairs, Side(ta, "1"), Side(tb, "2"), keys, [chord(e) ** 2 for e in edges])
    return _per_edge(total, keys, edges, convention)


def pair_count_terms(points: DataFrame, terms: DataFrame, edges_deg, pairs: DataFrame, nside: int = 32,
                     keys=("corr_id", "zbin"), convention: str = "pixel", covered: float | None = None) -> DataFrame:
    """Counts ``*keys, term, pix1, pix2, edge_idx, n`` of every term of every correlation at once.

    ``points`` has ``*keys, catalog, ra, dec`` (optionally ``pix``), ``terms`` has ``corr_id,
    term, first, second``, ``pairs`` has ``corr_id, pix1, pix2`` and covers the neighbour rings, or
    the angle ``covered``. Each catalog is summed into
    cells once; terms multiply cells, not objects.
    """
    edges = _checked(edges_deg, covered or reach(nside), convention)
    tree_keys = [*keys, "catalog"]
    if convention == "symmetric":
        pairs = both_ways(pairs)
    work = pairs.join(terms.select("corr_id", "term", "first", "second"), "corr_id")
    tree = _tree(_positions(points, tree_keys, nside, None), tree_keys, first_shift(edges[-1], nside))
    a, b = Side(tree, "1", {"catalog": "first"}), Side(tree, "2", {"catalog": "second"})
    total = _count(work, a, b, [*keys, "term"], [chord(e) ** 2 for e in edges])
    return _per_edge(total, [*keys, "term"], edges, convention)

"""Joining catalogs by position or by object number."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import chord, chord_sq, unit_vector, with_unit_vector
from ..lineage import cut, stash
from .pairs import GRID_BITS, CellTree, Side, leaf_objects, meet_cells, opened_pairs, pending, point_distance_sq

MATCH_LEAF = 32
# right rows that a left row meets in its cube on average, and left rows of a cube that one task looks up row by row
CUBE_MEAN, CUBE_ROWS = 8, 100_000
# cubes of the first tally have a side of 1/32, or as much as the radius needs
FIRST_SHIFT = GRID_BITS - 5
_AXIS = 1 << 20
_SPOT = ("_rx", "_ry", "_rz")


def _placed(ra: str, dec: str) -> Column:
    """Whether a row has a position: neither missing nor without bounds."""
    return F.coalesce((F.abs(F.radians(ra)) < F.lit(math.inf)) & (F.abs(F.radians(dec)) < F.lit(math.inf)), F.lit(False))


def _axis(c: Column, shift: int) -> Column:
    return F.shiftright(F.floor((c + 1.0) * float(2 ** GRID_BITS)).cast("long"), shift)


def _number(a: Column, b: Column, c: Column) -> Column:
    # from one on each axis, as -1 lies beside the sky; never NULL, or Spark tests the whole formula for NULL below each join
    return F.coalesce(((a + 1) * _AXIS + b + 1) * _AXIS + c + 1, F.lit(-1).cast("long"))


def _block(cube: str) -> Column:
    """The block of four by four by four cubes that a cube belongs to."""
    a, b, c = (F.shiftright(F.shiftright(cube, s).bitwiseAND(_AXIS - 1), 2) for s in (40, 20, 0))
    return (a * _AXIS + b) * _AXIS + c


def _cube(ra: str, dec: str, shift: int) -> Column:
    """The cube of space that holds a position."""
    return _number(*[_axis(c, shift) for c in unit_vector(ra, dec)])


def _in_cubes(right: DataFrame, shift: int, reach: float) -> DataFrame:
    """``_ra, _dec, rid`` once for each cube (``_pix``) that comes within the reach of the position; a cube is at least twice as wide."""
    d = with_unit_vector(right, "_ra", "_dec").select(
        *right.columns, *[_axis(F.col(c) + F.lit(to), shift).alias(f"{tag}{c}") for c in "xyz" for tag, to in (("lo", -reach), ("hi", reach))])
    one = (F.col("lox") == F.col("hix")) & (F.col("loy") == F.col("hiy")) & (F.col("loz") == F.col("hiz"))
    all_ = [_number(*map(F.col, some)) for some in product(("lox", "hix"), ("loy", "hiy"), ("loz", "hiz"))]
    return d.select(*right.columns, F.explode_outer(F.when(one, F.array(all_[0])).otherwise(F.array_distinct(F.array(*all_)))).alias("_pix"))


def _tally(left: DataFrame, right: DataFrame, l_ra: str, l_dec: str, reach: float) -> tuple[int, float, DataFrame | None, int]:
    """The size of cubes, the number of right rows, the wide cubes that hold many left rows (if there are any), and the size of these.

    Cubes are at least 8 times as wide as the reach, so that few right rows lie near to a face, and else
    so small that a left row meets few right ones.
    """
    least = min(max(GRID_BITS + math.ceil(math.log2(8 * reach)), GRID_BITS - 14), GRID_BITS + 3)
    wide = max(least, FIRST_SHIFT)
    counted = left.select(_cube(l_ra, l_dec, wide).alias("pix"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(_cube("_ra", "_dec", wide).alias("pix"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    # a table of known size, some thousand cubes at most: Spark sends it to the rows
    counted = stash(counted.groupBy("pix").agg(F.sum("l").cast("double").alias("l"), F.sum("r").cast("double").alias("r")), "tally")
    lefts, rights, met, most = counted.agg(F.sum("l"), F.sum("r"), F.sum(F.col("l") * F.col("r")), F.max("l")).first()
    mean, shift = met / lefts if lefts else 0.0, wide
    while mean > CUBE_MEAN and shift > least:
        mean, shift = mean / 4, shift - 1
    many = counted.where(F.col("l") > CUBE_ROWS).select(F.col("pix").alias("_wide")) if (most or 0) > CUBE_ROWS else None
    return shift, rights or 0.0, many, wide


def _crowded(near: DataFrame, rights: float, left: DataFrame, many: DataFrame | None) -> DataFrame | None:
    """Cubes (``_pix``) with many right rows or very many left ones, if there are any.

    Blocks of cubes are counted first, which are summed before they are dealt; cubes then in crowded blocks only.
    """
    most = 4 * MATCH_LEAF
    over = lambda d, by, n: d.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > n)
    cubes = near.select("_pix", _block("_pix").alias("_block"))
    blocks = stash(over(cubes, "_block", most), "blocks")
    held = blocks.agg(F.sum("n")).first()[0]
    parts = []
    if held:
        # where they hold much of the rows, the rows are counted as they are
        some = cubes.join(blocks.select("_block"), "_block", "left_semi") if held < rights / 4 else cubes
        parts.append(over(some, "_pix", most).select("_pix"))
    if many is not None:
        parts.append(over(left.join(many, "_wide", "left_semi"), "_pix", CUBE_ROWS).select("_pix"))
    if not parts:
        return None
    found = stash(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).distinct(), "crowded")
    return None if found.isEmpty() else found


def _nearest_crowded(left: DataFrame, right: DataFrame, cubes: DataFrame, shift: int, limit: float) -> DataFrame:
    """``_x, _y, _z, _best`` for the left positions of crowded cubes.

    ``left`` has ``pix, x, y, z``, ``right`` the same and ``rid``, with all rows that come near to the cube. Both are summed into
    distinct positions and cells; a pair of cells is dropped when another right cell is certainly nearer,
    and crowded cells are split, so equal or crowded positions never meet pair by pair.
    """
    lp = left.groupBy("pix", "x", "y", "z").agg(F.count(F.lit(1)).alias("n"))
    rp = right.groupBy("pix", "x", "y", "z").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("rid"))
    a, b = (Side(CellTree(stash(p, "positions"), [], shift, MATCH_LEAF, stored=True), tag) for p, tag in ((lp, "1"), (rp, "2")))
    pairs = cubes.select(F.col("_pix").alias("pix1"), F.col("_pix").alias("pix2"))
    while True:
        met = meet_cells(pairs, a, b, [limit])
        sure = met.groupBy("pix1", "node1").agg(F.min("far").alias("sure"))
        met = cut(met.join(sure, ["pix1", "node1"]).where("near <= sure").drop("sure"))
        crowded, tasks = pending(met)
        if not crowded:
            break
        pairs = opened_pairs(met)
        a.tree.split()
        b.tree.split()
    j = leaf_objects(met.select("pix1", "pix2", "node1", "node2"), a, b, [], tasks)
    spot = F.struct(*[F.col(f"q.{c}").alias(s) for c, s in zip("xyz", _SPOT)])
    j = j.select(*[F.col(f"p.{c}").alias(f"_{c}") for c in "xyz"], F.struct(point_distance_sq().alias("d2"), "q.rid", spot.alias("spot")).alias("at"))
    return j.where(F.col("at.d2") < F.lit(limit)).groupBy("_x", "_y", "_z").agg(F.min("at").alias("_best"))


def nearest(left: DataFrame, right: DataFrame, radius_arcsec: float, l_ra="ra", l_dec="dec",
            r_ra="ra", r_dec="dec", right_id="id", rows: bool = False) -> DataFrame:
    """``x, y, z, match, dist, _rx, _ry, _rz`` for each left position with a right one within the radius.

    ``match`` is the closest right object (the lowest number on equal distance) and
    ``dist`` the straight distance. With ``rows`` every left row that has a position comes back with its columns, and with
    the others as ``_x, _y, _z, _match, _dist`` and so on, NULL without a match.

    Space is cut into cubes whose size follows the density. A left row goes to its cube, a right one to each cube it comes
    within the radius of, so both are dealt once, by cube, and a left row looks at the
    right positions of its own cube only. Cubes with many right rows, or very many left ones, go another way, that
    of :func:`_nearest_crowded`; their rows are found by counting, before any row is dealt.
    """
    radius = chord(radius_arcsec / 3600.0)
    # a hair more than the radius, so that rounding never leaves a cube out
    limit, reach = radius * radius, radius * (1 + 1e-6) + 1e-12
    left = left.where(_placed(l_ra, l_dec))
    right = right.where(_placed(r_ra, r_dec)).select(F.col(r_ra).alias("_ra"), F.col(r_dec).alias("_dec"), F.col(right_id).alias("rid"))
    shift, rights, many, wide = _tally(left, right, l_ra, l_dec, reach)
    at = left.withColumn("_pix", _cube(l_ra, l_dec, shift))
    near = _in_cubes(right, shift, reach)
    crowded = _crowded(near, rights, left.select(_cube(l_ra, l_dec, wide).alias("_wide"), _cube(l_ra, l_dec, shift).alias("_pix")), many)
    # the cube and two angles are sent; vectors are made again from them
    few = (near if crowded is None else near.join(crowded, "_pix", "left_anti")).repartition("_pix")
    few = with_unit_vector(few, "_ra", "_dec").groupBy("_pix", "x", "y", "z").agg(F.min("rid").alias("rid"))
    few = few.groupBy("_pix").agg(F.collect_list(F.struct("x", "y", "z", "rid")).alias("_pts"))
    out = (at if crowded is None else at.join(crowded, "_pix", "left_anti")).join(few, "_pix", "left")
    out = with_unit_vector(out, l_ra, l_dec, ("_x", "_y", "_z"))
    apart = lambda q: chord_sq(tuple(F.col(f"_{c}") for c in "xyz"), tuple(q[c] for c in "xyz"))
    spot = lambda q: F.struct(*[q[c].alias(s) for c, s in zip("xyz", _SPOT)])
    best = F.transform("_pts", lambda q: F.struct(apart(q).alias("d2"), q["rid"].alias("rid"), spot(q).alias("spot")))
    best = F.array_min(F.filter(best, lambda t: t["d2"] < F.lit(limit)))
    # a row each: what is asked of the match later is not asked of the whole formula
    out = out.select(*left.columns, "_x", "_y", "_z", F.explode_outer(F.array(best)).alias("_best"))
    if crowded is not None:
        held = at.join(crowded, "_pix", "left_semi")
        lp = with_unit_vector(held, l_ra, l_dec).select(F.col("_pix").alias("pix"), "x", "y", "z")
        rp = with_unit_vector(near.join(crowded, "_pix", "left_semi"), "_ra", "_dec").select(F.col("_pix").alias("pix"), "x", "y", "z", "rid")
        found = _nearest_crowded(lp, rp, crowded, shift, limit)
        held = with_unit_vector(held.drop("_pix"), l_ra, l_dec, ("_x", "_y", "_z")).join(found, ["_x", "_y", "_z"], "left")
        out = out.unionByName(held)
    # a match without a number is none
    of = lambda c: F.when(F.col("_best.rid").isNotNull(), c)
    out = out.select(*[c for c in out.columns if c != "_best"], F.col("_best.rid").alias("_match"), of(F.sqrt("_best.d2")).alias("_dist"),
                     *[of(F.col(f"_best.spot.{s}")).alias(s) for s in _SPOT])
    if rows:
        return out
    out = out.where("_match is not null").select(*[F.col(f"_{c}").alias(c) for c in ("x", "y", "z", "match", "dist")], *_SPOT)
    return out.dropDuplicates(["x", "y", "z"])


def cross_match(left: DataFrame, right: DataFrame, radius_arcsec: float = 2.0, l_ra="ra", l_dec="dec",
                r_ra="ra", r_dec="dec", suffix="_join", right_id="id", distance: str | None = None) -> DataFrame:
    """Every left row with the columns of its nearest right row within the radius.

    Right columns take the suffix. Rows without a match, or without a position, get False in boolean
    columns and NULL elsewhere. ``distance`` names an extra column for the chord. Of right
    rows that share the matched number and position one is taken.
    """
    out = nearest(left, right, radius_arcsec, l_ra, l_dec, r_ra, r_dec, right_id, rows=True)
    # a number that stands for several right rows is told apart by the matched position; rows
    # without a match get a place off the sphere, so that they never share a key
    spot = ["_match", *_SPOT]
    out = out.withColumns({s: F.coalesce(s, F.col(c) + 4.0) for s, c in zip(_SPOT, ("_x", "_y", "_z"))})
    other = with_unit_vector(right.where(_placed(r_ra, r_dec)), r_ra, r_dec, _SPOT)
    other = other.select(*[F.col(c).alias(c + suffix) for c in right.columns], F.col(right_id).alias("_match"), *_SPOT)
    # every match finds one row: without a right column that is asked for, Spark leaves this join out
    out = out.join(other.dropDuplicates(spot), spot, "left").drop(*spot)
    # rows without a position match nothing and stay out of the joins
    out = out.unionByName(left.where(~_placed(l_ra, l_dec)), allowMissingColumns=True)
    cols = [F.col(c) for c in left.columns]
    for name, kind in right.dtypes:
        c = F.col(name + suffix)
        cols.append(F.coalesce(c, F.lit(False)).alias(name + suffix) if kind == "boolean" else c)
    if distance:
        cols.append(F.col("_dist").alias(distance))
    return out.select(*cols)


def match_by_id(catalog: DataFrame, curves: DataFrame, key: str = "object_id", curve: str = "pdz") -> DataFrame:
    """Catalog rows with their redshift curve; curves that start missing are dropped."""
    head = F.element_at(curve, 1)
    valid = curves.where(F.size(curve) > 0).where(head.isNotNull() & ~F.isnan(head))
    return catalog.join(valid, key)


def match_histogram_edges(num: int = 500, top: float = 0.0002424 / 2.0) -> list[float]:
    """Edges for the histogram of match distances."""
    return [top * i / (num - 1) for i in range(num)]

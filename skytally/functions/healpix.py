"""Equal-area sky pixels in ring order (equations of Gorski et al. 2005).

Everything here is built from column arithmetic; the pixel tables are generated
by ``spark.range`` and so have a size fixed by ``nside``, not by the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .geometry import chord, chord_col, chord_sq, col, unit_vector

# Row and longitude offsets of the twelve base faces.
FACE_ROW = (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4)
FACE_LON = (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7)


def npix(nside: int) -> int:
    return 12 * nside * nside


def _belt_pixel(nside: int, jp: Column, jm: Column) -> Column:
    """Pixel between the polar caps from its two diagonal line numbers."""
    four_ns = F.lit(4 * nside).cast("long")
    ir = F.lit(nside + 1).cast("long") + jp - jm
    shift = F.lit(1).cast("long") - ir.bitwiseAND(F.lit(1).cast("long"))
    half = F.shiftright(jp + jm - F.lit(nside).cast("long") + shift + F.lit(1).cast("long"), 1)
    ip = F.pmod(half, four_ns)
    return F.lit(2 * nside * (nside - 1)).cast("long") + (ir - F.lit(1).cast("long")) * four_ns + ip


def _cap_pixel(nside: int, tt: Column, z: Column, ring: Column) -> Column:
    """Pixel inside a polar cap from its ring counted from the nearer pole."""
    one, two = F.lit(1).cast("long"), F.lit(2).cast("long")
    ip = F.pmod(F.floor(tt * ring).cast("long"), F.lit(4).cast("long") * ring)
    return ip + F.when(z > F.lit(0.0), two * ring * (ring - one)).otherwise(
        F.lit(npix(nside)).cast("long") - two * ring * (ring + one)
    )


def _turns(ra: Column | str) -> Column:
    return F.pmod(F.radians(col(ra)) / F.lit(math.pi / 2), F.lit(4.0))


def _height(dec: Column | str) -> Column:
    return F.cos(F.lit(math.pi / 2) - F.radians(col(dec)))


def _lines(nside: int, tt: Column, z: Column) -> tuple[Column, Column]:
    t1 = F.lit(float(nside)) * (F.lit(0.5) + tt)
    t2 = F.lit(0.75 * nside) * z
    return F.floor(t1 - t2).cast("long"), F.floor(t1 + t2).cast("long")


def _cap_ring(nside: int, tt: Column, z: Column) -> Column:
    tp = tt - F.floor(tt)
    s = F.lit(float(nside)) * F.sqrt(F.lit(3.0) * (F.lit(1.0) - F.abs(z)))
    return (F.floor(tp * s) + F.floor((F.lit(1.0) - tp) * s) + F.lit(1)).cast("long")


def ang2pix(nside: int, ra: Column | str, dec: Column | str) -> Column:
    """Ring-ordered pixel of a position in degrees, as one long expression.

    :func:`with_pixel` computes the same in named steps and is the form to use
    on large inputs, because each step is then evaluated once per row.
    """
    tt, z = _turns(ra), _height(dec)
    return F.when(F.abs(z) <= F.lit(2.0 / 3.0), _belt_pixel(nside, *_lines(nside, tt, z))).otherwise(
        _cap_pixel(nside, tt, z, _cap_ring(nside, tt, z))
    )


def with_pixel(df: DataFrame, nside: int, ra: str = "ra", dec: str = "dec", name: str = "pix") -> DataFrame:
    """Add the ring-ordered pixel of each position, -1 for a missing position.

    Never NULL: a nullable key would make Spark test it for NULL below every join,
    which means working out the whole formula a second time.
    """
    tt, z = F.col("_tt"), F.col("_z")
    jp, jm = _lines(nside, tt, z)
    steps = (
        df.withColumns({"_tt": _turns(ra), "_z": _height(dec)})
        .withColumns({"_jp": jp, "_jm": jm, "_ir": _cap_ring(nside, tt, z)})
    )
    pix = F.when(F.abs(z) <= F.lit(2.0 / 3.0), _belt_pixel(nside, F.col("_jp"), F.col("_jm"))).otherwise(
        _cap_pixel(nside, tt, z, F.col("_ir"))
    )
    return steps.withColumn(name, F.coalesce(pix, F.lit(-1).cast("long"))).drop("_tt", "_z", "_jp", "_jm", "_ir")


def _ring_facts(nside: int, row: Column) -> tuple[Column, Column]:
    """Pixels per quarter ring and cos(polar angle) of corner or centre row ``row``."""
    ns = F.lit(nside).cast("long")
    nr = F.least(row, ns, F.lit(4 * nside).cast("long") - row)
    cap = nr.cast("double") * nr / F.lit(3.0 * nside * nside)
    z = (
        F.when(row < ns, F.lit(1.0) - cap)
        .when(row > F.lit(3 * nside), cap - F.lit(1.0))
        .otherwise(F.lit(2.0) * (F.lit(2 * nside) - row) / F.lit(3.0 * nside))
    )
    return nr, z


def pixel_table(spark: SparkSession, nside: int) -> DataFrame:
    """Every pixel with its face coordinates: ``pix, face_row, face_lon, fx, fy``."""
    ns = F.lit(nside).cast("long")
    base = spark.range(npix(nside)).select(
        F.floor(F.col("id") / F.lit(nside * nside)).cast("int").alias("face"),
        F.pmod(F.col("id"), ns).alias("fx"),
        F.pmod(F.floor(F.col("id") / ns).cast("long"), ns).alias("fy"),
    )
    pick = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("face") + 1)
    base = base.select(
        "fx", "fy", pick(FACE_ROW).alias("face_row"), pick(FACE_LON).alias("face_lon")
    )
    row = F.col("face_row") * ns - F.col("fx") - F.col("fy") - F.lit(1)
    base = base.withColumn("ring", row)
    nr, _ = _ring_facts(nside, F.col("ring"))
    base = base.withColumn("nr", nr)
    in_belt = (F.col("ring") >= ns) & (F.col("ring") <= F.lit(3 * nside))
    kshift = F.when(in_belt, F.pmod(F.col("ring") - ns, F.lit(2).cast("long"))).otherwise(F.lit(0))
    before = (
        F.when(F.col("ring") < ns, F.lit(2) * F.col("nr") * (F.col("nr") - 1))
        .when(in_belt, F.lit(2 * nside * (nside - 1)) + (F.col("ring") - ns) * F.lit(4 * nside))
        .otherwise(F.lit(npix(nside)) - F.lit(2) * F.col("nr") * (F.col("nr") + 1))
    )
    slot = F.floor(
        (F.col("face_lon") * F.col("nr") + F.col("fx") - F.col("fy") + 1 + kshift) / F.lit(2.0)
    ).cast("long")
    pix = before + F.pmod(slot - 1, F.lit(4).cast("long") * F.col("nr"))
    return base.select(pix.cast("long").alias("pix"), "face_row", "face_lon", "fx", "fy", "ring")


def pixel_centres(spark: SparkSession, nside: int) -> DataFrame:
    """``pix, ra, dec, x, y, z`` of every pixel centre."""
    t = pixel_table(spark, nside)
    nr, z = _ring_facts(nside, F.col("ring"))
    phi = (
        F.lit(math.pi / 4)
        * (F.col("face_lon") * nr + F.col("fx") - F.col("fy"))
        / nr
    )
    t = t.select("pix", z.alias("z"), F.pmod(phi, F.lit(2 * math.pi)).alias("phi"))
    s = F.sqrt((F.lit(1.0) - F.col("z")) * (F.lit(1.0) + F.col("z")))
    return t.select(
        "pix",
        F.degrees("phi").alias("ra"),
        F.degrees(F.asin("z")).alias("dec"),
        (s * F.cos("phi")).alias("x"),
        (s * F.sin("phi")).alias("y"),
        "z",
    )


def centre_of(nside: int, pix: Column | str) -> tuple[Column, Column]:
    """cos(polar angle) and longitude in radians of a pixel's centre, from its number alone."""
    p = col(pix).cast("long")
    cap, all_ = 2 * nside * (nside - 1), npix(nside)

    def ring(k):
        # the root is exact enough here: k stays below 2^53 up to nside 2^25
        return F.floor((F.lit(1.0) + F.sqrt(F.lit(1.0) + F.lit(2.0) * k)) / F.lit(2.0)).cast("long")

    north, south = ring(p), ring(F.lit(all_ - 1) - p)
    belt = F.floor((p - F.lit(cap)) / F.lit(4 * nside)).cast("long")
    z = (F.when(p < F.lit(cap), F.lit(1.0) - north * north / F.lit(3.0 * nside * nside))
         .when(p >= F.lit(all_ - cap), south * south / F.lit(3.0 * nside * nside) - F.lit(1.0))
         .otherwise((F.lit(nside) - belt) * F.lit(2.0) / F.lit(3.0 * nside)))
    half = math.pi / 2
    place = F.pmod(p - F.lit(cap), F.lit(4 * nside).cast("long"))
    from_end = F.lit(all_ - 1) - p - F.lit(2) * south * (south - 1)
    phi = (F.when(p < F.lit(cap), (p - F.lit(2) * north * (north - 1) + F.lit(0.5)) * F.lit(half) / north)
           .when(p >= F.lit(all_ - cap), (F.lit(4) * south - from_end - F.lit(0.5)) * F.lit(half) / south)
           .otherwise((place + F.when(belt % 2 == 0, F.lit(0.5)).otherwise(F.lit(0.0))) * F.lit(half / nside)))
    return z, phi


def nested_id(nside: int, z: Column, phi: Column) -> Column:
    """Number of the pixel at a place in nested order: the parent of a pixel is its number without the last two bits.

    An ``nside`` between powers of two is laid out as the next one, with gaps.
    """
    ns = F.lit(nside).cast("long")
    tt = F.pmod(phi / F.lit(math.pi / 2), F.lit(4.0))
    up, down = (F.floor(F.lit(0.5 * nside) + F.lit(nside) * tt + s * F.lit(0.75 * nside) * z).cast("long") for s in (1, -1))
    fp, fm = F.floor(down / ns).cast("long"), F.floor(up / ns).cast("long")
    belt_face = F.when(fp == fm, F.pmod(fp, F.lit(4).cast("long")) + 4).when(fp < fm, F.pmod(fp, F.lit(4).cast("long"))).otherwise(F.pmod(fm, F.lit(4).cast("long")) + 8)
    quarter = F.least(F.floor(tt), F.lit(3)).cast("long")
    width = F.lit(float(nside)) * F.sqrt(F.lit(3.0) * (F.lit(1.0) - F.abs(z)))
    jp, jm = (F.least(F.floor(t * width), ns - 1).cast("long") for t in (tt - quarter, F.lit(1.0) - tt + quarter))
    belt = F.abs(z) <= F.lit(2 / 3)
    face = F.when(belt, belt_face).when(z > 0, quarter).otherwise(quarter + 8)
    x = F.when(belt, F.pmod(up, ns)).when(z > 0, ns - 1 - jm).otherwise(jp)
    y = F.when(belt, ns - 1 - F.pmod(down, ns)).when(z > 0, ns - 1 - jp).otherwise(jm)

    def spread(v):
        # each bit moves to twice its place
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    depth = max(nside - 1, 0).bit_length()
    return F.shiftleft(face, 2 * depth) + spread(x) + F.shiftleft(spread(y), 1)


def pixel_radius(nside: int) -> float:
    """No point of a pixel is farther than this many degrees from its centre."""
    return math.degrees(1.2 / nside)


def pixel_corners(spark: SparkSession, nside: int) -> DataFrame:
    """``pix, corner, k``: the four corners of each pixel in walking order.

    A corner is named by whole numbers only (its row and its slot in the row),
    so corners of different faces meet exactly, without rounding.
    """
    t = pixel_table(spark, nside)
    steps = ((0, 0), (1, 0), (1, 1), (0, 1))
    t = t.select(
        "*",
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b"))
                      for k, (a, b) in enumerate(steps)])
        ).alias("c"),
    )
    cx, cy = F.col("fx") + F.col("c.a"), F.col("fy") + F.col("c.b")
    row = F.col("face_row") * F.lit(nside) - cx - cy
    nr, _ = _ring_facts(nside, row)
    slot = F.when(nr > 0, F.pmod(F.col("face_lon") * nr + cx - cy, F.greatest(F.lit(8) * nr, F.lit(1)))).otherwise(F.lit(0))
    return t.select("pix", F.col("c.k").alias("k"), (row * F.lit(8 * nside) + slot).alias("corner"))


def neighbours(spark: SparkSession, nside: int, pixels: DataFrame | None = None) -> DataFrame:
    """``pix, near``: pixels that share at least one corner, self excluded.

    ``pixels`` (a column ``pix``) limits both ends to a set of pixels.
    """
    c = pixel_corners(spark, nside)
    if pixels is not None:
        c = c.join(pixels.select("pix"), "pix", "left_semi")
    # at most four pixels meet in a corner, so the lists stay tiny
    meet = c.groupBy("corner").agg(F.collect_list("pix").alias("at"))
    meet = meet.select("at", F.explode("at").alias("pix"))
    return meet.select("pix", F.explode("at").alias("near")).where("pix <> near").distinct()


def edge_neighbours(spark: SparkSession, nside: int, pixels: DataFrame | None = None) -> DataFrame:
    """``pix, near``: pixels that share a whole edge (four per pixel on a full sky)."""
    c = pixel_corners(spark, nside)
    if pixels is not None:
        c = c.join(pixels.select("pix"), "pix", "left_semi")
    per_pixel = c.groupBy("pix").agg(
        *[F.max(F.when(F.col("k") == k, F.col("corner"))).alias(f"c{k}") for k in range(4)]
    )
    sides = per_pixel.select(
        "pix",
        F.explode(
            F.array(*[
                F.struct(
                    F.least(f"c{k}", f"c{(k + 1) % 4}").alias("lo"),
                    F.greatest(f"c{k}", f"c{(k + 1) % 4}").alias("hi"),
                )
                for k in range(4)
            ])
        ).alias("side"),
    )
    other = sides.select(F.col("pix").alias("near"), "side")
    return sides.join(other, "side").where("pix <> near").select("pix", "near").distinct()


def disc_pixels(df: DataFrame, radius_deg: float | Column, nside: int, ra: str = "ra", dec: str = "dec",
                slack_deg: float = 0.0) -> DataFrame:
    """Each row repeated for every pixel whose centre lies within the radius.

    The rings a disc touches follow from its latitude span and the slots of a
    ring from its longitude span, so a row makes its own pixels: no join and no
    shuffle. ``slack_deg`` widens the disc, e.g. by a pixel's own size. The radius is one
    number or a column.
    """
    reach = radius_deg + slack_deg
    if isinstance(radius_deg, Column):
        angle, reach_sq = F.radians(reach), F.pow(chord_col(F.least(reach, F.lit(180.0))), F.lit(2.0))
        cos_reach = F.cos(angle)
    else:
        angle, reach_sq = F.lit(math.radians(reach)), F.lit(chord(min(reach, 180.0)) ** 2)
        cos_reach = F.lit(math.cos(math.radians(reach)))
    x, y, z = unit_vector(ra, dec)
    d = df.withColumns({"_x": x, "_y": y, "_z": z})
    ns = nside
    # span of polar angle -> span of ring numbers, one ring of margin on each side
    theta = F.lit(math.pi / 2) - F.radians(col(dec))
    lo = F.greatest(theta - angle, F.lit(0.0))
    hi = F.least(theta + angle, F.lit(math.pi))

    def ring_at(angle: Column) -> Column:
        c = F.cos(angle)
        belt = F.lit(2.0 * ns) - F.lit(1.5 * ns) * c
        cap = F.lit(ns * math.sqrt(3.0)) * F.sqrt(F.greatest(F.lit(1.0) - F.abs(c), F.lit(0.0)))
        return F.when(F.abs(c) <= 2.0 / 3.0, belt).when(c > 0, cap).otherwise(F.lit(4.0 * ns) - cap)

    first = F.greatest(F.floor(ring_at(lo)).cast("long") - 1, F.lit(1).cast("long"))
    last = F.least(F.ceil(ring_at(hi)).cast("long") + 1, F.lit(4 * ns - 1).cast("long"))
    d = d.withColumn("_ring", F.explode(F.sequence(first, last)))
    ring = F.col("_ring")
    nr, zr = _ring_facts(ns, ring)
    belt = (ring >= ns) & (ring <= 3 * ns)
    d = d.withColumns({"_nr": nr, "_zr": zr, "_off": F.when(
        belt, (F.lit(1.0) + F.pmod(ring - F.lit(ns), F.lit(2).cast("long"))) / 2.0).otherwise(F.lit(0.5))})
    sr = F.sqrt((F.lit(1.0) - F.col("_zr")) * (F.lit(1.0) + F.col("_zr")))
    s0 = F.sqrt(F.greatest(F.lit(1.0) - F.col("_z") * F.col("_z"), F.lit(0.0)))
    cos_span = F.try_divide(
        cos_reach - F.col("_z") * F.col("_zr"), s0 * sr
    )
    # a disc round a pole meets all longitudes of a ring
    span = F.when(cos_span.isNull() | (cos_span <= -1.0), F.lit(math.pi)).when(
        cos_span >= 1.0, F.lit(0.0)).otherwise(F.acos(cos_span))
    phi = F.pmod(F.radians(col(ra)), F.lit(2 * math.pi))
    step = F.lit(math.pi / 2) / F.col("_nr")
    lo_j = F.floor((phi - span) / step - F.lit(1.0)).cast("long")
    hi_j = F.ceil((phi + span) / step + F.lit(1.0)).cast("long")
    full = hi_j - lo_j >= F.lit(4) * F.col("_nr")
    d = d.withColumns({
        "_j0": F.when(full, F.lit(0).cast("long")).otherwise(lo_j),
        "_j1": F.when(full, F.lit(4).cast("long") * F.col("_nr") - 1).otherwise(hi_j),
        "_sr": sr,
    })
    d = d.withColumn("_j", F.explode(F.sequence("_j0", "_j1")))
    slot = F.pmod(F.col("_j"), F.lit(4).cast("long") * F.col("_nr"))
    # pixel number slot+1 of the ring has longitude (slot + 1 - off) * step
    lon = (slot.cast("double") + F.lit(1.0) - F.col("_off")) * F.lit(math.pi / 2) / F.col("_nr")
    cxyz = (F.col("_sr") * F.cos(lon), F.col("_sr") * F.sin(lon), F.col("_zr"))
    inside = chord_sq((F.col("_x"), F.col("_y"), F.col("_z")), cxyz) <= reach_sq
    before = (
        F.when(ring < ns, F.lit(2) * F.col("_nr") * (F.col("_nr") - 1))
        .when(belt, F.lit(2 * ns * (ns - 1)) + (ring - F.lit(ns)) * F.lit(4 * ns))
        .otherwise(F.lit(npix(ns)) - F.lit(2) * F.col("_nr") * (F.col("_nr") + 1))
    )
    return d.where(inside).select(*df.columns, (before + slot).cast("long").alias("pix"))

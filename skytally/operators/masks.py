"""Sky masks and quality cuts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import to_galactic, with_unit_vector
from ..functions.healpix import disc_pixels, npix, pixel_radius, with_pixel
from ..functions.scalars import all_of, any_of, in_range, known
from ..lineage import wide_tasks

# a polygon is laid out on the smallest of these pixels that is not smaller than the polygon's radius
CAP_NSIDES = (1, 2, 8, 32, 128, 512, 2048)
# a sky of so many pixels at most is sent to every task
SMALL_SKY = 12 * 128 * 128


def in_boxes(ra: str, dec: str, boxes) -> Column:
    """Strictly inside any (ra0, ra1, dec0, dec1) of a short list. Boxes do not wrap."""
    return any_of(*[
        in_range(ra, r0, r1, "neither") & in_range(dec, d0, d1, "neither") for r0, r1, d0, d1 in boxes
    ])


def box_mask(df: DataFrame, boxes: DataFrame, ra: str = "ra", dec: str = "dec", keep_inside: bool = False,
             cell_deg: float = 1.0) -> DataFrame:
    """Rows outside (or inside) every box of a table ``ra0, ra1, dec0, dec1``.

    Boxes are laid out on a lattice of ``cell_deg`` so points find them by an
    equi-join on the lattice cell.
    """
    size = F.lit(float(cell_deg))
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    b = boxes.withColumn("cx", F.explode(F.sequence(cell("ra0"), cell("ra1"))))
    b = b.withColumn("cy", F.explode(F.sequence(cell("dec0"), cell("dec1"))))
    p = df.withColumns({"cx": cell(ra), "cy": cell(dec)}).alias("p")
    b = b.alias("b")
    on = (
        (F.col("p.cx") == F.col("b.cx")) & (F.col("p.cy") == F.col("b.cy"))
        & (F.col(f"p.{ra}") > F.col("b.ra0")) & (F.col(f"p.{ra}") < F.col("b.ra1"))
        & (F.col(f"p.{dec}") > F.col("b.dec0")) & (F.col(f"p.{dec}") < F.col("b.dec1"))
    )
    return p.join(b, on, "left_semi" if keep_inside else "left_anti").select(*df.columns)


def outside_patch(ra: str, dec: str, patch, active: bool = True) -> Column:
    """True outside the one rectangle in use; all false when switched off."""
    if not active:
        return F.lit(False)
    return ~in_boxes(ra, dec, [patch])


def _polygons(caps: DataFrame) -> DataFrame:
    """One row per polygon: its caps, a disc that bounds it, and the ``nside`` whose pixels suit the disc."""
    cap = F.struct("x", "y", "z", F.col("one_minus_cos").alias("cm"))
    polys = caps.groupBy("polygon_id").agg(F.collect_list(cap).alias("caps"))
    # the smallest cap bounds the polygon; a polygon with none is tried everywhere
    ups = F.filter("caps", lambda c: c.cm > 0)
    small = F.array_min(F.transform(ups, lambda c: F.struct(c.cm, c.x, c.y, c.z)))
    polys = polys.withColumn("b", F.coalesce(small, F.struct(
        F.lit(2.0).alias("cm"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z"))))
    radius = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.lit(1.0) - F.col("b.cm"))))
    polys = polys.select("polygon_id", "caps", radius.alias("rad"),
                         F.pmod(F.degrees(F.atan2("b.y", "b.x")), F.lit(360.0)).alias("bra"),
                         F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("b.z"))))).alias("bdec"))
    level = F.lit(CAP_NSIDES[0])
    for n in CAP_NSIDES[1:]:
        level = F.when(F.col("rad") <= math.degrees(math.sqrt(4 * math.pi / npix(n))), F.lit(n)).otherwise(level)
    return polys.where("rad <= 180").withColumn("nside", level)


def polygon_hits(df: DataFrame, caps: DataFrame, ra: str = "ra", dec: str = "dec", frame: str = "galactic",
                 how: str = "left_semi") -> DataFrame:
    """Rows inside any polygon (or outside all, with ``how='left_anti'``).

    A polygon is the overlap of spherical caps, given as rows ``polygon_id, x, y, z,
    one_minus_cos`` (a negative size means the outside of the cap). Points and
    polygons meet on pixels about as wide as the polygon, so the polygons tried for a point are those
    of its surroundings; polygons of each width in use are one join. The work is large for few
    bytes, so its tasks are not merged by size.
    """
    if frame == "galactic":
        lon, lat = to_galactic(ra, dec)
        p = df.withColumns({"_lon": lon, "_lat": lat})
    else:
        p = df.withColumns({"_lon": F.col(ra), "_lat": F.col(dec)})
    p = with_unit_vector(p, "_lon", "_lat", ("_ux", "_uy", "_uz"))
    away = lambda c: F.lit(1.0) - (c.x * F.col("_ux") + c.y * F.col("_uy") + c.z * F.col("_uz"))
    inside = F.forall(F.col("caps"), lambda c: F.when(c.cm >= 0, away(c) < c.cm).otherwise(away(c) > -c.cm))
    polys, tasks, hits = _polygons(caps), wide_tasks(df), None
    # one number for each width, at most as many as CAP_NSIDES
    for nside in sorted(r.nside for r in polys.select("nside").distinct().collect()):
        part = polys.where(F.col("nside") == nside)
        # a hair more than the disc and a pixel, so that rounding never loses a pixel
        reach = F.least(F.col("rad") + F.lit(pixel_radius(nside) + 1e-6), F.lit(181.0))
        part = disc_pixels(part.select("caps", "bra", "bdec", "rad"), reach, nside, "bra", "bdec")
        part = part.select("caps", F.col("pix").alias("_cap")).repartition(tasks, "_cap")
        at = with_pixel(p, nside, "_lon", "_lat", "_pix").repartition(tasks, "_pix")
        on = (F.col("_pix") == F.col("_cap")) & inside
        if how == "left_semi":
            hit = at.join(part, on, "left_semi").select(*df.columns)
            hits = hit if hits is None else hits.unionByName(hit)
        p = at.join(part, on, "left_anti").drop("_pix")
    if how == "left_semi":
        return df.limit(0) if hits is None else hits
    return p.select(*df.columns)


def polygon_mask(df: DataFrame, caps: DataFrame, ra: str = "ra", dec: str = "dec", frame: str = "galactic") -> DataFrame:
    """Rows outside every masked polygon."""
    return polygon_hits(df, caps, ra, dec, frame, "left_anti")


def polygon_flag(df: DataFrame, caps: DataFrame, name: str = "mask_ok", ra: str = "ra", dec: str = "dec",
                 frame: str = "galactic") -> DataFrame:
    """All rows with a flag: true outside every masked polygon."""
    ok = polygon_mask(df, caps, ra, dec, frame).withColumn(name, F.lit(True))
    return ok.unionByName(polygon_hits(df, caps, ra, dec, frame).withColumn(name, F.lit(False)))


def galaxy_quality_cut(zmin: float, zmax: float, spots=(), bad_patches=(), patch=None, imax: float = 24.0,
                       ra="ra", dec="dec", z="redshift", z_std="z_std", imag="imag", wise="wise_flag",
                       extended="extendedness") -> Column:
    """The galaxy sample: clean sky, a flag, a positive z error, extended and bright enough."""
    sky = [~in_boxes(ra, dec, spots), ~in_boxes(ra, dec, bad_patches)]
    if patch is not None:
        sky.append(~outside_patch(ra, dec, patch))
    return all_of(
        *sky,
        F.col(wise) > 0,
        known(z_std) > F.lit(0.0),
        in_range(z, zmin, zmax, "neither"),
        known(extended) > F.lit(0.3),
        known(imag) <= F.lit(float(imax)),
    )


def agn_quality_cut(zmin: float, zmax: float, kind: int = 0, matched: bool = False, confidence: float | None = 0.5,
                    z="z", specz="specz", p_t1="p_t1", p_t2="p_t2", conf="conf", match="z_match") -> Column:
    """The quasar sample: kind 1 or 2 by probability, kind 3 with a spectrum, 0 all."""
    tests = [in_range(z, zmin, zmax, "left")]
    if kind in (1, 2):
        tests.append(known(p_t1 if kind == 1 else p_t2) > F.lit(0.5))
    elif kind == 3:
        tests.append(known(specz).isNotNull())
    if confidence is not None:
        tests.append(known(conf) > F.lit(confidence))
    if matched:
        tests.append(known(match).isNotNull())
    return all_of(*tests)


def passes_bin_cut(value: str, z: str, bin_edges, thresholds) -> Column:
    """False below the threshold of the open redshift sub-bin a row lies in; true elsewhere."""
    low = any_of(*[
        in_range(z, lo, hi, "neither") & F.coalesce(known(value) < F.lit(float(t)), F.lit(False))
        for lo, hi, t in zip(bin_edges, bin_edges[1:], thresholds)
    ])
    return ~low


def cut_by_bin(df: DataFrame, value: str, z: str, bin_edges, thresholds) -> tuple[DataFrame, DataFrame]:
    """The rows that pass, and a one-row table of the fraction that does."""
    ok = passes_bin_cut(value, z, bin_edges, thresholds)
    return df.where(ok), df.agg(F.avg(ok.cast("double")).alias("fraction"))


def in_footprint(df: DataFrame, mask: DataFrame, nside: int, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """Rows whose pixel is in a mask table ``pix``.

    The pixels of a low ``nside`` are few, whatever the catalogs' size, so they go to the rows.
    """
    p = with_pixel(df, nside, ra, dec, "_pix")
    m = mask.select(F.col("pix").alias("_pix")).distinct()
    if npix(nside) <= SMALL_SKY:
        m = F.broadcast(m)
    return p.join(m, "_pix", "left_semi").select(*df.columns)

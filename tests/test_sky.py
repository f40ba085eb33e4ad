"""Pixels, masks and footprints against known answers and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytally.functions import geometry as G
from skytally.functions import healpix as H
from skytally.functions import scalars as S
from skytally.operators import footprint as FP
from skytally.operators import masks as M


def xyz(ra, dec):
    t, p = np.pi / 2 - np.radians(dec), np.radians(ra)
    return np.stack([np.cos(p) * np.sin(t), np.sin(p) * np.sin(t), np.cos(t)], -1)


def test_pixel_anchors(spark):
    z = spark.createDataFrame([(0.0, 0.0)], "ra double, dec double")
    got = z.select(*[H.ang2pix(n, "ra", "dec").alias(str(n)) for n in (1, 2, 4, 8, 16)]).first()
    assert list(got) == [4, 12, 72, 336, 1440]


def test_steps_equal_expression(spark):
    p = spark.range(3000).select((F.col("id") * 7.31 % 360).alias("ra"), (F.col("id") * 3.77 % 180 - 90).alias("dec"))
    both = H.with_pixel(p, 16).select("pix", H.ang2pix(16, "ra", "dec").alias("q")).toPandas()
    assert (both.pix == both.q).all() and both.pix.between(0, H.npix(16) - 1).all()


def test_missing_position_has_no_pixel(spark):
    p = spark.createDataFrame([(None, 1.0)], "ra double, dec double")
    assert H.with_pixel(p, 8).first().pix == -1


@pytest.mark.parametrize("n", [2, 8])
def test_neighbour_tables(spark, n):
    near = H.neighbours(spark, n)
    assert near.count() == 8 * H.npix(n) - 24
    edges = H.edge_neighbours(spark, n).groupBy("pix").count()
    assert edges.count() == H.npix(n) and edges.where("count <> 4").count() == 0


def test_disc_pixels_at_poles_and_wrap(spark):
    rows = [(1, 0.1, 0.0), (2, 140.0, 5.0), (3, 200.0, 89.5), (4, 300.0, -88.0), (5, 359.9, 41.8), (6, 0.0, -90.0)]
    pts = spark.createDataFrame(rows, "id int, ra double, dec double")
    cen = H.pixel_centres(spark, 16).toPandas()
    c = cen[["x", "y", "z"]].to_numpy()
    got = {(r.id, r.pix) for r in H.disc_pixels(pts, 7.0, 16).select("id", "pix").collect()}
    lim = G.chord(7.0) ** 2
    want = {(i, int(p)) for i, ra, dec in rows for p in cen.pix[((c - xyz(ra, dec)) ** 2).sum(1) <= lim]}
    assert got == want


def test_galactic_centre(spark):
    lon, lat = G.to_galactic("ra", "dec")
    r = spark.createDataFrame([(266.40499, -28.93617)], "ra double, dec double").select(lon.alias("l"), lat.alias("b")).first()
    assert min(r.l, 360 - r.l) < 1e-3 and abs(r.b) < 1e-3


def test_missing_values_fail_every_test(spark):
    d = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "v double")
    assert d.where(S.known("v") > 0.0).count() == 1
    assert d.where(S.in_range("v", 0, 5)).count() == 1
    # a threshold drops only what is known to lie below it
    cut = d.withColumn("z", F.lit(0.35)).where(M.passes_bin_cut("v", "z", (0.3, 0.4), (2.0,)))
    assert cut.count() == 2


def test_zbin_edges(spark):
    d = spark.createDataFrame([(0.2,), (0.3,), (0.5,), (1.1,), (float("nan"),)], "z double")
    got = [r[0] for r in d.select(S.zbin_index("z", [0.3, 0.5, 0.7, 0.9, 1.1])).collect()]
    assert got == [None, 0, 1, None, None]


def test_closures(spark):
    d = spark.createDataFrame([(0.0,), (1.0,)], "v double")
    got = {c: [r[0] for r in d.select(S.in_range("v", 0, 1, c)).collect()] for c in ("left", "both", "neither")}
    assert got == {"left": [True, False], "both": [True, True], "neither": [False, False]}


def test_box_table_equals_list(spark):
    p = spark.range(4000).select("id", (F.col("id") * 0.0173 % 10 + 130).alias("ra"), (F.col("id") * 0.0311 % 6 - 3).alias("dec"))
    boxes = [(131.0, 133.5, -1.0, 1.2), (139.2, 139.4, -3.0, 3.0)]
    table = spark.createDataFrame(boxes, "ra0 double, ra1 double, dec0 double, dec1 double")
    want = {r.id for r in p.where(~M.in_boxes("ra", "dec", boxes)).collect()}
    assert {r.id for r in M.box_mask(p, table).collect()} == want
    inside = {r.id for r in M.box_mask(p, table, keep_inside=True).collect()}
    assert inside | want == set(range(4000)) and not inside & want


def _square(spark, nside, lo, hi):
    c = H.pixel_centres(spark, nside)
    return c.where(f"ra > {lo} and ra < {hi} and dec > -4 and dec < 4").select("pix")


def test_contiguous_region_keeps_only_the_seeded_part(spark):
    mask = _square(spark, 16, 20, 40).union(_square(spark, 16, 60, 80))
    seeds = FP.seed_pixels(spark, 16, {"a": (30.0, 0.0)})
    got = {r.pix for r in FP.contiguous_region(mask, seeds, 16).collect()}
    assert got == {r.pix for r in _square(spark, 16, 20, 40).collect()}


def test_seed_outside_mask_is_an_error(spark):
    seeds = FP.seed_pixels(spark, 16, {"a": (200.0, 0.0)})
    with pytest.raises(Exception, match="outside the mask"):
        FP.contiguous_region(_square(spark, 16, 20, 40), seeds, 16).collect()


def test_lone_pixel_is_its_own_region(spark):
    seeds = FP.seed_pixels(spark, 16, {"a": (200.0, 10.0)})
    mask = seeds.select("pix").union(_square(spark, 16, 20, 40))
    assert FP.contiguous_region(mask, seeds, 16).count() == 1


def test_first_visit_wins(spark):
    v = spark.createDataFrame([(5, 1, "g"), (3, 1, "r"), (7, 2, "i")], "visit_id int, pntgid int, filter string")
    got = {(r.visit_id, r.filter) for r in FP.first_per_pointing(v).collect()}
    assert got == {(3, "r"), (7, "i")}


def test_polygon_with_hole(spark):
    v = xyz(np.array([100.0]), np.array([20.0]))[0].tolist()
    caps = spark.createDataFrame(
        [(1, *v, 1 - math.cos(math.radians(2.0))), (1, *v, -(1 - math.cos(math.radians(0.5))))],
        "polygon_id int, x double, y double, z double, one_minus_cos double")
    p = spark.createDataFrame([(1, 100.0, 20.1), (2, 100.0, 21.0), (3, 100.0, 23.0)], "id int, ra double, dec double")
    flags = {r.id: r.mask_ok for r in M.polygon_flag(p, caps, frame="given").collect()}
    assert flags == {1: True, 2: False, 3: True}

"""Shapes of plans and intermediate tables that keep large inputs cheap, next to brute force."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from skytally.operators import curves as CV
from skytally.operators import masks as M
from skytally.operators import partition as PT


def _plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_polygons_of_every_width_against_brute_force(spark):
    """F2, F8: polygons are laid out on pixels about as wide as they are, and lose no point of any width."""
    r = np.random.default_rng(3)
    n, widths = 400, [0.0, 0.01, 0.25, 1.0, 4.0, 20.0, 70.0, 179.0]
    ra, dec = r.uniform(0, 360, n), np.degrees(np.arcsin(r.uniform(-1, 1, n)))
    ra[:40], dec[:40], dec[:3] = r.normal(150, 0.2, 40), r.normal(2, 0.2, 40), [90.0, -90.0, 89.9]
    xyz = lambda a, d: np.stack([np.cos(np.radians(a)) * np.cos(np.radians(d)), np.sin(np.radians(a)) * np.cos(np.radians(d)), np.sin(np.radians(d))], 1)
    v = xyz(ra, dec)
    for k, some in enumerate((widths[:3], widths[3:6], widths[6:])):
        caps, inside = [], np.zeros(n, bool)
        for i, w in enumerate(some):
            for j in range(3):
                a, d = (150.0 + j * 0.3, 2.0) if j else (r.uniform(0, 360), 89.0)
                c, cm = xyz(np.array([a]), np.array([d]))[0], 1 - math.cos(math.radians(w))
                caps.append((i * 3 + j, *map(float, c), cm))
                caps.append((i * 3 + j, *map(float, c), -cm / 10))
                away = 1 - v @ c
                inside |= (away < cm) & (away > cm / 10)
        t = spark.createDataFrame(caps, "polygon_id long, x double, y double, z double, one_minus_cos double")
        p = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "ra": ra, "dec": dec}))
        got = {x.id: x.mask_ok for x in M.polygon_flag(p, t, frame="given").collect()}
        assert got == {i: not inside[i] for i in range(n)} and 0 < inside.sum(), k
    quarter = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 1 - math.cos(math.radians(0.25)))], "polygon_id long, x double, y double, z double, one_minus_cos double")
    assert M._polygons(quarter).first().nside == 128


def test_densities_of_one_file_are_spread(spark):
    """rows that one task reads are dealt to all before they are unrolled."""
    df = spark.createDataFrame([(0.5, 0.1), (1.0, 0.2), (None, 0.1), (1.0, 0.0)], "m double, s double").coalesce(1)
    g = CV.gauss_sum(df, "m", "s", 0.0, 2.0, 5)
    assert "RoundRobinPartitioning" in _plan(g)
    want = lambda x: sum(math.exp(-((x - m) / s) ** 2 / 2) / (s * math.sqrt(2 * math.pi)) for m, s in ((0.5, 0.1), (1.0, 0.2)))
    assert all(abs(r.y - want(r.x)) < 1e-9 for r in g.collect())


def test_random_points_are_not_shuffled(spark):
    """the few pixels of a footprint go to the points, whatever Spark thinks of the table they come from."""
    mask = spark.createDataFrame([(5,), (5,), (700,)], "pix long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = PT.random_catalog(spark, 3000, mask, 16)
        plan = _plan(got)
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        near = M.with_pixel(PT.random_catalog(spark, 3000, None, 16), 16).where(F.col("pix").isin(5, 700))
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in near.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_blocks_count_like_brute_force():
    """F1, F3 to F7, F9 to F13, F15 to F18: one block pair, weights and copies included, and only near positions sent."""
    import pyarrow as pa

    from skytally.operators.blocks import block_counter, near_points

    r = np.random.default_rng(8)
    a, b = r.normal(0, 1, (700, 3)), r.normal(0.5, 1, (900, 3))
    a[:200], b[:300] = a[0], b[1] * 0 + 0.25
    limits = [0.0, 0.01, 0.5, 4.0, 9.0]
    d2 = sum((a[:, None, c] - b[None, :, c]) ** 2 for c in range(3))
    block = lambda v, w: [{"x": float(p[0]), "y": float(p[1]), "z": float(p[2]), "n": k} for p, k in zip(v, w)]
    for top in (1, 5):
        u, w = r.integers(1, top + 1, len(a)).tolist(), r.integers(1, top + 1, len(b)).tolist()
        kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64()), ("n", pa.int64())]))
        batch = pa.RecordBatch.from_arrays([pa.array([7, 8]), pa.array([block(a, u), block(a[:3], u[:3])], kind), pa.array([block(b, w), block(b[:2], w[:2])], kind)], ["key", "pts1", "pts2"])
        got = next(block_counter(limits, ["key"])([batch])).to_pylist()
        for key, x, y in ((7, 700, 900), (8, 3, 2)):
            want = [int((np.outer(u[:x], w[:y]) * (d2[:x, :y] <= e)).sum()) for e in limits]
            mine = [sum(g["n"] for g in got if g["key"] == key and g["bucket"] <= k) for k in range(len(limits))]
            assert mine == want
    box = {f"{t}{c}": v for c in "xyz" for t, v in (("lo", 0.0), ("hi", 0.1))}
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), batch.column("pts1"), pa.array([box, {k: v + 99 for k, v in box.items()}])], ["key", "pts1", "box2"])
    out = next(near_points(0.25)([batch])).to_pylist()
    apart = (np.maximum(0, np.maximum(-a, a - 0.1)) ** 2).sum(1)
    assert [x["key"] for x in out] == [1] and len(out[0]["pts1"]) == (apart <= 0.25).sum()


def test_catalogs_are_not_dealt_by_their_names(spark):
    """the few rows about whole catalogs go to the points; a catalog is not sorted in one task."""
    pts = spark.createDataFrame([(0, "D0", 0.4), (0, "D0", None), (0, "R0", None)], "corr_id int, catalog string, redshift double")
    corrs = spark.createDataFrame([(0, "auto")], "corr_id int, type string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = PT.split_by_correlation(pts, corrs, [0.3, 0.5, 0.7])
        assert "BroadcastHashJoin Inner" in _plan(got)
        assert sorted((r.catalog, r.zbin) for r in got.collect()) == [("D0", 0), ("R0", 0), ("R0", 1)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

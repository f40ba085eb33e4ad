"""Cross match: what it keeps and deals, and its rows next to brute force."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skytally.functions.geometry import chord
from skytally.lineage import shared_folder
from skytally.operators import match as MT


def _kept(spark):
    top = shared_folder(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(top) for f in fs)


def _xyz(d):
    ph, th = np.radians(d.ra.to_numpy(float)), np.pi / 2 - np.radians(d.dec.to_numpy(float))
    return np.stack([np.cos(ph) * np.sin(th), np.sin(ph) * np.sin(th), np.cos(th)], 1)


def _moved(d, arcsec, r):
    m = d.copy()
    m["dec"] = m.dec + r.uniform(-1, 1, len(m)) * arcsec / 3600
    m["ra"] = m.ra + r.uniform(-1, 1, len(m)) * arcsec / 3600
    return m.sample(frac=1, random_state=4).reset_index(drop=True)


def _brute(a, b, arcsec):
    """The distance of the nearest right row of each left row, and the lowest number there; NaN and -1 without one."""
    x, y = _xyz(a), _xyz(b)
    dist, num = np.full(len(a), np.nan), np.full(len(a), -1)
    for i in range(len(a)):
        d2 = ((x[i] - y) ** 2).sum(1)
        near = np.flatnonzero(d2 < chord(arcsec / 3600) ** 2)
        if len(near):
            best = near[np.lexsort((b.id.to_numpy()[near], d2[near]))[0]]
            dist[i], num[i] = np.sqrt(d2[best]), b.id[best]
    return dist, num


def test_positions_are_dealt_once_and_not_kept(spark):
    """no copy of the positions goes to the shared folder, and one join deals them if no right column is asked for."""
    r = np.random.default_rng(1)
    n = 20_000
    a = pd.DataFrame({"id": np.arange(n), "ra": r.uniform(30, 31, n), "dec": r.uniform(-0.5, 0.5, n)})
    b = _moved(a, 0.2, r)
    left, right = spark.createDataFrame(a), spark.createDataFrame(b)
    before = _kept(spark)
    j = MT.cross_match(left, right, 2.0, distance="dist")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(j.select("dist")).count("Join ") == 1
    assert plan(j.select("dist", "ra_join")).count("Join ") == 2
    got = j.agg(F.count("dist"), F.count("id_join"), F.sum((F.col("id_join") != F.col("id")).cast("int")), F.max("dist")).first()
    assert _kept(spark) - before < 20 * n
    assert got[0] == got[1] == n and got[2] < n // 100 and got[3] < chord(0.4 / 3600)


@pytest.mark.parametrize("leaf,rows", [(32, 100_000), (2, 100_000), (2, 40)])
def test_match_at_cube_faces_and_in_crowds(spark, monkeypatch, leaf, rows):
    """cubes, crowded cubes and cubes with very many left rows give the rows of brute force."""
    monkeypatch.setattr(MT, "MATCH_LEAF", leaf)
    monkeypatch.setattr(MT, "CUBE_ROWS", rows)
    r = np.random.default_rng(2)
    # the axes are faces of cubes of every size
    ra = np.concatenate([r.uniform(0, 360, 400), r.normal(90, 0.003, 200), r.normal(0, 0.003, 200), r.normal(45, 0.002, 150), np.full(120, 200.0), r.uniform(0, 360, 60)])
    dec = np.concatenate([r.uniform(-89, 89, 400), r.normal(0, 0.003, 400), r.normal(45, 0.002, 150), np.full(120, -30.0), 90 - np.abs(r.normal(0, 0.004, 60))])
    a = pd.DataFrame({"id": np.arange(len(ra)), "ra": ra, "dec": dec})
    b = _moved(a, 8.0, r)
    b.loc[b.id % 5 == 0, "id"] = 7
    b["flag"] = True
    dist, num = _brute(a, b, 10.0)
    some = lambda d: spark.createDataFrame(pd.concat([d, d[-2:].assign(ra=[np.nan, 10.0], dec=[3.0, np.nan], id=[-2, -3])]))
    j = MT.cross_match(some(a), some(b), 10.0, distance="dist").toPandas().sort_values("id").reset_index(drop=True)
    assert j.id.tolist() == [-3, -2, *a.id] and j.id_join[:2].isna().all() and not j.flag_join[:2].any()
    j = j[2:]
    assert j.id_join.fillna(-1).astype(int).tolist() == num.tolist() and j.flag_join.tolist() == (num >= 0).tolist()
    assert np.allclose(j["dist"].to_numpy(float), dist, rtol=1e-9, atol=1e-15, equal_nan=True)
    # the matched row itself, where a number stands for several
    at = (num >= 0) & (num != 7)
    assert (j.ra_join.to_numpy(float)[at] == b.set_index("id").loc[num[at]].ra.to_numpy()).all() and 0 < at.sum() < len(a)
    few = MT.nearest(some(a), some(b), 10.0).toPandas()
    assert len(few) == len(np.unique(_xyz(a)[num >= 0], axis=0)) and few["dist"].max() < chord(10 / 3600)
    assert np.allclose(np.sqrt(((few[["x", "y", "z"]].to_numpy() - few[["_rx", "_ry", "_rz"]].to_numpy()) ** 2).sum(1)), few["dist"])


def test_a_match_without_a_number_is_none(spark):
    left = spark.createDataFrame([(1, 10.0, 0.0), (2, 20.0, 0.0), (3, 30.0, 0.0)], "id int, ra double, dec double")
    right = spark.createDataFrame([(None, 10.0, 0.0001, 5), (None, 20.0, 0.0001, 6), (9, 20.0, 0.0001, 7), (8, 20.0, 0.0002, 8)], "id int, ra double, dec double, v int")
    got = {r.id: (r.id_join, r.v_join, r.dist is None) for r in MT.cross_match(left, right, 2.0, distance="dist").collect()}
    assert got == {1: (None, None, True), 2: (9, 7, False), 3: (None, None, True)}


def test_crowded_cubes_are_those_of_a_plain_count(spark, monkeypatch):
    """counting blocks of cubes first misses no crowded cube, however many rows the blocks hold."""
    monkeypatch.setattr(MT, "MATCH_LEAF", 1)
    r = np.random.default_rng(3)
    ra, dec = np.concatenate([r.uniform(0, 360, 3000), r.normal(90, 0.5, 300)]), np.concatenate([r.uniform(-90, 90, 3000), r.normal(0, 0.5, 300)])
    near = MT._in_cubes(spark.createDataFrame(pd.DataFrame({"_ra": ra, "_dec": dec, "rid": 1})), MT.GRID_BITS - 6, 1e-4)
    want = {x._pix for x in near.groupBy("_pix").count().where("count > 4").collect()}
    assert 0 < len(want) < 400
    for rights in (0.0, 1e9):
        assert {x._pix for x in MT._crowded(near, rights, near, None).collect()} == want
    assert MT._crowded(near.limit(3), 3.0, near, None) is None

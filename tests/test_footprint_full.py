"""Footprint queries at nside 1024 with all exposures, against all pixel centres of the sky."""

import math
from collections import Counter

import numpy as np

SF = "/root/testdata/sf0.001"
NS, RADIUS = 1024, 0.75
NEED = {"g": 4, "r": 4, "i": 6, "z": 6, "y": 6}


def centres(n):
    """Unit vectors of all pixel centres, in ring order."""
    z, phi = [], []
    for ring in range(1, 4 * n):
        k = min(ring, n, 4 * n - ring)
        if k < n:
            height = 1 - k * k / (3 * n * n)
            height, shift = (height if ring < n else -height), 0.5
        else:
            height, shift = 4 / 3 - 2 * ring / (3 * n), 0.5 * ((ring - n + 1) % 2)
        z.append(np.full(4 * k, height))
        phi.append((np.arange(4 * k) + shift) * math.pi / (2 * k))
    z, phi = np.concatenate(z), np.concatenate(phi)
    r = np.sqrt((1 - z) * (1 + z))
    return r * np.cos(phi), r * np.sin(phi), z


def test_registered_footprints_take_every_pixel_and_exposure(spark):
    from queries import QUERIES
    from queries.sky_checks import _visits

    x, y, z = centres(NS)
    assert len(z) == 12 * NS ** 2
    most, cover, depth = (2 * math.sin(math.radians(RADIUS / 2))) ** 2, set(), Counter()
    for v in _visits(spark, SF).collect():
        a, d = math.radians(v.ra), math.radians(v.dec)
        p = math.cos(d) * math.cos(a), math.cos(d) * math.sin(a), math.sin(d)
        # z falls in ring order
        lo, hi = np.searchsorted(-z, [-(p[2] + 0.014), -(p[2] - 0.014)])
        s = slice(lo, hi)
        for pix in (lo + np.flatnonzero((x[s] - p[0]) ** 2 + (y[s] - p[1]) ** 2 + (z[s] - p[2]) ** 2 <= most)).tolist():
            cover.add((v.visit_id, pix))
            depth[pix, v["filter"][0]] += 1
    assert cover
    assert {tuple(r) for r in QUERIES["j7_disc_coverage"](spark, SF).select("visit_id", "pix").collect()} == cover
    assert {(r.pix, r.band): r.n for r in QUERIES["f9_band_depth"](spark, SF).collect()} == dict(depth)
    deep = {k for k, n in depth.items() if n >= NEED.get(k[1], math.inf)}
    bands = Counter(b for _, b in deep)
    full = {p for p, n in Counter(p for p, _ in deep).items() if n == len(NEED)}
    assert {r.band: r.pixels for r in QUERIES["f10_footprint_area"](spark, SF).collect()} == dict(bands) | {"all": len(full)}
    assert {r.pix for r in QUERIES["f9_full_depth_footprint"](spark, SF).collect()} == full
    print(len(cover), len(deep), len(full))

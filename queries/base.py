"""Registry and shared SQL text of the checks."""

from __future__ import annotations

import math
from collections.abc import Callable

from .fixtures import ctes, read

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

NSIDE = 32
ABINS = [0.0245, 0.0524, 0.1122, 0.24, 0.5]
ZBINS = [0.3, 0.5, 0.7, 0.9, 1.1]
PI = "pi()"


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` and its SQL."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def d(v: float) -> str:
    """A double literal."""
    return f"cast({v!r} as double)"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(p for p in parts if p)


def pix_steps(name: str, src: str, nside: int, z: str, phi: str, pix: str = "pix") -> str:
    """CTEs that add a ring pixel from z = cos(polar angle) and longitude in radians."""
    n = nside
    npix = 12 * n * n
    return f"""{name}_a AS (SELECT *, {z} AS zz_, ({phi}) / ({PI} / 2) - 4e0 * floor(({phi}) / ({PI} / 2) / 4e0) AS tt_ FROM {src}),
{name}_b AS (SELECT *, cast(floor({n}e0 * (0.5e0 + tt_) - 0.75e0 * {n} * zz_) AS bigint) AS jp_,
  cast(floor({n}e0 * (0.5e0 + tt_) + 0.75e0 * {n} * zz_) AS bigint) AS jm_,
  cast(floor((tt_ - floor(tt_)) * {n}e0 * sqrt(3e0 * (1e0 - abs(zz_)))) AS bigint)
   + cast(floor((1e0 - (tt_ - floor(tt_))) * {n}e0 * sqrt(3e0 * (1e0 - abs(zz_)))) AS bigint) + 1 AS cr_ FROM {name}_a),
{name} AS (SELECT * EXCLUDE (zz_, tt_, jp_, jm_, cr_),
  CASE WHEN abs(zz_) <= 2e0/3e0 THEN 2*{n}*({n}-1) + ({n}+jp_-jm_)*4*{n}
     + ((cast(floor((jp_+jm_-{n}+1-(({n}+1+jp_-jm_)%2)+1)/2e0) AS bigint) % (4*{n})) + 4*{n}) % (4*{n})
   WHEN zz_ > 0 THEN 2*cr_*(cr_-1) + cast(floor(tt_*cr_) AS bigint) % (4*cr_)
   ELSE {npix} - 2*cr_*(cr_+1) + cast(floor(tt_*cr_) AS bigint) % (4*cr_) END AS {pix} FROM {name}_b)"""


def pixed(name: str, src: str, nside: int = NSIDE, ra: str = "ra", dec: str = "dec", pix: str = "pix") -> str:
    """CTEs that add the pixel of a position in degrees."""
    return pix_steps(name, src, nside, f"cos({PI}/2 - radians({dec}))", f"radians({ra})", pix)


def xyzed(name: str, src: str, ra: str = "ra", dec: str = "dec") -> str:
    return f"""{name} AS (SELECT *, cos(radians({ra}))*sin({PI}/2-radians({dec})) AS x,
  sin(radians({ra}))*sin({PI}/2-radians({dec})) AS y, cos({PI}/2-radians({dec})) AS z FROM {src})"""


def sky(nside: int) -> str:
    """CTEs ``sky_pix`` (face place and ring pixel of each pixel) and ``corners`` (pix, k, cx, cy, cz)."""
    n = nside
    row = lambda u, v: f"(fr * {n} - ({u}) - ({v}))"
    def zp(u, v):
        jr = row(u, v)
        nr = f"least({jr}, {n}e0, {4 * n}e0 - {jr})"
        z = (f"CASE WHEN {jr} < {n} THEN 1e0 - {nr}*{nr}/(3e0*{n}*{n}) WHEN {jr} > {3 * n} THEN -1e0 + {nr}*{nr}/(3e0*{n}*{n}) "
             f"ELSE 2e0*(2*{n}-{jr})/(3e0*{n}) END")
        phi = f"CASE WHEN {nr} = 0 THEN 0e0 ELSE ({PI}/4)*(fl*{nr}+({u})-({v}))/{nr} END"
        return z, phi
    cz, cphi = zp("fx + 0.5e0", "fy + 0.5e0")
    kz, kphi = zp("fx + dx", "fy + dy")
    return f"""faces AS (SELECT [2,2,2,2,3,3,3,3,4,4,4,4][cast(id // {n * n} AS int) + 1] AS fr,
  [1,3,5,7,0,2,4,6,1,3,5,7][cast(id // {n * n} AS int) + 1] AS fl, cast(id % {n} AS double) AS fx,
  cast((id // {n}) % {n} AS double) AS fy FROM range({12 * n * n}) t(id)),
centres AS (SELECT fr, fl, fx, fy, {cz} AS z0, {cphi} AS phi0 FROM faces),
{pix_steps('sky_pix', 'centres', n, 'z0', f'phi0 + 2 * {PI}')},
corner_at AS (SELECT pix, k, {kz} AS kz, {kphi} AS kphi FROM sky_pix,
  (VALUES (0, 0e0, 0e0), (1, 1e0, 0e0), (2, 1e0, 1e0), (3, 0e0, 1e0)) s(k, dx, dy)),
corners AS (SELECT pix, k, cast(round(sqrt((1e0-kz)*(1e0+kz))*cos(kphi)*1e7) AS bigint) AS cx,
  cast(round(sqrt((1e0-kz)*(1e0+kz))*sin(kphi)*1e7) AS bigint) AS cy, cast(round(kz*1e7) AS bigint) AS cz FROM corner_at)"""


def near_sky(nside: int) -> str:
    return f"""{sky(nside)},
near AS (SELECT DISTINCT a.pix, b.pix AS near FROM corners a JOIN corners b USING (cx, cy, cz) WHERE a.pix <> b.pix)"""


def pairs_sky(nside: int) -> str:
    """CTEs up to ``pixpairs`` (pix1, pix2, ring)."""
    two = ("UNION ALL SELECT a.pix, b.near, 2 FROM near a JOIN near b ON a.near = b.pix WHERE a.pix < b.near"
           if nside > 16 else "")
    return f"""{near_sky(nside)},
pixpairs AS (SELECT pix1, pix2, min(ring) AS ring FROM (SELECT pix AS pix1, pix AS pix2, 0 AS ring FROM sky_pix
  UNION ALL SELECT pix, near, 1 FROM near WHERE pix < near {two}) GROUP BY ALL)"""


def chord_sq_at(theta: float) -> str:
    return d((2.0 * math.sin(math.radians(theta) / 2.0)) ** 2)


def bucket(d2: str = "d2", edges=ABINS) -> str:
    return "(" + " + ".join(f"cast({d2} > {chord_sq_at(e)} AS int)" for e in edges) + ")"


def counted(name: str, a: str, b: str, pairs: str = "pixpairs", keys=(), edges=ABINS) -> str:
    """CTEs up to ``name`` (keys, pix1, pix2, edge_idx, n): brute force over pixel pairs.

    ``a`` and ``b`` are located relations with x, y, z, pix and the key columns.
    """
    k = "".join(f"a.{c}, " for c in keys)
    on = "".join(f" AND a.{c} = b.{c}" for c in keys)
    d2 = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)"
    kk = "".join(f"{c}, " for c in keys)
    sums = ", ".join(f"cast(sum(CASE WHEN bk <= {i} THEN c ELSE 0 END) AS bigint)" for i in range(len(edges)))
    # rows of one pixel lie within a few degrees: a bound on dec drops most candidates
    return f"""{name}_r AS (SELECT {k}p.pix1, p.pix2, {d2} AS d2 FROM {pairs} p JOIN {a} a ON a.pix = p.pix1
  JOIN {b} b ON b.pix = p.pix2{on} WHERE {d2} <= {chord_sq_at(edges[-1])}),
{name}_b AS (SELECT {kk}pix1, pix2, {bucket('d2', edges)} AS bk, count(*) AS c FROM {name}_r GROUP BY ALL),
{name}_w AS (SELECT {kk}pix1, pix2, [{sums}] AS ns FROM {name}_b GROUP BY ALL),
{name} AS (SELECT {kk}pix1, pix2, unnest(range({len(edges)})) AS edge_idx, unnest(ns) AS n FROM {name}_w)"""


__all__ = ["QUERIES", "ORACLES", "NSIDE", "ABINS", "ZBINS", "PI", "query", "d", "with_", "pix_steps", "pixed", "xyzed",
           "sky", "near_sky", "pairs_sky", "chord_sq_at", "bucket", "counted", "ctes", "read"]

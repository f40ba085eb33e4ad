"""Angles and positions on the unit sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rotation from equatorial (ICRS) to galactic axes, row by row
# (the standard matrix of the Hipparcos catalogue, volume 1, section 1.5.3).
GALACTIC_ROTATION = (
    (-0.0548755604162154, -0.8734370902348850, -0.4838350155487132),
    (0.4941094278755837, -0.4448296299600112, 0.7469822444972189),
    (-0.8676661490190047, -0.1980763734312015, 0.4559837761750669),
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unit_vector(ra: Column | str, dec: Column | str) -> tuple[Column, Column, Column]:
    """Cartesian x, y, z of a position given in degrees.

    The polar angle is measured from the pole, so z is ``cos(pi/2 - dec)``:
    positions exactly on the equator keep the small positive z that the pixel
    formula relies on.
    """
    phi = F.radians(col(ra))
    theta = F.lit(math.pi / 2) - F.radians(col(dec))
    return (
        F.cos(phi) * F.sin(theta),
        F.sin(phi) * F.sin(theta),
        F.cos(theta),
    )


def with_unit_vector(df, ra: str = "ra", dec: str = "dec", names=("x", "y", "z")):
    return df.withColumns(dict(zip(names, unit_vector(ra, dec))))


def chord(theta_deg: float) -> float:
    """Straight-line distance that an angle in degrees spans on the unit sphere."""
    return 2.0 * math.sin(math.radians(theta_deg) / 2.0)


def chord_col(theta_deg: Column | str) -> Column:
    return F.lit(2.0) * F.sin(F.radians(col(theta_deg)) / F.lit(2.0))


def chord_sq(a: tuple, b: tuple) -> Column:
    """Squared distance of two cartesian points, each a triple of columns."""
    dx, dy, dz = (p - q for p, q in zip(a, b))
    return dx * dx + dy * dy + dz * dz


def to_galactic(ra: Column | str, dec: Column | str) -> tuple[Column, Column]:
    """Galactic longitude (0 to 360) and latitude in degrees."""
    v = unit_vector(ra, dec)
    gx, gy, gz = (
        sum((F.lit(m) * c for m, c in zip(row[1:], v[1:])), F.lit(row[0]) * v[0])
        for row in GALACTIC_ROTATION
    )
    lon = F.pmod(F.degrees(F.atan2(gy, gx)), F.lit(360.0))
    lat = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), gz))))
    return lon, lat


def deg_to_rad(theta: Column | str) -> Column:
    return F.radians(col(theta))


def arcmin(theta_deg: Column | str) -> Column:
    """Degrees as minutes of arc, two decimals."""
    return F.round(col(theta_deg) * F.lit(60.0), 2)

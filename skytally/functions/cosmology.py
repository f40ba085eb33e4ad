"""Distances and special functions of the theory curves."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import col

LIGHT_KM_S = 299792.458


@dataclass(frozen=True)
class Cosmology:
    """Flat universe of matter and a constant (no radiation or neutrino terms)."""

    h0: float = 70.0
    om: float = 0.3

    @property
    def ol(self) -> float:
        return 1.0 - self.om


def hubble_over_c(z: Column | str, cosmo: Cosmology = Cosmology()) -> Column:
    """H(z)/c in 1/Mpc."""
    u = F.lit(1.0) + col(z)
    return F.lit(cosmo.h0 / LIGHT_KM_S) * F.sqrt(F.lit(cosmo.om) * u * u * u + F.lit(cosmo.ol))


# nodes of the quadrature; the integrand is smooth from here to any redshift, so 20 give nine digits and more
_NODES, _WEIGHTS = (v.tolist() for v in np.polynomial.legendre.leggauss(20))


def comoving_distance(z: Column | str, cosmo: Cosmology = Cosmology()) -> Column:
    """Line-of-sight distance in Mpc: the integral of c/H from 0 to z, by Gauss-Legendre quadrature.

    With s = 1/sqrt(1 + z) the integral is that of 2/sqrt(om + ol s^6) from s to 1, over a
    bounded range whatever the redshift. A redshift that is missing, negative or not finite
    has no distance.
    """
    z = col(z)
    s = F.lit(1.0) / F.sqrt(F.lit(1.0) + z)
    # 1 - s without cancellation at small redshifts
    half = z / (F.lit(1.0) + z) / (F.lit(1.0) + s) / F.lit(2.0)
    total = F.lit(0.0)
    for x, w in zip(_NODES, _WEIGHTS):
        u = s + half * F.lit(1.0 + x)
        total = total + F.lit(2.0 * w) / F.sqrt(F.lit(cosmo.om) + F.lit(cosmo.ol) * F.pow(u, F.lit(6.0)))
    sound = ~F.isnan(z) & (z >= 0) & (z < F.lit(float("inf")))
    return F.when(sound, F.lit(LIGHT_KM_S / cosmo.h0) * half * total)


def with_distance(df: DataFrame, z: str = "z", z_max: float | None = None, cosmo: Cosmology = Cosmology(), name: str = "d_c") -> DataFrame:
    """Attach the comoving distance of each row's redshift, worked out in the row itself.

    A redshift beyond a given ``z_max`` has no distance.
    """
    d = comoving_distance(z, cosmo)
    return df.withColumn(name, d if z_max is None else F.when(col(z) <= F.lit(z_max), d))


def comoving_scale(theta_deg: Column | str, d_c: Column | str) -> Column:
    """Length that an angle spans at a comoving distance."""
    return col(d_c) * F.tan(F.radians(col(theta_deg)))


def _poly(x: Column, coeffs) -> Column:
    out = F.lit(coeffs[-1])
    for c in reversed(coeffs[:-1]):
        out = out * x + F.lit(c)
    return out


# Abramowitz & Stegun 9.4.1 and 9.4.3, lowest power first.
J0_NEAR = (1.0, -2.2499997, 1.2656208, -0.3163866, 0.0444479, -0.0039444, 0.0002100)
J0_AMPLITUDE = (0.79788456, -0.00000077, -0.00552740, -0.00009512, 0.00137237, -0.00072805, 0.00014476)
J0_PHASE = (-0.78539816, -0.04166397, -0.00003954, 0.00262573, -0.00054125, -0.00029333, 0.00013558)


def bessel_j0(x: Column | str) -> Column:
    """Bessel function of order zero, to about 1e-7 (published polynomials)."""
    ax = F.abs(col(x))
    near = _poly((ax / F.lit(3.0)) * (ax / F.lit(3.0)), J0_NEAR)
    u = F.lit(3.0) / F.greatest(ax, F.lit(3.0))
    far = _poly(u, J0_AMPLITUDE) * F.cos(ax + _poly(u, J0_PHASE)) / F.sqrt(F.greatest(ax, F.lit(3.0)))
    return F.when(ax <= F.lit(3.0), near).otherwise(far)

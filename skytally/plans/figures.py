"""The tables behind the survey's figures (drawing is left to the reader)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import best_redshift, color, known, zbin_index
from ..operators.curves import gauss_sum, stack_pdz
from ..operators.histograms import contour_levels, hist1d, hist2d
from ..operators.masks import agn_quality_cut, passes_bin_cut

# Luminosity limits and their redshift sub-bins.
LUM_CUTS = (43.70, 44.15, 44.35, 44.45, 44.55)
LUM_Z_EDGES = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8)


def with_best_redshift(agn: DataFrame) -> DataFrame:
    z, sigma = best_redshift("redshift", "specz", "z_up", "z_lo")
    return agn.withColumns({"z": z, "z_sigma": sigma, "specz": known("specz")})


def color_redshift(df: DataFrame, a: str, b: str, z: str, color_range, z_range, bins=(150, 800), keys=()) -> DataFrame:
    """Counts over redshift and one colour."""
    return hist2d(df.withColumn("_c", color(a, b)), z, "_c", z_range, color_range, bins, keys)


def color_color(df: DataFrame, first, second, x_range, y_range, bins, z: str | None = None, z_edges=None) -> DataFrame:
    """Counts over two colours, per redshift bin when edges are given."""
    d = df.withColumns({"_x": color(*first), "_y": color(*second)})
    keys = []
    if z_edges is not None:
        d, keys = d.withColumn("zbin", zbin_index(z, z_edges)).where("zbin is not null"), ["zbin"]
    return hist2d(d, "_x", "_y", x_range, y_range, bins, keys)


def agn_sample(agn: DataFrame, zmin: float, zmax: float, kind: int = 0, lumcut: bool = True, matched: bool = False,
               confidence: float | None = 0.5) -> DataFrame:
    """Quasars with their best redshift that pass the cuts of their kind."""
    d = with_best_redshift(agn)
    d = d.where(agn_quality_cut(zmin, zmax, kind, matched, confidence))
    return d.where(passes_bin_cut("lum", "z", LUM_Z_EDGES, LUM_CUTS)) if lumcut else d


def agn_pseudo_pdz(agn: DataFrame, zmin: float, zmax: float, kind: int = 0, matched: bool = True, num: int = 500) -> DataFrame:
    """Sum of normal densities of the best redshifts."""
    return gauss_sum(agn_sample(agn, zmin, zmax, kind, False, matched, None), "z", "z_sigma", num=num)


def agn_stacked_pdz(agn: DataFrame, zmin: float, zmax: float, kind: int = 0, pdz: str = "pdz", step: float = 0.025) -> DataFrame:
    """Sum of normalised curves; rows with a spectrum add a narrow density."""
    return stack_pdz(agn_sample(agn, zmin, zmax, kind), pdz, step, specz="specz")


def spec_only_pdz(df: DataFrame, z: str, zmin: float, zmax: float, sigma: float = 0.01, num: int = 500) -> DataFrame:
    """Sum of narrow densities of spectroscopic redshifts."""
    d = df.where(F.col(z).isNotNull() & (F.col(z) > zmin) & (F.col(z) < zmax)).withColumn("_s", F.lit(sigma))
    return gauss_sum(d, z, "_s", num=num)


def luminosity_histogram(agn: DataFrame, z_edges, lo: float = 42.0, hi: float = 47.0, bins: int = 50) -> DataFrame:
    """``kind, zbin, bin_idx, ...``: counts per quasar kind (1, 2) and redshift bin."""
    d = with_best_redshift(agn).withColumn("zbin", zbin_index("z", z_edges)).where("zbin is not null")
    kinds = F.array_compact(F.array(
        F.when(known("p_t1") > 0.5, F.lit(1)), F.when(known("p_t2") > 0.5, F.lit(2))))
    d = d.withColumn("kind", F.explode(kinds))
    return hist1d(d, "lum", lo, hi, bins, ["kind", "zbin"])


def error_contours(df: DataFrame, x: str, err: str, x_range, err_range, bins=(20, 20), keys=()) -> DataFrame:
    """Counts of redshift error against redshift or magnitude, with contour levels."""
    return contour_levels(hist2d(df, x, err, x_range, err_range, bins, keys), keys=keys)

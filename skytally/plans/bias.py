"""From measured signals and redshift distributions to biases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cosmology import Cosmology
from ..lineage import cut
from ..operators.curves import interp, normalize_curve
from ..operators.estimators import fit_range
from ..operators.model import best_bias, bias_likelihood, deproject_bias, limber_model


@dataclass
class BiasFit:
    model: DataFrame       # corr_id, zbin, t, theta, w
    likelihood: DataFrame  # corr_id, zbin, i, b, likelihood, chi2
    best: DataFrame        # corr_id, zbin, best, chi2, bias


def model_at(points: DataFrame, model: DataFrame, x: str = "theta") -> DataFrame:
    """Signal points with the model interpolated to their angle, for points keyed by (corr_id, zbin)."""
    key = F.concat_ws("/", F.col("corr_id").cast("string"), F.col("zbin").cast("string"))
    curve = model.select(key.alias("curve_id"), F.col("theta").alias("x"), F.col("w").alias("y"))
    return interp(points.withColumn("curve_id", key), x, curve, name="model").drop("curve_id")


def corr_bias(signals: DataFrame, corrs: DataFrame, samples: DataFrame, pdz: DataFrame, k_table: DataFrame,
              n_to_cut: int = 3, cosmo: Cosmology = Cosmology()) -> BiasFit:
    """Model, likelihood and best bias of every correlation and redshift bin at once.

    ``signals`` has ``corr_id, zbin, bin_idx, theta, w, err``; ``samples`` has ``corr_id,
    zbin, curve1, curve2``; ``pdz`` has ``curve_id, x, y``; ``corrs`` has ``corr_id, type, auto_id``.
    """
    keys = ["corr_id", "zbin"]
    curves = normalize_curve(pdz, ["curve_id"])
    model = limber_model(curves, curves, k_table, samples, cosmo)
    # a few rows per correlation, read several times below
    points = cut(model_at(fit_range(signals, n_to_cut), model))
    likelihood = bias_likelihood(points, keys)
    best = best_bias(likelihood, keys)
    return BiasFit(model, likelihood, deproject_bias(best, best, corrs))

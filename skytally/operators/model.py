"""Theory curves as table jobs, and the fit of a bias to a measured signal."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cosmology import Cosmology, bessel_j0, hubble_over_c, with_distance
from ..functions.scalars import grid_points
from .curves import interp, sorted_place



def trapezoid_weights(df: DataFrame, x: str, keys, name: str = "weight") -> DataFrame:
    """Each grid point's share of a trapezoid integral over ``x``."""
    w = W.partitionBy(*keys).orderBy(x)
    left = F.coalesce(F.col(x) - F.lag(x).over(w), F.lit(0.0))
    right = F.coalesce(F.lead(x).over(w) - F.col(x), F.lit(0.0))
    return df.withColumn(name, (left + right) / F.lit(2.0))


def k_integral_table(power: DataFrame, thetas_deg, cosmo: Cosmology = Cosmology(), z_max: float | None = None) -> DataFrame:
    """``z, t, theta, value``: integral over k of k P(z,k)/(2 pi^2) J0(k theta D(z)).

    ``power`` has ``z, k, p``. Weights of the integral are set before the angles are
    unrolled, so the sum is one aggregation with map-side combining.
    """
    p = trapezoid_weights(power.select("z", "k", "p"), "k", ["z"])
    p = with_distance(p, "z", z_max, cosmo=cosmo)
    p = p.select("z", "k", "d_c", (F.col("weight") * F.col("k") * F.col("p") / F.lit(2 * math.pi ** 2)).alias("c"))
    p = p.select("z", "k", "d_c", "c", F.explode(grid_points(thetas_deg)).alias("g"))
    arg = F.col("k") * F.radians("g.x") * F.col("d_c")
    return p.groupBy("z", F.col("g.i").alias("t"), F.col("g.x").alias("theta")).agg(
        F.sum(F.col("c") * bessel_j0(arg)).alias("value"))


def matter_power(df: DataFrame, power: DataFrame, z: str = "z", k: str = "k", name: str = "p") -> DataFrame:
    """Power at (z, k): linear in k on the two nearest redshift rows, then linear in z.

    ``df`` needs a column ``id``. Values beyond the table take its edge.
    """
    # the table's redshifts, one sorted array that every row searches by itself
    rows = power.agg(F.array_sort(F.collect_set("z")).alias("zs")).scalar()
    last = F.size("_zs") - 1
    d = df.withColumn("_zs", rows)
    q = F.least(F.greatest(F.col(z), F.element_at("_zs", 1)), F.element_at("_zs", -1))
    d = d.withColumn("_q", q).withColumn("_at", sorted_place("_zs", F.col("_q")))
    d = d.withColumns({"_z0": F.element_at("_zs", F.col("_at") + 1), "_z1": F.element_at("_zs", F.least(F.col("_at") + 1, last) + 1)}).drop("_zs", "_at")
    part = F.coalesce(F.try_divide(F.col("_q") - F.col("_z0"), F.col("_z1") - F.col("_z0")), F.lit(0.0))
    d = d.withColumn("_part", part).drop("_q")
    curves = power.select(F.col("z").alias("curve_z"), F.col("k").alias("x"), F.col("p").alias("y"))
    d = interp(d.withColumn("curve_z", F.col("_z0")), k, curves, key="curve_z", name="_plo").drop("curve_z")
    d = interp(d.withColumn("curve_z", F.col("_z1")), k, curves, key="curve_z", name="_phi").drop("curve_z")
    value = F.col("_plo") + F.col("_part") * (F.col("_phi") - F.col("_plo"))
    return d.select(*df.columns, value.alias(name))


def limber_model(pdz1: DataFrame, pdz2: DataFrame, k_table: DataFrame, keys, cosmo: Cosmology = Cosmology()) -> DataFrame:
    """``*keys, t, theta, w``: pi * integral over z of p1 p2 (H/c) K(z, theta).

    ``pdz1`` and ``pdz2`` have ``curve_id, x, y`` with one ``curve_id`` per key set;
    ``keys`` maps output rows to curves: a table ``*keys, curve1, curve2``.
    """
    names = [c for c in keys.columns if c not in ("curve1", "curve2")]
    # rows are key sets x redshifts of the table; the grid comes as the value of a subquery
    zs = trapezoid_weights(k_table.select("z").distinct().withColumn("grid", F.lit(0)), "z", ["grid"])
    zs = zs.groupBy("grid").agg(F.array_sort(F.collect_list(F.struct("z", "weight"))).alias("zs"))
    g = keys.select(*keys.columns, F.explode(zs.select("zs").scalar()).alias("g")).select(*keys.columns, "g.z", "g.weight")
    g = interp(g.withColumn("curve_id", F.col("curve1")), "z", pdz1, name="p1").drop("curve_id")
    g = interp(g.withColumn("curve_id", F.col("curve2")), "z", pdz2, name="p2").drop("curve_id")
    g = g.withColumn("c", F.lit(math.pi) * F.col("weight") * F.col("p1") * F.col("p2") * hubble_over_c("z", cosmo))
    return g.join(k_table, "z").groupBy(*names, "t", "theta").agg(F.sum(F.col("c") * F.col("value")).alias("w"))


def bias_likelihood(points: DataFrame, keys, lo: float = 0.0, hi: float = 8.0, num: int = 400) -> DataFrame:
    """``*keys, i, b, likelihood, chi2``: probability of each bias b, area 1 per key.

    ``points`` has ``*keys, w, err, model``. Works on sums of logarithms, so many or
    distant points do not underflow.
    """
    keys = list(keys)
    step = (hi - lo) / (num - 1)
    # chi2(b) needs three sums per key only, whatever the number of points
    inv = F.lit(1.0) / (F.col("err") * F.col("err"))
    s = points.groupBy(*keys).agg(
        F.sum(F.col("w") * F.col("w") * inv).alias("ww"), F.sum(F.col("w") * F.col("model") * inv).alias("wm"),
        F.sum(F.col("model") * F.col("model") * inv).alias("mm"))
    g = s.select("*", F.explode(F.sequence(F.lit(0), F.lit(num - 1))).alias("i"))
    g = g.withColumn("b", F.lit(lo) + F.col("i") * F.lit(step))
    b2 = F.col("b") * F.col("b")
    g = g.withColumn("chi2", F.col("ww") - F.lit(2.0) * b2 * F.col("wm") + b2 * b2 * F.col("mm"))
    # the grid of a key stands together; its rows are a setting
    own = W.partitionBy(*keys)
    g = g.withColumn("l", F.exp((F.min("chi2").over(own) - F.col("chi2")) / F.lit(2.0)))
    edge = F.when(F.col("i").isin(0, num - 1), F.lit(0.5)).otherwise(F.lit(1.0))
    g = g.withColumn("area", F.sum(F.col("l") * edge).over(own) * F.lit(step))
    return g.select(*keys, "i", "b", (F.col("l") / F.col("area")).alias("likelihood"), "chi2")


def best_bias(likelihood: DataFrame, keys) -> DataFrame:
    """``*keys, best, chi2``: the most likely bias, the first on a tie."""
    return likelihood.groupBy(*keys).agg(
        F.max_by(F.struct("b", "chi2"), F.struct("likelihood", (-F.col("i")).alias("i"))).alias("m")
    ).select(*keys, F.col("m.b").alias("best"), "m.chi2")


def chi_square(points: DataFrame, keys) -> DataFrame:
    """``*keys, chi2`` of ``w, err, model`` rows."""
    pull = (F.col("w") - F.col("model")) / F.col("err")
    return points.groupBy(*keys).agg(F.sum(pull * pull).alias("chi2"))


def chi_square_matrix(chi: DataFrame, row: str, column: str, columns) -> DataFrame:
    return chi.groupBy(row).pivot(column, list(columns)).agg(F.first("chi2"))


def deproject_bias(rows: DataFrame, best: DataFrame, corrs: DataFrame, value: str = "best") -> DataFrame:
    """Adds ``bias``: the fit itself for autocorrelations, fit^2 / bias of the auto for cross.

    ``rows`` is the table of best fits or a whole likelihood curve (``value='b'``);
    ``best`` has ``corr_id, zbin, best``; ``corrs`` has ``corr_id, type, auto_id``, the
    autocorrelation of the known sample.
    """
    b = rows.join(corrs.select("corr_id", "type", "auto_id"), "corr_id")
    auto = best.select(F.col("corr_id").alias("auto_id"), "zbin", F.col("best").alias("_auto"))
    b = b.join(auto, ["auto_id", "zbin"], "left")
    x = F.col(value)
    return b.withColumn("bias", F.when(F.col("type") == "auto", x).otherwise(
        F.try_divide(x * x, F.col("_auto")))).drop("_auto", "type", "auto_id")


def attach_curves(signal: DataFrame, samples: DataFrame, curves: DataFrame) -> DataFrame:
    """Signal rows with the curve numbers of both samples of their correlation.

    ``samples`` has ``corr_id, sample1, sample2`` (equal for an autocorrelation),
    ``curves`` has ``sample, zbin, curve_id``.
    """
    s = signal.join(samples, "corr_id")
    for i in (1, 2):
        s = s.join(curves.select(F.col("sample").alias(f"sample{i}"), "zbin", F.col("curve_id").alias(f"curve{i}")),
                   [f"sample{i}", "zbin"])
    return s

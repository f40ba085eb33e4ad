"""Photometry, redshift and range expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .geometry import col


def known(c: Column | str) -> Column:
    """NaN as NULL, so that comparisons treat missing values as not true."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def clean_floats(df: DataFrame) -> DataFrame:
    """NaN as NULL in every float and double column."""
    floats = [n for n, t in df.dtypes if t in ("float", "double")]
    return df.withColumns({n: known(n) for n in floats}) if floats else df


def sym_error(up: Column | str, lo: Column | str, peak: Column | str | None = None) -> Column:
    """Mean of two one-sided errors; with ``peak``, of the distances to two quantiles."""
    up, lo = col(up), col(lo)
    if peak is not None:
        up, lo = F.abs(up - col(peak)), F.abs(col(peak) - lo)
    return (up + lo) / F.lit(2.0)


def best_redshift(photo, spec, up, lo, spec_sigma: float = 0.01) -> tuple[Column, Column]:
    """Redshift and its sigma: the spectroscopic value wins where there is one."""
    spec = known(spec)
    z = F.coalesce(spec, col(photo))
    sigma = F.when(spec.isNotNull(), F.lit(spec_sigma)).otherwise(sym_error(up, lo, photo))
    return z, sigma


def color(a: Column | str, b: Column | str) -> Column:
    return col(a) - col(b)


def gauss(x, mu, sigma) -> Column:
    """Normal density."""
    x, mu, sigma = (v if isinstance(v, Column) else F.lit(v) if not isinstance(v, str) else F.col(v)
                    for v in (x, mu, sigma))
    u = x - mu
    return F.exp(-(u * u) / (F.lit(2.0) * sigma * sigma)) / (sigma * F.lit(math.sqrt(2 * math.pi)))


def zbin_index(z: Column | str, edges) -> Column:
    """Number i of the bin with edges[i] <= z < edges[i+1]; NULL outside all bins."""
    z = known(z)
    out = F.when(z < F.lit(float(edges[0])), F.lit(None).cast("int"))
    for i, hi in enumerate(edges[1:]):
        out = out.when(z < F.lit(float(hi)), F.lit(i))
    return out


def in_range(x: Column | str, lo, hi, closed: str = "left") -> Column:
    """Bounded test; ``closed`` is 'left' [lo,hi), 'both' [lo,hi] or 'neither' (lo,hi)."""
    x = known(x)
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    tests = {
        "left": lambda: (x >= lo) & (x < hi),
        "both": lambda: (x >= lo) & (x <= hi),
        "neither": lambda: (x > lo) & (x < hi),
    }
    return F.coalesce(tests[closed](), F.lit(False))


def all_of(*masks: Column) -> Column:
    return reduce(lambda a, b: a & b, masks, F.lit(True))


def any_of(*masks: Column) -> Column:
    return reduce(lambda a, b: a | b, masks, F.lit(False))


def edges_linear(lo: float, hi: float, num: int) -> list[float]:
    step = (hi - lo) / (num - 1)
    return [lo + i * step for i in range(num - 1)] + [hi]


def edges_log(lo: float, hi: float, num: int) -> list[float]:
    logs = edges_linear(math.log10(lo), math.log10(hi), num)
    return [10.0 ** v for v in logs]


def midpoints(edges) -> list[float]:
    return [(a + b) / 2.0 for a, b in zip(edges, edges[1:])]


def edge_table(spark: SparkSession, edges) -> DataFrame:
    """``bin_idx, lo, hi, mid`` of a grid given by its edges."""
    rows = [(i, float(a), float(b), (a + b) / 2.0) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    return spark.createDataFrame(rows, "bin_idx int, lo double, hi double, mid double")


def grid_points(values) -> Column:
    """Array of ``(i, x)`` to explode: a fixed grid attached to each row."""
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(v)).alias("x")) for i, v in enumerate(values)])


def linear_grid(lo: float, hi: float, num: int) -> Column:
    """The same for an even grid of any length, without one literal per point."""
    step = (hi - lo) / (num - 1)
    return F.transform(
        F.sequence(F.lit(0), F.lit(num - 1)),
        lambda i: F.struct(i.alias("i"), (F.lit(float(lo)) + i * F.lit(step)).alias("x")),
    )


def dither(x: Column | str, interval: float = 0.01, seed: int | None = None) -> Column:
    """Add even noise of total width ``interval`` for display."""
    noise = F.rand(seed) if seed is not None else F.rand()
    return col(x) + F.lit(interval) * (F.lit(0.5) - noise)


def clip_lower_error(w: Column | str, err: Column | str) -> tuple[Column, Column]:
    """Lower and upper error bar; the lower one stays just short of zero signal."""
    w, err = col(w), col(err)
    lower = F.when(err > w, w * F.lit(1.0 - 0.0001)).otherwise(err)
    return lower, err


def power_law(x: Column | str, a, k) -> Column:
    return a * F.pow(col(x), k)


def band_letter(name: Column | str) -> Column:
    return F.substring(col(name), 1, 1)

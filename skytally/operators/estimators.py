"""Correlation estimators, resampling and power-law fits."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..lineage import cut


def expand_terms(corrs: DataFrame) -> DataFrame:
    """``corr_id, term, first, second, role`` of each correlation by its type.

    Roles name the place of a term in the estimator: dd, dr, rd, rr.
    """
    def rows(*items):
        return F.array(*[
            F.struct(F.lit(t).alias("term"), F.lit(a).alias("first"), F.lit(b).alias("second"), F.lit(r).alias("role"))
            for t, a, b, r in items
        ])
    auto = rows(("D0D0", "D0", "D0", "dd"), ("D0R0", "D0", "R0", "dr"), ("R0R0", "R0", "R0", "rr"))
    cross = rows(("D1D2", "D1", "D2", "dd"), ("D1R2", "D1", "R2", "dr"),
                 ("D2R1", "D2", "R1", "rd"), ("R1R2", "R1", "R2", "rr"))
    kind = F.col("type")
    terms = F.when(kind == "auto", auto).when(kind == "cross", cross).otherwise(
        F.raise_error(F.concat(F.lit("unknown correlation type "), kind)))
    return corrs.select("corr_id", F.explode(terms).alias("t")).select("corr_id", "t.*")


def landy_szalay_auto(dd, dr, rr):
    return F.try_divide(dd - F.lit(2.0) * dr + rr, rr)


def landy_szalay_cross(dd, dr, rd, rr):
    return F.try_divide(dd - dr - rd + rr, rr)


def estimate(signals: DataFrame, terms: DataFrame, keys) -> DataFrame:
    """``*keys, bin_idx, w, rr`` from normalised term signals.

    ``signals`` has ``*keys, term, bin_idx, signal``; keys include ``corr_id``.
    Autocorrelations have one mixed term that counts twice, cross-correlations two. A
    term without a row has no pairs and counts as 0; without random pairs w is NULL.
    """
    kinds = terms.groupBy("corr_id").agg(F.bool_or(F.col("role") == "rd").alias("crossed"))
    s = signals.join(terms.select("corr_id", "term", "role"), ["corr_id", "term"]).join(kinds, "corr_id")
    pick = lambda r: F.max(F.when(F.col("role") == r, F.col("signal")))
    none = lambda r: F.coalesce(pick(r), F.lit(0.0)).alias(r)
    g = s.groupBy(*keys, "bin_idx").agg(none("dd"), none("dr"), none("rd"), pick("rr").alias("rr"), F.bool_or("crossed").alias("crossed"))
    rd = F.when(F.col("crossed"), F.col("rd")).otherwise(F.col("dr"))
    return g.select(*keys, "bin_idx", landy_szalay_cross(F.col("dd"), F.col("dr"), rd, F.col("rr")).alias("w"), "rr")


def jackknife_regions(shares: DataFrame, num: int = 16, keys=()) -> DataFrame:
    """``*keys, pix, region, region_share``: pixels dealt into ``num`` nearly equal parts.

    The largest pixels seed the regions, then the smallest remaining pixel goes to
    the lightest region (the first of equals). ``shares`` has one row per occupied
    pixel, a number that nside bounds, whatever the size of the catalogs; to deal larger
    parts of the sky count at a lower nside. Too few pixels are an error.
    """
    keys = list(keys)
    kinds = dict(shares.dtypes)

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < num:
            raise ValueError(f"asked for {num} regions but only {len(pdf)} pixels have data")
        pdf = pdf.sort_values(["share", "pix"]).reset_index(drop=True)
        share = pdf["share"].to_numpy()
        region = [0] * len(pdf)
        weight = []
        for i in range(num):
            at = len(pdf) - 1 - i
            region[at] = i
            weight.append((float(share[at]), i))
        heapq.heapify(weight)
        for at in range(len(pdf) - num):
            w, i = weight[0]
            heapq.heapreplace(weight, (w + float(share[at]), i))
            region[at] = i
        total = sum(w for w, _ in weight)
        part = {i: w / total for w, i in weight}
        pdf["region"] = region
        pdf["region_share"] = [part[r] for r in region]
        return pdf[[*keys, "pix", "region", "region_share"]]

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "pix long, region int, region_share double"])
    named = shares.select(*keys, "pix", "share").withColumn("_all", F.lit(0))
    return named.groupBy(*(keys or ["_all"])).applyInPandas(deal, schema)


def _without_each(sums: DataFrame, keys, num: int, name: str) -> DataFrame:
    """Per key, the total (region -1) less each region's part.

    The parts of a key are at most ``num`` + 1 numbers, held in one small map.
    """
    parts = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("region", "n"))).alias("part"))
    parts = parts.select(*keys, "part", F.explode(F.sequence(F.lit(-1), F.lit(num - 1))).alias("region"))
    own = F.when(F.col("region") >= 0, F.coalesce(F.try_element_at("part", F.col("region")), F.lit(0))).otherwise(F.lit(0))
    return parts.select(*keys, "region", (F.try_element_at("part", F.lit(-1)) - own).alias(name))


def leave_one_out(counts: DataFrame, populations: DataFrame, terms: DataFrame, regions: DataFrame,
                  num: int, keys, edges: int) -> DataFrame:
    """Signals with each region left out: ``*keys, term, region, bin_idx, signal``; region -1 keeps all.

    Every term with objects on both sides has a row for each of the ``edges`` - 1 angles, also where no pair is left.

    ``counts`` has ``*keys, term, pix1, pix2, edge_idx, n``, ``populations`` has ``*keys,
    catalog, pix, n``, ``regions`` has ``*keys, pix, region``. One pass over the counts:
    the pairs that touch a region are taken off the total.
    """
    keys = list(keys)
    r = regions.select(*keys, "pix", "region")
    c = counts.join(r.withColumnsRenamed({"pix": "pix1", "region": "ra"}), [*keys, "pix1"], "left")
    c = c.join(r.withColumnsRenamed({"pix": "pix2", "region": "rb"}), [*keys, "pix2"], "left")
    hit = F.array_compact(F.array_distinct(F.array(F.lit(-1), F.col("ra"), F.col("rb"))))
    sums = (
        c.select(*keys, "term", "edge_idx", "n", F.explode(hit).alias("region"))
        .groupBy(*keys, "term", "edge_idx", "region").agg(F.sum("n").alias("n"))
    )
    left = _without_each(sums, [*keys, "term", "edge_idx"], num, "n")

    p = populations.join(r, [*keys, "pix"], "left")
    p = p.select(*keys, "catalog", "n", F.explode(F.array_compact(F.array(F.lit(-1), F.col("region")))).alias("region"))
    psum = p.groupBy(*keys, "catalog", "region").agg(F.sum("n").alias("n"))
    pop = _without_each(psum, [*keys, "catalog"], num, "pop")
    d = with_populations(terms, pop, [*keys, "region"])
    d = with_pairs(d, left, [*keys, "term", "region"], edges)
    norm = F.col("pop1").cast("double") * F.col("pop2")
    return d.select(*keys, "term", "region", "bin_idx", F.try_divide(F.col("pairs").cast("double"), norm).alias("signal"))


def with_populations(terms: DataFrame, pop: DataFrame, keys) -> DataFrame:
    """``*keys, term, pop1, pop2`` of each term whose two catalogs have objects under the same keys.

    ``pop`` has ``*keys, catalog, pop``; keys include ``corr_id``.
    """
    d = terms.select("corr_id", "term", "first", "second").join(pop.withColumnsRenamed({"catalog": "first", "pop": "pop1"}), ["corr_id", "first"])
    return d.join(pop.withColumnsRenamed({"catalog": "second", "pop": "pop2"}), [*keys, "second"]).select(*keys, "term", "pop1", "pop2")


def with_pairs(known: DataFrame, sums: DataFrame, keys, edges: int) -> DataFrame:
    """``known`` with ``bin_idx, pairs`` for each angle; counts that ``sums`` (``*keys, edge_idx, n``) lacks are 0."""
    grid = known.select("*", F.explode(F.sequence(F.lit(0), F.lit(edges - 1))).alias("edge_idx"))
    full = grid.join(sums, [*keys, "edge_idx"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    before = F.lag("n").over(W.partitionBy(*keys).orderBy("edge_idx"))
    d = full.withColumn("pairs", F.col("n") - before).where("pairs is not null")
    return d.withColumn("bin_idx", F.col("edge_idx") - 1).drop("edge_idx", "n")


def jackknife(loo: DataFrame, terms: DataFrame, keys) -> DataFrame:
    """``*keys, bin_idx, w, err, w_mean, w_std`` from :func:`leave_one_out` signals.

    ``err`` weighs each region's departure by its share of random pairs; ``w_mean``
    and ``w_std`` are the plain mean and spread over the left-out estimates.
    """
    keys = list(keys)
    e = estimate(loo, terms, [*keys, "region"])
    # the few estimates of one bin stand side by side with the one that keeps all
    w = W.partitionBy(*keys, "bin_idx")
    whole = lambda c: F.max(F.when(F.col("region") == -1, F.col(c))).over(w)
    e = e.withColumns({"w0": whole("w"), "rr0": whole("rr")}).where("region >= 0")
    dev = F.col("w") - F.col("w0")
    return e.groupBy(*keys, "bin_idx").agg(
        F.first("w0").alias("w"),
        F.sqrt(F.sum(F.try_divide(F.col("rr"), F.col("rr0")) * dev * dev)).alias("err"),
        F.avg("w").alias("w_mean"),
        F.stddev_pop("w").alias("w_std"),
    )


def weighted_mean_std(df: DataFrame, keys, value: str, weight: str | None = None) -> DataFrame:
    """Mean and spread of a value per key, optionally weighted."""
    w = F.col(weight) if weight else F.lit(1.0)
    v = F.col(value)
    g = df.where(v.isNotNull()).groupBy(*keys).agg(
        F.sum(w).alias("_w"), F.sum(w * v).alias("_s"), F.sum(w * v * v).alias("_q"))
    mean = F.try_divide(F.col("_s"), F.col("_w"))
    var = F.try_divide(F.col("_q"), F.col("_w")) - mean * mean
    return g.select(*keys, mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"))


def fit_range(signals: DataFrame, n_to_cut: int = 3) -> DataFrame:
    """Without the ``n_to_cut`` smallest angles."""
    return signals.where(F.col("bin_idx") >= n_to_cut)


def positive_points(signals: DataFrame) -> DataFrame:
    """Rows of positive signal; an error of zero counts as one."""
    return signals.where("w > 0").withColumn("err", F.when(F.col("err") == 0, F.lit(1.0)).otherwise(F.col("err")))


MOVES = 40


def _tried(points: DataFrame, keys, num: int, step: float) -> DataFrame:
    """``*keys, b``: the best of ``num`` exponents from ``k0`` on, as ``sse, k, a, i``; points have ``x, y, g, k0``."""
    q = points.select(*keys, "x", "y", "g", "k0", F.explode(F.sequence(F.lit(0), F.lit(num - 1))).alias("i"))
    q = q.withColumn("k", F.col("k0") + F.col("i") * F.lit(step))
    t = F.pow("x", "k")
    s = q.groupBy(*keys, "k", "i").agg(
        F.sum(F.col("g") * F.col("y") * t).alias("sxy"), F.sum(F.col("g") * t * t).alias("sxx"),
        F.sum(F.col("g") * F.col("y") * F.col("y")).alias("syy"))
    a = F.try_divide(F.col("sxy"), F.col("sxx"))
    s = s.select(*keys, "k", "i", a.alias("a"), (F.col("syy") - a * F.col("sxy")).alias("sse"))
    # powers that overflow are no fit
    s = s.where(F.col("sse").isNotNull() & ~F.isnan("sse"))
    return s.groupBy(*keys).agg(F.min(F.struct("sse", "k", "a", "i")).alias("b"))


def fit_power_law(points: DataFrame, keys, x: str = "theta", k_lo: float = -3.0, k_hi: float = 1.0,
                  num: int = 81, passes: int = 3) -> DataFrame:
    """Least-squares ``w = a * x**k`` per key: ``*keys, a, k, sse, settled``.

    For a given exponent the amplitude is a ratio of sums, so a grid of exponents
    is tried in one aggregation. ``k_lo`` and ``k_hi`` are where it starts: while the best
    exponent of a key lies on the edge of its grid, that key's grid moves on by its width. Then it is
    refined round the best one. A fit that still improves after 40 moves (data of which no
    power is the best) keeps its last exponent and is not ``settled``.
    """
    keys = list(keys)
    p = points.select(*keys, F.col(x).alias("x"), F.col("w").alias("y"), (F.lit(1.0) / (F.col("err") * F.col("err"))).alias("g"))
    step = (k_hi - k_lo) / (num - 1)
    best = cut(_tried(p.withColumn("k0", F.lit(float(k_lo))), keys, num, step))
    for _ in range(MOVES):
        on_edge = F.col("b.i").isin(0, num - 1)
        moved = best.where(on_edge).select(*keys, F.when(F.col("b.i") == 0, F.col("b.k") - F.lit(k_hi - k_lo)).otherwise(F.col("b.k")).alias("k0"))
        if moved.isEmpty():
            break
        again = _tried(p.join(moved, keys), keys, num, step)
        # settled where the shared exponent stays the best
        again = again.join(best.select(*keys, F.col("b.k").alias("was")), keys)
        again = again.withColumn("b", F.when(F.abs(F.col("b.k") - F.col("was")) < step / 2, F.col("b").withField("i", F.lit(1))).otherwise(F.col("b")))
        best = cut(best.where(~on_edge).unionByName(again.select(*keys, "b")))
    settled = best.select(*keys, (~F.col("b.i").isin(0, num - 1)).alias("settled"))
    for _ in range(passes - 1):
        start = best.select(*keys, (F.col("b.k") - F.lit(step)).alias("k0"))
        step = 2.0 * step / (num - 1)
        best = _tried(p.join(start, keys), keys, num, step)
    return best.join(settled, keys).select(*keys, "b.a", "b.k", "b.sse", "settled")

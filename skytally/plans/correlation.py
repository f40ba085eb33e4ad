"""Whole correlation functions: preparation, counts, estimate, errors, summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.healpix import with_pixel
from ..functions.scalars import midpoints
from ..lineage import cut
from ..operators.counts import mean_share
from ..operators.estimators import estimate, expand_terms, jackknife, jackknife_regions, leave_one_out, with_pairs, with_populations
from ..operators.histograms import count_per_pixel, z_histogram
from ..operators.pairs import good_pairs, good_pixels, pair_count_terms, pairs_within, pixel_pairs, reach
from ..operators.partition import fit_randoms, normalize_random, split_by_correlation, split_by_z


@dataclass
class Counted:
    """The tables of a counted set of correlations."""

    terms: DataFrame
    counts: DataFrame       # corr_id, zbin, term, pix1, pix2, edge_idx, n
    populations: DataFrame  # corr_id, zbin, catalog, pix, n
    edges: int              # number of angles


@dataclass
class PreparedPair:
    """A data catalog with its random catalog, ready to count."""

    data: DataFrame         # with pix and zbin, without redshift
    randoms: DataFrame
    before: DataFrame       # catalog, pix, n before normalisation
    after: DataFrame        # catalog, pix, n after it
    by_bin: DataFrame       # catalog, zbin, pix, n
    z_hist: DataFrame       # catalog, bin_idx, lo, hi, n, density


def prepare_pair(data: DataFrame, randoms: DataFrame, zbins, nside: int, normalize: bool = False,
                 norm_nside: int = 8, use_zbins: bool = True, z_bins: int = 29, order=None) -> PreparedPair:
    """Populations, optional fit of the randoms to the data, and the split by bin and pixel."""
    both = lambda d, r: d.select("pix").withColumn("catalog", F.lit("D")).unionByName(
        r.select("pix").withColumn("catalog", F.lit("R")))
    d = with_pixel(data, nside)
    before = count_per_pixel(both(d, with_pixel(randoms, nside)), nside, keys=["catalog"])
    r = normalize_random(data, randoms, norm_nside, order) if normalize else randoms
    r = with_pixel(r, nside)
    after = count_per_pixel(both(d, r), nside, keys=["catalog"])
    hist = z_histogram(
        data.select("redshift").withColumn("catalog", F.lit("D")).unionByName(
            randoms.select("redshift").withColumn("catalog", F.lit("R"))),
        zbins[0], zbins[-1], z_bins, keys=["catalog"])
    ds, rs = split_by_z(d, zbins, use_zbins=use_zbins), split_by_z(r, zbins, use_zbins=use_zbins)
    tag = lambda df, c: df.select("pix", "zbin").withColumn("catalog", F.lit(c))
    by_bin = count_per_pixel(tag(ds, "D").unionByName(tag(rs, "R")), nside, keys=["catalog", "zbin"])
    return PreparedPair(ds, rs, before, after, by_bin, hist)


def count_correlations(points: DataFrame, corrs: DataFrame, abins, zbins=None, nside: int = 32,
                       convention: str = "pixel") -> Counted:
    """Pair counts of every correlation, redshift bin and term in one keyed plan.

    ``points`` has ``corr_id, catalog, ra, dec, redshift``; ``corrs`` has ``corr_id, type`` and
    may have ``use_zbins``. A catalog without redshift goes into every bin. Without
    ``zbins`` everything is bin 0.
    """
    terms = expand_terms(corrs)
    p = with_pixel(points.where("ra is not null and dec is not null"), nside)
    whole = p.groupBy("corr_id", "catalog", "pix").agg(F.count(F.lit(1)).alias("n"))
    good = good_pixels(whole, corrs)
    z = split_by_correlation(p, corrs, zbins)
    populations = z.groupBy("corr_id", "zbin", "catalog", "pix").agg(F.count(F.lit(1)).alias("n"))
    widest = float(list(abins)[-1])
    if widest <= reach(nside):
        pairs, widest = pixel_pairs(points.sparkSession, nside), None
    else:
        pairs = pairs_within(good, nside, widest)
    counts = pair_count_terms(z, terms, abins, good_pairs(pairs, good), nside, ("corr_id", "zbin"), convention, widest)
    return Counted(terms, counts, populations, len(list(abins)))


def term_signals(counted: Counted) -> DataFrame:
    """``corr_id, zbin, term, bin_idx, pairs, signal``: normalised pairs of every term.

    A term whose catalogs both have objects in a redshift bin has a row for each angle, also without any pair.
    """
    keys = ["corr_id", "zbin", "term"]
    sums = counted.counts.groupBy(*keys, "edge_idx").agg(F.sum("n").alias("n"))
    pop = counted.populations.groupBy("corr_id", "zbin", "catalog").agg(F.sum("n").alias("pop"))
    d = with_pairs(with_populations(counted.terms, pop, ["corr_id", "zbin"]), sums, keys, counted.edges)
    norm = F.col("pop1").cast("double") * F.col("pop2")
    return d.select(*keys, "bin_idx", "pairs", F.try_divide(F.col("pairs").cast("double"), norm).alias("signal"))


def correlation_function(points: DataFrame, corrs: DataFrame, abins, zbins, nside: int = 32, regions: int = 16,
                         convention: str = "pixel", norm_nside: int = 8, order=None) -> DataFrame:
    """``corr_id, zbin, bin_idx, w, err, w_mean, w_std``: all signals with both errors.

    ``corrs`` has ``corr_id, type`` and may have the flags of a specification: ``normalize`` fits
    a correlation's randoms to its data first (``points`` then has ``id``), ``use_zbins`` splits it
    by redshift. Regions are dealt from the random-random populations of each correlation and bin.
    """
    keys = ["corr_id", "zbin"]
    points = fit_randoms(points, corrs, norm_nside, order)
    c = count_correlations(points, corrs, abins, zbins, nside, convention)
    c.populations = cut(c.populations)
    rr = c.terms.where("role = 'rr'")
    sides = F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("first").alias("catalog")),
                              F.struct(F.lit(2).alias("side"), F.col("second").alias("catalog"))))
    rr = rr.select("corr_id", sides.alias("s")).select("corr_id", "s.*")
    shares = mean_share(c.populations.join(rr, ["corr_id", "catalog"]), keys)
    parts = cut(jackknife_regions(shares, regions, keys))
    # every left-out estimate reads counts, populations and regions, so they are kept once
    loo = leave_one_out(cut(c.counts), c.populations, c.terms, parts, regions, keys, c.edges)
    return jackknife(loo, c.terms, keys)


def simple_correlation(signals: DataFrame, terms: DataFrame, keys) -> DataFrame:
    """Estimates without errors from normalised term signals."""
    return estimate(signals, terms, keys).drop("rr")


def with_angle(signals: DataFrame, abins) -> DataFrame:
    """Adds the middle angle of each bin."""
    mids = F.array(*[F.lit(m) for m in midpoints(list(abins))])
    return signals.withColumn("theta", F.element_at(mids, F.col("bin_idx") + 1))


def correlation_summary(signals: DataFrame, populations: DataFrame, corrs: DataFrame, zbins) -> DataFrame:
    """``corr_id, zbin, text``: one readable line per correlation and redshift bin.

    ``corrs`` has ``corr_id, str``; ``populations`` has ``corr_id, zbin, catalog, pix, n``.
    """
    size = populations.groupBy("corr_id", "zbin", "catalog").agg(F.sum("n").alias("n"))
    size = size.groupBy("corr_id", "zbin").agg(F.array_sort(F.collect_list(
        F.concat_ws("=", "catalog", F.col("n").cast("string")))).alias("sizes"))
    sig = signals.groupBy("corr_id", "zbin").agg(F.array_sort(F.collect_list(F.struct(
        "bin_idx", F.format_string("%.3f+-%.3f", "w", "err").alias("t")))).alias("s"))
    edge = lambda k: F.element_at(F.array(*[F.lit(float(e)) for e in zbins]), F.col("zbin") + k)
    j = sig.join(size, ["corr_id", "zbin"]).join(corrs.select("corr_id", "str"), "corr_id")
    span = F.format_string("z [%.2f, %.2f)", edge(1), edge(2))
    return j.select("corr_id", "zbin", F.concat_ws(
        " | ", "str", span, F.concat_ws(" ", "sizes"), F.concat_ws(" ", F.transform("s", lambda v: v.t))).alias("text"))

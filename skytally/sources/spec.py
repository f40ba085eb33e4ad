"""Description of a set of correlations and its metadata tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.estimators import expand_terms

SLOTS = ("D0", "R0", "D1", "D2", "R1", "R2")
TYPE_SLOTS = {"auto": ("D0", "R0"), "cross": ("D1", "D2", "R1", "R2")}


def edges_from_text(text: str) -> list[float]:
    """Bin edges from numbers separated by commas."""
    return [float(v) for v in text.split(",") if v.strip()]


def correlation_spec(spark: SparkSession, spec: dict) -> dict[str, DataFrame]:
    """Tables ``corrs, catalogs, terms, abins, zbins, other`` of a specification.

    ``spec`` has ``abins`` and ``zbins`` (lists, or text of numbers and commas), ``nside``
    and ``correlations``: a list of dicts with ``str, type, use_zbins, normalize`` ('y'
    or 'n') and a path per catalog slot. An unknown type is an error.
    """
    rows = []
    for i, c in enumerate(spec["correlations"]):
        kind = c["type"]
        if kind not in TYPE_SLOTS:
            raise ValueError(f"correlation {i}: unknown type {kind!r}")
        missing = [s for s in TYPE_SLOTS[kind] if not c.get(s)]
        if missing:
            raise ValueError(f"correlation {i}: no path for {', '.join(missing)}")
        flag = lambda name: c.get(name, "n") == "y"
        rows.append((i, kind, c.get("str", ""), flag("use_zbins"), flag("normalize"),
                     *[c.get(s, "") if s in TYPE_SLOTS[kind] else "" for s in SLOTS]))
    corrs = spark.createDataFrame(
        rows, "corr_id int, type string, str string, use_zbins boolean, normalize boolean, "
        + ", ".join(f"{s} string" for s in SLOTS))
    edges = lambda v: edges_from_text(v) if isinstance(v, str) else [float(e) for e in v]
    single = lambda name, values: spark.createDataFrame(
        [(i, v) for i, v in enumerate(values)], f"idx int, {name} double")
    return {
        "corrs": corrs,
        "catalogs": catalog_slots(corrs),
        "terms": expand_terms(corrs),
        "abins": single("abins", edges(spec["abins"])),
        "zbins": single("zbins", edges(spec["zbins"])),
        "other": spark.createDataFrame([(len(rows), int(spec["nside"]))], "n_corrs int, nside int"),
    }


def catalog_slots(corrs: DataFrame) -> DataFrame:
    """``corr_id, catalog, path, kind``: the filled slots of each correlation, kind data or random."""
    slots = F.explode(F.array(*[F.struct(F.lit(s).alias("catalog"), F.col(s).alias("path")) for s in SLOTS]))
    kind = F.when(F.col("catalog").startswith("D"), F.lit("data")).otherwise(F.lit("random"))
    return corrs.select("corr_id", slots.alias("s")).select("corr_id", "s.*").where("path <> ''").withColumn("kind", kind)


def merge_meta(old: DataFrame, new: DataFrame, key: str = "catalog") -> DataFrame:
    """Union of two metadata tables keyed by catalog; stored entries win."""
    return old.unionByName(new.join(old.select(key).distinct(), key, "left_anti").select(*old.columns))


def drop_empty(hist: DataFrame, key: str = "catalog") -> DataFrame:
    """Without the histograms that count nothing."""
    full = hist.groupBy(key).agg(F.sum("n").alias("_t")).where("_t > 0").select(key)
    return hist.join(full, key, "left_semi")

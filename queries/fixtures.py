"""Sky tables derived from the given tables by plain arithmetic.

The expressions are written once, as text that Spark and SQL engines read the
same way, so both sides of a check hold the same bits. ``$S`` is the patch scale:
the square root of the number of orders over 15000.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession


def _frac(v: str) -> str:
    return f"({v} - floor({v}))"


def _d(v: str) -> str:
    return f"cast({v} as double)"


def _sq(v: str) -> str:
    return f"({_d(v)} * {_d(v)})"


_CU = _sq("o_custkey")
_K2 = _sq("o_orderkey")
_CC = _sq("c_custkey")
_PP = _sq("p_partkey")
_EV = "((cast(event_id as double) + 0.5e0) * (cast(event_id as double) + 0.5e0))"
_VV = _sq("vec_id")
_LL = "(cast(l_orderkey as double) * 7e0 + cast(l_linenumber as double))"

A, B, C = "0.7548776662466927e0", "0.5698402909980532e0", "0.2360679774997898e0"
D, E = "0.4142135623730951e0", "0.7320508075688772e0"
G, H, K = "0.3027756377319946e0", "0.6457513110645906e0", "0.3166247903553998e0"


def _ra(seed: str, width: str = "20e0 * $S", mult: str = A) -> str:
    return f"140e0 + {width} * ({_frac(f'{seed} * {mult}')} - 0.5e0)"


def _dec(seed: str, width: str = "10e0 * $S", mult: str = B) -> str:
    return f"{width} * ({_frac(f'{seed} * {mult}')} - 0.5e0)"


# name -> (table, {column: expression})
TABLES: dict[str, tuple[str, dict[str, str]]] = {
    # objects gathered round their customer's place
    "galaxies": ("orders", {
        "id": "o_orderkey",
        "ra": f"{_ra(_CU)} + 0.4e0 * ({_frac(f'{_K2} * {D}')} - 0.5e0)",
        "dec": f"{_dec(_CU)} + 0.4e0 * ({_frac(f'{_K2} * {E}')} - 0.5e0)",
        "redshift": f"0.2e0 + {_frac(f'{_K2} * {C}')}",
        "z_std": f"0.1e0 * {_frac(f'{_K2} * {G}')} - 0.005e0",
        "imag": f"19e0 + 6e0 * {_frac(f'{_K2} * {H}')}",
        "wise_flag": "case when o_orderstatus = 'P' then 0 else 1 end",
        "extendedness": _frac(f"{_K2} * {K}"),
        "price": "o_totalprice",
        "cust": "o_custkey",
    }),
    "randoms": ("events", {
        "id": "event_id",
        "ra": _ra(_EV, "(20e0 * $S + 0.4e0)"),
        "dec": _dec(_EV, "(10e0 * $S + 0.4e0)"),
        "redshift": f"0.2e0 + {_frac(f'{_EV} * {C}')}",
    }),
    "quasars": ("customer", {
        "id": "c_custkey",
        "ra": _ra(_CC),
        "dec": _dec(_CC),
        "redshift": f"0.2e0 + {_frac(f'{_CC} * {C}')}",
        "z_up": f"0.2e0 + {_frac(f'{_CC} * {C}')} + 0.02e0 + 0.1e0 * {_frac(f'{_CC} * {D}')}",
        "z_lo": f"0.2e0 + {_frac(f'{_CC} * {C}')} - 0.02e0 - 0.1e0 * {_frac(f'{_CC} * {E}')}",
        "specz": f"case when c_mktsegment = 'MACHINERY' then 0.2e0 + {_frac(f'{_CC} * {G}')} "
                 "when c_mktsegment = 'BUILDING' then cast('NaN' as double) end",
        "conf": _frac(f"{_CC} * {H}"),
        "p_t1": _frac(f"{_CC} * {K}"),
        "p_t2": f"1e0 - {_frac(f'{_CC} * {K}')}",
        "lum": f"42e0 + 5e0 * {_frac(f'{_CC} * {E}')}",
        "gmag": f"18e0 + 6e0 * {_frac(f'{_CC} * {D}')}",
        "imag": f"17.5e0 + 6e0 * {_frac(f'{_CC} * {G}')}",
        "w2": f"13e0 + 4e0 * {_frac(f'{_CC} * {H}')}",
        "w3": f"9e0 + 4e0 * {_frac(f'{_CC} * {A}')}",
        "z_match": "case when c_acctbal > 0e0 then c_acctbal end",
    }),
    "quasar_randoms": ("events", {
        "id": "event_id",
        "ra": _ra(_EV, "(20e0 * $S + 0.4e0)", D),
        "dec": _dec(_EV, "(10e0 * $S + 0.4e0)", E),
        "redshift": f"0.2e0 + {_frac(f'{_EV} * {G}')}",
    }),
    # the galaxies again, each moved by less than 0.18 arcsec
    "moved": ("orders", {
        "id": "o_orderkey",
        "ra": f"{_ra(_CU)} + 0.4e0 * ({_frac(f'{_K2} * {D}')} - 0.5e0) + 1e-4 * ({_frac(f'{_K2} * {G}')} - 0.5e0)",
        "dec": f"{_dec(_CU)} + 0.4e0 * ({_frac(f'{_K2} * {E}')} - 0.5e0) + 1e-4 * ({_frac(f'{_K2} * {H}')} - 0.5e0)",
        "mag": "o_totalprice",
        "bright": "o_totalprice > 200000e0",
    }),
    # telescope visits; two part keys share one pointing
    "visits": ("part", {
        "visit_id": "p_partkey",
        "pntgid": "cast(floor(p_partkey / 2e0) as bigint)",
        "ra": _ra(_PP, "6e0 * $S"),
        "dec": _dec(_PP, "6e0 * $S"),
        "filter": "case p_size - 5 * cast(floor(p_size / 5e0) as bigint) when 0 then 'g-band' when 1 then 'r-band' "
                  "when 2 then 'i2' when 3 then 'z' else 'y' end",
        "is_null": "p_type = 'ECONOMY' and p_size > 45",
    }),
    # one redshift curve per vector, on 64 points
    "curves": ("embeddings", {
        "object_id": "vec_id",
        "label": "label",
        "pdz": "embedding",
    }),
}


def scale(spark: SparkSession, sf_dir: str) -> float:
    return math.sqrt(spark.read.parquet(f"{sf_dir}/orders.parquet").count() / 15000.0)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, cols = TABLES[name]
    text = [f"{e} as {c}" for c, e in cols.items()]
    if any("$S" in t for t in text):
        s = repr(scale(spark, sf_dir)) + "e0"
        text = [t.replace("$S", s) for t in text]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*text)


def ctes(*names: str) -> str:
    """``name AS (SELECT ...)`` clauses for SQL."""
    scale_sql = "(select sqrt(count(*) / 15000e0) from orders)"
    parts = []
    for n in names:
        table, cols = TABLES[n]
        body = ", ".join(f"{e} as {c}" for c, e in cols.items()).replace("$S", "sc.s")
        parts.append(f"{n} AS (SELECT {body} FROM {table}, (select {scale_sql} as s) sc)")
    return ",\n".join(parts)

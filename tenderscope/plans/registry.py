"""Registry of named queries.

Each entry holds
* ``build(spark, sf_dir) -> DataFrame`` — the library's Spark job on the base tables;
* ``sql`` — the same query in DuckDB SQL over the base-table views, written
  against a ``contracts_base`` CTE that the registry prepends (``ADAPTER_SQL``);
* ``r4`` / ``r6`` — double columns rounded to 4 / 6 decimals on both sides, so
  the cross-engine comparison does not depend on floating-point summation order;
* ``mean`` — means of values on a decimal grid. Such a mean is often an exact tie
  of a rounding, where summation noise would decide; it is shifted off the ties
  (by ``MEAN_SHIFT``) on both sides before it is rounded to 3 decimals.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.contracts import ADAPTER_SQL


@dataclass
class QuerySpec:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    r6: tuple[str, ...] = ()
    r4: tuple[str, ...] = ()
    mean: tuple[str, ...] = ()
    headline: bool = False
    tags: tuple[str, ...] = field(default_factory=tuple)


MEAN_SHIFT = 0.000314159

REGISTRY: dict[str, QuerySpec] = {}

QUERY_MODULES = ("catalogue", "history", "features", "graph", "stats", "ml", "integration", "audits", "views", "profiles", "viewer")


def register(name: str, sql: str | None = None, r6=(), r4=(), mean=(), headline: bool = False):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query name {name}")
        REGISTRY[name] = QuerySpec(name, fn, sql, tuple(r6), tuple(r4), tuple(mean), headline)
        return fn
    return deco


def load_all() -> dict[str, QuerySpec]:
    for m in QUERY_MODULES:
        try:
            importlib.import_module(f"{__package__}.{m}")
        except ModuleNotFoundError as e:  # module not written yet
            if e.name != f"{__package__}.{m}":
                raise
    return REGISTRY


def _round_doubles(df: DataFrame, r4: tuple[str, ...], r6: tuple[str, ...], mean: tuple[str, ...] = ()) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (f.name in r4 or f.name in r6):
            digits = 4 if f.name in r4 else 6
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        elif f.name in mean:
            cols.append(F.round(F.col(f.name) + MEAN_SHIFT, 3).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def spark_query_for(name: str) -> Callable[[SparkSession, str], DataFrame]:
    spec = REGISTRY[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _round_doubles(spec.build(spark, sf_dir), spec.r4, spec.r6, spec.mean)

    run.__name__ = name
    run.__doc__ = spec.build.__doc__
    return run


def with_contracts_cte(sql: str) -> str:
    body = sql.strip().rstrip(";")
    cte = f"contracts_base AS ({ADAPTER_SQL})"
    upper = body.upper()
    if upper.startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {cte},\n{body[len('WITH RECURSIVE'):]}"
    if upper.startswith("WITH"):
        return f"WITH {cte},\n{body[4:]}"
    return f"WITH {cte}\n{body}"


def oracle_sql_for(name: str) -> str | None:
    spec = REGISTRY[name]
    if spec.sql is None:
        return None
    full = with_contracts_cte(spec.sql)
    reps = [f"round({c}, 4) AS {c}" for c in spec.r4] + [f"round({c}, 6) AS {c}" for c in spec.r6] \
        + [f"round({c} + {MEAN_SHIFT:.9f}, 3) AS {c}" for c in spec.mean]
    if not reps:
        return full
    return f"SELECT * REPLACE ({', '.join(reps)}) FROM (\n{full}\n) AS oracle_q"

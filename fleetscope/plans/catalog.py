"""Registered queries: one per inventory operator, with its DuckDB twin.

Each entry is ``name -> (build(spark, sf_dir) -> DataFrame, sql | None)``.
The SQL body runs after the CTEs of ``plans.oracle``; ``None`` marks an
operator that SQL cannot express (iterative models) and that is checked by
tests against a brute-force replay instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetscope.plans.oracle import AS_OF, AS_OF_FAST, with_views
from fleetscope.session import configure
from fleetscope.sources import bindings as B

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

AS_OF_TS = B.AS_OF
AS_OF_FAST_TS = B.as_of_fast(B.AS_OF)


def register(name: str, sql: str | None, recursive: bool = False):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)          # UTC instants and a checkpoint folder, whoever made the session
            return finalize(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = (run, with_views(sql, recursive) if sql else None)
        return run
    return deco


def finalize(df: DataFrame) -> DataFrame:
    """Present instants as zone-less timestamps (the driver's parquet type)
    and integral columns as 64-bit, the types the SQL twin produces."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampType):
            cols.append(F.col(f.name).cast("timestamp_ntz").alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            cols.append(F.col(f.name).cast("long").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: v[1] for k, v in REGISTRY.items() if v[1]}


def _load() -> None:
    # importing the modules fills REGISTRY
    from fleetscope.plans import (q_series, q_security, q_logs, q_alerts, q_fleet, q_ml,  # noqa: F401
                                  q_ingest, q_stream, q_rollup)

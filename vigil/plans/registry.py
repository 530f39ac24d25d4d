"""Query catalogue: every operator applied to the driver tables, with the
DuckDB SQL that computes the same result (the correctness oracle)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with an
    optional oracle SQL text (tables are the driver's views)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    # importing the family modules fills the two dicts
    import importlib
    for m in FAMILIES:
        importlib.import_module(f"vigil.plans.{m}")


FAMILIES = ["q_featurestore", "q_quality", "q_expect", "q_profile", "q_drift", "q_history",
            "q_models", "q_clean", "q_relational", "q_sources", "q_stream", "q_alerts",
            "q_traces", "q_ml"]

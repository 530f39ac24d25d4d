"""Projection, filter, union and paging operators (§2.2)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.core import materialised, numbered, with_row


def union_hot_cold(history: DataFrame, fresh: DataFrame) -> DataFrame:
    """History ∪ fresh rows by column name; columns missing on one side are
    null."""
    return history.unionByName(fresh, allowMissingColumns=True)


def align_features(ref: DataFrame, cur: DataFrame, requested: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Common columns of both sides (∩ requested), in the reference order."""
    cs = set(cur.columns)
    common = [c for c in ref.columns if c in cs and (requested is None or c in set(requested))]
    if not common:
        raise ValueError("no common features")
    return ref.select(*common), cur.select(*common)


def concat_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """Side-by-side by row position (pandas ``concat(axis=1)``): both sides
    are numbered, then joined on the position (full outer).  Prefer a keyed
    join when a key exists."""
    return numbered(left, "_pos").join(numbered(right, "_pos"), "_pos", "full_outer")


def filter_period(df: DataFrame, ts: str, start: Column, end: Column) -> DataFrame:
    """start ≤ ts ≤ end (a partition column here prunes files)."""
    return df.filter(F.col(ts).between(start, end))


def filter_tags(registry: DataFrame, tags: Mapping[str, str], col: str = "tags") -> DataFrame:
    """Rows whose tag map holds every given key = value pair."""
    cond = F.lit(True)
    for k, v in tags.items():
        cond = cond & (F.element_at(F.col(col), F.lit(k)) == F.lit(v))
    return registry.filter(F.coalesce(cond, F.lit(False)))


def with_sample(registry: DataFrame, features: str = "features", n: int = 5) -> DataFrame:
    """Registry rows with the number of their features and the first ``n`` of
    them instead of the list (a null list has none)."""
    held = F.coalesce(F.col(features), F.array().cast(registry.schema[features].dataType))
    return registry.withColumn("num_features", F.size(held).cast("long")).withColumn("sample_features", F.slice(held, 1, n)).drop(features)


def filter_stage(versions: DataFrame, name: str | None, stage: str | None,
                 name_col: str = "model", stage_col: str = "current_state") -> DataFrame:
    out = versions
    if name is not None:
        out = out.filter(F.col(name_col) == name)
    if stage is not None:
        out = out.filter(F.col(stage_col) == stage)
    return out


def page(df: DataFrame, order: Sequence[str], offset: int, limit: int) -> DataFrame:
    """Stable page: ORDER BY ``order`` (unique, nulls first) OFFSET o LIMIT n,
    in order, with the total row count and a has_more flag.

    The order columns alone are range-partitioned and counted; the prefix
    sums of those counts (a row a range) tell between which keys the page
    lies.  Only the rows between are sorted and numbered (:func:`numbered`), so
    a page deep in a table costs what the first one does, and no task holds the
    rows before it."""
    order = list(order)
    key = F.struct(*[F.col(c) for c in order])
    ranges = df.select(key.alias("_key")).repartitionByRange("_key").groupBy(F.spark_partition_id().alias("_range")) \
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_key").alias("_lo"), F.max("_key").alias("_hi"))
    upto = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))  # one row a range
    ranges = materialised(ranges.withColumn("_upto", upto))
    held = ranges.filter((F.col("_upto") > offset) & (F.col("_upto") - F.col("_n") < offset + limit))
    bounds = held.agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    total = ranges.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total"))
    near = with_row(df.withColumn("_key", key), bounds).filter((F.col("_key") >= F.col("_lo")) & (F.col("_key") <= F.col("_hi")))
    first = held.agg(F.min(F.col("_upto") - F.col("_n")).alias("_first"))
    rows = with_row(numbered(near.select(*df.columns, "_key").orderBy("_key"), "_number"), first)
    number = F.col("_number") + F.col("_first")
    rows = rows.filter((number >= offset) & (number < offset + limit)).orderBy("_key").select(*df.columns)
    return with_row(rows, total).withColumn("has_more", F.col("total") > offset + limit)


def page_after(df: DataFrame, order: Sequence[str], last: Sequence | None, limit: int) -> DataFrame:
    """The next page by cursor: the first ``limit`` rows whose ``order`` values
    come after ``last`` (those of the last row seen; None for the first page).
    Keeps ``limit`` rows a task, whatever comes before."""
    order = list(order)
    rows = df
    if last is not None:
        kinds = [df.schema[c].dataType for c in order]
        seen = F.struct(*[F.lit(str(v) if isinstance(k, T.TimestampNTZType) and v is not None else v).cast(k).alias(c)
                          for v, k, c in zip(last, kinds, order)])
        rows = rows.filter(F.struct(*[F.col(c) for c in order]) > seen)
    return rows.orderBy(*order).limit(limit)


def log_tail_filter(logs: DataFrame, n: int, level: str | None, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Last n log lines by time, then the level filter (tail before filter,
    as the reference does)."""
    tail = logs.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)
    return tail.filter(F.col("level") == level) if level else tail


LOG_SCHEMA = "ts string, service string, environment string, level string, correlation_id string, message string"


def parse_json_logs(lines: DataFrame, col: str = "value", schema: str = LOG_SCHEMA) -> DataFrame:
    """Parse JSON log lines; unparsable lines keep a null record."""
    return lines.select(F.from_json(F.col(col), schema).alias("j")).select("j.*")


def logs_by_correlation(parsed: DataFrame) -> DataFrame:
    """Events per correlation id: count, errors, services, first / last."""
    return parsed.groupBy("correlation_id").agg(
        F.count(F.lit(1)).cast("long").alias("n_events"),
        F.count_if(F.col("level") == "ERROR").cast("long").alias("n_errors"),
        F.count_distinct("service").cast("long").alias("n_services"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))

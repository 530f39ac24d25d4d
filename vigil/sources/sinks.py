"""Sinks: partitioned appends, table DDL and inserts, time-series tables,
history appends, quarantine gate, retention and report export (§2.1)."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import ensure_checkpoint_dir, settings
from vigil.sources.versioned import Files


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh directory under the shared ``spark.checkpoint.dir`` (never a
    machine-local temp folder)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/vigil-{name}-{uuid.uuid4().hex[:12]}"


def append_partitioned(df: DataFrame, path: str, partition_cols: Sequence[str], fmt: str = "parquet") -> None:
    """Append a batch as new files under its partition directories."""
    df.write.mode("append").partitionBy(*partition_cols).format(fmt).save(path)


def create_table(spark: SparkSession, name: str, schema: str, partition_cols: Sequence[str] = (),
                 bucket_col: str | None = None, buckets: int = 10, location: str | None = None) -> None:
    """CREATE TABLE IF NOT EXISTS … USING parquet [PARTITIONED BY] CLUSTERED
    BY (first column by default) INTO 10 BUCKETS [LOCATION]."""
    first = bucket_col or schema.split(",")[0].strip().split()[0]
    parts = f" PARTITIONED BY ({', '.join(partition_cols)})" if partition_cols else ""
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet{parts} "
              f"CLUSTERED BY ({first}) INTO {buckets} BUCKETS{loc}")


def table_insert(df: DataFrame, name: str) -> None:
    """Append rows into an existing table (column order of the table)."""
    cols = df.sparkSession.table(name).columns
    df.select(*cols).write.insertInto(name)


def replace_partitions(df: DataFrame, name: str) -> None:
    """Write rows into a partitioned table; the partitions they fall into hold
    nothing else afterwards, the others stay.  Repeating the write changes
    nothing."""
    spark = df.sparkSession
    with settings(spark, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
        df.select(*spark.table(name).columns).write.insertInto(name, overwrite=True)


def timeseries_table(spark: SparkSession, name: str, schema: str, ts_col: str, key: str, buckets: int = 4,
                     location: str | None = None) -> None:
    """Time-partitioned (by day) and key-bucketed metric table."""
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}, day DATE) USING parquet PARTITIONED BY (day) "
              f"CLUSTERED BY ({key}) INTO {buckets} BUCKETS{loc}")


def write_timeseries(df: DataFrame, name: str, ts_col: str) -> None:
    table_insert(df.withColumn("day", F.to_date(ts_col)), name)


def history_append(df: DataFrame, path: str, partition_col: str = "run_date", ts_col: str = "ts") -> None:
    """Append run / metric / alert rows to a history table partitioned by day."""
    append_partitioned(df.withColumn(partition_col, F.to_date(ts_col)), path, [partition_col])


def quarantine_split(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Tag each row with the list of rules (SQL predicates that must hold)
    it fails, in one pass.  Split by ``size(failed_rules) == 0``."""
    checks = [F.when(~F.coalesce(F.expr(pred), F.lit(False)), F.lit(name)) for name, pred in rules.items()]
    return df.withColumn("failed_rules", F.filter(F.array(*checks), lambda x: x.isNotNull()))


def quarantine_write(df: DataFrame, rules: Mapping[str, str], good_path: str, bad_path: str,
                     mode: str = "append") -> None:
    """Good rows continue, bad rows go to quarantine with their failed-rule
    list; the tagged frame is persisted so the input is read once."""
    tagged = quarantine_split(df, rules).persist()
    try:
        tagged.filter(F.size("failed_rules") == 0).drop("failed_rules").write.mode(mode).parquet(good_path)
        tagged.filter(F.size("failed_rules") > 0).write.mode(mode).parquet(bad_path)
    finally:
        tagged.unpersist()


def retention(df: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """Label rows kept / purged by age (older than as_of − days → purged)."""
    return df.withColumn("retention", F.when(F.col(ts) >= F.timestamp_add("DAY", F.lit(-days), as_of), "kept")
                         .otherwise("purged"))


def purge_partitions(spark: SparkSession, path: str, day_col: str, as_of: Column, days: int) -> DataFrame:
    """Drop the day partitions older than as_of − days from a day-partitioned
    table, in place; returns (retention, n_rows, first_day, last_day) of what
    went and what stayed, counted before and read back after.

    Only whole partition folders go: no kept row is rewritten or moved, a reader
    sees each day whole or not at all, and a purge that dies half-way is
    finished by the next one.  Rows without a day are older than any day that
    is kept and go too."""
    files = Files(spark, path)
    df = spark.read.parquet(path)
    cut = spark.range(1).select(F.timestamp_add("DAY", F.lit(-days), as_of).cast("string").alias("c")).first()["c"]
    n = F.count(F.lit(1)).cast("long").alias("n_rows")
    spans = [n, F.min(day_col).cast("date").alias("first_day"), F.max(day_col).cast("date").alias("last_day")]
    stays = F.coalesce(F.col(day_col) >= F.lit(cut).cast("timestamp_ntz"), F.lit(False))
    gone = df.filter(~stays).agg(*spans).collect()
    for folder in files.names(path):  # one name a day
        value = folder.removeprefix(f"{day_col}=")
        if value != folder and (value == "__HIVE_DEFAULT_PARTITION__" or value < cut[:10] or (value == cut[:10] and cut[10:] > " 00:00:00")):
            files.delete(f"{path.rstrip('/')}/{folder}")
    spark.catalog.refreshByPath(path)
    schema = "n_rows long, first_day date, last_day date"
    left = spark.read.schema(df.schema).parquet(path).agg(*spans)
    return spark.createDataFrame(gone, schema).withColumn("retention", F.lit("purged")) \
        .unionByName(left.withColumn("retention", F.lit("kept"))).filter("n_rows > 0")


def tier(df: DataFrame, ts: str, as_of: Column, hot_days: int = 90) -> DataFrame:
    """hot (within hot_days of as_of) / archive tier column."""
    return df.withColumn("tier", F.when(F.col(ts) >= F.timestamp_add("DAY", F.lit(-hot_days), as_of), "hot")
                         .otherwise("archive"))


def export_report(df: DataFrame, path: str, fmt: str = "json") -> str:
    """Write a (small) report aggregate as JSON lines or CSV with header.
    HTML and PDF rendering are not built."""
    w = df.coalesce(1).write.mode("overwrite")
    if fmt == "json":
        w.json(path)
    elif fmt == "csv":
        w.option("header", True).csv(path)
    else:
        raise ValueError(f"unsupported export format {fmt}")
    return path

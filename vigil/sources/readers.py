"""Batch and streaming readers (§2.1 sources)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """One driver table; selecting columns here lets the scan prune."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_parquet(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None,
                 merge_schema: bool = False) -> DataFrame:
    """``src_parquet``: a file, a directory or a glob; predicate and column
    pruning reach the scan."""
    r = spark.read.option("mergeSchema", str(merge_schema).lower())
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(*(path if isinstance(path, list) else [path]))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             header: bool = True, infer: bool = False, sep: str = ",") -> DataFrame:
    """``src_csv``: declared schema preferred (inference costs a full pass)."""
    r = spark.read.option("header", header).option("sep", sep)
    if schema is not None:
        r = r.schema(schema)
    elif infer:
        r = r.option("inferSchema", True)
    return r.csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
              multiline: bool = False) -> DataFrame:
    """``src_json``: JSON lines by default; ``multiline`` for arrays."""
    r = spark.read.option("multiLine", multiline)
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def read_jdbc(spark: SparkSession, url: str, query: str | None = None, table_name: str | None = None,
              partition_column: str | None = None, lower: int | None = None,
              upper: int | None = None, num_partitions: int = 8,
              properties: Mapping[str, str] | None = None) -> DataFrame:
    """``src_jdbc``: parallel read split on a numeric column.  The driver jar
    must be on the classpath; no database is reachable in tests, which use
    the same call shape on a temp view through :func:`read_query`."""
    r = spark.read.format("jdbc").option("url", url)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if query is not None and partition_column is None:
        r = r.option("query", query)
    else:
        src = table_name if table_name else f"({query}) q"
        r = r.option("dbtable", src)
    if partition_column is not None:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
             .option("upperBound", upper).option("numPartitions", num_partitions))
    return r.load()


def read_query(spark: SparkSession, sql: str) -> DataFrame:
    """SQL text over registered views (the in-process twin of ``read_jdbc``)."""
    return spark.sql(sql)


def load_sources(spark: SparkSession, sources: Mapping[str, Mapping]) -> dict[str, DataFrame]:
    """``src_multi``: load N named sources by type.

    ``sources = {name: {"type": "file", "format": "parquet", "path": ...}}``.
    Types: file (parquet/csv/json), database (jdbc or SQL on views),
    feature_store (entity frame + feature view via ``pit_join``).
    """
    out: dict[str, DataFrame] = {}
    for name, cfg in sources.items():
        kind = cfg.get("type", "file")
        if kind == "file":
            fmt = cfg.get("format", "parquet")
            if fmt == "parquet":
                out[name] = read_parquet(spark, cfg["path"], cfg.get("schema"))
            elif fmt == "csv":
                out[name] = read_csv(spark, cfg["path"], cfg.get("schema"),
                                     infer=cfg.get("infer", cfg.get("schema") is None))
            elif fmt == "json":
                out[name] = read_json(spark, cfg["path"], cfg.get("schema"), cfg.get("multiline", False))
            else:
                raise ValueError(f"unsupported format {fmt}")
        elif kind == "database":
            if "url" in cfg:
                out[name] = read_jdbc(spark, cfg["url"], query=cfg.get("query"),
                                      table_name=cfg.get("table"),
                                      partition_column=cfg.get("partition_column"),
                                      lower=cfg.get("lower"), upper=cfg.get("upper"),
                                      num_partitions=cfg.get("num_partitions", 8),
                                      properties=cfg.get("properties"))
            else:
                out[name] = read_query(spark, cfg["query"])
        elif kind == "feature_store":
            from vigil.operators.featurestore import pit_join
            out[name] = pit_join(cfg["entities"], cfg["features"], cfg["keys"],
                                 cfg.get("entity_ts", "event_ts"), cfg.get("feature_ts", "feature_ts"),
                                 cfg.get("feature_cols"), ttl_seconds=cfg.get("ttl_seconds"))
        else:
            raise ValueError(f"unsupported source type {kind}")
    return out


def sources_summary(frames: Mapping[str, DataFrame]) -> DataFrame:
    """``src_multi`` report: one row per loaded dataset with its row count,
    computed as ONE job over a union of per-source counts."""
    parts = [df.select(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("n_rows")).groupBy("dataset").agg(F.sum("n_rows").alias("n_rows"))
             for name, df in frames.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u


def read_stream_files(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet",
                      max_files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """``src_stream_files``: continuous ingest of landed files."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path)


def read_stream_kafka(spark: SparkSession, servers: str, topic: str, value_schema: T.StructType | str,
                      starting: str = "latest") -> DataFrame:
    """``src_stream_kafka``: broker ingest; the kafka connector jar must be
    on the classpath.  The JSON decoding step is :func:`parse_json_value`,
    which tests exercise on a file stream."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic).option("startingOffsets", starting).load())
    return parse_json_value(raw.select(F.col("value").cast("string").alias("value"),
                                       F.col("timestamp").alias("kafka_ts")), value_schema)


def parse_json_value(df: DataFrame, schema: T.StructType | str, col: str = "value") -> DataFrame:
    parsed = df.withColumn("_j", F.from_json(F.col(col), schema))
    others = [c for c in df.columns if c != col]
    return parsed.select(*others, "_j.*")

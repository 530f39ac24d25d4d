"""§2.1 source and sink queries: each writes to / reads from a scratch
directory under the shared ``spark.checkpoint.dir`` and returns what the
sink holds afterwards, computed from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.core import ts_lit
from vigil.sources import readers as rd
from vigil.sources import sinks as sk
from vigil.plans.registry import query


@query("src_parquet", "SELECT event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY event_type")
def q_src_parquet(spark, sf):
    df = rd.read_parquet(spark, f"{sf}/event*.parquet")
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


CUST_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("src_csv", "SELECT * FROM customer")
def q_src_csv(spark, sf):
    path = sk.scratch_dir(spark, "csv")
    rd.table(spark, sf, "customer").write.option("header", True).csv(path)
    return rd.read_csv(spark, path, CUST_SCHEMA)


ORD_SCHEMA = ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string")


@query("src_json", "SELECT * FROM orders")
def q_src_json(spark, sf):
    path = sk.scratch_dir(spark, "json")
    rd.table(spark, sf, "orders").write.json(path)
    return rd.read_json(spark, path, ORD_SCHEMA)


@query("src_jdbc", """SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 6) AS total FROM orders
WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY o_orderstatus""")
def q_src_jdbc(spark, sf):
    """The query-source path without a database: the same SQL text runs on
    a registered view (``read_jdbc`` sends it to the database instead)."""
    rd.table(spark, sf, "orders").createOrReplaceTempView("vigil_src_orders")
    return rd.read_query(spark, """SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 6) AS total
        FROM vigil_src_orders WHERE o_orderdate >= TIMESTAMP_NTZ '1998-01-01' GROUP BY o_orderstatus""")


@query("src_features", """WITH e AS (SELECT event_id, user_id, ts AS event_ts FROM events WHERE event_type = 'purchase'),
f AS (SELECT user_id, ts AS feature_ts, event_id AS f_id, value AS view_value FROM events WHERE event_type = 'view'),
m AS (SELECT e.event_id, e.user_id, e.event_ts, f.feature_ts, f.view_value,
  row_number() OVER (PARTITION BY e.event_id ORDER BY f.feature_ts DESC, f.f_id DESC) AS rn
  FROM e LEFT JOIN f ON f.user_id = e.user_id AND f.feature_ts <= e.event_ts)
SELECT event_id, user_id, event_ts, feature_ts, view_value FROM m WHERE rn = 1""")
def q_src_features(spark, sf):
    ev = rd.table(spark, sf, "events")
    ents = ev.filter("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("event_ts"))
    feats = ev.filter("event_type = 'view'").select("user_id", F.col("ts").alias("feature_ts"),
                                                   F.col("event_id").alias("f_id"), F.col("value").alias("view_value"))
    src = rd.load_sources(spark, {"training": {"type": "feature_store", "entities": ents, "features": feats,
                                               "keys": ["user_id"], "entity_ts": "event_ts", "feature_ts": "feature_ts",
                                               "feature_cols": ["view_value"], "tie": "f_id"}})
    return src["training"]


@query("src_multi", """SELECT 'orders' AS dataset, count(*) AS n_rows FROM orders
UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'lineitem', count(*) FROM lineitem""")
def q_src_multi(spark, sf):
    frames = rd.load_sources(spark, {
        "orders": {"type": "file", "format": "parquet", "path": f"{sf}/orders.parquet"},
        "customer": {"type": "file", "format": "parquet", "path": f"{sf}/customer.parquet"},
        "lineitem": {"type": "file", "format": "parquet", "path": f"{sf}/lineitem.parquet"}})
    return rd.sources_summary(frames)


@query("sink_parquet_append", """SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN DATE '2024-01-15' ELSE DATE '2024-01-31' END AS ingest_date,
  count(*) AS n FROM events GROUP BY 1""")
def q_sink_parquet_append(spark, sf):
    path = sk.scratch_dir(spark, "append")
    ev = rd.table(spark, sf, "events")
    split = ts_lit("2024-01-16")
    sk.append_partitioned(ev.filter(F.col("ts") < split).withColumn("ingest_date", F.lit("2024-01-15").cast("date")),
                          path, ["ingest_date"])
    sk.append_partitioned(ev.filter(F.col("ts") >= split).withColumn("ingest_date", F.lit("2024-01-31").cast("date")),
                          path, ["ingest_date"])
    back = spark.read.parquet(path)
    return back.groupBy(F.col("ingest_date").cast("date").alias("ingest_date")).agg(F.count(F.lit(1)).alias("n"))


def _tname(prefix):
    import uuid
    return f"vigil_{prefix}_{uuid.uuid4().hex[:8]}"


@query("sink_table_insert", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 6) AS bal FROM customer GROUP BY 1")
def q_sink_table_insert(spark, sf):
    name = _tname("cust")
    sk.create_table(spark, name, CUST_SCHEMA, location=sk.scratch_dir(spark, "tbl"))
    sk.table_insert(rd.table(spark, sf, "customer"), name)
    return spark.table(name).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"),
                                                         F.round(F.sum("c_acctbal"), 6).alias("bal"))


@query("sink_create_table")
def q_sink_create_table(spark, sf):
    """Partitioned + bucketed table DDL; returns the table description."""
    name = _tname("ddl")
    sk.create_table(spark, name, "o_orderkey bigint, o_totalprice double, o_orderstatus string",
                    partition_cols=["o_orderstatus"], location=sk.scratch_dir(spark, "ddl"))
    sk.table_insert(rd.table(spark, sf, "orders", ["o_orderkey", "o_totalprice", "o_orderstatus"]), name)
    return spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter(F.col("col_name").isin("Num Buckets", "Bucket Columns",
                                                                                          "Provider", "o_orderstatus"))


@query("sink_timeseries", """SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(avg(value), 9) AS mean_value FROM events
GROUP BY 1""")
def q_sink_timeseries(spark, sf):
    name = _tname("ts")
    sk.timeseries_table(spark, name, "event_id bigint, ts timestamp_ntz, event_type string, value double", "ts",
                        "event_type", location=sk.scratch_dir(spark, "ts"))
    sk.write_timeseries(rd.table(spark, sf, "events", ["event_id", "ts", "event_type", "value"]), name, "ts")
    return spark.table(name).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 9).alias("mean_value"))


@query("sink_history", """SELECT event_type AS dataset, count(*) AS n_runs FROM (SELECT DISTINCT event_type, CAST(ts AS DATE) FROM events)
GROUP BY 1""")
def q_sink_history(spark, sf):
    from vigil.plans.fixtures import dq_runs
    path = sk.scratch_dir(spark, "hist")
    runs = dq_runs(spark, sf)
    sk.history_append(runs.filter(F.col("ts") < ts_lit("2024-01-16")), path)
    sk.history_append(runs.filter(F.col("ts") >= ts_lit("2024-01-16")), path)
    return spark.read.parquet(path).groupBy("dataset").agg(F.count(F.lit(1)).alias("n_runs"))


QUAR_RULES = {"value_present": "value IS NOT NULL AND NOT isnan(value)", "known_type": "event_type <> '??'",
              "value_range": "value <= 1000"}


@query("sink_quarantine", """WITH d AS (SELECT event_id,
  CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 17 = 0 THEN CAST('NaN' AS DOUBLE)
       WHEN event_id % 100 = 1 THEN value * 100 ELSE value END AS value,
  CASE WHEN event_id % 25 = 0 THEN '??' ELSE event_type END AS event_type FROM events),
t AS (SELECT event_id, list_filter([
    CASE WHEN NOT coalesce(value IS NOT NULL AND NOT isnan(value), false) THEN 'value_present' END,
    CASE WHEN NOT coalesce(event_type <> '??', false) THEN 'known_type' END,
    CASE WHEN NOT coalesce(value <= 1000, false) THEN 'value_range' END], lambda x: x IS NOT NULL) AS f FROM d)
SELECT CASE WHEN len(f) = 0 THEN 'good' ELSE 'quarantine' END AS sink, array_to_string(f, ',') AS failed_rules, count(*) AS n
FROM t GROUP BY 1, 2""")
def q_sink_quarantine(spark, sf):
    from vigil.plans.fixtures import events_defects
    dq = events_defects(spark, sf).dropDuplicates(["event_id"]).select("event_id", "value", "event_type")
    good, bad = sk.scratch_dir(spark, "good"), sk.scratch_dir(spark, "bad")
    sk.quarantine_write(dq, QUAR_RULES, good, bad)
    g = spark.read.parquet(good).select(F.lit("good").alias("sink"), F.lit("").alias("failed_rules"))
    b = spark.read.parquet(bad).select(F.lit("quarantine").alias("sink"), F.concat_ws(",", "failed_rules").alias("failed_rules"))
    return g.unionByName(b).groupBy("sink", "failed_rules").agg(F.count(F.lit(1)).alias("n"))


@query("retention_purge", """SELECT CASE WHEN CAST(ts AS DATE) >= TIMESTAMP '2024-02-01' - INTERVAL 10 DAY THEN 'kept' ELSE 'purged' END
  AS retention, count(*) AS n_rows, min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day FROM events GROUP BY 1""")
def q_retention_purge(spark, sf):
    """A day-partitioned copy of the events, purged in place and read back."""
    path = sk.scratch_dir(spark, "ret")
    ev = rd.table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    ev.write.partitionBy("day").parquet(path)
    return sk.purge_partitions(spark, path, "day", ts_lit("2024-02-01"), 10)


@query("tier_hot_cold", """SELECT CASE WHEN o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 90 DAY THEN 'hot' ELSE 'archive' END AS tier,
  count(*) AS n FROM orders GROUP BY 1""")
def q_tier_hot_cold(spark, sf):
    o = rd.table(spark, sf, "orders", ["o_orderdate"])
    return sk.tier(o, "o_orderdate", ts_lit("2001-08-01"), 90).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("export_report")
def q_export_report(spark, sf):
    """The quality report aggregate written as JSON and CSV, read back."""
    from vigil.operators.history import quality_report
    from vigil.plans.fixtures import dq_checks
    rep = quality_report(dq_checks(spark, sf))
    base = sk.scratch_dir(spark, "report")
    sk.export_report(rep, base + "/json", "json")
    sk.export_report(rep, base + "/csv", "csv")
    return spark.read.schema("level string, item string, n_failed long").json(base + "/json")

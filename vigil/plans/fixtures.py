"""Stand-in inputs built from the driver tables (FIXTURES.md B and C).

Each builder only reshapes driver rows into the schema an operator expects
(injecting the listed defects); the operators do all the work.  Every
builder has a DuckDB twin so that the oracle sees identical input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.sources.readers import table

# column kinds of the driver tables (num / float / str / time), for SQL text
SCHEMAS = {
    "events": [("event_id", "int"), ("ts", "time"), ("user_id", "int"), ("event_type", "str"),
               ("value", "float"), ("props", "str")],
    "orders": [("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "str"),
               ("o_totalprice", "float"), ("o_orderdate", "time"), ("o_orderpriority", "str")],
    "customer": [("c_custkey", "int"), ("c_name", "str"), ("c_nationkey", "int"), ("c_acctbal", "float"),
                 ("c_mktsegment", "str")],
    "lineitem": [("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"), ("l_linenumber", "int"),
                 ("l_quantity", "float"), ("l_extendedprice", "float"), ("l_discount", "float"),
                 ("l_tax", "float"), ("l_returnflag", "str"), ("l_linestatus", "str"), ("l_shipdate", "time")],
}
SCHEMAS["events_dq"] = SCHEMAS["events"]


# ---------------------------------------------------------------- defects
def events_defects(spark: SparkSession, sf: str) -> DataFrame:
    """events with nulls (id % 10 = 0), NaN (% 17 = 0), outliers x100
    (% 100 = 1), a bad category '??' (% 25 = 0) and duplicated rows
    (% 50 = 0 appended once more)."""
    ev = table(spark, sf, "events")
    eid = F.col("event_id")
    val = (F.when(eid % 10 == 0, F.lit(None).cast("double"))
           .when(eid % 17 == 0, F.lit(float("nan")))
           .when(eid % 100 == 1, F.col("value") * 100)
           .otherwise(F.col("value")))
    et = F.when(eid % 25 == 0, F.lit("??")).otherwise(F.col("event_type"))
    d = ev.select("event_id", "ts", "user_id", et.alias("event_type"), val.alias("value"), "props")
    return d.unionByName(d.filter(F.col("event_id") % 50 == 0))


EVENTS_DQ_SQL = """events_dq AS (
  WITH d AS (SELECT event_id, ts, user_id,
      CASE WHEN event_id % 25 = 0 THEN '??' ELSE event_type END AS event_type,
      CASE WHEN event_id % 10 = 0 THEN NULL
           WHEN event_id % 17 = 0 THEN CAST('NaN' AS DOUBLE)
           WHEN event_id % 100 = 1 THEN value * 100 ELSE value END AS value,
      props FROM events)
  SELECT * FROM d UNION ALL SELECT * FROM d WHERE event_id % 50 = 0)"""


# ---------------------------------------------------------------- history
def dq_runs(spark: SparkSession, sf: str) -> DataFrame:
    """One quality run per event day and event type: score
    100 - |avg(value) - 50| clipped at 0, passed / failed = rows with value
    below / at least 100."""
    from vigil.operators.quality import score_status_expr
    ev = table(spark, sf, "events", ["ts", "event_type", "value"])
    g = ev.groupBy(F.col("event_type").alias("dataset"),
                   F.to_date("ts").alias("day")).agg(
        F.avg("value").alias("_avg"),
        F.count_if(F.col("value") < 100).alias("passed"),
        F.count_if(F.col("value") >= 100).alias("failed"))
    score = F.round(F.greatest(F.lit(0.0), 100 - F.abs(F.col("_avg") - 50)), 6)
    return g.select("dataset", F.col("day").cast("timestamp_ntz").alias("ts"),
                    F.concat_ws("/", "dataset", F.date_format("day", "yyyy-MM-dd")).alias("run_id"),
                    score.alias("overall_score"),
                    score_status_expr(score, F.lit(0)).alias("status"),
                    F.col("passed").cast("long"), F.col("failed").cast("long"))


DQ_RUNS_SQL = """dq_runs AS (
  SELECT dataset, ts, run_id, overall_score,
         CASE WHEN overall_score >= 90 THEN 'excellent' WHEN overall_score >= 80 THEN 'good'
              WHEN overall_score >= 70 THEN 'fair' WHEN overall_score >= 60 THEN 'warning'
              WHEN overall_score >= 50 THEN 'poor' WHEN overall_score >= 30 THEN 'error' ELSE 'failed' END AS status,
         passed, failed
  FROM (SELECT event_type AS dataset, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts,
               event_type || '/' || strftime(CAST(ts AS DATE), '%Y-%m-%d') AS run_id,
               round(greatest(0.0, 100 - abs(avg(value) - 50)), 6) AS overall_score,
               count(*) FILTER (WHERE value < 100) AS passed,
               count(*) FILTER (WHERE value >= 100) AS failed
        FROM events GROUP BY event_type, CAST(ts AS DATE)))"""

# Check catalogue used to label check rows (fixed lists of this fixture).
CHECK_TYPES = ["completeness", "uniqueness", "validity", "consistency"]
SEVERITIES = ["low", "medium", "high", "critical"]


def dq_checks(spark: SparkSession, sf: str) -> DataFrame:
    """One check row per event: run = (event day, type); check name, type
    and severity by event_id arithmetic; failed when value >= 100."""
    ev = table(spark, sf, "events", ["event_id", "ts", "event_type", "value"])
    types = F.array(*[F.lit(t) for t in CHECK_TYPES])
    sev = F.array(*[F.lit(s) for s in SEVERITIES])
    return ev.select(
        F.concat_ws("/", "event_type", F.date_format(F.to_date("ts"), "yyyy-MM-dd")).alias("run_id"),
        F.col("event_type").alias("dataset"), F.col("ts"),
        F.concat(F.lit("check_"), (F.col("event_id") % 7).cast("string")).alias("check_name"),
        F.element_at(types, (F.col("event_id") % 4 + 1).cast("int")).alias("check_type"),
        F.element_at(sev, (F.col("event_id") % 4 + 1).cast("int")).alias("severity"),
        F.when(F.col("value") >= 100, "failed").otherwise("passed").alias("status"),
        F.format_string("value %.2f", F.col("value")).alias("message"))


DQ_CHECKS_SQL = """dq_checks AS (
  SELECT event_type || '/' || strftime(CAST(ts AS DATE), '%Y-%m-%d') AS run_id,
         event_type AS dataset, ts,
         'check_' || CAST(event_id % 7 AS VARCHAR) AS check_name,
         (['completeness', 'uniqueness', 'validity', 'consistency'])[event_id % 4 + 1] AS check_type,
         (['low', 'medium', 'high', 'critical'])[event_id % 4 + 1] AS severity,
         CASE WHEN value >= 100 THEN 'failed' ELSE 'passed' END AS status,
         printf('value %.2f', value) AS message
  FROM events)"""


def lifecycle_events(spark: SparkSession, sf: str) -> DataFrame:
    """Model lifecycle events from orders: model = o_custkey % 10, version =
    o_orderkey % 5, to_state by order status, ts = order date."""
    o = table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice"])
    st = (F.when(F.col("o_orderstatus") == "F", "deployed")
          .when(F.col("o_orderstatus") == "O", "validated").otherwise("archived"))
    return o.select(F.concat(F.lit("model_"), (F.col("o_custkey") % 10).cast("string")).alias("model"),
                    (F.col("o_orderkey") % 5 + 1).cast("long").alias("version"),
                    st.alias("to_state"), F.col("o_orderdate").alias("ts"),
                    F.col("o_orderkey").alias("event_id"),
                    F.round(F.col("o_totalprice") / 600000.0, 6).alias("score"))


LIFECYCLE_SQL = """lifecycle_events AS (
  SELECT 'model_' || CAST(o_custkey % 10 AS VARCHAR) AS model,
         CAST(o_orderkey % 5 + 1 AS BIGINT) AS version,
         CASE WHEN o_orderstatus = 'F' THEN 'deployed' WHEN o_orderstatus = 'O' THEN 'validated'
              ELSE 'archived' END AS to_state,
         o_orderdate AS ts, o_orderkey AS event_id, round(o_totalprice / 600000.0, 6) AS score
  FROM orders)"""


def drift_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Drift history: one run per (event type = model, day); score = the
    day's standardized mean shift |avg_day − avg_all| / std_all."""
    from vigil.operators.drift import severity
    ev = table(spark, sf, "events", ["ts", "event_type", "value"])
    allm = ev.groupBy("event_type").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    day = ev.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.avg("value").alias("_dm"))
    j = day.join(allm, "event_type")
    score = F.round(F.abs(F.col("_dm") - F.col("_m")) / F.col("_s"), 6)
    return j.select(F.col("event_type").alias("model_name"), F.col("d").cast("timestamp_ntz").alias("ts"),
                    score.alias("drift_score"), (score > 0.1).alias("is_drifted"),
                    severity(score, 0.1).alias("severity"))


DRIFT_RUNS_SQL = """drift_runs AS (
  SELECT model_name, ts, drift_score, drift_score > 0.1 AS is_drifted,
    CASE WHEN drift_score <= 0.1 THEN 'none' WHEN drift_score <= 0.1 * 1.5 THEN 'low'
         WHEN drift_score <= 0.1 * 2.0 THEN 'medium' WHEN drift_score <= 0.1 * 3.0 THEN 'high' ELSE 'critical' END AS severity
  FROM (SELECT d.event_type AS model_name, CAST(d.d AS TIMESTAMP) AS ts,
               round(abs(d.dm - a.m) / a.s, 6) AS drift_score
        FROM (SELECT event_type, CAST(ts AS DATE) AS d, avg(value) AS dm FROM events GROUP BY 1, 2) d
        JOIN (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1) a
          ON a.event_type = d.event_type))"""

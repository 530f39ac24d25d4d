"""§2.2 projection, filter, union and paging queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.core import ts_lit
from vigil.operators import relational as rl
from vigil.plans.fixtures import LIFECYCLE_SQL, lifecycle_events
from vigil.plans.registry import query
from vigil.sources.readers import table


@query("union_hot_cold", """SELECT event_id, ts, value, CAST(NULL AS VARCHAR) AS ingest_note FROM events WHERE ts < TIMESTAMP '2024-01-16'
UNION ALL SELECT event_id, ts, value, 'fresh' FROM events WHERE ts >= TIMESTAMP '2024-01-16'""")
def q_union_hot_cold(spark, sf):
    ev = table(spark, sf, "events", ["event_id", "ts", "value"])
    hist = ev.filter(F.col("ts") < ts_lit("2024-01-16"))
    fresh = ev.filter(F.col("ts") >= ts_lit("2024-01-16")).withColumn("ingest_note", F.lit("fresh"))
    return rl.union_hot_cold(hist, fresh)


@query("align_features", """SELECT 'reference' AS side, l_quantity, l_discount FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'
UNION ALL SELECT 'current', l_quantity, l_discount FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'""")
def q_align_features(spark, sf):
    li = table(spark, sf, "lineitem")
    ref = li.filter(F.col("l_shipdate") < ts_lit("1998-01-01")).select("l_quantity", "l_tax", "l_discount", "l_returnflag")
    cur = li.filter(F.col("l_shipdate") >= ts_lit("1998-01-01")).select("l_discount", "l_quantity", "l_extendedprice")
    r, c = rl.align_features(ref, cur, ["l_quantity", "l_discount", "l_tax"])
    return r.withColumn("side", F.lit("reference")).unionByName(c.withColumn("side", F.lit("current")))


@query("concat_columns")
def q_concat_columns(spark, sf):
    """Position-wise concat of two projections of the same file."""
    o = table(spark, sf, "orders")
    return rl.concat_columns(o.select("o_orderkey", "o_custkey"), o.select("o_totalprice", "o_orderdate"))


@query("filter_period", """SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30'""")
def q_filter_period(spark, sf):
    o = table(spark, sf, "orders", ["o_orderkey", "o_orderdate"])
    return rl.filter_period(o, "o_orderdate", ts_lit("1997-01-01"), ts_lit("1997-06-30"))


def _registry(spark, sf):
    """Feature-set registry: one set per (event type, day-of-week bucket)."""
    ev = table(spark, sf, "events", ["event_type", "ts", "user_id"])
    g = ev.groupBy("event_type", F.dayofweek("ts").alias("dow")).agg(
        F.count_distinct("user_id").alias("n_users"),
        F.array_sort(F.collect_set(F.concat(F.lit("hour_"), F.hour("ts").cast("string")))).alias("features"))
    return g.select(F.concat_ws("_", F.lit("fs"), "event_type", F.col("dow").cast("string")).alias("feature_set"),
                    F.create_map(F.lit("type"), F.col("event_type"),
                                 F.lit("weekend"), F.when(F.col("dow").isin(1, 7), "yes").otherwise("no")).alias("tags"),
                    F.col("n_users").cast("long").alias("n_users"), "features")


@query("filter_tags", """SELECT 'fs_' || event_type || '_' || CAST(dayofweek(ts) + 1 AS VARCHAR) AS feature_set,
  count(DISTINCT user_id) AS n_users, count(DISTINCT hour(ts)) AS num_features,
  array_to_string(list_sort(list(DISTINCT 'hour_' || hour(ts)))[1:5], ',') AS sample_features
FROM events WHERE event_type = 'click' AND dayofweek(ts) IN (0, 6) GROUP BY 1""")
def q_filter_tags(spark, sf):
    """Sets by tag, with their first five features."""
    found = rl.with_sample(rl.filter_tags(_registry(spark, sf), {"type": "click", "weekend": "yes"}))
    return found.withColumn("sample_features", F.array_join("sample_features", ",")).drop("tags")


@query("filter_stage", f"""WITH {LIFECYCLE_SQL}
SELECT model, version, arg_max(to_state, (ts, event_id)) AS current_state FROM lifecycle_events
GROUP BY model, version HAVING model = 'model_3' AND arg_max(to_state, (ts, event_id)) = 'validated'""")
def q_filter_stage(spark, sf):
    from vigil.operators.models import current_state
    cs = current_state(lifecycle_events(spark, sf), ["model", "version"]).select("model", "version", "current_state")
    return rl.filter_stage(cs, "model_3", "validated")


@query("page_offset_limit", """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total,
  (SELECT count(*) FROM orders) > 40 + 20 AS has_more FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40""")
def q_page_offset_limit(spark, sf):
    o = table(spark, sf, "orders", ["o_orderkey", "o_totalprice"])
    return rl.page(o, ["o_orderkey"], 40, 20)


_LOGS_SQL = """logs AS (SELECT event_id, ts, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level,
  'svc-' || event_type AS service FROM events)"""


def _logs(spark, sf):
    ev = table(spark, sf, "events", ["event_id", "ts", "event_type"])
    lvl = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARNING").otherwise("INFO")
    return ev.select("event_id", "ts", lvl.alias("level"), F.concat(F.lit("svc-"), "event_type").alias("service"))


@query("log_filter_tail", f"""WITH {_LOGS_SQL}
SELECT * FROM (SELECT * FROM logs ORDER BY ts DESC, event_id DESC LIMIT 100) WHERE level = 'ERROR'""")
def q_log_filter_tail(spark, sf):
    return rl.log_tail_filter(_logs(spark, sf), 100, "ERROR")


@query("log_parse_json", """SELECT CAST(user_id AS VARCHAR) AS correlation_id, count(*) AS n_events,
  count(*) FILTER (WHERE event_type = 'error') AS n_errors, count(DISTINCT event_type) AS n_services,
  min(strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS first_ts, max(strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS last_ts FROM events GROUP BY user_id""")
def q_log_parse_json(spark, sf):
    """JSON log lines rendered from events, parsed back, grouped by
    correlation id."""
    ev = table(spark, sf, "events", ["ts", "user_id", "event_type", "props"])
    lines = ev.select(F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("event_type").alias("service"),
        F.lit("prod").alias("environment"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
        F.col("user_id").cast("string").alias("correlation_id"), F.col("props").alias("message"))).alias("value"))
    return rl.logs_by_correlation(rl.parse_json_logs(lines))

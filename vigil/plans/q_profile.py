"""§2.7 profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.core import ts_lit
from vigil.operators import profile as pr
from vigil.operators import sketches as skt
from vigil.plans.registry import query
from vigil.sources.readers import table

LI_NUM = [("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
          ("l_discount", "double"), ("l_tax", "double")]


def _num_sql(tbl, cols, fields):
    parts = []
    for c, dt in cols:
        f = {
            "column": f"'{c}' AS \"column\"", "dtype": f"'{dt}' AS dtype", "count": f"count({c}) AS count",
            "null_count": f"count(*) - count({c}) AS null_count",
            "null_ratio": f"round(CAST(count(*) - count({c}) AS DOUBLE) / count(*), 9) AS null_ratio",
            "min": f"CAST(min({c}) AS DOUBLE) AS min", "max": f"CAST(max({c}) AS DOUBLE) AS max",
            "mean": f"round(avg({c}), 9) AS mean", "std": f"round(stddev_samp({c}), 9) AS std",
            "skewness": f"round(skewness({c}), 6) AS skewness", "kurtosis": f"round(kurtosis({c}), 6) AS kurtosis",
            "median": f"round(quantile_cont({c}, 0.5), 9) AS median"}
        parts.append(f"SELECT {', '.join(f[x] for x in fields)} FROM {tbl}")
    return " UNION ALL ".join(parts)


NUM_FIELDS = ["column", "dtype", "count", "null_count", "null_ratio", "min", "max", "mean", "std",
              "skewness", "kurtosis", "median"]


@query("profile_numeric", _num_sql("lineitem", LI_NUM, NUM_FIELDS))
def q_profile_numeric(spark, sf):
    return pr.profile_numeric(table(spark, sf, "lineitem"), [c for c, _ in LI_NUM])


@query("profile_skew", _num_sql("lineitem", LI_NUM, ["column", "skewness"]))
def q_profile_skew(spark, sf):
    return pr.profile_shape(table(spark, sf, "lineitem"), [c for c, _ in LI_NUM], "skewness")


@query("profile_kurtosis", _num_sql("lineitem", LI_NUM, ["column", "kurtosis"]))
def q_profile_kurtosis(spark, sf):
    return pr.profile_shape(table(spark, sf, "lineitem"), [c for c, _ in LI_NUM], "kurtosis")


@query("profile_table", """SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(6 AS BIGINT) AS n_columns,
  CAST(0 AS BIGINT) AS missing_cells, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS n FROM events GROUP BY ALL)""".replace(
    "GROUP BY ALL", "GROUP BY event_id, ts, user_id, event_type, value, props"))
def q_profile_table(spark, sf):
    return pr.profile_table(table(spark, sf, "events"))


@query("profile_datetime", """SELECT 'l_shipdate' AS "column", count(l_shipdate) AS count,
  min(l_shipdate) AS min, max(l_shipdate) AS max FROM lineitem
UNION ALL SELECT 'o_orderdate', count(o_orderdate), min(o_orderdate), max(o_orderdate) FROM orders""")
def q_profile_datetime(spark, sf):
    a = pr.profile_datetime(table(spark, sf, "lineitem", ["l_shipdate"]))
    b = pr.profile_datetime(table(spark, sf, "orders", ["o_orderdate"]))
    return a.unionByName(b)


_CLASS_COLS = ["c_name", "c_mktsegment"]


@query("profile_class", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_distinct, count({c}) AS count,
      CASE WHEN count(DISTINCT {c}) < 50 AND count(DISTINCT {c}) < 0.5 * count(*) THEN 'categorical' ELSE 'text' END AS kind,
      round(avg(length({c})), 9) AS mean_length FROM customer""" for c in _CLASS_COLS))
def q_profile_class(spark, sf):
    return pr.profile_class(table(spark, sf, "customer"), _CLASS_COLS)


_DOC_COLS = ["text", "lang", "source"]


@query("profile_text_len", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(avg(length({c})), 9) AS mean_length FROM documents""" for c in _DOC_COLS))
def q_profile_text_len(spark, sf):
    return pr.profile_class(table(spark, sf, "documents", _DOC_COLS), _DOC_COLS).select("column", "mean_length")


@query("profile_top5", """SELECT "column", rank, value, count FROM (
  SELECT "column", value, count, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank
  FROM (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS count FROM orders GROUP BY 2
        UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2
        UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR), count(*) FROM orders GROUP BY 2))
WHERE rank <= 5""")
def q_profile_top5(spark, sf):
    o = table(spark, sf, "orders", ["o_orderstatus", "o_orderpriority", "o_custkey"])
    o = o.withColumn("o_custkey", F.col("o_custkey").cast("string"))
    return pr.profile_top_values(o, ["o_orderstatus", "o_orderpriority", "o_custkey"], 5)


@query("profile_fingerprint")
def q_profile_fingerprint(spark, sf):
    return pr.profile_fingerprint(table(spark, sf, "orders"))


def _profile_history(spark, sf):
    """Stored profile rows: one per (event type, day)."""
    ev = table(spark, sf, "events", ["ts", "event_type", "value"])
    return ev.groupBy(F.col("event_type").alias("dataset"), F.to_date("ts").alias("d")).agg(
        F.count(F.lit(1)).cast("long").alias("n_rows"), F.round(F.avg("value"), 9).alias("mean_value")) \
        .select("dataset", F.col("d").cast("timestamp_ntz").alias("ts"), "n_rows", "mean_value")


@query("profile_latest", """SELECT dataset, ts, n_rows, mean_value FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY ts DESC) AS rn FROM (
    SELECT event_type AS dataset, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts, count(*) AS n_rows,
           round(avg(value), 9) AS mean_value FROM events GROUP BY 1, 2)) WHERE rn = 1""")
def q_profile_latest(spark, sf):
    return pr.latest_profile(_profile_history(spark, sf), "dataset", "ts")


@query("profile_mergeable")
def q_profile_mergeable(spark, sf):
    """Daily KLL/HLL sketches of events.value, stored per day, merged."""
    ev = table(spark, sf, "events", ["ts", "value", "user_id", "event_type"])
    daily = pr.profile_sketch(ev.withColumn("day", F.to_date("ts")), "value", ["event_type", "day"])
    return pr.merge_sketches(daily, ["event_type"])


def _daily_events(spark, sf):
    return table(spark, sf, "events", ["ts", "event_type", "user_id"]).withColumn("day", F.to_date("ts"))


@query("profile_frequencies", "SELECT user_id, count(*) AS n, true AS covered FROM events GROUP BY user_id")
def q_profile_frequencies(spark, sf):
    """Count-min counters of each day, merged; ``covered``: the estimate is at
    least the true count and within its bound."""
    ev = _daily_events(spark, sf)
    merged = skt.merge_count_min(skt.count_min(ev, "user_id", ["day"], width=8192, depth=7))
    est = skt.frequencies(ev, "user_id", merged, width=8192, depth=7)
    true = ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    ok = (F.col("estimate") >= F.col("n")) & (F.col("estimate") <= F.col("n") + F.col("bound"))
    return true.join(est, true["user_id"] == est["value"]).select("user_id", "n", ok.alias("covered"))


@query("profile_heavy_hitters", """SELECT event_type AS value, count(*) AS estimate,
  CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) AS INTEGER) AS rank FROM events GROUP BY 1 ORDER BY 3 LIMIT 3""")
def q_profile_heavy_hitters(spark, sf):
    """The three most frequent event types from daily sketches (exact while a
    slice has fewer items than the sketch holds)."""
    return skt.merge_top_items(skt.top_items(_daily_events(spark, sf), "event_type", ["day"]), 3)


@query("profile_membership", "SELECT DISTINCT user_id AS value FROM events")
def q_profile_membership(spark, sf):
    """Users that the merged daily filters hold, asked for all users seen: a
    filter forgets none."""
    ev = _daily_events(spark, sf)
    return skt.members(ev, "user_id", skt.merge_bloom(skt.bloom(ev, "user_id", ["day"])))


_DIFF_COLS = ["user_id", "event_type", "value"]


@query("profile_diff", """WITH b AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16'),
a AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-16'),
pb AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / count(*) AS nr, count(DISTINCT {c}) AS d FROM b"
    for c in _DIFF_COLS) + """),
pa AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / count(*) AS nr, count(DISTINCT {c}) AS d FROM a"
    for c in _DIFF_COLS) + """)
SELECT pb.col AS "column", round(pb.nr, 9) AS null_rate_before, round(pa.nr, 9) AS null_rate_after,
  pb.d AS distinct_before, pa.d AS distinct_after, round(pa.nr - pb.nr, 9) AS null_rate_jump,
  round(CAST(pa.d - pb.d AS DOUBLE) / pb.d, 9) AS distinct_change,
  (abs(pa.nr - pb.nr) > 0.05 OR abs(coalesce(CAST(pa.d - pb.d AS DOUBLE) / pb.d, 0.0)) > 0.2) AS anomaly
FROM pb JOIN pa ON pb.col = pa.col""")
def q_profile_diff(spark, sf):
    ev = table(spark, sf, "events", ["ts"] + _DIFF_COLS)
    b = ev.filter(F.col("ts") < ts_lit("2024-01-16")).drop("ts")
    a = ev.filter(F.col("ts") >= ts_lit("2024-01-16")).drop("ts")
    return pr.profile_diff(b, a, _DIFF_COLS)


def _versions(spark, sf):
    o = table(spark, sf, "orders")
    old = o.filter(F.col("o_orderdate") < ts_lit("2000-01-01"))
    new = o.filter(F.col("o_orderdate") >= ts_lit("1996-01-01")).withColumn(
        "o_orderstatus", F.when(F.col("o_orderpriority") == "1-URGENT", "X").otherwise(F.col("o_orderstatus")))
    return old, new


@query("dataset_diff", """WITH o AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'),
n AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
             o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01')
SELECT change, count(*) AS n_rows FROM (
  SELECT CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed'
    WHEN o.o_custkey IS NOT DISTINCT FROM n.o_custkey AND o.o_orderstatus IS NOT DISTINCT FROM n.o_orderstatus
     AND o.o_totalprice IS NOT DISTINCT FROM n.o_totalprice AND o.o_orderdate IS NOT DISTINCT FROM n.o_orderdate
     AND o.o_orderpriority IS NOT DISTINCT FROM n.o_orderpriority THEN 'unchanged' ELSE 'changed' END AS change
  FROM o FULL OUTER JOIN n ON o.o_orderkey = n.o_orderkey) GROUP BY change""")
def q_dataset_diff(spark, sf):
    old, new = _versions(spark, sf)
    return pr.dataset_diff(old, new, ["o_orderkey"])


@query("dataset_diff_keyless", """WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'),
n AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
             o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01')
SELECT 'added' AS change, count(*) AS n_rows FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o)
UNION ALL SELECT 'removed', count(*) FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n)
UNION ALL SELECT 'unchanged', count(*) FROM (SELECT * FROM o INTERSECT ALL SELECT * FROM n)""")
def q_dataset_diff_keyless(spark, sf):
    old, new = _versions(spark, sf)
    return pr.dataset_diff_keyless(old, new)

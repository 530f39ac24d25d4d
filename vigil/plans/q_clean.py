"""§2.3 cleaning and §2.4 feature-engineering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.core import ts_lit
from vigil.operators import clean as cl
from vigil.operators import features as fe
from vigil.plans.fixtures import EVENTS_DQ_SQL, events_defects
from vigil.plans.registry import query
from vigil.sources.readers import table

_DQ = f"WITH {EVENTS_DQ_SQL}\n"
_MISS = "(value IS NULL OR isnan(value))"


def _dq(spark, sf):
    return events_defects(spark, sf)


@query("clean_drop_null", _DQ + f"SELECT event_id, ts, user_id, event_type, value FROM events_dq WHERE NOT {_MISS}")
def q_clean_drop_null(spark, sf):
    return cl.drop_null(_dq(spark, sf), ["value"]).drop("props")


@query("clean_fill_mean", _DQ + f"""SELECT event_id, round(CASE WHEN {_MISS} THEN (SELECT avg(value) FROM events_dq WHERE NOT {_MISS})
  ELSE value END, 9) AS value FROM events_dq""")
def q_clean_fill_mean(spark, sf):
    d = cl.fill_mean(_dq(spark, sf).select("event_id", "value"), ["value"])
    return d.select("event_id", F.round("value", 9).alias("value"))


@query("clean_fill_median", _DQ + f"""SELECT event_id, round(CASE WHEN {_MISS} THEN
  (SELECT quantile_cont(value, 0.5) FROM events_dq WHERE NOT {_MISS}) ELSE value END, 9) AS value FROM events_dq""")
def q_clean_fill_median(spark, sf):
    d = cl.fill_median(_dq(spark, sf).select("event_id", "value"), ["value"])
    return d.select("event_id", F.round("value", 9).alias("value"))


@query("clean_ffill", _DQ + """SELECT event_id, user_id, ts, last_value(CASE WHEN isnan(value) THEN NULL ELSE value END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events_dq""")
def q_clean_ffill(spark, sf):
    d = _dq(spark, sf).select("event_id", "user_id", "ts",
                              F.when(F.isnan("value"), F.lit(None)).otherwise(F.col("value")).alias("value"))
    return cl.ffill(d, ["value"], ["user_id"], "ts", tie="event_id")


@query("clean_dedup", _DQ + "SELECT DISTINCT * FROM events_dq")
def q_clean_dedup(spark, sf):
    return cl.dedup(_dq(spark, sf))


@query("clean_dedup_first", """SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts,
  arg_min(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id""")
def q_clean_dedup_first(spark, sf):
    """Keep-first dedup by key: the earliest event per user."""
    ev = table(spark, sf, "events", ["user_id", "ts", "event_id", "event_type"])
    return cl.dedup(ev.withColumn("_o", F.struct("ts", "event_id")), ["user_id"], keep_first_by="_o").drop("_o")


@query("clean_cast", """SELECT event_id, TRY_CAST(CASE WHEN event_id % 25 = 0 THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS BIGINT) AS s,
  event_id % 25 = 0 AS cast_failed FROM events""")
def q_clean_cast(spark, sf):
    ev = table(spark, sf, "events", ["event_id", "user_id"])
    d = ev.select("event_id", F.when(F.col("event_id") % 25 == 0, "n/a").otherwise(F.col("user_id").cast("string")).alias("s"))
    return cl.safe_cast(d, "s", "bigint")


@query("clean_outliers", _DQ + f"""SELECT event_id, value FROM events_dq, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
  FROM events_dq WHERE NOT {_MISS}) q
WHERE NOT (NOT {_MISS} AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)))""")
def q_clean_outliers(spark, sf):
    return cl.outliers(_dq(spark, sf).select("event_id", "value"), ["value"], "remove")


@query("ingest_clean")
def q_ingest_clean(spark, sf):
    """validate → profile → clean by issue → features, one summary row."""
    from vigil.plans.ingest import ingest_clean
    return ingest_clean(_dq(spark, sf))


# ------------------------------------------------------------- features
_LI = "l_orderkey, l_linenumber"


@query("fe_square", f"SELECT {_LI}, round(pow(l_quantity, 2), 9) AS l_quantity_sq FROM lineitem")
def q_fe_square(spark, sf):
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"])
    return li.select("l_orderkey", "l_linenumber", F.round(fe.square("l_quantity"), 9).alias("l_quantity_sq"))


@query("fe_log1p_abs", f"SELECT {_LI}, round(ln(1 + abs(l_extendedprice - 30000)), 9) AS price_log FROM lineitem")
def q_fe_log1p_abs(spark, sf):
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice"])
    return li.select("l_orderkey", "l_linenumber",
                     F.round(F.log1p(F.abs(F.col("l_extendedprice") - 30000)), 9).alias("price_log"))


@query("fe_interaction", f"SELECT {_LI}, round(l_quantity * l_discount, 9) AS qty_x_disc FROM lineitem")
def q_fe_interaction(spark, sf):
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_discount"])
    return li.select("l_orderkey", "l_linenumber", F.round(fe.interaction("l_quantity", "l_discount"), 9).alias("qty_x_disc"))


@query("fe_ratio", f"SELECT {_LI}, round(l_extendedprice / (l_quantity + 1), 9) AS price_per_qty FROM lineitem")
def q_fe_ratio(spark, sf):
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"])
    return li.select("l_orderkey", "l_linenumber", F.round(fe.ratio("l_extendedprice", "l_quantity"), 9).alias("price_per_qty"))


@query("fe_date_parts", """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year,
  CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month, CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day FROM orders""")
def q_fe_date_parts(spark, sf):
    o = table(spark, sf, "orders", ["o_orderkey", "o_orderdate"])
    return fe.date_parts(o, "o_orderdate").drop("o_orderdate")


@query("fe_category_codes", """SELECT o_orderkey,
  CAST(coalesce(p.code, -1) AS BIGINT) AS o_orderpriority_code, CAST(coalesce(c.code, -1) AS BIGINT) AS o_custkey_code
FROM orders o
LEFT JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT o_orderpriority AS v FROM orders)) p ON p.v = o.o_orderpriority
LEFT JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT o_custkey AS v FROM orders)) c ON c.v = o.o_custkey""")
def q_fe_category_codes(spark, sf):
    o = table(spark, sf, "orders", ["o_orderkey", "o_orderpriority", "o_custkey"])
    o = fe.category_codes(o, "o_orderpriority")
    o = fe.category_codes(o, "o_custkey")
    return o.select("o_orderkey", "o_orderpriority_code", "o_custkey_code")


@query("fe_zscore", f"""SELECT {_LI}, round((l_quantity - m1) / (s1 + 1e-8), 9) AS l_quantity_z,
  round((l_extendedprice - m2) / (s2 + 1e-8), 9) AS l_extendedprice_z
FROM lineitem, (SELECT avg(l_quantity) AS m1, stddev_samp(l_quantity) AS s1, avg(l_extendedprice) AS m2,
  stddev_samp(l_extendedprice) AS s2 FROM lineitem)""")
def q_fe_zscore(spark, sf):
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"])
    z = fe.zscore(li, ["l_quantity", "l_extendedprice"])
    return z.select("l_orderkey", "l_linenumber", F.round("l_quantity_z", 9).alias("l_quantity_z"),
                    F.round("l_extendedprice_z", 9).alias("l_extendedprice_z"))


@query("fe_standard_scaler", f"""SELECT {_LI}, round((l_quantity - m) / s, 9) AS l_quantity_scaled FROM lineitem,
  (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01')
WHERE l_shipdate >= TIMESTAMP '1998-01-01'""")
def q_fe_standard_scaler(spark, sf):
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_shipdate"])
    train = li.filter(F.col("l_shipdate") < ts_lit("1998-01-01"))
    serve = li.filter(F.col("l_shipdate") >= ts_lit("1998-01-01")).drop("l_shipdate")
    params = fe.scaler_fit(train, ["l_quantity"])
    t = fe.scaler_transform(serve, params, ["l_quantity"])
    return t.select("l_orderkey", "l_linenumber", F.round("l_quantity_scaled", 9).alias("l_quantity_scaled"))


@query("fe_one_hot", """SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS o_orderstatus_F,
  CAST(o_orderstatus = 'O' AS INTEGER) AS o_orderstatus_O, CAST(o_orderstatus = 'P' AS INTEGER) AS o_orderstatus_P FROM orders""")
def q_fe_one_hot(spark, sf):
    o = table(spark, sf, "orders", ["o_orderkey", "o_orderstatus"])
    return fe.one_hot_columns(o, "o_orderstatus").drop("o_orderstatus")


@query("fe_window_counts", """SELECT event_id, user_id, ts,
  count(*) FILTER (WHERE event_type = 'view') OVER w AS page_views_1h,
  count(*) FILTER (WHERE event_type = 'click') OVER w AS clicks_1h,
  count(*) FILTER (WHERE event_type = 'purchase') OVER w AS purchases_1h,
  count(*) OVER w AS events_1h
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)""")
def q_fe_window_counts(spark, sf):
    ev = table(spark, sf, "events", ["event_id", "user_id", "ts", "event_type"])
    t = F.col("event_type")
    aggs = {"page_views_1h": F.count(F.when(t == "view", 1)), "clicks_1h": F.count(F.when(t == "click", 1)),
            "purchases_1h": F.count(F.when(t == "purchase", 1)), "events_1h": F.count(F.lit(1))}
    r = fe.range_window_agg(ev, ["user_id"], "ts", 3600, aggs)
    return r.select("event_id", "user_id", "ts", *[F.col(c).cast("long").alias(c) for c in aggs])


@query("fe_user_profile", """SELECT user_id, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'purchase') AS n_purchases,
  round(coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0.0), 6) AS lifetime_value, round(avg(value), 9) AS avg_value,
  count(DISTINCT event_type) AS n_types, min(ts) AS first_seen, max(ts) AS last_seen, count(DISTINCT CAST(ts AS DATE)) AS active_days
FROM events GROUP BY user_id""")
def q_fe_user_profile(spark, sf):
    return fe.user_profile(table(spark, sf, "events"))


@query("split_train_val")
def q_split_train_val(spark, sf):
    return fe.hash_split(table(spark, sf, "orders", ["o_orderkey", "o_totalprice"]), "o_orderkey", 0.2, 42) \
        .groupBy("split").agg(F.count(F.lit(1)).alias("n"))

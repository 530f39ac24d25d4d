"""§2.12 streaming queries.  Each runs a Structured Streaming job over the
events parquet (file stream, availableNow) and returns the sink; the
oracle SQL is the batch twin, which keeps only windows the final watermark
(max event time − 10 minutes) has closed."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.core import instant_to_ntz, ntz_to_instant, ts_lit
from vigil.operators.features import sliding_rate
from vigil.plans.registry import query
from vigil.sources import sinks as sk
from vigil.sources.readers import table
from vigil.sources.versioned import VersionedTable
from vigil.streaming import breaches as br
from vigil.streaming import jobs as st

_WM = "(SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM events) mx"


@query("src_stream_files", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def q_src_stream_files(spark, sf):
    s = st.event_stream(spark, sf)
    out = st.run_to_table(s.drop("ets"), "files")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("src_stream_kafka")
def q_src_stream_kafka(spark, sf):
    """The broker path's decoding step (``parse_json_value``) on a file
    stream of JSON text values; no broker runs here."""
    from vigil.sources.readers import parse_json_value
    d = sk.scratch_dir(spark, "kafka-text")
    table(spark, sf, "events").select(F.to_json(F.struct("*")).alias("value")).write.text(d)
    raw = spark.readStream.schema("value string").text(d)
    parsed = parse_json_value(raw, st.EVENTS_SCHEMA)
    return st.run_to_table(parsed, "kafka")


@query("st_profile", f"""SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
  event_type, count(*) AS n, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 9) AS null_rate,
  round(avg(value), 9) AS mean, round(var_samp(value), 6) AS variance
FROM events, {_WM} WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= wm GROUP BY 1, 2, 3""")
def q_st_profile(spark, sf):
    return st.run_to_table(st.windowed_profile(st.event_stream(spark, sf)), "profile")


@query("st_behavior_1h", f"""WITH b AS (SELECT user_id, event_type,
  time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(5 * k) AS window_start FROM events, unnest(range(12)) t(k))
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, user_id,
  count(*) FILTER (WHERE event_type = 'view') AS page_views, count(*) FILTER (WHERE event_type = 'click') AS clicks,
  count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) AS events
FROM b, {_WM} WHERE window_start + INTERVAL 1 HOUR <= wm GROUP BY 1, 2, 3""")
def q_st_behavior_1h(spark, sf):
    return st.sliding_behaviour(st.event_stream(spark, sf))


@query("st_sessions", f"""WITH o AS (SELECT user_id, ts, event_type,
  CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
        OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new_s FROM events),
s AS (SELECT *, sum(new_s) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM o),
g AS (SELECT user_id, sid, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events,
  count(*) FILTER (WHERE event_type = 'view') AS n_views, count(*) FILTER (WHERE event_type = 'purchase') AS n_purchases
  FROM s GROUP BY user_id, sid)
SELECT session_start, session_end, user_id, n_events, n_views, n_purchases FROM g, {_WM} WHERE session_end <= wm""")
def q_st_sessions(spark, sf):
    return st.run_to_table(st.sessions(st.event_stream(spark, sf)), "sessions")


SPLIT = "2024-01-16"


@query("st_drift_psi", f"""WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events WHERE ts < TIMESTAMP '{SPLIT}'),
rb AS (SELECT CAST(least(greatest(floor(CAST(10 AS DOUBLE) * (value - lo) / (hi - lo)), 0), 9) AS INTEGER) AS bin, count(*) AS rn
       FROM events, r WHERE ts < TIMESTAMP '{SPLIT}' GROUP BY 1),
rt AS (SELECT sum(rn) AS rtot FROM rb),
cb AS (SELECT date_trunc('day', ts) AS window_start, CAST(least(greatest(floor(CAST(10 AS DOUBLE) * (value - lo) / (hi - lo)), 0), 9) AS INTEGER) AS bin,
       count(*) AS n FROM events, r, {_WM} WHERE ts >= TIMESTAMP '{SPLIT}' AND date_trunc('day', ts) + INTERVAL 1 DAY <= wm GROUP BY 1, 2),
sp AS (SELECT DISTINCT window_start, CAST(unnest(range(10)) AS INTEGER) AS bin FROM cb),
j AS (SELECT sp.window_start, sp.bin, coalesce(cb.n, 0) AS n, coalesce(rb.rn, 0) AS rn FROM sp
      LEFT JOIN cb USING (window_start, bin) LEFT JOIN rb USING (bin)),
t AS (SELECT window_start, sum(n) AS tot FROM j GROUP BY 1),
x AS (SELECT j.window_start, CASE WHEN CAST(rn AS DOUBLE) / rtot = 0 THEN 1e-4 ELSE CAST(rn AS DOUBLE) / rtot END AS p,
      CASE WHEN CAST(n AS DOUBLE) / tot = 0 THEN 1e-4 ELSE CAST(n AS DOUBLE) / tot END AS q FROM j JOIN t USING (window_start), rt)
SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, round(sum((q - p) * ln(q / p)), 9) AS psi,
  sum((q - p) * ln(q / p)) > 0.1 AS drifted FROM x GROUP BY 1""")
def q_st_drift_psi(spark, sf):
    """Days after the split, each scored by the stream as it closes."""
    ref = table(spark, sf, "events", ["ts", "value"]).filter(F.col("ts") < ts_lit(SPLIT))
    lo, hi, shares = st.reference_shares(ref, "value")
    cur = st.event_stream(spark, sf).filter(F.col("ts") >= ts_lit(SPLIT))
    return st.run_to_table(st.windowed_psi(cur, "value", lo, hi, shares), "psi")


_BUCKETS = ", ".join(f"count(*) FILTER (WHERE value / 1000.0 <= {b}) AS {st.bucket_name(b)}" for b in st.LATENCY_BUCKETS)


@query("st_request_metrics", f"""SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
  event_type AS model, count(*) AS n_requests, count(*) FILTER (WHERE value > 250) AS n_errors, {_BUCKETS}
FROM events, {_WM} WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= wm GROUP BY 1, 2, 3""")
def q_st_request_metrics(spark, sf):
    return st.run_to_table(st.request_metrics(st.as_requests(st.event_stream(spark, sf))), "requests")


@query("st_request_labels", f"""SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
  event_type AS model, 'v' || (user_id % 3) AS version, CASE WHEN event_id % 2 = 0 THEN 'predict' ELSE 'explain' END AS endpoint,
  CASE WHEN value > 250 THEN 'error' ELSE 'ok' END AS status, count(*) AS n_requests, count(*) FILTER (WHERE value > 250) AS n_errors,
  round(sum(value / 1000.0), 6) AS latency_sum_s, {_BUCKETS}
FROM events, {_WM} WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= wm GROUP BY 1, 2, 3, 4, 5, 6""")
def q_st_request_labels(spark, sf):
    """Request counter and latency histogram by model, version, endpoint and status."""
    r = st.as_requests(st.event_stream(spark, sf))
    return st.run_to_table(st.request_metrics(r, labels=("model", "version", "endpoint", "status")), "request-labels")


@query("st_profile_sketches")
def q_st_profile_sketches(spark, sf):
    """Sketches of every closed hour, merged per day and type: approximate
    quantiles and distinct users (tested against the exact ones)."""
    from vigil.operators.profile import merge_sketches
    hours = st.run_to_table(st.windowed_sketches(st.event_stream(spark, sf)), "sketches")
    return merge_sketches(hours.withColumn("day", F.to_date("window_start")), ["event_type", "day"])


@query("st_request_p95")
def q_st_request_p95(spark, sf):
    return st.run_to_table(st.request_p95(st.as_requests(st.event_stream(spark, sf))), "p95")


@query("st_dedup", """SELECT DISTINCT event_id, ts, user_id, CASE WHEN event_id % 25 = 0 THEN '??' ELSE event_type END AS event_type
FROM events""")
def q_st_dedup(spark, sf):
    from vigil.plans.fixtures import events_defects
    d = sk.scratch_dir(spark, "dupes")
    events_defects(spark, sf).write.parquet(d + "/events_dq")
    s = st.event_stream(spark, d + "/events_dq", name="part")
    out = st.run_to_table(st.dedup_within_watermark(s).drop("ets"), "dedup")
    return out.select("event_id", "ts", "user_id", "event_type")


def replay(spark, sf, groups: int = 7):
    """Late-arrival replay: step k appends the events with event_id % 7 = k,
    as range-partitioned files, to a folder and yields the folder.  A stream
    run after each step, with one checkpoint, reads only the new files."""
    d = sk.scratch_dir(spark, "replay")
    ev = table(spark, sf, "events")
    for k in range(groups):
        ev.filter(F.col("event_id") % groups == k).repartitionByRange("ts").write.mode("append").parquet(d)
        yield d


@query("st_late", """WITH e AS (SELECT ts, event_id % 7 AS k, date_trunc('hour', ts) AS window_start FROM events),
m AS (SELECT k, max(ts) AS top FROM e GROUP BY k),
w AS (SELECT a.k, max(b.top) - INTERVAL 10 MINUTE AS wm FROM m a LEFT JOIN m b ON b.k < a.k GROUP BY a.k),
l AS (SELECT e.*, coalesce(window_start + INTERVAL 1 HOUR <= w.wm, false) AS late FROM e JOIN w USING (k))
SELECT window_start, count(*) FILTER (WHERE NOT late) AS n, count(*) FILTER (WHERE late) AS n_late FROM l
WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)
GROUP BY 1 HAVING count(*) FILTER (WHERE NOT late) > 0""")
def q_st_late(spark, sf):
    """Hourly counts over the replay: rows behind the watermark of the steps
    before are dropped; ``n_late`` is what the closed window misses."""
    home = sk.scratch_dir(spark, "late")
    for d in replay(spark, sf):
        s = st.event_stream(spark, d, name="part")
        agg = s.withWatermark("ets", "10 minutes").groupBy(F.window("ets", "1 hour")).agg(F.count(F.lit(1)).alias("n"))
        out = st.run_to_table(agg.select(instant_to_ntz("window.start").alias("window_start"), "n"), "late", folder=home)
    whole = table(spark, sf, "events", ["ts"]).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("window_start")) \
        .agg(F.count(F.lit(1)).alias("total"))
    return out.join(whole, "window_start").select("window_start", "n", (F.col("total") - F.col("n")).alias("n_late"))


_LABELS = """SELECT p.event_id AS pred_id, p.user_id, p.ts AS pred_ts, l.event_id AS label_id, l.ts AS label_ts
FROM p {how} JOIN l ON p.user_id = l.user_id AND l.ts >= p.ts AND l.ts <= p.ts + INTERVAL 2 HOUR"""
_SIDES = """WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), l AS (SELECT * FROM events WHERE event_type = 'click'),
wm AS (SELECT least((SELECT max(ts) FROM p), (SELECT max(ts) FROM l)) - INTERVAL 10 MINUTE AS wm)
"""


def _sides(spark, sf):
    s = st.event_stream(spark, sf)
    return s.filter("event_type = 'purchase'"), s.filter("event_type = 'click'")


@query("st_label_join", _SIDES + f"SELECT x.* FROM ({_LABELS.format(how='LEFT')}) x, wm "
       "WHERE label_id IS NOT NULL OR pred_ts + INTERVAL 2 HOUR < wm")
def q_st_label_join(spark, sf):
    """Every prediction whose interval is over, and every label match."""
    return st.run_to_table(st.label_join(*_sides(spark, sf)), "labels")


@query("st_label_join_inner", _SIDES + _LABELS.format(how=""))
def q_st_label_join_inner(spark, sf):
    return st.run_to_table(st.label_join(*_sides(spark, sf), how="inner"), "labels-inner")


@query("st_online_upsert", """SELECT user_id, ts, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type = 'view')
WHERE rn = 1""")
def q_st_online_upsert(spark, sf):
    """Seven steps of late and early events, merged batch by batch into the
    buckets that each batch touches."""
    home, online = sk.scratch_dir(spark, "upsert"), VersionedTable(spark, sk.scratch_dir(spark, "online"), ["user_id"], buckets=16)
    for d in replay(spark, sf):
        s = st.event_stream(spark, d, name="part").filter("event_type = 'view'").select("user_id", "ts", "event_id", "value")
        st.run_foreach(s, "upsert", st.online_upsert(online, "ts", tie="event_id"), folder=home)
    return online.read()


@query("st_rate_limit", f"""SELECT date_trunc('minute', ts) AS window_start, date_trunc('minute', ts) + INTERVAL 1 MINUTE AS window_end,
  user_id, count(*) AS n FROM events, {_WM} WHERE date_trunc('minute', ts) + INTERVAL 1 MINUTE <= wm GROUP BY 1, 2, 3
HAVING count(*) > 1""")
def q_st_rate_limit(spark, sf):
    return st.run_to_table(st.rate_limit(st.event_stream(spark, sf), "user_id", 1), "ratelimit")


@query("st_rate_sliding", """SELECT event_id, user_id, ts, n_recent FROM (SELECT event_id, user_id, ts,
  count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 59999999 MICROSECOND PRECEDING AND CURRENT ROW) AS n_recent
  FROM events) WHERE n_recent > 1""")
def q_st_rate_sliding(spark, sf):
    """Requests above one a key in the 60 seconds up to them."""
    ev = table(spark, sf, "events", ["event_id", "user_id", "ts"])
    return sliding_rate(ev, ["user_id"], "ts", 1).filter("limited").drop("limited")


@query("st_consecutive_breach", """WITH r AS (SELECT event_type AS model_name, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts,
  abs(avg(value) - 250) > 20 AS breach FROM events GROUP BY 1, 2),
f AS (SELECT r.* FROM r, (SELECT max(ts) - INTERVAL 1 DAY AS wm FROM r) WHERE ts <= wm),
n AS (SELECT *, breach AND coalesce(ts <= lag(ts) OVER (PARTITION BY model_name ORDER BY ts) + INTERVAL 7 DAY, true) AS goes_on FROM f),
g AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY model_name ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM n),
s AS (SELECT *, sum(CASE WHEN breach THEN 1 ELSE 0 END) OVER (PARTITION BY model_name, grp ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS streak FROM g)
SELECT model_name, ts, CAST(streak AS BIGINT) AS streak FROM s WHERE breach AND streak >= 3""")
def q_st_consecutive_breach(spark, sf):
    """Daily breach series (|daily mean value − 250| > 20) per event type,
    streamed in two batches, the odd days first; alert rows from the third
    consecutive breach on, of the days that the watermark has passed."""
    ev = table(spark, sf, "events", ["event_type", "ts", "value"])
    daily = ev.groupBy(F.col("event_type").alias("model_name"), F.to_date("ts").cast("timestamp_ntz").alias("ts")) \
        .agg((F.abs(F.avg("value") - 250) > 20).alias("breach"))
    d, home = sk.scratch_dir(spark, "breach"), sk.scratch_dir(spark, "breaches")
    for odd in (1, 0):
        daily.filter(F.dayofyear("ts") % 2 == odd).write.mode("append").parquet(d)
        s = spark.readStream.schema("model_name string, ts timestamp_ntz, breach boolean").parquet(d).withColumn("ets", ntz_to_instant("ts"))
        # the odd days run up to the last one: a delay of all days keeps the even ones in time, and a day closes the series
        delay = "400 days" if odd else "1 day"
        out = st.run_to_table(br.consecutive_breaches(s, "model_name", "ets", "breach", 3, delay), "breach", conf=br.ROCKSDB, folder=home)
    return out


QUAR = {"value_present": "value IS NOT NULL AND NOT isnan(value)", "known_type": "event_type <> '??'"}


@query("st_quality_gate", """WITH d AS (SELECT CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value,
  CASE WHEN event_id % 25 = 0 THEN '??' ELSE event_type END AS event_type FROM events)
SELECT CASE WHEN value IS NOT NULL AND event_type <> '??' THEN 'good' ELSE 'quarantine' END AS sink, count(*) AS n FROM d GROUP BY 1""")
def q_st_quality_gate(spark, sf):
    ev = table(spark, sf, "events")
    d = sk.scratch_dir(spark, "gate-in")
    ev.select("event_id", "ts", "user_id",
              F.when(F.col("event_id") % 25 == 0, "??").otherwise(F.col("event_type")).alias("event_type"),
              F.when(F.col("event_id") % 10 == 0, F.lit(None).cast("double")).otherwise(F.col("value")).alias("value"),
              "props").write.parquet(d)
    s = st.event_stream(spark, d, name="part")
    good, bad = sk.scratch_dir(spark, "gate-good"), sk.scratch_dir(spark, "gate-bad")
    st.run_foreach(s, "gate", st.quality_gate(QUAR, good, bad))
    g = spark.read.parquet(good).select(F.lit("good").alias("sink"))
    b = spark.read.parquet(bad).select(F.lit("quarantine").alias("sink"))
    # (batch_id partitions are read back as one table)
    return g.unionByName(b).groupBy("sink").agg(F.count(F.lit(1)).alias("n"))

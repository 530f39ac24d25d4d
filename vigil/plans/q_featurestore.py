"""§2.8 feature-store queries on the events table.

Entity rows are purchase events (``event_id, user_id, event_ts``); the
feature view is the view events of the same user (``feature_ts``,
``view_value``, tie-broken by ``event_id``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.core import ts_lit
from vigil.operators import featurestore as fs
from vigil.plans.registry import query
from vigil.sources.readers import table
from vigil.sources.versioned import VersionedTable

DAY = 86400
SPLIT = "2024-01-16"
AS_OF = "2024-02-01"


def _entities(spark, sf):
    ev = table(spark, sf, "events", ["event_id", "user_id", "event_type", "ts"])
    return ev.filter("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("event_ts"))


def _view(spark, sf, etype="view", name="view_value"):
    ev = table(spark, sf, "events", ["event_id", "user_id", "event_type", "ts", "value"])
    return ev.filter(F.col("event_type") == etype).select(
        "user_id", F.col("ts").alias("feature_ts"), F.col("event_id").alias("f_id"),
        F.col("value").alias(name))


_E = "e AS (SELECT event_id, user_id, ts AS event_ts FROM events WHERE event_type = 'purchase')"
_F = ("f AS (SELECT user_id, ts AS feature_ts, event_id AS f_id, value AS view_value "
      "FROM events WHERE event_type = 'view')")
_PIT = f"""WITH {_E}, {_F},
m AS (SELECT e.event_id, e.user_id, e.event_ts, f.feature_ts, f.view_value,
             row_number() OVER (PARTITION BY e.event_id ORDER BY f.feature_ts DESC, f.f_id DESC) AS rn
      FROM e LEFT JOIN f ON f.user_id = e.user_id AND f.feature_ts <= e.event_ts)"""


@query("pit_join", _PIT + "\nSELECT event_id, user_id, event_ts, feature_ts, view_value FROM m WHERE rn = 1")
def q_pit_join(spark, sf):
    return fs.pit_join(_entities(spark, sf), _view(spark, sf), ["user_id"], "event_ts", "feature_ts",
                       ["view_value"], tie="f_id")


_TTL_SQL = _PIT + """
SELECT event_id, user_id, event_ts,
       CASE WHEN feature_ts >= event_ts - INTERVAL 7 DAY THEN feature_ts END AS feature_ts,
       CASE WHEN feature_ts >= event_ts - INTERVAL 7 DAY THEN view_value END AS view_value
FROM m WHERE rn = 1"""


def pit_ttl(spark, sf, bucket_seconds=DAY):
    return fs.pit_join(_entities(spark, sf), _view(spark, sf), ["user_id"], "event_ts", "feature_ts",
                       ["view_value"], ttl_seconds=7 * DAY, tie="f_id", bucket_seconds=bucket_seconds)


@query("pit_join_ttl", _TTL_SQL)
def q_pit_join_ttl(spark, sf):
    return pit_ttl(spark, sf)


def flagship(spark, sf):
    """pit_join_ttl, then a per-column profile of the joined frame."""
    from vigil.operators.profile import profile_numeric
    return profile_numeric(pit_ttl(spark, sf), ["user_id", "view_value"])


_MULTI_SQL = f"""WITH {_E},
v AS (SELECT user_id, ts AS feature_ts, event_id AS f_id, value AS view_value FROM events
      WHERE event_type = 'view' AND ts < TIMESTAMP '{SPLIT}'
      UNION ALL
      SELECT user_id, ts, event_id, value FROM events
      WHERE event_type = 'view' AND ts >= TIMESTAMP '{SPLIT}'),
c AS (SELECT user_id, ts AS feature_ts, event_id AS f_id, value AS click_value FROM events WHERE event_type = 'click'),
mv AS (SELECT e.event_id, v.feature_ts, v.view_value,
              row_number() OVER (PARTITION BY e.event_id ORDER BY v.feature_ts DESC, v.f_id DESC) AS rn
       FROM e LEFT JOIN v ON v.user_id = e.user_id AND v.feature_ts <= e.event_ts),
mc AS (SELECT e.event_id, c.feature_ts, c.click_value,
              row_number() OVER (PARTITION BY e.event_id ORDER BY c.feature_ts DESC, c.f_id DESC) AS rn
       FROM e LEFT JOIN c ON c.user_id = e.user_id AND c.feature_ts <= e.event_ts)
SELECT e.event_id, e.user_id, e.event_ts,
       CASE WHEN mv.feature_ts >= e.event_ts - INTERVAL 7 DAY THEN mv.feature_ts END AS views__feature_ts,
       CASE WHEN mv.feature_ts >= e.event_ts - INTERVAL 7 DAY THEN mv.view_value END AS views__view_value,
       CASE WHEN mc.feature_ts >= e.event_ts - INTERVAL 1 DAY THEN mc.feature_ts END AS clicks__feature_ts,
       CASE WHEN mc.feature_ts >= e.event_ts - INTERVAL 1 DAY THEN mc.click_value END AS clicks__click_value
FROM e JOIN mv ON mv.event_id = e.event_id AND mv.rn = 1
       JOIN mc ON mc.event_id = e.event_id AND mc.rn = 1"""


@query("pit_join_multi", _MULTI_SQL)
def q_pit_join_multi(spark, sf):
    v = _view(spark, sf)
    hist = v.filter(F.col("feature_ts") < ts_lit(SPLIT))
    fresh = v.filter(F.col("feature_ts") >= ts_lit(SPLIT))
    clicks = _view(spark, sf, "click", "click_value")
    views = [
        {"name": "views", "sources": [hist, fresh], "ts": "feature_ts", "features": ["view_value"],
         "ttl": 7 * DAY, "tie": "f_id"},
        {"name": "clicks", "sources": [clicks], "ts": "feature_ts", "features": ["click_value"],
         "ttl": DAY, "tie": "f_id"},
    ]
    return fs.pit_join_multi(_entities(spark, sf), views, ["user_id"], "event_ts")


@query("feature_select", "SELECT user_id, value, ts FROM events WHERE event_type = 'view'")
def q_feature_select(spark, sf):
    ev = table(spark, sf, "events").filter("event_type = 'view'").drop("event_type")
    return fs.feature_select(ev, ["user_id"], ["value", "ts"])


_LATEST_SQL = """SELECT user_id, ts, event_id, value, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events WHERE event_type = 'view' {cond}) WHERE rn = 1"""


def _latest_views(spark, sf, start=None, end=None):
    ev = table(spark, sf, "events", ["user_id", "ts", "event_id", "value", "event_type"]) \
        .filter("event_type = 'view'")
    return fs.latest_per_key(ev, ["user_id"], "ts", "event_id",
                             ts_lit(start) if start else None, ts_lit(end) if end else None)


@query("materialize", _LATEST_SQL.format(
    cond="AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'"))
def q_materialize(spark, sf):
    return _latest_views(spark, sf, "2024-01-05", "2024-01-20")


@query("materialize_incremental", _LATEST_SQL.format(cond=""))
def q_materialize_incremental(spark, sf):
    ev = table(spark, sf, "events", ["user_id", "ts", "event_id", "value", "event_type"]) \
        .filter("event_type = 'view'")
    old = fs.latest_per_key(ev.filter(F.col("ts") < ts_lit(SPLIT)), ["user_id"], "ts", "event_id")
    new = ev.filter(F.col("ts") >= ts_lit(SPLIT))
    return fs.materialize_incremental(old, new, ["user_id"], "ts", "event_id")


@query("online_lookup", """
WITH l AS (""" + _LATEST_SQL.format(cond="") + """)
SELECT c.c_custkey AS user_id, coalesce(CAST(l.value AS DOUBLE), 0.0) AS value,
       coalesce(l.event_type, 'unknown') AS event_type
FROM customer c LEFT JOIN l ON l.user_id = c.c_custkey""")
def q_online_lookup(spark, sf):
    ents = table(spark, sf, "customer", ["c_custkey"]).select(F.col("c_custkey").alias("user_id"))
    latest = _latest_views(spark, sf)
    return fs.online_lookup(ents, latest, ["user_id"], ["value", "event_type"])


_FS_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("feature_stats", " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 9) AS mean,
       round(stddev_samp({c}), 9) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
       count(*) FILTER (WHERE {c} IS NULL OR isnan({c})) AS missing,
       count(*) FILTER (WHERE {c} = 0) AS zeros FROM lineitem""" for c in _FS_COLS))
def q_feature_stats(spark, sf):
    return fs.feature_stats(table(spark, sf, "lineitem", _FS_COLS), _FS_COLS)


@query("feature_skew", f"""
WITH off AS ({_LATEST_SQL.format(cond="")}),
onl AS ({_LATEST_SQL.format(cond="AND ts < TIMESTAMP '2024-01-25'")}),
j AS (SELECT off.value AS a, onl.value AS b FROM off FULL OUTER JOIN onl ON off.user_id = onl.user_id)
SELECT 'value' AS feature, count(*) AS n_keys,
       count(*) FILTER (WHERE NOT (a IS NOT NULL AND b IS NOT NULL AND abs(a - b) <= 1e-9)) AS n_mismatch,
       round(count(*) FILTER (WHERE NOT (a IS NOT NULL AND b IS NOT NULL AND abs(a - b) <= 1e-9)) / count(*), 9) AS mismatch_rate
FROM j""")
def q_feature_skew(spark, sf):
    offline = _latest_views(spark, sf)
    online = _latest_views(spark, sf, end="2024-01-24 23:59:59.999999")
    return fs.feature_skew(offline, online, ["user_id"], ["value"])


@query("feature_freshness", f"""SELECT event_type AS feature_set, max(ts) AS latest_ts,
  CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(ts))) / 1e6) AS BIGINT) AS age_seconds,
  round((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(ts))) / 3.6e9, 6) AS age_hours FROM events GROUP BY event_type""")
def q_feature_freshness(spark, sf):
    ev = table(spark, sf, "events", ["event_type", "ts"])
    return fs.feature_freshness(ev, "event_type", "ts", ts_lit(AS_OF))


@query("feature_write", """SELECT 'online' AS sink, count(DISTINCT user_id) AS n_rows FROM events WHERE event_type = 'view'
UNION ALL SELECT 'warehouse', count(*) FROM events WHERE event_type = 'view'
UNION ALL SELECT 'offline', count(*) FROM events WHERE event_type = 'view'""")
def q_feature_write(spark, sf):
    """Validated write of the view-feature batch to online, warehouse and
    offline sinks; returns the row count each sink holds afterwards."""
    import uuid
    from vigil.sources import sinks as sk
    ev = table(spark, sf, "events", ["user_id", "ts", "event_id", "value", "event_type"]).filter("event_type = 'view'")
    batch = ev.select("user_id", "ts", "event_id", "value")
    online, offline = VersionedTable(spark, sk.scratch_dir(spark, "online"), ["user_id"], buckets=16), sk.scratch_dir(spark, "offline")
    name = f"vigil_fw_{uuid.uuid4().hex[:8]}"
    sk.create_table(spark, name, "user_id bigint, ts timestamp_ntz, event_id bigint, value double, batch_id int", ["batch_id"],
                    location=sk.scratch_dir(spark, "wh"))
    expected = {"user_id": "integer", "ts": "datetime", "event_id": "integer", "value": "float"}
    for _ in range(2):  # the second write is a retry: no sink gains a row
        fs.feature_write(batch, expected, ["user_id"], "ts", online, name, offline, batch_id=0)
    n = F.count(F.lit(1)).alias("n_rows")
    return (online.read().agg(n).select(F.lit("online").alias("sink"), "n_rows")
            .unionByName(spark.table(name).agg(n).select(F.lit("warehouse").alias("sink"), "n_rows"))
            .unionByName(spark.read.parquet(offline).agg(n).select(F.lit("offline").alias("sink"), "n_rows")))

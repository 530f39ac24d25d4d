"""§2.13 alert and retraining queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import alerts as al
from vigil.plans.fixtures import DQ_CHECKS_SQL, DRIFT_RUNS_SQL, dq_checks, drift_runs
from vigil.plans.registry import query
from vigil.sources.readers import table


def daily_metrics(spark, sf):
    """Wide metric row per (model = event type, day): drift score, accuracy
    (share of requests under 60 ms) and run status (failed when any request
    took over 400 ms)."""
    ev = table(spark, sf, "events", ["event_type", "ts", "value"])
    m = ev.groupBy(F.col("event_type").alias("model_name"), F.to_date("ts").cast("timestamp_ntz").alias("ts")).agg(
        F.avg((F.col("value") < 60).cast("double")).alias("accuracy"),
        F.when(F.count_if(F.col("value") > 400) > 0, "failed").otherwise("ok").alias("status"))
    return m.join(drift_runs(spark, sf).select("model_name", "ts", "drift_score"), ["model_name", "ts"], "left")


_DAILY = f"""{DRIFT_RUNS_SQL},
dm AS (SELECT m.*, d.drift_score FROM (SELECT event_type AS model_name, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts,
  avg(CASE WHEN value < 60 THEN 1.0 ELSE 0.0 END) AS accuracy,
  CASE WHEN count(*) FILTER (WHERE value > 400) > 0 THEN 'failed' ELSE 'ok' END AS status FROM events GROUP BY 1, 2) m
  LEFT JOIN drift_runs d USING (model_name, ts))"""


@query("alert_rules", f"""WITH {_DAILY},
r AS (SELECT model_name, ts, 'data_drift_detected' AS rule, 'high' AS severity, ['slack', 'email'] AS ch FROM dm WHERE coalesce(drift_score > 0.1, false)
  UNION ALL SELECT model_name, ts, 'model_performance_degradation', 'critical', ['slack', 'email', 'pagerduty'] FROM dm WHERE coalesce(accuracy < 0.7, false)
  UNION ALL SELECT model_name, ts, 'pipeline_failed', 'medium', ['slack'] FROM dm WHERE coalesce(status = 'failed', false))
SELECT model_name, ts, rule, severity, unnest(ch) AS channel FROM r""")
def q_alert_rules(spark, sf):
    return al.evaluate_rules(daily_metrics(spark, sf), al.DEFAULT_RULES, ["model_name"], "ts")


def _error_alerts(spark, sf):
    ev = table(spark, sf, "events", ["user_id", "ts", "event_type", "value"]).filter("event_type = 'error'")
    sev = (F.when(F.col("value") > 200, "critical").when(F.col("value") > 100, "high")
           .when(F.col("value") > 50, "medium").otherwise("low"))
    return ev.select("user_id", "ts", sev.alias("severity"))


@query("alert_cooldown", """WITH RECURSIVE u AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i
  FROM (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'error')),
k(user_id, ts, i, last, kept) AS (SELECT user_id, ts, i, ts, TRUE FROM u WHERE i = 1
  UNION ALL SELECT u.user_id, u.ts, u.i, CASE WHEN u.ts >= k.last + INTERVAL 30 MINUTE THEN u.ts ELSE k.last END,
    u.ts >= k.last + INTERVAL 30 MINUTE FROM k JOIN u ON u.user_id = k.user_id AND u.i = k.i + 1)
SELECT user_id, ts FROM k WHERE kept""")
def q_alert_cooldown(spark, sf):
    """Error-event alerts per user with a 30-minute cooldown."""
    return al.cooldown(_error_alerts(spark, sf), ["user_id"], "ts", 30)


@query("alert_quiet_hours", """SELECT user_id, ts, CASE WHEN value > 200 THEN 'critical' WHEN value > 100 THEN 'high'
  WHEN value > 50 THEN 'medium' ELSE 'low' END AS severity, hour(ts) >= 22 OR hour(ts) < 8 AS quiet,
  CASE WHEN value > 200 THEN 'email,slack,webhook' WHEN value > 100 THEN 'slack,webhook' WHEN value > 50 THEN 'webhook' ELSE '' END AS channels
FROM events WHERE event_type = 'error'""")
def q_alert_quiet_hours(spark, sf):
    q = al.quiet_hours(_error_alerts(spark, sf), "ts")
    return q.withColumn("channels", F.concat_ws(",", "channels"))


@query("retrain_triggers", f"""WITH RECURSIVE {_DAILY},
d AS (SELECT model_name, CAST(ts AS DATE) AS day, 'drift' AS trigger FROM drift_runs WHERE drift_score > 0.1),
a AS (SELECT model_name, CAST(ts AS DATE) AS day, avg(accuracy) OVER (PARTITION BY model_name ORDER BY CAST(ts AS DATE)
  RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS acc7 FROM dm),
p AS (SELECT model_name, day, 'performance' AS trigger FROM a WHERE acc7 < 0.7),
u AS (SELECT *, row_number() OVER (PARTITION BY model_name, trigger ORDER BY day) AS i FROM
  (SELECT DISTINCT * FROM (SELECT * FROM d UNION ALL SELECT * FROM p))),
k(model_name, trigger, i, day, last, kept) AS (SELECT model_name, trigger, i, day, day, TRUE FROM u WHERE i = 1
  UNION ALL SELECT u.model_name, u.trigger, u.i, u.day,
    CASE WHEN u.day - k.last >= CASE WHEN u.trigger = 'drift' THEN 1 ELSE 2 END THEN u.day ELSE k.last END,
    u.day - k.last >= CASE WHEN u.trigger = 'drift' THEN 1 ELSE 2 END
  FROM k JOIN u ON u.model_name = k.model_name AND u.trigger = k.trigger AND u.i = k.i + 1)
SELECT model_name, day, trigger FROM k WHERE kept
UNION ALL SELECT model_name, CAST(ts AS DATE), 'schedule' FROM dm WHERE dayofweek(ts) = 1""")
def q_retrain_triggers(spark, sf):
    m = daily_metrics(spark, sf).withColumn("day", F.to_date("ts"))
    return al.retrain_triggers(drift_runs(spark, sf), m.select("model_name", "day", "accuracy"),
                               m.select("model_name", "day"))


@query("gate_failure_rate", f"""WITH {DQ_CHECKS_SQL}
SELECT dataset, count(*) AS n_checks, count(*) FILTER (WHERE status = 'failed') AS n_failed,
  round(CAST(count(*) FILTER (WHERE status = 'failed') AS DOUBLE) / count(*), 9) AS failure_rate,
  CAST(count(*) FILTER (WHERE status = 'failed') AS DOUBLE) / count(*) > 0.01 AS gate_failed FROM dq_checks GROUP BY dataset""")
def q_gate_failure_rate(spark, sf):
    return al.failure_rate_gate(dq_checks(spark, sf))

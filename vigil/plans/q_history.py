"""§2.10 history, trend and anomaly queries over the run-history fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import history as hi
from vigil.plans.fixtures import DQ_CHECKS_SQL, DQ_RUNS_SQL, dq_checks, dq_runs
from vigil.plans.registry import query


def _runs(spark, sf):
    return dq_runs(spark, sf).withColumn("pass_rate", F.col("passed") / (F.col("passed") + F.col("failed")))


_R = f"WITH {DQ_RUNS_SQL},\nrr AS (SELECT *, CAST(passed AS DOUBLE) / (passed + failed) AS pass_rate FROM dq_runs)\n"


@query("hist_score_stats", _R + """SELECT dataset, count(*) AS n_runs, round(avg(overall_score), 9) AS mean_score,
  round(stddev_pop(overall_score), 9) AS std_score, min(overall_score) AS min_score, max(overall_score) AS max_score,
  arg_max(overall_score, ts) AS latest_score FROM rr GROUP BY dataset""")
def q_hist_score_stats(spark, sf):
    return hi.score_stats(_runs(spark, sf))


@query("hist_status_dist", _R + "SELECT dataset, status, count(*) AS n FROM rr GROUP BY dataset, status")
def q_hist_status_dist(spark, sf):
    return hi.status_distribution(_runs(spark, sf))


@query("hist_daily", _R + """SELECT dataset, CAST(ts AS DATE) AS day, round(avg(overall_score), 9) AS mean_score,
  min(overall_score) AS min_score, max(overall_score) AS max_score, count(*) AS n_runs FROM rr GROUP BY 1, 2""")
def q_hist_daily(spark, sf):
    return hi.daily(_runs(spark, sf))


@query("hist_last_n", _R + """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY ts DESC) AS recency FROM rr)
WHERE recency <= 10""")
def q_hist_last_n(spark, sf):
    return hi.last_n(_runs(spark, sf), 10)


@query("hist_trend_time", _R + """, m AS (SELECT dataset, avg(CAST(epoch(ts) AS BIGINT)) AS tm FROM rr GROUP BY 1)
SELECT dataset, count(*) AS n_runs, round(regr_slope(overall_score, CAST(epoch(ts) AS BIGINT) - tm), 12) AS slope,
  CASE WHEN regr_slope(overall_score, CAST(epoch(ts) AS BIGINT) - tm) > 0.1 THEN 'improving'
       WHEN regr_slope(overall_score, CAST(epoch(ts) AS BIGINT) - tm) < -0.1 THEN 'deteriorating' ELSE 'stable' END AS trend,
  arg_max(overall_score, ts) AS latest_score, round(arg_max(overall_score, ts) - arg_min(overall_score, ts), 9) AS score_change,
  CAST(floor(date_diff('second', min(ts), max(ts)) / 86400) AS BIGINT) AS period_days
FROM rr JOIN m USING (dataset) GROUP BY dataset HAVING count(*) >= 2""")
def q_hist_trend_time(spark, sf):
    return hi.trend_time(_runs(spark, sf))


@query("hist_trend_index", _R + """, x AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY ts) - 1 AS i FROM rr)
SELECT dataset, count(*) AS n_points, round(regr_slope(pass_rate, i), 9) AS slope,
  CASE WHEN regr_slope(pass_rate, i) > 0.001 THEN 'improving' WHEN regr_slope(pass_rate, i) < -0.001 THEN 'declining' ELSE 'stable' END AS trend,
  round(arg_max(pass_rate, ts), 9) AS current, round(avg(pass_rate), 9) AS mean, round(stddev_pop(pass_rate), 9) AS std
FROM x GROUP BY dataset HAVING count(*) >= 2""")
def q_hist_trend_index(spark, sf):
    return hi.trend_index(_runs(spark, sf))


@query("anom_sigma", _R + """, w AS (SELECT *, avg(overall_score) OVER (PARTITION BY dataset) AS m,
  stddev_pop(overall_score) OVER (PARTITION BY dataset) AS s, count(*) OVER (PARTITION BY dataset) AS n FROM rr)
SELECT dataset, ts, overall_score, round(m, 9) AS mean_score, round(overall_score - m, 9) AS deviation
FROM w WHERE n >= 3 AND abs(overall_score - m) > 2 * s""")
def q_anom_sigma(spark, sf):
    return hi.anomalies_sigma(_runs(spark, sf))


@query("anom_jump", _R + """, l AS (SELECT *, lag(overall_score) OVER (PARTITION BY dataset ORDER BY ts) AS prev_score FROM rr)
SELECT dataset, ts, overall_score, prev_score, round(overall_score - prev_score, 9) AS change
FROM l WHERE abs(overall_score - prev_score) > 10""")
def q_anom_jump(spark, sf):
    return hi.anomalies_jump(_runs(spark, sf))


@query("anom_iqr", _R + """, q AS (SELECT dataset, quantile_cont(pass_rate, 0.25) AS q1, quantile_cont(pass_rate, 0.75) AS q3, count(*) AS n
  FROM rr GROUP BY dataset),
x AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY ts) - 1 AS idx FROM rr)
SELECT dataset, idx, ts, round(pass_rate, 9) AS pass_rate FROM x JOIN q USING (dataset)
WHERE n >= 3 AND (pass_rate < q1 - 1.5 * (q3 - q1) OR pass_rate > q3 + 1.5 * (q3 - q1))""")
def q_anom_iqr(spark, sf):
    return hi.anomalies_iqr(_runs(spark, sf))


@query("hist_declining5", _R + """, l AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY ts DESC) AS r FROM rr),
k AS (SELECT *, lag(overall_score) OVER (PARTITION BY dataset ORDER BY ts) AS prev FROM l WHERE r <= 5)
SELECT dataset, count(*) = 5 AND count(*) FILTER (WHERE overall_score < prev) = 4 AS declining,
  CASE WHEN count(*) = 5 AND count(*) FILTER (WHERE overall_score < prev) = 4
       THEN 'quality keeps declining, check the processing flow now' ELSE '' END AS recommendation FROM k GROUP BY dataset""")
def q_hist_declining5(spark, sf):
    return hi.declining(_runs(spark, sf))


@query("quality_summary", _R + """SELECT dataset, count(*) AS total_runs,
  count(*) FILTER (WHERE status IN ('excellent', 'good')) AS success_runs,
  count(*) FILTER (WHERE status IN ('fair', 'warning')) AS warning_runs,
  count(*) FILTER (WHERE status IN ('poor', 'error', 'failed')) AS error_runs,
  round(avg(CASE WHEN status IN ('excellent', 'good') THEN 1.0 ELSE 0.0 END), 9) AS success_rate,
  round(avg(CAST(passed AS DOUBLE) / (passed + failed)), 9) AS avg_pass_rate, arg_max(status, ts) AS latest_status
FROM rr GROUP BY dataset""")
def q_quality_summary(spark, sf):
    return hi.quality_summary(_runs(spark, sf))


@query("quality_report", f"""WITH {DQ_CHECKS_SQL},
f AS (SELECT * FROM dq_checks WHERE status IN ('failed', 'error')),
g AS (SELECT check_type, severity, count(*) AS n_failed FROM f GROUP BY GROUPING SETS ((check_type), (severity), ())),
t AS (SELECT check_name, count(*) AS n_failed FROM f GROUP BY check_name)
SELECT CASE WHEN check_type IS NOT NULL THEN 'by_type' WHEN severity IS NOT NULL THEN 'by_severity' ELSE 'total' END AS level,
  coalesce(check_type, severity, 'all') AS item, n_failed FROM g
UNION ALL SELECT 'top_check', check_name, n_failed FROM (
  SELECT *, row_number() OVER (ORDER BY n_failed DESC, check_name) AS r FROM t) WHERE r <= 10""")
def q_quality_report(spark, sf):
    return hi.quality_report(dq_checks(spark, sf))


@query("quality_rates", f"""WITH {DQ_CHECKS_SQL},
r AS (SELECT dataset, run_id, avg((status = 'passed')::INT::DOUBLE) AS r, count(*) FILTER (WHERE status = 'passed') AS p,
  count(*) FILTER (WHERE status = 'warning') AS w, count(*) FILTER (WHERE status IN ('failed', 'error')) AS f, min(ts) AS a, max(ts) AS b
  FROM dq_checks GROUP BY dataset, run_id),
g AS (SELECT dataset, count(*) AS n_runs, round(avg(r), 9) AS avg_pass_rate, round(min(r), 9) AS min_pass_rate, round(max(r), 9) AS max_pass_rate,
  CAST(sum(p) AS BIGINT) AS n_passed, CAST(sum(w) AS BIGINT) AS n_warning, CAST(sum(f) AS BIGINT) AS n_failed,
  min(a) AS first_ts, max(b) AS last_ts FROM r GROUP BY dataset)
SELECT *, CASE WHEN avg_pass_rate < 0.8 THEN 'review the failing checks' WHEN min_pass_rate < 0.8 THEN 'review the worst runs' ELSE 'none' END AS advice FROM g""")
def q_quality_rates(spark, sf):
    return hi.quality_rates(dq_checks(spark, sf))


@query("filter_lookback", _R + "SELECT dataset, ts, overall_score FROM rr WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 7 DAY")
def q_filter_lookback(spark, sf):
    from vigil.functions.core import ts_lit
    return hi.lookback(_runs(spark, sf), "ts", ts_lit("2024-02-01"), 7).select("dataset", "ts", "overall_score")

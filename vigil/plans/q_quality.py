"""§2.5 data-quality queries.  Dataset ``events_dq`` = events with the
injected defects of FIXTURES C; ``orders`` and ``customer`` as they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.core import rnd, ts_lit
from vigil.operators import quality as q
from vigil.plans import sqlgen
from vigil.plans.fixtures import EVENTS_DQ_SQL, SCHEMAS, events_defects
from vigil.operators.rules import overall_status
from vigil.plans.registry import query
from vigil.sources.readers import table

AS_OF = {"events_dq": "2024-02-01", "orders": "2001-09-01", "customer": None}


def _src(spark, sf, ds):
    return events_defects(spark, sf) if ds == "events_dq" else table(spark, sf, ds)


def _metrics(spark, sf, ds="events_dq", families=q.ALL_FAMILIES):
    a = AS_OF.get(ds)
    return q.quality_metrics(_src(spark, sf, ds), ds, ts_lit(a) if a else None, families)


def _msql(ds="events_dq", families=q.ALL_FAMILIES, prefix=None):
    prefix = prefix or f"{ds}_"
    ctes, name = sqlgen.metrics_sql(prefix, ds, SCHEMAS[ds], ds, AS_OF.get(ds), families)
    head = (EVENTS_DQ_SQL + ",\n") if ds == "events_dq" else ""
    return head + ctes, name


def _family_query(key, families, ds="events_dq"):
    ctes, name = _msql(ds, families)
    sql = f"WITH {ctes}\nSELECT dataset, name, \"column\", metric_type, value, threshold, direction, status FROM {name}"

    @query(key, sql)
    def _q(spark, sf):
        return _metrics(spark, sf, ds, families)
    _q.__name__ = f"q_{key}"
    return _q


_family_query("dq_overall_completeness", ["overall"])
_family_query("dq_col_completeness", ["profile_completeness"])
_family_query("dq_missing_rate", ["missing"])
_family_query("dq_uniqueness", ["profile_uniqueness"])
_family_query("dq_validity_finite", ["profile_validity"])
_family_query("dq_duplicate_rate", ["duplicate"])
_family_query("dq_zero_rate", ["zero"])
_family_query("dq_outlier_rate_iqr", ["outlier"])
_family_query("dq_freshness_days", ["freshness"], "orders")

_ctes, _m = _msql()


@query("dq_metric_type", f"WITH {_ctes}\nSELECT name, metric_type FROM {_m}")
def q_dq_metric_type(spark, sf):
    return _metrics(spark, sf).select("name", "metric_type")


@query("dq_thresholds", f"WITH {_ctes}\nSELECT name, threshold, direction FROM {_m}")
def q_dq_thresholds(spark, sf):
    return _metrics(spark, sf).select("name", "threshold", "direction")


@query("dq_pass", f"WITH {_ctes}\nSELECT name, value, threshold, direction, status FROM {_m}")
def q_dq_pass(spark, sf):
    return _metrics(spark, sf).select("name", "value", "threshold", "direction", "status")


def _score_sql(ds):
    ctes, m = _msql(ds)
    return (f"WITH {ctes},\ns AS ({sqlgen.score_sql(m)})\n"
            f"SELECT dataset, _score AS overall_score, critical_failures, "
            f"{sqlgen.band_sql('_score', 'critical_failures')} AS status FROM s")


@query("dq_score", _score_sql("orders"))
def q_dq_score(spark, sf):
    return q.dq_score(_metrics(spark, sf, "orders"))


@query("dq_score_class", f"""WITH {_ctes},
s AS (SELECT dataset, metric_type, value, threshold, direction, status, CASE metric_type WHEN 'completeness' THEN 0.25 WHEN 'accuracy' THEN 0.25
    WHEN 'consistency' THEN 0.20 WHEN 'validity' THEN 0.15 WHEN 'uniqueness' THEN 0.10 ELSE 0.05 END AS w,
  CASE WHEN threshold IS NULL THEN 50.0 WHEN direction = 'ge' THEN least(100.0, greatest(0.0, value * 100))
    ELSE least(100.0, greatest(0.0, 100 - value * 100)) END AS p FROM {_m}),
g AS (SELECT dataset, sum(p * w) / sum(w) AS sc, count(*) FILTER (WHERE status = 'failed' AND
  ((direction = 'ge' AND value < threshold * 0.5) OR (direction = 'le' AND value > threshold * 2.0))) AS critical_failures FROM s GROUP BY dataset)
SELECT dataset, round(sc, 9) AS overall_score, critical_failures, {sqlgen.band_sql('sc', 'critical_failures')} AS status FROM g""")
def q_dq_score_class(spark, sf):
    return q.dq_score(_metrics(spark, sf), mode="class")


@query("dq_bounds", f"""WITH {_ctes}
SELECT name, value, CASE WHEN threshold IS NULL THEN 'measured' WHEN direction = 'ge' AND value < threshold THEN 'failed'
  WHEN direction = 'le' AND value > threshold THEN 'failed' ELSE 'passed' END AS status FROM {_m}""")
def q_dq_bounds(spark, sf):
    m = _metrics(spark, sf)
    lo = F.when(F.col("direction") == "ge", F.col("threshold"))
    hi = F.when(F.col("direction") == "le", F.col("threshold"))
    return m.select("name", "value", q.bounds_status(F.col("value"), lo, hi).alias("status"))


@query("dq_status", _score_sql("events_dq"))
def q_dq_status(spark, sf):
    return q.dq_score(_metrics(spark, sf, "events_dq"))


_WARN = ("threshold IS NOT NULL AND ((direction = 'ge' AND value >= 0.8 AND value < threshold) OR "
         "(direction = 'le' AND value > threshold AND value <= 1.2))")


@query("dq_failed_warning", f"""WITH {_ctes}
SELECT dataset, name, "column", metric_type, value, threshold, direction, status,
       CASE WHEN status = 'failed' THEN 'failed' ELSE 'warning' END AS kind
FROM {_m} WHERE status = 'failed' OR ({_WARN})""")
def q_dq_failed_warning(spark, sf):
    return q.failed_and_warning(_metrics(spark, sf))


@query("dq_alerts", f"""WITH {_ctes}
SELECT dataset, name, metric_type,
       printf('[%s] metric %s out of threshold: value=%.4f, threshold=%.4f', dataset, name, value, threshold) AS message
FROM {_m} WHERE status = 'failed'""")
def q_dq_alerts(spark, sf):
    return q.metric_alerts(_metrics(spark, sf))


@query("dq_run_summary", f"""WITH {_ctes}
SELECT dataset, count(*) AS total_checks, count(*) FILTER (WHERE status <> 'failed') AS passed_checks,
       count(*) FILTER (WHERE status = 'failed') AS failed_checks,
       count(*) FILTER (WHERE {_WARN}) AS warning_checks
FROM {_m} GROUP BY dataset""")
def q_dq_run_summary(spark, sf):
    return q.run_summary(_metrics(spark, sf))


def _pct(c):
    return f"printf('%.2f%%', {c} * 100)"


@query("dq_recommendations", f"""WITH {_ctes}
SELECT dataset, name, CASE
  WHEN metric_type = 'completeness' THEN 'raise completeness: ' || name || ' is ' || {_pct('value')} || ', threshold ' || {_pct('threshold')}
  WHEN metric_type = 'accuracy' THEN 'raise accuracy: ' || name || ' is ' || {_pct('value')} || ', threshold ' || {_pct('threshold')}
  WHEN metric_type = 'validity' THEN 'improve validity: ' || name || ' is ' || {_pct('value')} || ', above threshold ' || {_pct('threshold')}
  END AS recommendation
FROM {_m} WHERE status = 'failed' AND metric_type IN ('completeness', 'accuracy', 'validity')""")
def q_dq_recommendations(spark, sf):
    return q.recommendations(_metrics(spark, sf))


@query("dq_entropy", """SELECT "column", round(-sum(p * log2(p)), 9) AS entropy, count(*) AS n_values FROM (
  SELECT "column", CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY "column") AS p FROM (
    SELECT 'o_orderstatus' AS "column", o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 2
    UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2))
GROUP BY "column\"""")
def q_dq_entropy(spark, sf):
    return q.entropy(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


# ------------------------------------------------------------- pipeline
PIPE = ["events_dq", "orders", "customer"]


def _pipe_metrics(spark, sf):
    ms = [_metrics(spark, sf, ds) for ds in PIPE]
    u = ms[0]
    for m in ms[1:]:
        u = u.unionByName(m)
    return u


def _pipe_sql():
    parts, names = [], []
    for ds in PIPE:
        c, n = _msql(ds)
        parts.append(c)
        names.append(n)
    allm = " UNION ALL ".join(f"SELECT * FROM {n}" for n in names)
    return ",\n".join(parts) + f",\npm AS ({allm})"


_PIPE = _pipe_sql()
_PSCORE = (f"ps0 AS ({sqlgen.score_sql('pm')}),\n"
           f"ps AS (SELECT dataset, _score AS overall_score, critical_failures, "
           f"{sqlgen.band_sql('_score', 'critical_failures')} AS status FROM ps0)")
_PRIO = ("CASE status WHEN 'failed' THEN 0 WHEN 'error' THEN 1 WHEN 'poor' THEN 2 WHEN 'warning' THEN 3 "
         "WHEN 'fair' THEN 4 WHEN 'good' THEN 5 WHEN 'excellent' THEN 6 ELSE 7 END")


@query("dq_validate_pipeline", f"WITH {_PIPE},\n{_PSCORE}\nSELECT * FROM ps")
def q_dq_validate_pipeline(spark, sf):
    return q.dq_score(_pipe_metrics(spark, sf))


@query("dq_pipeline_status", f"""WITH {_PIPE},\n{_PSCORE}
SELECT count(*) AS n_datasets, arg_min(status, ({_PRIO}, dataset)) AS pipeline_status,
       round(avg(overall_score), 9) AS pipeline_score,
       round(avg(CASE WHEN status IN ('excellent', 'good', 'fair') THEN 1.0 ELSE 0.0 END), 9) AS success_rate
FROM ps""")
def q_dq_pipeline_status(spark, sf):
    return q.pipeline_rollup(q.dq_score(_pipe_metrics(spark, sf)))


@query("dq_pipeline_bands", f"""WITH {_PIPE},
r AS (SELECT dataset, count(*) AS n, count(*) FILTER (WHERE status IN ('error', 'failed')) AS bad, count(*) FILTER (WHERE status = 'warning') AS warn,
  count(*) FILTER (WHERE status IN ('passed', 'excellent', 'good')) AS ok FROM pm WHERE status IS NOT NULL GROUP BY dataset),
d AS (SELECT CAST(ok AS DOUBLE) / n AS rate, CASE WHEN bad > 0 THEN 'critical' WHEN warn > 0 THEN 'warning' WHEN CAST(ok AS DOUBLE) / n >= 0.95 THEN 'excellent'
  WHEN CAST(ok AS DOUBLE) / n >= 0.85 THEN 'good' ELSE 'error' END AS st FROM r)
SELECT count(*) AS n_datasets, round(avg(round(rate, 9)), 9) AS mean_pass_rate, CASE WHEN count(*) FILTER (WHERE st IN ('critical', 'error')) > 0 THEN 'critical'
  WHEN count(*) FILTER (WHERE st = 'warning') > 0 THEN 'warning' WHEN avg(rate) >= 0.95 THEN 'excellent' WHEN avg(rate) >= 0.85 THEN 'good' ELSE 'error' END AS pipeline_status
FROM d""")
def q_dq_pipeline_bands(spark, sf):
    """Pipeline status by bands of the datasets' check results."""
    checks = _pipe_metrics(spark, sf).filter("status IS NOT NULL")
    return q.pipeline_status(overall_status(checks, ["dataset"]))


@query("dq_pipeline_score", f"""WITH {_PIPE},\n{_PSCORE}
SELECT round(avg(overall_score), 9) AS pipeline_score,
       round(avg(CASE WHEN status IN ('excellent', 'good', 'fair') THEN 1.0 ELSE 0.0 END), 9) AS success_rate
FROM ps""")
def q_dq_pipeline_score(spark, sf):
    return q.pipeline_rollup(q.dq_score(_pipe_metrics(spark, sf))).select("pipeline_score", "success_rate")


@query("dq_pipeline_metrics", f"""WITH {_PIPE}
SELECT metric_type, 'pipeline_avg_' || name AS name, round(avg(value), 9) AS value, count(*) AS n_datasets
FROM pm GROUP BY metric_type, name""")
def q_dq_pipeline_metrics(spark, sf):
    return q.pipeline_metrics(_pipe_metrics(spark, sf))


@query("dq_pipeline_alerts", f"""WITH {_PIPE}
SELECT dataset, '[' || dataset || '] ' || printf('[%s] metric %s out of threshold: value=%.4f, threshold=%.4f',
       dataset, name, value, threshold) AS message FROM pm WHERE status = 'failed'""")
def q_dq_pipeline_alerts(spark, sf):
    return q.pipeline_alerts(q.metric_alerts(_pipe_metrics(spark, sf)))


@query("dq_gate", f"""WITH {_PIPE},\n{_PSCORE}
SELECT *, (overall_score >= 95.0 OR status IN ('excellent', 'good', 'fair')) AS passed FROM ps""")
def q_dq_gate(spark, sf):
    return q.quality_gate(q.dq_score(_pipe_metrics(spark, sf)))

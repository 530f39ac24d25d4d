"""§2.6 expectation, schema, rule and check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import expect as ex
from vigil.plans.fixtures import EVENTS_DQ_SQL, events_defects
from vigil.plans.registry import query
from vigil.sources.readers import table

EV_COLS = [("event_id", "int"), ("ts", "time"), ("user_id", "int"), ("event_type", "str"),
           ("value", "float"), ("props", "str")]


def _miss(c, k):
    return f"({c} IS NULL OR isnan({c}))" if k == "float" else f"({c} IS NULL)"


def _row(kind, col, elem, unexp, obs, succ, src="events_dq"):
    u = unexp if unexp is not None else "CAST(NULL AS BIGINT)"
    o = f"round(CAST({obs} AS DOUBLE), 9)" if obs is not None else "CAST(NULL AS DOUBLE)"
    pct = f"round(CAST({unexp} AS DOUBLE) / {elem} * 100, 9)" if unexp is not None else "CAST(NULL AS DOUBLE)"
    return (f"SELECT '{kind}' AS expectation, '{col}' AS \"column\", CAST({elem} AS BIGINT) AS element_count, "
            f"CAST({u} AS BIGINT) AS unexpected_count, {pct} AS unexpected_percent, {o} AS observed_value, "
            f"{succ} AS success FROM {src}")


def _suite_sql(rows, head=EVENTS_DQ_SQL):
    return f"WITH {head}\n" + "\nUNION ALL ".join(rows)


def _evdq(spark, sf):
    return events_defects(spark, sf)


NN_SUITE = [ex.Expectation("not_null", c) for c, _ in EV_COLS]


@query("exp_not_null", _suite_sql([
    _row("not_null", c, "count(*)", f"count(*) FILTER (WHERE {_miss(c, k)})", None,
         f"count(*) FILTER (WHERE {_miss(c, k)}) = 0") for c, k in EV_COLS]))
def q_exp_not_null(spark, sf):
    return ex.run_suite(_evdq(spark, sf), NN_SUITE)


def _between_row(kind, c, k, lo, hi, x=None):
    x = x or c
    nm = f"NOT {_miss(c, k)}"
    bad = f"{nm} AND ({x} < {lo} OR {x} > {hi})"
    return _row(kind, c, f"count(*) FILTER (WHERE {nm})", f"count(*) FILTER (WHERE {bad})", None,
                f"count(*) FILTER (WHERE {bad}) = 0")


@query("exp_between", _suite_sql([_between_row("between", "value", "float", 0, 1000),
                                  _between_row("between", "user_id", "int", 1, 100)]))
def q_exp_between(spark, sf):
    return ex.run_suite(_evdq(spark, sf), [ex.Expectation("between", "value", {"min": 0, "max": 1000}),
                                           ex.Expectation("between", "user_id", {"min": 1, "max": 100})])


TYPES = ["view", "click", "purchase", "signup", "error"]


@query("exp_in_set", _suite_sql([_row(
    "in_set", "event_type", "count(event_type)",
    "count(*) FILTER (WHERE event_type IS NOT NULL AND event_type NOT IN ('view', 'click', 'purchase', 'signup', 'error'))",
    None, "count(*) FILTER (WHERE event_type IS NOT NULL AND event_type NOT IN ('view', 'click', 'purchase', 'signup', 'error')) = 0")]))
def q_exp_in_set(spark, sf):
    return ex.run_suite(_evdq(spark, sf), [ex.Expectation("in_set", "event_type", {"values": TYPES})])


@query("exp_unique", f"""WITH {EVENTS_DQ_SQL},
g AS (SELECT count(*) AS n FROM events_dq WHERE event_id IS NOT NULL GROUP BY event_id)
SELECT 'unique' AS expectation, 'event_id' AS "column", CAST(sum(n) AS BIGINT) AS element_count,
  CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS unexpected_count,
  round(CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS DOUBLE) / sum(n) * 100, 9) AS unexpected_percent,
  CAST(NULL AS DOUBLE) AS observed_value, coalesce(sum(n) FILTER (WHERE n > 1), 0) = 0 AS success FROM g""")
def q_exp_unique(spark, sf):
    return ex.run_suite(_evdq(spark, sf), [ex.Expectation("unique", "event_id")])


_DATES = """dates AS (SELECT CASE WHEN event_id % 25 = 0 THEN 'not-a-date'
  ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS date_str FROM events)"""


@query("exp_strftime", f"""WITH {_DATES}
SELECT 'strftime' AS expectation, 'date_str' AS "column", count(date_str) AS element_count,
  count(*) FILTER (WHERE date_str IS NOT NULL AND try_strptime(date_str, '%Y-%m-%d %H:%M:%S') IS NULL) AS unexpected_count,
  round(CAST(count(*) FILTER (WHERE date_str IS NOT NULL AND try_strptime(date_str, '%Y-%m-%d %H:%M:%S') IS NULL) AS DOUBLE) / count(date_str) * 100, 9) AS unexpected_percent,
  CAST(NULL AS DOUBLE) AS observed_value,
  count(*) FILTER (WHERE date_str IS NOT NULL AND try_strptime(date_str, '%Y-%m-%d %H:%M:%S') IS NULL) = 0 AS success
FROM dates""")
def q_exp_strftime(spark, sf):
    ev = table(spark, sf, "events", ["event_id", "ts"])
    d = ev.select(F.when(F.col("event_id") % 25 == 0, F.lit("not-a-date"))
                  .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("date_str"))
    return ex.run_suite(d, [ex.Expectation("strftime", "date_str", {"format": "%Y-%m-%d %H:%M:%S"})])


def _obs_row(kind, c, obs, lo, hi, src="events_dq"):
    cond = []
    if lo is not None:
        cond.append(f"{obs} >= {lo}")
    if hi is not None:
        cond.append(f"{obs} <= {hi}")
    return _row(kind, c, "count(*)", None, obs, f"coalesce({' AND '.join(cond)}, false)", src)


@query("exp_distinct_between", _suite_sql([
    _obs_row("distinct_between", "event_type", "count(DISTINCT event_type)", 1, 5),
    _obs_row("distinct_between", "user_id", "count(DISTINCT user_id)", 1, 1000)]))
def q_exp_distinct_between(spark, sf):
    return ex.run_suite(_evdq(spark, sf), [ex.Expectation("distinct_between", "event_type", {"min": 1, "max": 5}),
                                           ex.Expectation("distinct_between", "user_id", {"min": 1, "max": 1000})])


@query("exp_length_between", "WITH d AS (SELECT * FROM documents)\n" + "\nUNION ALL ".join([
    _between_row("length_between", "text", "str", 20, 50000, "length(text)").replace("FROM events_dq", "FROM d"),
    _between_row("length_between", "lang", "str", 2, 2, "length(lang)").replace("FROM events_dq", "FROM d")]))
def q_exp_length_between(spark, sf):
    return ex.run_suite(table(spark, sf, "documents", ["text", "lang"]),
                        [ex.Expectation("length_between", "text", {"min": 20, "max": 50000}),
                         ex.Expectation("length_between", "lang", {"min": 2, "max": 2})])


@query("exp_distribution_between", _suite_sql([
    _obs_row("mean_between", "value", "avg(value) FILTER (WHERE NOT isnan(value))", 0, 300),
    _obs_row("median_between", "value", "quantile_cont(value, 0.5) FILTER (WHERE NOT isnan(value))", 100, 300),
    _obs_row("stdev_between", "value", "stddev_samp(value) FILTER (WHERE NOT isnan(value))", None, 100)]))
def q_exp_distribution_between(spark, sf):
    return ex.run_suite(_evdq(spark, sf), [ex.Expectation("mean_between", "value", {"min": 0, "max": 300}),
                                           ex.Expectation("median_between", "value", {"min": 100, "max": 300}),
                                           ex.Expectation("stdev_between", "value", {"max": 100})])


_DEFAULT_ROWS = []
for _c, _k in EV_COLS:
    _DEFAULT_ROWS.append(_row("not_null", _c, "count(*)", f"count(*) FILTER (WHERE {_miss(_c, _k)})", None,
                              f"count(*) FILTER (WHERE {_miss(_c, _k)}) = 0"))
    _DEFAULT_ROWS.append(_obs_row("distinct_between", _c,
                                  f"count(DISTINCT CASE WHEN NOT {_miss(_c, _k)} THEN {_c} END)", 1, None))


@query("exp_suite", f"""WITH {EVENTS_DQ_SQL}, r AS ({' UNION ALL '.join(_DEFAULT_ROWS)})
SELECT coalesce(bool_and(success), true) AS success,
  round(coalesce(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) * 100, 100.0), 9) AS success_percent,
  count(*) AS evaluated, count(*) FILTER (WHERE NOT success) AS issues FROM r""")
def q_exp_suite(spark, sf):
    df = _evdq(spark, sf)
    return ex.suite_result(ex.run_suite(df, ex.default_suite(df)))


# ------------------------------------------------------------------ schema
@query("schema_pk_unique", """SELECT 'primary_key' AS kind, 'l_orderkey,l_linenumber' AS "column",
  CAST(sum(n - 1) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
  HAVING sum(n - 1) > 0""")
def q_schema_pk_unique(spark, sf):
    return ex.schema_violations(table(spark, sf, "lineitem"),
                                ex.DatasetSchema(columns={}, primary_keys=["l_orderkey", "l_linenumber"]))


_EV_CONS = ex.DatasetSchema(columns={}, constraints={
    "value": {"not_null": True, "min": 0, "max": 1000}, "event_id": {"unique": True},
    "user_id": {"not_null": True}})
_EV_CONS_SQL = f"""WITH {EVENTS_DQ_SQL}, v AS (
  SELECT 'not_null' AS kind, 'value' AS "column", count(*) FILTER (WHERE value IS NULL OR isnan(value)) AS n FROM events_dq
  UNION ALL SELECT 'range', 'value', count(*) FILTER (WHERE NOT (value IS NULL OR isnan(value)) AND (value < 0 OR value > 1000)) FROM events_dq
  UNION ALL SELECT 'not_null', 'user_id', count(*) FILTER (WHERE user_id IS NULL) FROM events_dq
  UNION ALL SELECT 'unique', 'event_id', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM events_dq GROUP BY event_id))
SELECT kind, "column", CAST(n AS BIGINT) AS n FROM v WHERE n > 0"""


@query("schema_constraints", _EV_CONS_SQL)
def q_schema_constraints(spark, sf):
    """schema_not_null / schema_unique / schema_range in one pass."""
    return ex.schema_violations(_evdq(spark, sf), _EV_CONS)


_ORD_SCHEMA = ex.DatasetSchema(
    columns={"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "str", "o_totalprice": "float",
             "o_orderdate": "datetime", "o_orderpriority": "int", "o_comment": "str"},
    primary_keys=["o_orderkey"], required_columns=["o_orderkey", "o_comment"],
    constraints={"o_totalprice": {"min": 0, "max": 400000}})


@query("schema_report", """WITH v AS (
  SELECT 'missing_column' AS kind, 'o_comment' AS "column", 1 AS n
  UNION ALL SELECT 'type_mismatch', 'o_orderpriority', 1
  UNION ALL SELECT 'range', 'o_totalprice', count(*) FILTER (WHERE o_totalprice < 0 OR o_totalprice > 400000) FROM orders
  UNION ALL SELECT 'primary_key', 'o_orderkey', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey)),
w AS (SELECT * FROM v WHERE n > 0)
SELECT count(*) = 0 AS valid, count(*) AS n_violations, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_bad_values,
  coalesce(string_agg(kind || ':' || "column", ';' ORDER BY kind || ':' || "column"), '') AS violations FROM w""")
def q_schema_report(spark, sf):
    return ex.schema_report(ex.schema_violations(table(spark, sf, "orders"), _ORD_SCHEMA))


# ------------------------------------------------------------------- rules
from vigil.operators import rules as ru  # noqa: E402
from vigil.operators.profile import profile_table  # noqa: E402
from vigil.plans.q_drift import ks_sql  # noqa: E402
from vigil.sources import sinks as sk  # noqa: E402

CUSTOM_RULE = ru.Rule("custom_rule_001", "known users and types", "custom", "custom_violation_ratio", 0.05, "<=",
                      "high", tags=["custom"])
ALL_RULES = ru.DEFAULT_RULES + [CUSTOM_RULE]
EV_SPLIT = "2024-01-16"


def orders_orphans(spark, sf):
    o = table(spark, sf, "orders", ["o_orderkey", "o_custkey"])
    return o.select("o_orderkey", (F.col("o_custkey") + F.when(F.col("o_orderkey") % 40 == 0, 10000000)
                                   .otherwise(0)).alias("o_custkey"))


def rule_metrics(spark, sf, only=None):
    from vigil.functions.core import ts_lit
    dq = _evdq(spark, sf)
    base = dq.filter(F.col("ts") < ts_lit(EV_SPLIT))
    cur = dq.filter(F.col("ts") >= ts_lit(EV_SPLIT))
    made = {"missing_ratio": lambda: ru.completeness_metric(dq), "duplicate_ratio": lambda: ru.uniqueness_metric(dq),
            "invalid_ratio": lambda: ru.validity_metric(dq, "value", 0, 1000),
            "inconsistency_ratio": lambda: ru.consistency_metric(orders_orphans(spark, sf), table(spark, sf, "customer", ["c_custkey"]),
                                                                 "o_custkey", "c_custkey"),
            "distribution_ks_stat": lambda: ru.distribution_metric(cur, base, ["value"]),
            "custom_violation_ratio": lambda: ru.custom_metric(dq, "user_id > 0 AND event_type <> '??'")}
    parts = [made[m]() for m in only or made]  # a metric that no rule asks for is not built
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u


def rule_checks(spark, sf, only=None):
    rules = [r for r in ALL_RULES if only is None or r.metric in only]
    return ru.run_rules(rule_metrics(spark, sf, only), ru.rules_table(spark, rules))


_M_ALL = " + ".join(f"count(*) FILTER (WHERE {_miss(c, k)})" for c, k in EV_COLS)
_EVDQ_COLS = ", ".join(c for c, _ in EV_COLS)
_KS_DQ = ks_sql(f"""lf AS (SELECT 'value' AS feature, CASE WHEN ts < TIMESTAMP '{EV_SPLIT}' THEN 0 ELSE 1 END AS side,
  value FROM events_dq WHERE value IS NOT NULL AND NOT isnan(value))""").replace("WITH lf AS", "lf AS", 1)
RULE_METRICS_SQL = f"""{EVENTS_DQ_SQL},
oo AS (SELECT o_custkey + CASE WHEN o_orderkey % 40 = 0 THEN 10000000 ELSE 0 END AS k FROM orders),
ks AS (WITH {_KS_DQ}),
rm AS (
  SELECT 'missing_ratio' AS metric, CAST({_M_ALL} AS DOUBLE) / (count(*) * 6) AS value FROM events_dq
  UNION ALL SELECT 'duplicate_ratio', CAST(sum(n - 1) AS DOUBLE) / sum(n) FROM (SELECT count(*) AS n FROM events_dq GROUP BY {_EVDQ_COLS})
  UNION ALL SELECT 'invalid_ratio', CAST(count(*) FILTER (WHERE NOT (value IS NULL OR isnan(value)) AND (value < 0 OR value > 1000)) AS DOUBLE)
      / count(*) FILTER (WHERE NOT (value IS NULL OR isnan(value))) FROM events_dq
  UNION ALL SELECT 'inconsistency_ratio', CAST(count(*) FILTER (WHERE c.c_custkey IS NULL) AS DOUBLE) / count(*)
      FROM oo LEFT JOIN (SELECT DISTINCT c_custkey FROM customer) c ON oo.k = c.c_custkey WHERE oo.k IS NOT NULL
  UNION ALL SELECT 'distribution_ks_stat', max(statistic) FROM ks
  UNION ALL SELECT 'custom_violation_ratio', CAST(count(*) FILTER (WHERE NOT coalesce(user_id > 0 AND event_type <> '??', false)) AS DOUBLE) / count(*) FROM events_dq),
rules(rule_id, rule_name, rule_type, metric, threshold, operator, severity) AS (VALUES
  {", ".join(f"('{r.rule_id}', '{r.name}', '{r.rule_type}', '{r.metric}', {r.threshold}, '{r.operator}', '{r.severity}')" for r in ALL_RULES)}),
checks AS (SELECT rule_id, rule_name, rule_type, metric, round(value, 9) AS value, CAST(threshold AS DOUBLE) AS threshold, operator, severity,
  CASE WHEN value IS NULL THEN 'error' WHEN (CASE operator WHEN '<=' THEN value <= threshold WHEN '<' THEN value < threshold
       WHEN '>=' THEN value >= threshold WHEN '>' THEN value > threshold WHEN '==' THEN abs(value - threshold) < 1e-10
       WHEN '!=' THEN abs(value - threshold) >= 1e-10 END) THEN 'passed' ELSE 'failed' END AS status
  FROM rules LEFT JOIN rm USING (metric))"""


def _one_rule(key, metric):
    @query(key, f"WITH {RULE_METRICS_SQL}\nSELECT * FROM checks WHERE metric = '{metric}'")
    def _q(spark, sf):
        return rule_checks(spark, sf, [metric])
    return _q


_one_rule("rule_completeness", "missing_ratio")
_one_rule("rule_uniqueness", "duplicate_ratio")
_one_rule("rule_validity", "invalid_ratio")
_one_rule("rule_consistency", "inconsistency_ratio")
_one_rule("rule_distribution", "distribution_ks_stat")
_one_rule("rule_custom", "custom_violation_ratio")


@query("rules_run", f"WITH {RULE_METRICS_SQL}\nSELECT * FROM checks")
def q_rules_run(spark, sf):
    return rule_checks(spark, sf)


_OPS = ["<=", "<", ">=", ">", "==", "!="]


@query("rule_eval", f"""WITH {EVENTS_DQ_SQL},
m AS ({" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER (WHERE {_miss(c, k)}) AS DOUBLE) / count(*) AS value FROM events_dq" for c, k in EV_COLS)}),
o(operator) AS (VALUES {", ".join(f"('{o}')" for o in _OPS)})
SELECT "column", operator, round(value, 9) AS value, CASE operator WHEN '<=' THEN value <= 0.05 WHEN '<' THEN value < 0.05
  WHEN '>=' THEN value >= 0.05 WHEN '>' THEN value > 0.05 WHEN '==' THEN abs(value - 0.05) < 1e-10
  WHEN '!=' THEN abs(value - 0.05) >= 1e-10 END AS passed FROM m, o""")
def q_rule_eval(spark, sf):
    dq = _evdq(spark, sf)
    from vigil.functions.core import missing as _m
    m = dq.agg(*[(F.count_if(_m(dq, c)) / F.count(F.lit(1))).alias(c) for c, _ in EV_COLS])
    long = m.unpivot([], [c for c, _ in EV_COLS], "column", "value")
    ops = long.select("column", "value", F.explode(F.array(*[F.lit(o) for o in _OPS])).alias("operator"))
    return ops.select("column", "operator", F.round("value", 9).alias("value"),
                      ru.rule_eval(F.col("value"), F.col("operator"), F.lit(0.05)).alias("passed"))


# ------------------------------------------------------------------ checks
@query("chk_column_count", """WITH b AS (SELECT count(*) AS base, count(*) FILTER (WHERE column_name IN
  ('o_orderkey', 'o_custkey', 'o_totalprice', 'o_orderdate')) AS cur FROM (SELECT column_name FROM (DESCRIBE orders)))
SELECT 'orders' AS dataset, 'column_count' AS check_name, cur, base, CASE WHEN cur < 0.8 * base THEN 'warning' ELSE 'passed' END AS status FROM b""")
def q_chk_column_count(spark, sf):
    o = table(spark, sf, "orders")
    base = profile_table(o).withColumn("dataset", F.lit("orders"))
    cur = profile_table(o.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")).withColumn("dataset", F.lit("orders"))
    return ru.column_count_check(cur, base)


@query("chk_row_count", """WITH p AS (SELECT event_type, CAST(ts AS DATE) AS d, count(*) AS n_rows FROM events GROUP BY 1, 2),
l AS (SELECT *, lag(n_rows) OVER (PARTITION BY event_type ORDER BY d) AS prev_rows FROM p)
SELECT event_type, d, n_rows, prev_rows, round(CAST(n_rows AS DOUBLE) / prev_rows, 9) AS ratio,
  CASE WHEN CAST(n_rows AS DOUBLE) / prev_rows < 0.5 OR CAST(n_rows AS DOUBLE) / prev_rows > 2.0 THEN 'warning' ELSE 'passed' END AS status
FROM l WHERE prev_rows IS NOT NULL""")
def q_chk_row_count(spark, sf):
    ev = table(spark, sf, "events", ["event_type", "ts"])
    prof = ev.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n_rows"))
    return ru.row_count_check(prof, "event_type", "d")


_CUR_ORDERS = """SELECT * EXCLUDE (o_orderpriority) REPLACE (CAST(o_totalprice AS VARCHAR) AS o_totalprice),
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS o_total_whole FROM orders"""
_SPARK_TYPE = "CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'INTEGER' THEN 'int' ELSE lower(column_type) END"


@query("chk_dtype", f"""WITH b AS (SELECT column_name AS c, {_SPARK_TYPE} AS t FROM (DESCRIBE SELECT * FROM orders)),
k AS (SELECT column_name AS c, {_SPARK_TYPE} AS t FROM (DESCRIBE {_CUR_ORDERS})),
bn AS (UNPIVOT (SELECT count(COLUMNS(*)) FROM orders) ON COLUMNS(*) INTO NAME c VALUE n),
kn AS (UNPIVOT (SELECT count(COLUMNS(*)) FROM ({_CUR_ORDERS})) ON COLUMNS(*) INTO NAME c VALUE n)
SELECT coalesce(b.c, k.c) AS "column", b.t AS base_dtype, k.t AS cur_dtype, bn.n AS base_values, kn.n AS cur_values,
  CASE WHEN b.t IS NULL THEN 'added' WHEN k.t IS NULL THEN 'removed' ELSE 'type_changed' END AS change
FROM b FULL JOIN k ON b.c = k.c LEFT JOIN bn ON bn.c = b.c LEFT JOIN kn ON kn.c = k.c WHERE b.t IS DISTINCT FROM k.t""")
def q_chk_dtype(spark, sf):
    """A second version of the orders, written as Parquet, against the first:
    both are known by what their files say."""
    o = table(spark, sf, "orders")
    whole = F.when(F.col("o_orderkey") % 5 != 0, F.floor("o_totalprice"))
    path = sk.scratch_dir(spark, "orders-v2")
    o.withColumn("o_total_whole", whole).withColumn("o_totalprice", F.col("o_totalprice").cast("string")).drop("o_orderpriority").write.parquet(path)
    return ru.dtype_check(spark.read.parquet(path), o)


_STATUS_SQL = """st AS (SELECT count(*) AS n_checks, count(*) FILTER (WHERE status IN ('error', 'failed')) AS n_critical,
  count(*) FILTER (WHERE status = 'warning') AS n_warning, count(*) FILTER (WHERE status IN ('passed', 'excellent', 'good')) AS n_passed
  FROM checks),
sts AS (SELECT *, round(coalesce(CAST(n_passed AS DOUBLE) / nullif(n_checks, 0), 1.0), 9) AS pass_rate,
  CASE WHEN n_checks = 0 THEN 'excellent' WHEN n_critical > 0 THEN 'critical' WHEN n_warning > 0 THEN 'warning'
       WHEN CAST(n_passed AS DOUBLE) / n_checks >= 0.95 THEN 'excellent' WHEN CAST(n_passed AS DOUBLE) / n_checks >= 0.85 THEN 'good'
       ELSE 'error' END AS overall_status FROM st)"""

_SUMMARY_SQL = f"""tp AS (SELECT sum(n) AS n_rows, 6 AS n_columns, sum(n * mc) AS missing_cells, sum(n - 1) AS duplicate_rows FROM (
  SELECT count(*) AS n, max(({" + ".join(f"CASE WHEN {_miss(c, k)} THEN 1 ELSE 0 END" for c, k in EV_COLS)})) AS mc
  FROM events_dq GROUP BY {_EVDQ_COLS})),
sm AS (SELECT count(*) AS total_metrics, count(*) FILTER (WHERE status = 'passed') AS passed_metrics,
  count(*) FILTER (WHERE status = 'warning') AS warning_metrics, count(*) FILTER (WHERE status IN ('failed', 'error')) AS failed_metrics,
  round(coalesce(CAST(count(*) FILTER (WHERE status = 'passed') AS DOUBLE) / nullif(count(*), 0), 1.0), 9) AS pass_rate FROM checks),
summ AS (SELECT sm.*, round(CAST(missing_cells AS DOUBLE) / (n_rows * n_columns), 9) AS missing_ratio,
  round(CAST(duplicate_rows AS DOUBLE) / n_rows, 9) AS duplicate_ratio FROM sm, tp)"""


@query("chk_overall_status", f"WITH {RULE_METRICS_SQL},\n{_STATUS_SQL}\nSELECT * FROM sts")
def q_chk_overall_status(spark, sf):
    return ru.overall_status(rule_checks(spark, sf))


@query("chk_summary", f"WITH {RULE_METRICS_SQL},\n{_SUMMARY_SQL}\nSELECT * FROM summ")
def q_chk_summary(spark, sf):
    return ru.check_summary(rule_checks(spark, sf), profile_table(_evdq(spark, sf)))


@query("chk_alerts", f"""WITH {RULE_METRICS_SQL},\n{_STATUS_SQL},\n{_SUMMARY_SQL}
SELECT 'status' AS kind, 'data quality ' || overall_status || ': events_dq' AS message FROM sts WHERE overall_status IN ('critical', 'error')
UNION ALL SELECT 'pass_rate', printf('low check pass rate: %.2f%%', pass_rate * 100) FROM summ WHERE pass_rate < 0.8
UNION ALL SELECT 'rule', 'important rule failed: ' || rule_name FROM checks WHERE severity IN ('high', 'critical') AND status IN ('failed', 'error')""")
def q_chk_alerts(spark, sf):
    checks = rule_checks(spark, sf)
    return ru.check_alerts("events_dq", ru.overall_status(checks),
                           ru.check_summary(checks, profile_table(_evdq(spark, sf))), checks)


@query("chk_recommend", f"""WITH {RULE_METRICS_SQL},\n{_STATUS_SQL},\n{_SUMMARY_SQL},
fc AS (SELECT *, row_number() OVER (ORDER BY rule_id) AS r FROM checks WHERE status IN ('failed', 'error'))
SELECT CAST(ord AS INTEGER) AS ord, text FROM (
  SELECT 1 AS ord, CASE overall_status WHEN 'critical' THEN 'severe quality problems, investigate now'
    WHEN 'error' THEN 'quality problems, fix with priority' WHEN 'warning' THEN 'quality warnings, keep watching' END AS text FROM sts
  UNION ALL SELECT 2, CASE WHEN missing_ratio > 0.1 THEN 'high missing ratio, check the source or impute' END FROM summ
  UNION ALL SELECT 3, CASE WHEN duplicate_ratio > 0.05 THEN 'many duplicate rows, deduplicate' END FROM summ
  UNION ALL SELECT 3 + r, 'check failed: ' || rule_name || ' - ' || metric || '=' || printf('%.6f', value) FROM fc WHERE r <= 3)
WHERE text IS NOT NULL""")
def q_chk_recommend(spark, sf):
    checks = rule_checks(spark, sf)
    return ru.check_recommendations(ru.overall_status(checks),
                                    ru.check_summary(checks, profile_table(_evdq(spark, sf))), checks)


def _kind_query(key, kind):
    @query(key, _EV_CONS_SQL.replace("WHERE n > 0", f"WHERE n > 0 AND kind = '{kind}'"))
    def _q(spark, sf):
        return ex.schema_violations(_evdq(spark, sf), _EV_CONS).filter(F.col("kind") == kind)
    return _q


_kind_query("schema_not_null", "not_null")
_kind_query("schema_unique", "unique")
_kind_query("schema_range", "range")

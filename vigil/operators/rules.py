"""Variant-B quality rules, custom profile checks and run status (§2.6).

Rule metrics are computed as rows ``(rule_id, metric, value)`` by data
jobs, joined to the (broadcast) rule table and evaluated with
:func:`rule_eval`.  Custom checks compare the current profile with the
previous stored profile (D8)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.functions.core import duplicate_rows, missing, rnd, safe_div

TOL = 1e-10


@dataclass
class Rule:
    rule_id: str
    name: str
    rule_type: str
    metric: str
    threshold: float
    operator: str
    severity: str
    enabled: bool = True
    tags: list[str] = field(default_factory=list)
    condition: dict = field(default_factory=dict)


# The default rule set (id, type, metric, threshold, operator, severity, tags)
DEFAULT_RULES = [
    Rule("completeness_rule_001", "completeness check", "completeness", "missing_ratio", 0.05, "<=", "high",
         tags=["completeness", "mandatory"]),
    Rule("uniqueness_rule_001", "primary key uniqueness", "uniqueness", "duplicate_ratio", 0.001, "<=", "high",
         tags=["uniqueness", "mandatory"]),
    Rule("validity_rule_001", "value validity", "validity", "invalid_ratio", 0.01, "<=", "medium",
         tags=["validity", "business"]),
    Rule("consistency_rule_001", "cross-table consistency", "consistency", "inconsistency_ratio", 0.02, "<=", "medium",
         tags=["consistency", "business"]),
    Rule("distribution_rule_001", "distribution check", "distribution", "distribution_ks_stat", 0.1, "<=", "low",
         tags=["distribution", "monitoring"]),
]


def rules_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [(r.rule_id, r.name, r.rule_type, r.metric, float(r.threshold), r.operator, r.severity, r.enabled,
             list(r.tags)) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, rule_name string, rule_type string, metric string, "
                                       "threshold double, operator string, severity string, enabled boolean, "
                                       "tags array<string>")


def rule_eval(value: Column, op: Column, thr: Column) -> Column:
    """``value op threshold`` for <= < >= > == != (== and != with 1e-10)."""
    return (F.when(op == "<=", value <= thr).when(op == "<", value < thr).when(op == ">=", value >= thr)
            .when(op == ">", value > thr).when(op == "==", F.abs(value - thr) < TOL)
            .when(op == "!=", F.abs(value - thr) >= TOL))


# ---------------------------------------------------------- rule metrics
def completeness_metric(df: DataFrame) -> DataFrame:
    """R1 missing_ratio = missing cells / cells."""
    cols = df.columns
    m = sum((F.count_if(missing(df, c)) for c in cols), F.lit(0))
    return df.agg(safe_div(m, F.count(F.lit(1)) * len(cols)).alias("value")) \
        .select(F.lit("missing_ratio").alias("metric"), "value")


def uniqueness_metric(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """R2 duplicate_ratio = rows beyond the first per group / rows."""
    d = df.select(*keys) if keys else df
    dup = duplicate_rows(d).withColumn("_k", F.lit(1))
    n = d.agg(F.count(F.lit(1)).alias("_rows")).withColumn("_k", F.lit(1))
    return dup.join(n, "_k").select(F.lit("duplicate_ratio").alias("metric"),
                                    safe_div(F.col("_dups"), F.col("_rows")).alias("value"))


def validity_metric(df: DataFrame, column: str, lo=None, hi=None) -> DataFrame:
    """R3 invalid_ratio = non-missing values outside [lo, hi] / non-missing."""
    bad = F.lit(False)
    if lo is not None:
        bad = bad | (F.col(column) < lo)
    if hi is not None:
        bad = bad | (F.col(column) > hi)
    pres = ~missing(df, column)
    return df.agg(safe_div(F.count_if(pres & bad), F.count_if(pres)).alias("value")) \
        .select(F.lit("invalid_ratio").alias("metric"), "value")


def consistency_metric(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """R4 inconsistency_ratio = child rows whose key has no parent / child
    rows with a key (anti join on the key; the parent side is shuffled or,
    if AQE measures it small, broadcast)."""
    c = child.select(F.col(child_key).alias("_k")).filter(F.col("_k").isNotNull())
    p = parent.select(F.col(parent_key).alias("_k")).distinct()
    orphans = c.join(p, "_k", "left_anti").agg(F.count(F.lit(1)).alias("_o"))
    total = c.agg(F.count(F.lit(1)).alias("_t"))
    return orphans.withColumn("_j", F.lit(1)).join(total.withColumn("_j", F.lit(1)), "_j") \
        .select(F.lit("inconsistency_ratio").alias("metric"), safe_div(F.col("_o"), F.col("_t")).alias("value"))


def cross_field_metric(df: DataFrame, predicate: str) -> DataFrame:
    """R4 within-row form: share of rows violating a boolean SQL predicate."""
    ok = F.coalesce(F.expr(predicate), F.lit(False))
    return df.agg(safe_div(F.count_if(~ok), F.count(F.lit(1))).alias("value")) \
        .select(F.lit("inconsistency_ratio").alias("metric"), "value")


def distribution_metric(current: DataFrame, baseline: DataFrame, columns: Sequence[str]) -> DataFrame:
    """R5 distribution_ks_stat = largest KS statistic vs the baseline."""
    from vigil.operators.drift import ks_test
    return ks_test(baseline, current, columns).agg(F.max("statistic").alias("value")) \
        .select(F.lit("distribution_ks_stat").alias("metric"), "value")


def custom_metric(df: DataFrame, predicate: str, name: str = "custom_violation_ratio") -> DataFrame:
    """R6 user predicate: share of rows for which it is not true."""
    ok = F.coalesce(F.expr(predicate), F.lit(False))
    return df.agg(safe_div(F.count_if(~ok), F.count(F.lit(1))).alias("value")) \
        .select(F.lit(name).alias("metric"), "value")


def run_rules(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Evaluate every enabled rule against its metric row.

    ``metrics``: (metric, value).  Output: one check row per rule with
    status passed / failed (error when the metric is missing)."""
    r = rules.filter("enabled")
    j = r.join(metrics, "metric", "left")
    ok = rule_eval(F.col("value"), F.col("operator"), F.col("threshold"))
    return j.select("rule_id", "rule_name", "rule_type", "metric", rnd(F.col("value")).alias("value"),
                    "threshold", "operator", "severity",
                    F.when(F.col("value").isNull(), "error").when(ok, "passed").otherwise("failed").alias("status"))


# -------------------------------------------------------- custom checks
def column_count_check(current: DataFrame, baseline: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Columns < 0.8 x baseline → warning.  Inputs: profile rows with
    (dataset, n_columns)."""
    j = current.select("dataset", F.col("n_columns").alias("cur")).join(
        baseline.select("dataset", F.col("n_columns").alias("base")), "dataset")
    return j.select("dataset", F.lit("column_count").alias("check_name"), "cur", "base",
                    F.when(F.col("cur") < ratio * F.col("base"), "warning").otherwise("passed").alias("status"))


def row_count_check(profiles: DataFrame, key: str, order: str, lo: float = 0.5, hi: float = 2.0) -> DataFrame:
    """Row ratio to the previous profile of the same dataset outside
    [0.5, 2.0] → warning (``lag`` per dataset over profile rows)."""
    w = Window.partitionBy(key).orderBy(order)
    p = profiles.withColumn("prev_rows", F.lag("n_rows").over(w)).filter(F.col("prev_rows").isNotNull())
    ratio = safe_div(F.col("n_rows"), F.col("prev_rows"))
    return p.select(key, order, "n_rows", "prev_rows", rnd(ratio).alias("ratio"),
                    F.when((ratio < lo) | (ratio > hi), "warning").otherwise("passed").alias("status"))


def schema_rows(df: DataFrame) -> DataFrame:
    """(column, dtype, n_values) of a table: its schema, and how many values of
    each column are not null (one aggregate)."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)]) if df.columns else None
    if counts is None:
        return df.sparkSession.createDataFrame([], "column string, dtype string, n_values long")
    rows = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"n{i}").alias("n_values"))
            for i, f in enumerate(df.schema.fields)]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def dtype_check(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Changed / added / removed columns between two versions of a table, with
    the number of values that each version holds in them."""
    j = schema_rows(baseline).withColumnsRenamed({"dtype": "base_dtype", "n_values": "base_values"}).join(
        schema_rows(current).withColumnsRenamed({"dtype": "cur_dtype", "n_values": "cur_values"}), "column", "full_outer")
    change = (F.when(F.col("base_dtype").isNull(), "added").when(F.col("cur_dtype").isNull(), "removed")
              .when(F.col("base_dtype") != F.col("cur_dtype"), "type_changed"))
    return j.select("column", "base_dtype", "cur_dtype", "base_values", "cur_values", change.alias("change")).filter(F.col("change").isNotNull())


# ------------------------------------------------------------ run status
def overall_status(checks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """any failed/error → critical; any warning → warning; pass share ≥ .95
    excellent, ≥ .85 good, else error; no checks → excellent."""
    agg = checks.groupBy(*by).agg(
        F.count(F.lit(1)).cast("long").alias("n_checks"),
        F.count_if(F.col("status").isin("error", "failed")).cast("long").alias("n_critical"),
        F.count_if(F.col("status") == "warning").cast("long").alias("n_warning"),
        F.count_if(F.col("status").isin("passed", "excellent", "good")).cast("long").alias("n_passed"))
    pr = safe_div(F.col("n_passed"), F.col("n_checks"))
    st = (F.when(F.col("n_checks") == 0, "excellent").when(F.col("n_critical") > 0, "critical")
          .when(F.col("n_warning") > 0, "warning").when(pr >= 0.95, "excellent").when(pr >= 0.85, "good")
          .otherwise("error"))
    return agg.select(*by, "n_checks", "n_critical", "n_warning", "n_passed",
                      rnd(F.coalesce(pr, F.lit(1.0))).alias("pass_rate"), st.alias("overall_status"))


def check_summary(checks: DataFrame, table_profile: DataFrame) -> DataFrame:
    """metric totals, pass rate and the dataset missing / duplicate ratios
    (metrics without a threshold are informational and left out, D5)."""
    s = checks.agg(F.count(F.lit(1)).cast("long").alias("total_metrics"),
                   F.count_if(F.col("status") == "passed").cast("long").alias("passed_metrics"),
                   F.count_if(F.col("status") == "warning").cast("long").alias("warning_metrics"),
                   F.count_if(F.col("status").isin("failed", "error")).cast("long").alias("failed_metrics"))
    s = s.withColumn("pass_rate", rnd(F.coalesce(safe_div(F.col("passed_metrics"), F.col("total_metrics")), F.lit(1.0))))
    p = table_profile.select(
        rnd(safe_div(F.col("missing_cells"), F.col("n_rows") * F.col("n_columns"))).alias("missing_ratio"),
        rnd(safe_div(F.col("duplicate_rows"), F.col("n_rows"))).alias("duplicate_ratio"))
    return s.withColumn("_j", F.lit(1)).join(p.withColumn("_j", F.lit(1)), "_j").drop("_j")


def check_alerts(dataset: str, status: DataFrame, summary: DataFrame, checks: DataFrame) -> DataFrame:
    """Alerts: bad overall status, pass rate < 0.8, failed high/critical rules."""
    a = status.filter(F.col("overall_status").isin("critical", "error")).select(
        F.lit("status").alias("kind"), F.concat(F.lit("data quality "), F.col("overall_status"), F.lit(f": {dataset}")).alias("message"))
    b = summary.filter(F.col("pass_rate") < 0.8).select(
        F.lit("pass_rate").alias("kind"), F.format_string("low check pass rate: %.2f%%", F.col("pass_rate") * 100).alias("message"))
    c = checks.filter(F.col("severity").isin("high", "critical") & F.col("status").isin("failed", "error")).select(
        F.lit("rule").alias("kind"), F.concat(F.lit("important rule failed: "), F.col("rule_name")).alias("message"))
    return a.unionByName(b).unionByName(c)


def check_recommendations(status: DataFrame, summary: DataFrame, checks: DataFrame) -> DataFrame:
    """Advice rows: by status, missing > 0.1, duplicates > 0.05, and the
    first 3 failed checks (by rule id)."""
    st = status.select(F.lit(1).alias("ord"), F.when(F.col("overall_status") == "critical", "severe quality problems, investigate now")
                       .when(F.col("overall_status") == "error", "quality problems, fix with priority")
                       .when(F.col("overall_status") == "warning", "quality warnings, keep watching").alias("text"))
    ms = summary.select(F.lit(2).alias("ord"), F.when(F.col("missing_ratio") > 0.1, "high missing ratio, check the source or impute").alias("text"))
    ds = summary.select(F.lit(3).alias("ord"), F.when(F.col("duplicate_ratio") > 0.05, "many duplicate rows, deduplicate").alias("text"))
    # first three failed checks: ORDER BY … LIMIT 3, then numbered (3 rows)
    first3 = checks.filter(F.col("status").isin("failed", "error")).orderBy("rule_id").limit(3)
    fc = first3.withColumn("_r", F.row_number().over(Window.orderBy("rule_id"))).select((F.lit(3) + F.col("_r")).alias("ord"),
                                         F.concat(F.lit("check failed: "), F.col("rule_name"), F.lit(" - "),
                                                  F.col("metric"), F.lit("="), F.format_string("%.6f", F.col("value"))).alias("text"))
    return st.unionByName(ms).unionByName(ds).unionByName(fc).filter(F.col("text").isNotNull())

"""Data-quality metrics, thresholds, score, status and alerts (§2.5).

Metrics are produced as a long table (one row per metric) so that score,
status, alerts and pipeline roll-ups are ordinary grouped aggregates:

    dataset, name, column, metric_type, value, threshold, direction, status

``direction`` is explicit per metric (``ge`` = higher is better, ``le`` =
lower is better), fixing the reference's type-based pass test.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.core import distinct_counts, duplicate_rows, exact_quantiles, is_numeric, is_time, missing, rnd, safe_div

# Fixed values (must equal the reference):
# default threshold table: metric name, type, warning, error, condition
DEFAULT_THRESHOLDS = [
    ("missing_values_rate", "completeness", 0.05, 0.10, "le"),
    ("accuracy_score", "accuracy", 0.90, 0.80, "ge"),
    ("inconsistency_rate", "consistency", 0.05, 0.10, "le"),
    ("invalid_values_rate", "validity", 0.05, 0.10, "le"),
    ("duplicate_rate", "uniqueness", 0.05, 0.10, "le"),
]
# score weights by metric type (monitor variant); any other type weighs 0.05
MONITOR_WEIGHTS = {"completeness": 0.30, "accuracy": 0.25, "validity": 0.20,
                   "consistency": 0.15, "uniqueness": 0.10}
DEFAULT_WEIGHT = 0.05
# class-level variant of the weights
CLASS_WEIGHTS = {"completeness": 0.25, "accuracy": 0.25, "consistency": 0.20,
                 "validity": 0.15, "uniqueness": 0.10, "timeliness": 0.05}
# keyword lists, tested in this order, for the metric type of a name
TYPE_KEYWORDS = [
    ("completeness", ["completeness", "missing", "null"]),
    ("accuracy", ["accuracy", "correctness", "precision"]),
    ("consistency", ["consistency", "coherence"]),
    ("validity", ["validity", "valid", "outlier"]),
    ("uniqueness", ["uniqueness", "duplicate", "unique"]),
    ("timeliness", ["freshness", "timeliness", "age"]),
    ("volume", ["volume", "count", "size"]),
    ("distribution", ["distribution", "skew", "kurtosis"]),
]
# status bands of the overall score (lower bound, status), first match wins
STATUS_BANDS = [(90, "excellent"), (80, "good"), (70, "fair"), (60, "warning"), (50, "poor"), (30, "error")]
# worst-first status priority for pipeline roll-up
STATUS_PRIORITY = {"failed": 0, "error": 1, "poor": 2, "warning": 3, "fair": 4, "good": 5,
                   "excellent": 6, "unknown": 7}

METRIC_SCHEMA = ("dataset string, name string, column string, metric_type string, value double, "
                 "threshold double, direction string")


def metric_type_of(name: Column) -> Column:
    """Ordered keyword match of the lower-cased name; default completeness."""
    low = F.lower(name)
    expr = None
    for typ, words in TYPE_KEYWORDS:
        cond = None
        for w in words:
            c = F.instr(low, w) > 0
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, typ) if expr is None else expr.when(cond, typ)
    return expr.otherwise("completeness")


def thresholds_table(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows or DEFAULT_THRESHOLDS,
                                 "t_name string, t_type string, warning double, error double, t_direction string")


def _metric(dataset: str, name: str, column: str | None, mtype: str | None, value: Column,
            threshold: float | None, direction: str | None) -> Column:
    return F.struct(F.lit(dataset).alias("dataset"), F.lit(name).alias("name"),
                    F.lit(column).cast("string").alias("column"), F.lit(mtype).cast("string").alias("metric_type"),
                    value.cast("double").alias("value"), F.lit(threshold).cast("double").alias("threshold"),
                    F.lit(direction).cast("string").alias("direction"))


ALL_FAMILIES = ("overall", "duplicate", "missing", "zero", "outlier", "freshness",
                "profile_completeness", "profile_uniqueness", "profile_validity")


def quality_metrics(df: DataFrame, dataset: str, as_of: Column | None = None,
                    families: Sequence[str] = ALL_FAMILIES, thresholds: DataFrame | None = None,
                    approx_distinct: bool = False) -> DataFrame:
    """Variant-A metrics of one dataset as long rows (``families`` picks
    which; only their aggregates are planned).

    Work: exact quartiles of the numeric columns first (sketch + bracket
    scan, a small result), then one wide aggregate (counts, zeros,
    finiteness, distincts, IQR outliers against the literal fences, max
    timestamps) and the hashed duplicate count.  ``approx_distinct`` swaps
    the exact distinct counts (:func:`distinct_counts`) for HLL sketches."""
    fam = set(families)
    cols = df.columns
    num = [c for c in cols if is_numeric(df, c)]
    fresh = [c for c in cols if is_time(df, c) and ("date" in c.lower() or "time" in c.lower())]
    if as_of is None:
        fresh = []
    fences = {}
    if "outlier" in fam and num:
        # IQR fences from exact quartiles (a small materialised result), then
        # the outlier counts ride in the same wide aggregate as the rest
        qs = {(r["feature"], r["p"]): r["q"] for r in exact_quantiles(df, num, [0.25, 0.75]).collect()}
        for c in num:
            q1, q3 = qs.get((c, 0.25)), qs.get((c, 0.75))
            if q1 is not None and q3 is not None:
                fences[c] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in cols:
        aggs.append(F.count_if(missing(df, c)).alias(f"{c}__miss"))
        if "profile_uniqueness" in fam and approx_distinct:
            aggs.append(F.approx_count_distinct(F.when(~missing(df, c), F.col(c))).alias(f"{c}__dist"))
    for c in num:
        x = F.col(c).cast("double")
        if "zero" in fam:
            aggs.append(F.count_if(~missing(df, c) & (x == 0)).alias(f"{c}__zero"))
        if "profile_validity" in fam:
            aggs.append(F.count_if(~missing(df, c) & (F.abs(x) < float("inf"))).alias(f"{c}__fin"))
        if "outlier" in fam:
            if c in fences:
                lo, hi = fences[c]
                aggs.append(F.count_if(~missing(df, c) & ((x < F.lit(lo)) | (x > F.lit(hi)))).alias(f"{c}__out"))
            else:
                aggs.append(F.lit(0).alias(f"{c}__out"))
    if "freshness" in fam:
        for c in fresh:
            aggs.append(F.max(c).alias(f"{c}__max"))
    wide = df.agg(*aggs)
    if "profile_uniqueness" in fam and not approx_distinct:
        wide = _one_row_join(wide, distinct_counts(df, {f"{c}__dist": F.when(~missing(df, c), F.col(c)) for c in cols}))
    if "duplicate" in fam:
        # group on all columns, count rows beyond the first occurrence
        wide = _one_row_join(wide, duplicate_rows(df))
    n = F.col("_rows")
    ms: list[Column] = []
    if "overall" in fam:
        total_miss = sum((F.col(f"{c}__miss") for c in cols), F.lit(0))
        ms.append(_metric(dataset, "overall_completeness", None, "completeness",
                          1 - safe_div(total_miss, n * len(cols)), 0.95, "ge"))
    if "duplicate" in fam:
        ms.append(_metric(dataset, "duplicate_rate", None, "uniqueness", safe_div(F.col("_dups"), n), 0.05, "le"))
    if "missing" in fam:
        for c in cols:
            ms.append(_metric(dataset, f"missing_rate_{c}", c, "completeness",
                              safe_div(F.col(f"{c}__miss"), n), 0.10, "le"))
    for c in num:
        pres = n - F.col(f"{c}__miss")
        if "zero" in fam:
            ms.append(_metric(dataset, f"zero_rate_{c}", c, "validity", safe_div(F.col(f"{c}__zero"), pres), 0.50, "le"))
        if "outlier" in fam:
            ms.append(_metric(dataset, f"outlier_rate_{c}", c, "validity", safe_div(F.col(f"{c}__out"), pres), 0.05, "le"))
    if "freshness" in fam:
        for c in fresh:
            age_days = F.floor(F.timestamp_diff("MICROSECOND", F.col(f"{c}__max"), as_of) / 86400e6)
            ms.append(_metric(dataset, f"data_freshness_{c}", c, "timeliness", age_days, 7.0, "le"))
    for c in cols:
        if "profile_completeness" in fam:
            ms.append(_metric(dataset, f"profile_completeness_{c}", c, None,
                              1 - safe_div(F.col(f"{c}__miss"), n), None, None))
        if "profile_uniqueness" in fam:
            ms.append(_metric(dataset, f"profile_uniqueness_{c}", c, None,
                              safe_div(F.col(f"{c}__dist"), n), None, None))
    if "profile_validity" in fam:
        for c in num:
            ms.append(_metric(dataset, f"profile_validity_{c}", c, None, safe_div(F.col(f"{c}__fin"), n), None, None))
    long = wide.select(F.explode(F.array(*ms)).alias("m")).select("m.*").filter(F.col("value").isNotNull())
    return attach_thresholds(long, thresholds)


def entropy(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Shannon entropy (bits) of each categorical column, nulls ignored."""
    lf = df.select(*[F.col(c).cast("string") for c in columns]).unpivot([], list(columns), "column", "value") \
        .filter(F.col("value").isNotNull())
    counts = lf.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    tot = counts.groupBy("column").agg(F.sum("n").alias("_t"))
    p = counts.join(tot, "column").select("column", (F.col("n") / F.col("_t")).alias("p"))
    return p.groupBy("column").agg(rnd(-F.sum(F.col("p") * F.log2("p"))).alias("entropy"),
                                   F.count(F.lit(1)).cast("long").alias("n_values"))


def _one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Combine two single-row aggregates side by side (a keyed join on a
    constant, so no cartesian product is planned)."""
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")


def attach_thresholds(metrics: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """``dq_metric_type`` + ``dq_thresholds`` + ``dq_pass``: fill the type by
    keyword inference, the threshold and direction from the (broadcast)
    threshold table by exact name, then the pass status."""
    spark = metrics.sparkSession
    t = thresholds if thresholds is not None else thresholds_table(spark)
    j = metrics.join(t, metrics["name"] == t["t_name"], "left")
    j = j.select(
        "dataset", "name", "column",
        F.coalesce(F.col("metric_type"), F.col("t_type"), metric_type_of(F.col("name"))).alias("metric_type"),
        "value",
        F.coalesce(F.col("threshold"), F.col("warning")).alias("threshold"),
        F.coalesce(F.col("direction"), F.col("t_direction")).alias("direction"))
    return j.withColumn("status", pass_status(F.col("value"), F.col("threshold"), F.col("direction")))


def pass_status(value: Column, thr: Column, direction: Column) -> Column:
    return (F.when(thr.isNull(), "measured")
            .when((direction == "ge") & (value >= thr), "passed")
            .when((direction == "le") & (value <= thr), "passed")
            .otherwise("failed"))


def bounds_status(value: Column, lo: Column, hi: Column) -> Column:
    """Variant-B status with optional min/max bounds; no bound = measured."""
    return (F.when(lo.isNull() & hi.isNull(), "measured")
            .when((lo.isNull() | (value >= lo)) & (hi.isNull() | (value <= hi)), "passed")
            .otherwise("failed"))


def _weight(t: Column, weights: Mapping[str, float]) -> Column:
    e = None
    for k, w in weights.items():
        e = F.when(t == k, w) if e is None else e.when(t == k, w)
    return e.otherwise(DEFAULT_WEIGHT)


def metric_score(value: Column, thr: Column, direction: Column) -> Column:
    """Per-metric 0–100 score: pass = 100; below a ge-threshold value/thr·100;
    above a le-threshold max(0, 100 − (v−t)/t·100); no threshold 50."""
    ge = F.when(value >= thr, 100.0).otherwise(safe_div(value, thr) * 100)
    le = F.when(value <= thr, 100.0).otherwise(F.greatest(F.lit(0.0), 100 - safe_div(value - thr, thr) * 100))
    return F.when(thr.isNull(), 50.0).when(direction == "ge", ge).otherwise(le)


def class_score(value: Column, thr: Column, direction: Column) -> Column:
    """Class-level mode: value·100 (ge) or 100 − value·100 (le), clamped."""
    v = F.when(direction == "ge", value * 100).otherwise(100 - value * 100)
    return F.when(thr.isNull(), 50.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), v)))


def score_status_expr(score: Column, critical: Column) -> Column:
    e = F.when(critical >= 3, "failed")
    for lo, st in STATUS_BANDS:
        e = e.when(score >= lo, st)
    return e.otherwise("failed")


def dq_score(metrics: DataFrame, by: Sequence[str] = ("dataset",), mode: str = "monitor") -> DataFrame:
    """Weighted overall score and status per dataset (``dq_score`` +
    ``dq_status``); critical failures: ge-metric < 0.5·thr, le-metric > 2·thr."""
    weights = MONITOR_WEIGHTS if mode == "monitor" else CLASS_WEIGHTS
    sc = metric_score if mode == "monitor" else class_score
    m = metrics.select(*by, F.col("metric_type"), "value", "threshold", "direction", "status",
                       _weight(F.col("metric_type"), weights).alias("_w"),
                       sc(F.col("value"), F.col("threshold"), F.col("direction")).alias("_s"))
    crit = ((F.col("status") == "failed") &
            (((F.col("direction") == "ge") & (F.col("value") < F.col("threshold") * 0.5)) |
             ((F.col("direction") == "le") & (F.col("value") > F.col("threshold") * 2.0))))
    agg = m.groupBy(*by).agg((F.sum(F.col("_s") * F.col("_w")) / F.sum("_w")).alias("_score"),
                             F.count_if(crit).alias("critical_failures"))
    return agg.select(*by, rnd(F.col("_score")).alias("overall_score"),
                      F.col("critical_failures").cast("long"),
                      score_status_expr(F.col("_score"), F.col("critical_failures")).alias("status"))


def failed_and_warning(metrics: DataFrame) -> DataFrame:
    """Failed metrics and near-threshold (warning) metrics, labelled."""
    v, t, d = F.col("value"), F.col("threshold"), F.col("direction")
    warn = t.isNotNull() & (((d == "ge") & (v >= 0.8) & (v < t)) | ((d == "le") & (v > t) & (v <= 1.2)))
    kind = F.when(F.col("status") == "failed", "failed").when(warn, "warning")
    return metrics.withColumn("kind", kind).filter(F.col("kind").isNotNull())


def metric_alerts(metrics: DataFrame) -> DataFrame:
    """One alert row per failed metric."""
    f = metrics.filter(F.col("status") == "failed")
    msg = F.format_string("[%s] metric %s out of threshold: value=%.4f, threshold=%.4f",
                          F.col("dataset"), F.col("name"), F.col("value"), F.col("threshold"))
    return f.select("dataset", "name", "metric_type", msg.alias("message"))


def run_summary(metrics: DataFrame, shape: DataFrame | None = None) -> DataFrame:
    """total / passed / failed / warning counts per dataset."""
    v, t, d = F.col("value"), F.col("threshold"), F.col("direction")
    warn = t.isNotNull() & (((d == "ge") & (v >= 0.8) & (v < t)) | ((d == "le") & (v > t) & (v <= 1.2)))
    out = metrics.groupBy("dataset").agg(
        F.count(F.lit(1)).cast("long").alias("total_checks"),
        F.count_if(F.col("status") != "failed").cast("long").alias("passed_checks"),
        F.count_if(F.col("status") == "failed").cast("long").alias("failed_checks"),
        F.count_if(warn).cast("long").alias("warning_checks"))
    if shape is not None:
        out = out.join(shape, "dataset", "left")
    return out


def recommendations(metrics: DataFrame) -> DataFrame:
    """Advice text per failed metric, by metric type."""
    f = metrics.filter(F.col("status") == "failed")
    pct = lambda c: F.format_string("%.2f%%", c * 100)
    t = F.col("metric_type")
    text = (F.when(t == "completeness", F.concat(F.lit("raise completeness: "), F.col("name"), F.lit(" is "),
                                                    pct(F.col("value")), F.lit(", threshold "), pct(F.col("threshold"))))
            .when(t == "accuracy", F.concat(F.lit("raise accuracy: "), F.col("name"), F.lit(" is "),
                                            pct(F.col("value")), F.lit(", threshold "), pct(F.col("threshold"))))
            .when(t == "validity", F.concat(F.lit("improve validity: "), F.col("name"), F.lit(" is "),
                                            pct(F.col("value")), F.lit(", above threshold "), pct(F.col("threshold")))))
    return f.select("dataset", "name", text.alias("recommendation")).filter(F.col("recommendation").isNotNull())


def pipeline_rollup(scores: DataFrame) -> DataFrame:
    """Pipeline status = worst dataset status; score = mean dataset score;
    success rate = share of excellent/good/fair datasets."""
    prio = None
    for st, p in STATUS_PRIORITY.items():
        prio = F.when(F.col("status") == st, p) if prio is None else prio.when(F.col("status") == st, p)
    s = scores.withColumn("_p", prio)
    return s.agg(F.count(F.lit(1)).cast("long").alias("n_datasets"),
                 F.min_by("status", F.struct("_p", "dataset")).alias("pipeline_status"),
                 rnd(F.avg("overall_score")).alias("pipeline_score"),
                 rnd(F.avg(F.col("status").isin("excellent", "good", "fair").cast("double"))).alias("success_rate"))


# Mean pass rate from which a pipeline without errors and warnings is excellent, good
PASS_BANDS = (0.95, 0.85)


def pipeline_status(results: DataFrame) -> DataFrame:
    """The other pipeline status, from per-dataset results (overall_status,
    pass_rate): critical if any dataset is critical or in error, else warning
    if any has a warning, else by the mean pass rate (a null one counts as 0);
    excellent without datasets."""
    bad, warn = F.count_if(F.col("overall_status").isin("critical", "error")), F.count_if(F.col("overall_status") == "warning")
    g = results.agg(F.count(F.lit(1)).cast("long").alias("n_datasets"), bad.alias("_bad"), warn.alias("_warn"),
                    F.avg(F.coalesce(F.col("pass_rate"), F.lit(0.0))).alias("_rate"))
    status = (F.when(F.col("n_datasets") == 0, "excellent").when(F.col("_bad") > 0, "critical").when(F.col("_warn") > 0, "warning")
              .when(F.col("_rate") >= PASS_BANDS[0], "excellent").when(F.col("_rate") >= PASS_BANDS[1], "good").otherwise("error"))
    return g.select("n_datasets", rnd(F.col("_rate")).alias("mean_pass_rate"), status.alias("pipeline_status"))


def pipeline_metrics(metrics: DataFrame) -> DataFrame:
    """Mean per (metric type, name) across datasets: ``pipeline_avg_<name>``."""
    return metrics.groupBy("metric_type", "name").agg(
        rnd(F.avg("value")).alias("value"), F.count(F.lit(1)).cast("long").alias("n_datasets")) \
        .select("metric_type", F.concat(F.lit("pipeline_avg_"), F.col("name")).alias("name"), "value", "n_datasets")


def pipeline_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.select("dataset", F.concat(F.lit("["), F.col("dataset"), F.lit("] "), F.col("message")).alias("message"))


def quality_gate(scores: DataFrame, threshold: float = 95.0, ok_status=("excellent", "good", "fair")) -> DataFrame:
    """Dataset passes if score ≥ threshold or its status is acceptable."""
    return scores.withColumn("passed", (F.col("overall_score") >= threshold) | F.col("status").isin(*ok_status))

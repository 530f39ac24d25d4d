"""History, trend and anomaly operators over run tables (§2.10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.core import rnd


def lookback(df: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """Rows with as_of − days ≤ ts (``filter_lookback``); ``as_of`` is a
    parameter, never the wall clock, so results are reproducible."""
    return df.filter(F.col(ts) >= F.timestamp_add("DAY", F.lit(-days), as_of))


def drift_summary(runs: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """checks, drifted, rate, counts by severity, last 5 drifted days, last
    check per model.  Windows are per model over run rows (one per check)."""
    r = lookback(runs, "ts", as_of, days)
    w = Window.partitionBy("model_name", "is_drifted").orderBy(F.col("ts").desc())
    r = r.withColumn("rn", F.row_number().over(w))
    recent = F.when(F.col("is_drifted") & (F.col("rn") <= 5), F.date_format("ts", "yyyy-MM-dd"))
    sev = lambda s: F.count_if(F.col("is_drifted") & (F.col("severity") == s)).cast("long")
    return r.groupBy("model_name").agg(
        F.count(F.lit(1)).cast("long").alias("total_checks"),
        F.count_if("is_drifted").cast("long").alias("drifted_checks"),
        rnd(F.count_if("is_drifted") / F.count(F.lit(1))).alias("drift_rate"),
        sev("low").alias("n_low"), sev("medium").alias("n_medium"), sev("high").alias("n_high"),
        sev("critical").alias("n_critical"),
        F.concat_ws(",", F.sort_array(F.collect_list(recent))).alias("recent_drifts"),
        F.max("ts").alias("last_check"))


def score_stats(runs: DataFrame, key: str = "dataset", score: str = "overall_score", ts: str = "ts") -> DataFrame:
    """mean, population std, min, max and latest score per series."""
    return runs.groupBy(key).agg(
        F.count(F.lit(1)).cast("long").alias("n_runs"), rnd(F.avg(score)).alias("mean_score"),
        rnd(F.stddev_pop(score)).alias("std_score"), F.min(score).alias("min_score"),
        F.max(score).alias("max_score"), F.max_by(score, F.struct(ts, score)).alias("latest_score"))


def status_distribution(runs: DataFrame, key: str = "dataset", status: str = "status") -> DataFrame:
    return runs.groupBy(key, status).agg(F.count(F.lit(1)).cast("long").alias("n"))


def daily(runs: DataFrame, key: str = "dataset", score: str = "overall_score", ts: str = "ts") -> DataFrame:
    return runs.groupBy(key, F.to_date(ts).alias("day")).agg(
        rnd(F.avg(score)).alias("mean_score"), F.min(score).alias("min_score"), F.max(score).alias("max_score"),
        F.count(F.lit(1)).cast("long").alias("n_runs"))


def last_n(runs: DataFrame, n: int = 10, key: str = "dataset", ts: str = "ts") -> DataFrame:
    """Newest n runs per series.  Run rows per series are few (one per run)."""
    w = Window.partitionBy(key).orderBy(F.col(ts).desc())
    return runs.withColumn("recency", F.row_number().over(w).cast("long")).filter(F.col("recency") <= n)


def trend_time(runs: DataFrame, key: str = "dataset", score: str = "overall_score", ts: str = "ts",
               band: float = 0.1) -> DataFrame:
    """OLS slope of score on seconds since the first run (time axis centred
    for a stable fit); improving / deteriorating / stable at ±0.1."""
    first = runs.groupBy(key).agg(F.min(ts).alias("_t0"), F.avg(F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts))).alias("_tm"))
    j = runs.join(first, key)
    secs = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts)) - F.col("_tm")
    g = j.groupBy(key).agg(F.regr_slope(F.col(score), secs).alias("slope"),
                           F.count(F.lit(1)).cast("long").alias("n_runs"),
                           F.max_by(score, ts).alias("latest_score"), F.min_by(score, ts).alias("first_score"),
                           F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    trend = F.when(F.col("slope") > band, "improving").when(F.col("slope") < -band, "deteriorating").otherwise("stable")
    return g.filter(F.col("n_runs") >= 2).select(
        key, "n_runs", rnd(F.col("slope"), 12).alias("slope"), trend.alias("trend"), "latest_score",
        rnd(F.col("latest_score") - F.col("first_score")).alias("score_change"),
        F.floor(F.timestamp_diff("SECOND", F.col("_a"), F.col("_b")) / 86400).cast("long").alias("period_days"))


def trend_index(runs: DataFrame, key: str = "dataset", value: str = "pass_rate", ts: str = "ts",
                band: float = 0.001) -> DataFrame:
    """OLS slope of the value on the run index; improving / declining /
    stable at ±0.001; plus mean and population std."""
    w = Window.partitionBy(key).orderBy(ts)
    r = runs.withColumn("_i", (F.row_number().over(w) - 1).cast("double"))
    g = r.groupBy(key).agg(F.regr_slope(F.col(value), F.col("_i")).alias("slope"),
                           F.count(F.lit(1)).cast("long").alias("n_points"),
                           F.max_by(value, ts).alias("current"), F.avg(value).alias("_m"),
                           F.stddev_pop(value).alias("_s"))
    trend = F.when(F.col("slope") > band, "improving").when(F.col("slope") < -band, "declining").otherwise("stable")
    return g.filter(F.col("n_points") >= 2).select(key, "n_points", rnd(F.col("slope")).alias("slope"),
                                                    trend.alias("trend"), rnd(F.col("current")).alias("current"),
                                                    rnd(F.col("_m")).alias("mean"), rnd(F.col("_s")).alias("std"))


def anomalies_sigma(runs: DataFrame, key: str = "dataset", score: str = "overall_score", ts: str = "ts",
                    k: float = 2.0, min_points: int = 3) -> DataFrame:
    """|score − mean| > 2·std (population) within each series of ≥ 3 runs."""
    st = runs.groupBy(key).agg(F.avg(score).alias("_m"), F.stddev_pop(score).alias("_s"),
                               F.count(F.lit(1)).alias("_n"))
    r = runs.join(st, key)
    f = r.filter((F.col("_n") >= min_points) & (F.abs(F.col(score) - F.col("_m")) > k * F.col("_s")))
    return f.select(key, ts, score, rnd(F.col("_m")).alias("mean_score"),
                    rnd(F.col(score) - F.col("_m")).alias("deviation"))


def anomalies_jump(runs: DataFrame, key: str = "dataset", score: str = "overall_score", ts: str = "ts",
                   jump: float = 10.0) -> DataFrame:
    """|score − previous score| > 10."""
    w = Window.partitionBy(key).orderBy(ts)
    r = runs.withColumn("prev_score", F.lag(score).over(w))
    return r.filter(F.abs(F.col(score) - F.col("prev_score")) > jump).select(
        key, ts, score, "prev_score", rnd(F.col(score) - F.col("prev_score")).alias("change"))


def anomalies_iqr(runs: DataFrame, key: str = "dataset", value: str = "pass_rate", ts: str = "ts",
                  min_points: int = 3) -> DataFrame:
    """Points outside the series' IQR fence; returns the run index."""
    from vigil.functions.core import cell, exact_quantiles
    q = exact_quantiles(runs, [value], [0.25, 0.75], [key]) \
        .groupBy(cell([key]).alias("_cell")).agg(F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q1"),
                                                F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q3"))
    w = Window.partitionBy(key).orderBy(ts)
    wa = Window.partitionBy(key)
    r = runs.withColumn("idx", (F.row_number().over(w) - 1).cast("long")).withColumn("_n", F.count(F.lit(1)).over(wa))
    j = r.withColumn("_cell", cell([key])).join(q, "_cell")
    iqr = F.col("q3") - F.col("q1")
    out = j.filter((F.col("_n") >= min_points) &
                   ((F.col(value) < F.col("q1") - 1.5 * iqr) | (F.col(value) > F.col("q3") + 1.5 * iqr)))
    return out.select(key, "idx", ts, rnd(F.col(value)).alias(value))


def declining(runs: DataFrame, key: str = "dataset", score: str = "overall_score", ts: str = "ts",
              n: int = 5) -> DataFrame:
    """Series whose last n scores are strictly decreasing."""
    w = Window.partitionBy(key).orderBy(F.col(ts).desc())
    last = runs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    w2 = Window.partitionBy(key).orderBy(ts)
    last = last.withColumn("_prev", F.lag(score).over(w2))
    g = last.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(score) < F.col("_prev")).alias("_dec"))
    dec = (F.col("_n") == n) & (F.col("_dec") == n - 1)
    advice = F.when(dec, F.lit("quality keeps declining, check the processing flow now")).otherwise(F.lit(""))
    return g.select(key, dec.alias("declining"), advice.alias("recommendation"))


def quality_summary(runs: DataFrame, key: str = "dataset", ts: str = "ts") -> DataFrame:
    """runs, success / warning / error counts, success rate, average pass
    rate and latest status per dataset."""
    st = F.col("status")
    pr = F.col("passed") / (F.col("passed") + F.col("failed"))
    return runs.groupBy(key).agg(
        F.count(F.lit(1)).cast("long").alias("total_runs"),
        F.count_if(st.isin("excellent", "good")).cast("long").alias("success_runs"),
        F.count_if(st.isin("fair", "warning")).cast("long").alias("warning_runs"),
        F.count_if(st.isin("poor", "error", "failed")).cast("long").alias("error_runs"),
        rnd(F.avg(st.isin("excellent", "good").cast("double"))).alias("success_rate"),
        rnd(F.avg(pr)).alias("avg_pass_rate"),
        F.max_by("status", ts).alias("latest_status"))


def quality_report(checks: DataFrame, top: int = 10) -> DataFrame:
    """Failed checks (status failed or error) counted by type, by severity and
    in total (one GROUPING SETS aggregate), plus the top failing check names."""
    f = checks.filter(F.col("status").isin("failed", "error"))
    gs = f.groupingSets([["check_type"], ["severity"], []], "check_type", "severity") \
        .agg(F.count(F.lit(1)).cast("long").alias("n_failed"))
    dims = gs.select(F.when(F.col("check_type").isNotNull(), "by_type")
                     .when(F.col("severity").isNotNull(), "by_severity").otherwise("total").alias("level"),
                     F.coalesce("check_type", "severity", F.lit("all")).alias("item"), "n_failed")
    names = f.groupBy("check_name").agg(F.count(F.lit(1)).cast("long").alias("n_failed"))
    # ORDER BY … LIMIT: per-partition top-n, then one small merge
    topn = names.orderBy(F.col("n_failed").desc(), F.col("check_name")).limit(top) \
        .select(F.lit("top_check").alias("level"), F.col("check_name").alias("item"), "n_failed")
    return dims.unionByName(topn)


def quality_rates(checks: DataFrame, run: str = "run_id", dataset: str = "dataset", ts: str = "ts") -> DataFrame:
    """Per dataset: runs, mean / least / greatest pass rate of a run, checks by
    status, the period covered and the advice that follows from the mean."""
    st = F.col("status")
    runs = checks.groupBy(dataset, run).agg(
        F.avg((st == "passed").cast("double")).alias("_r"), F.count_if(st == "passed").alias("_p"),
        F.count_if(st == "warning").alias("_w"), F.count_if(st.isin("failed", "error")).alias("_f"),
        F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    g = runs.groupBy(dataset).agg(
        F.count(F.lit(1)).cast("long").alias("n_runs"), rnd(F.avg("_r")).alias("avg_pass_rate"),
        rnd(F.min("_r")).alias("min_pass_rate"), rnd(F.max("_r")).alias("max_pass_rate"),
        F.sum("_p").cast("long").alias("n_passed"), F.sum("_w").cast("long").alias("n_warning"),
        F.sum("_f").cast("long").alias("n_failed"), F.min("_a").alias("first_ts"), F.max("_b").alias("last_ts"))
    advice = F.when(F.col("avg_pass_rate") < 0.8, "review the failing checks").when(
        F.col("min_pass_rate") < 0.8, "review the worst runs").otherwise("none")
    return g.withColumn("advice", advice)

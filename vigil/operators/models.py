"""Model metrics, version comparison and lifecycle tables (§2.10)."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.core import cell, cumulative, rnd, safe_div, top_k


def cls_metrics(df: DataFrame, label: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """accuracy, precision, recall, F1 (zero division → 0) from tp/fp/fn/tn;
    rows without a label or a prediction are counted as ``n_dropped``."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    g = df.groupBy(*keys).agg(F.count_if(y.isNull() | p.isNull()).alias("n_dropped"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
                              F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    prec = F.coalesce(safe_div(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(safe_div(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(safe_div(2 * prec * rec, prec + rec), F.lit(0.0))
    return g.select(*keys, *[F.col(c).cast("long") for c in ("tp", "fp", "fn", "tn", "n_dropped")],
                    rnd(safe_div(tp + tn, tp + fp + fn + tn)).alias("accuracy"), rnd(prec).alias("precision"),
                    rnd(rec).alias("recall"), rnd(f1).alias("f1"))


def auc(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """ROC AUC by the rank-sum (Mann–Whitney) identity with ties counted
    half: Σ_s pos(s)·(neg_below(s) + neg(s)/2) / (P·N).  Scores are grouped
    first and ranked with range-wise running sums (no global window).  Rows
    without a label or a score take no part and are counted as ``n_dropped``;
    null keys are a group of their own."""
    keys = list(keys)
    known = F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    s = F.when(known, F.col(score).cast("double"))
    counts = df.groupBy(*keys, s.alias("s")).agg(F.count_if(known & (F.col(label) == 1)).alias("pos"),
                                                 F.count_if(known & (F.col(label) != 1)).alias("neg"), F.count_if(~known).alias("_out"))
    cum = cumulative(counts, keys, "s", ["neg"])
    g = cum.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2.0)).alias("_u"),
                               F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.sum("_out").alias("D"))
    return g.select(*keys, F.col("P").cast("long").alias("n_pos"), F.col("N").cast("long").alias("n_neg"),
                    F.col("D").cast("long").alias("n_dropped"), rnd(safe_div(F.col("_u"), F.col("P") * F.col("N"))).alias("auc"))


def reg_metrics(df: DataFrame, y: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """MAE, MSE, R² = 1 − SSE / SST (null for a constant target)."""
    e = F.col(y) - F.col(pred)
    g = df.groupBy(*keys).agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
                              F.sum(e * e).alias("_sse"), F.var_pop(y).alias("_v"), F.count(F.lit(1)).alias("n"))
    return g.select(*keys, F.col("n").cast("long"), rnd(F.col("mae")).alias("mae"), rnd(F.col("mse"), 6).alias("mse"),
                    rnd(1 - F.try_divide(F.col("_sse"), F.col("_v") * F.col("n"))).alias("r2"))


def confusion_matrix(df: DataFrame, label: str, pred: str, classes: Sequence) -> DataFrame:
    """Counts per (label, prediction) as a pivot with a fixed class list."""
    return df.groupBy(F.col(label).alias("label")).pivot(pred, list(classes)).agg(F.count(F.lit(1))) \
        .select("label", *[F.coalesce(F.col(str(c)), F.lit(0)).cast("long").alias(f"pred_{c}") for c in classes])


def fairness(df: DataFrame, group: str, label: str, pred: str, threshold: float = 0.8) -> DataFrame:
    """Disparate impact (min/max positive rate over groups) and equal
    opportunity difference (max − min true-positive rate); passes if the
    impact ratio ≥ 0.8."""
    g = df.groupBy(group).agg(F.avg((F.col(pred) == 1).cast("double")).alias("pos_rate"),
                              safe_div(F.count_if((F.col(pred) == 1) & (F.col(label) == 1)),
                                       F.count_if(F.col(label) == 1)).alias("tpr"))
    a = g.agg(F.count(F.lit(1)).cast("long").alias("n_groups"),
              safe_div(F.min("pos_rate"), F.max("pos_rate")).alias("_di"),
              (F.max("tpr") - F.min("tpr")).alias("_eo"))
    return a.select("n_groups", rnd(F.col("_di")).alias("disparate_impact"), rnd(F.col("_eo")).alias("equal_opportunity_diff"),
                    F.coalesce(F.col("_di") >= threshold, F.lit(False)).alias("passed"))


def error_slices(df: DataFrame, features: Sequence[str], error: str, min_rows: int = 1, pairs: bool = False) -> DataFrame:
    """Error rate and lift per (feature, value) slice; with ``pairs`` also per
    pair of features (names and values joined by " & "; a null value of
    either makes the pair's value null)."""
    text = {c: F.col(c).cast("string") for c in features}
    cells = [F.struct(F.lit(c).alias("feature"), v.alias("value")) for c, v in text.items()]
    if pairs:
        cells += [F.struct(F.lit(f"{a} & {b}").alias("feature"), F.concat(text[a], F.lit(" & "), text[b]).alias("value"))
                  for a, b in itertools.combinations(features, 2)]
    lf = df.select(F.col(error).cast("double").alias("_e"), F.explode(F.array(*cells)).alias("s")).select("_e", "s.*")
    s = lf.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), F.avg("_e").alias("error_rate"))
    overall = df.agg(F.avg(F.col(error).cast("double")).alias("_o"))
    j = s.withColumn("_k", F.lit(1)).join(overall.withColumn("_k", F.lit(1)), "_k")
    return j.filter(F.col("n") >= min_rows).select(
        "feature", "value", F.col("n").cast("long"), rnd(F.col("error_rate")).alias("error_rate"),
        rnd(safe_div(F.col("error_rate"), F.col("_o"))).alias("lift"))


def confidence_entropy(df: DataFrame, conf: str, period: Column, pred: str, n_bins: int = 10) -> DataFrame:
    """Per period: entropy (bits) of the 10-bin confidence histogram and the
    positive-class share (imbalance)."""
    b = F.least(F.floor(F.col(conf) * n_bins), F.lit(n_bins - 1)).cast("int")
    x = df.select(period.alias("period"), b.alias("bin"), F.col(pred).alias("_p"))
    h = x.groupBy("period", "bin").agg(F.count(F.lit(1)).alias("n"))
    tot = x.groupBy("period").agg(F.count(F.lit(1)).alias("_t"), F.avg((F.col("_p") == 1).cast("double")).alias("_pos"))
    j = h.join(tot, "period")
    pr = F.col("n") / F.col("_t")
    return j.groupBy("period", "_t", "_pos").agg((-F.sum(pr * F.log2(pr))).alias("_h")).select(
        "period", F.col("_t").cast("long").alias("n"), rnd(F.col("_h")).alias("entropy"),
        rnd(F.col("_pos")).alias("positive_share"))


def metric_gate(candidate: DataFrame, baseline: DataFrame, ratio: float = 0.9,
                minimums: Mapping[str, float] | None = None) -> DataFrame:
    """Accept the candidate if no metric is below ratio × baseline and the
    absolute minimums (accuracy ≥ .8, F1 ≥ .7) hold.  Inputs are long
    (metric, value) tables."""
    mins = minimums or {"accuracy": 0.8, "f1": 0.7}
    j = candidate.select("metric", F.col("value").alias("cand")).join(
        baseline.select("metric", F.col("value").alias("base")), "metric", "left")
    mm = F.create_map(*[x for k, v in mins.items() for x in (F.lit(k), F.lit(float(v)))])
    ok = F.coalesce(F.col("cand") >= ratio * F.col("base"), F.lit(True)) & \
        F.coalesce(F.col("cand") >= F.element_at(mm, F.col("metric")), F.lit(True))
    return j.select("metric", "cand", "base", ok.alias("ok"))


def validation_rollup(checks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """passed / failed / warning lists and the overall status of each
    validation (``keys``; any failed → failed; any warning → warning; else
    passed).  Check rows per validation are few (one per rule)."""
    st = F.col("status")
    g = checks.groupBy(*keys).agg(
        F.concat_ws(",", F.sort_array(F.collect_list(F.when(st == "passed", F.col("rule_id"))))).alias("passed"),
        F.concat_ws(",", F.sort_array(F.collect_list(F.when(st.isin("failed", "error"), F.col("rule_id"))))).alias("failed"),
        F.concat_ws(",", F.sort_array(F.collect_list(F.when(st == "warning", F.col("rule_id"))))).alias("warnings"),
        F.count_if(st.isin("failed", "error")).alias("_f"), F.count_if(st == "warning").alias("_w"))
    return g.select(*keys, "passed", "failed", "warnings",
                    F.when(F.col("_f") > 0, "failed").when(F.col("_w") > 0, "warning").otherwise("passed").alias("status"))


def run_durations(steps: DataFrame, run: str, step: str, ts: str, failed: Column) -> DataFrame:
    """Duration of each step = time to the next step of the same run; per
    step name: count, mean, exact p95 of durations and failures."""
    from vigil.functions.core import exact_quantiles
    w = Window.partitionBy(run).orderBy(ts)
    d = steps.withColumn("duration_s", F.timestamp_diff("MICROSECOND", F.col(ts), F.lead(ts).over(w)) / 1e6) \
        .withColumn("_failed", failed)
    g = d.groupBy(step).agg(F.count(F.lit(1)).cast("long").alias("n_steps"),
                            rnd(F.avg("duration_s")).alias("mean_duration_s"),
                            F.count_if("_failed").cast("long").alias("n_failed"))
    p95 = exact_quantiles(d, ["duration_s"], [0.95], [step]) \
        .select(cell([step]).alias("_step"), rnd(F.col("q")).alias("p95_duration_s"))
    return g.withColumn("_step", cell([step])).join(p95, "_step", "left").drop("_step")


# --------------------------------------------------------- lifecycle
def current_state(events: DataFrame, keys: Sequence[str], state: str = "to_state", ts: str = "ts",
                  tie: str = "event_id") -> DataFrame:
    """Latest state per key (``max(struct(ts, tie, state))``), event count and
    last event time."""
    m = F.max(F.struct(F.col(ts), F.col(tie), F.col(state)))
    return events.groupBy(*keys).agg(m.alias("_m"), F.count(F.lit(1)).cast("long").alias("n_events")) \
        .select(*keys, F.col(f"_m.{state}").alias("current_state"), F.col(f"_m.{ts}").alias("last_ts"), "n_events")


def recent_events(events: DataFrame, keys: Sequence[str], n: int = 10, state: str = "to_state", ts: str = "ts",
                  tie: str = "event_id") -> DataFrame:
    """The last ``n`` events of each key, newest first, as one text of
    ``state`` values and the time of the oldest of them.  Ranked in salted
    slices first, so a model with most of the events is not one task."""
    last = top_k(events.select(*keys, state, ts, tie), list(keys), n, [F.col(ts).desc(), F.col(tie).desc()], tie)
    g = last.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", state))).alias("_e"),
                                F.count(F.lit(1)).cast("long").alias("n_recent"), F.min(ts).alias("since"))
    return g.select(*keys, "n_recent", "since", F.concat_ws(",", F.transform("_e", lambda e: e[state])).alias("recent_states"))


def lifecycle_report(events: DataFrame, validations: DataFrame, deployments: DataFrame, keys: Sequence[str], n_events: int = 10,
                     n_validations: int = 5, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The whole state of each key: current state, its last ``n_events``
    states, the statuses and counts of its last ``n_validations`` validations
    (``status, passed, failed, warnings``), newest first, and all its
    deployments in order of their id.  Keys come from the events; what a key
    lacks is 0 or empty.  Lists other than the deployments are ranked in salted
    slices, so no key is one task."""
    now = current_state(events, keys, ts=ts, tie=tie)
    recent = recent_events(events, keys, n_events, ts=ts, tie=tie)
    last = top_k(validations, list(keys), n_validations, [F.col(ts).desc(), F.col(tie).desc()], tie)
    line = F.format_string("%s:%d/%d/%d", "status", "passed", "failed", "warnings")
    checks = last.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda v: v["line"]), ",")
                                     .alias("validations"), F.count(F.lit(1)).alias("n_validations"))
    held = deployments.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("deployment_id", "stage"))),
                                                                   lambda d: F.concat_ws(":", d["deployment_id"].cast("string"), d["stage"])), ",")
                                          .alias("deployments"), F.count(F.lit(1)).alias("n_deployments"))
    out = now.select(cell(keys).alias("_cell"), *keys, "current_state")
    for part in (recent, checks, held):
        out = out.join(part.withColumn("_cell", cell(keys)).drop(*keys), "_cell", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(*keys, "current_state", "recent_states", zero("n_validations"), none("validations"), zero("n_deployments"), none("deployments"))


def latest_production(events: DataFrame, model: str = "model", version: str = "version",
                      prod_state: str = "deployed") -> DataFrame:
    """Current production version per model: versions whose latest state is
    production; the most recently promoted one wins."""
    cs = current_state(events, [model, version]).filter(F.col("current_state") == prod_state)
    return cs.groupBy(model).agg(F.max(F.struct("last_ts", version)).alias("_m"),
                                 F.count(F.lit(1)).cast("long").alias("n_active")) \
        .select(model, F.col(f"_m.{version}").alias("production_version"), F.col("_m.last_ts").alias("since"), "n_active")


def prod_conflicts(events: DataFrame, model: str = "model", version: str = "version",
                   prod_state: str = "deployed") -> DataFrame:
    """Models with more than one version currently in production."""
    return latest_production(events, model, version, prod_state).filter(F.col("n_active") > 1) \
        .select(model, "n_active")


def promote_apply(events: DataFrame, model: str = "model", version: str = "version", ts: str = "ts",
                  tie: str = "event_id", prod_state: str = "deployed") -> DataFrame:
    """Replay promotions: each promotion to production archives the previous
    production version of the model → validity intervals (SCD2)."""
    p = events.filter(F.col("to_state") == prod_state)
    w = Window.partitionBy(model).orderBy(ts, tie)
    return p.select(model, version, F.col(ts).alias("valid_from"), F.lead(ts).over(w).alias("valid_to"),
                    F.lead(version).over(w).alias("replaced_by")) \
        .withColumn("is_current", F.col("valid_to").isNull())


def lifecycle_illegal(events: DataFrame, allowed: DataFrame, keys: Sequence[str], ts: str = "ts",
                      tie: str = "event_id") -> DataFrame:
    """Transitions (previous state → new state per key) not present in the
    allowed-pairs table; the first event of a key is always allowed."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    t = events.withColumn("from_state", F.lag("to_state").over(w)).filter(F.col("from_state").isNotNull())
    return t.join(allowed, ["from_state", "to_state"], "left_anti") \
        .select(*keys, ts, tie, "from_state", "to_state")


def version_top(events: DataFrame, n: int = 5, model: str = "model", version: str = "version",
                ts: str = "ts") -> DataFrame:
    """Newest n versions per model by their latest event."""
    v = events.groupBy(model, version).agg(F.max(ts).alias("last_ts"))
    w = Window.partitionBy(model).orderBy(F.col("last_ts").desc(), F.col(version).desc())
    return v.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)


def deployment_history(events: DataFrame, model: str = "model", version: str = "version", ts: str = "ts",
                       tie: str = "event_id", prod_state: str = "deployed") -> DataFrame:
    """Deployments per (model, version): count, first and last deployment,
    latest status of the version."""
    d = events.filter(F.col("to_state") == prod_state).groupBy(model, version).agg(
        F.count(F.lit(1)).cast("long").alias("n_deployments"), F.min(ts).alias("first_deployed"),
        F.max(ts).alias("last_deployed"))
    return d.join(current_state(events, [model, version], ts=ts, tie=tie).select(model, version, F.col("current_state").alias("latest_status")),
                  [model, version])


def compare_versions(metrics: DataFrame, model: str, version: str, metric: str, value: str,
                     names: Sequence[str]) -> DataFrame:
    """Versions side by side: pivot metric names into columns."""
    return metrics.groupBy(model, version).pivot(metric, list(names)).agg(F.first(value))


def tags_to_maps(df: DataFrame, tags: str, prefixes: Mapping[str, str]) -> DataFrame:
    """Split a tag map by key prefix into named maps (prefix stripped);
    remaining keys go to ``other``."""
    def has(pre):
        return lambda k, v: k.startswith(pre)

    def strip(pre):
        return lambda k, v: F.substring(k, F.lit(len(pre) + 1), F.char_length(k))

    outs = [F.transform_keys(F.map_filter(F.col(tags), has(pre)), strip(pre)).alias(name)
            for name, pre in prefixes.items()]
    pres = list(prefixes.values())

    def rest(k, v):
        c = F.lit(True)
        for pre in pres:
            c = c & ~k.startswith(pre)
        return c
    other = F.map_filter(F.col(tags), rest).alias("other")
    return df.select(*[c for c in df.columns if c != tags], *outs, other)


def map_text(m: Column) -> Column:
    """Stable text of a map: sorted k=v pairs joined by ';'."""
    return F.concat_ws(";", F.sort_array(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))))


def ab_assign(df: DataFrame, key: str, fraction: float, salt: str = "ab") -> DataFrame:
    """Stable split: variant B when pmod(xxhash64(key, salt), 10000) <
    fraction × 10000."""
    b = F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(10000)) < int(fraction * 10000)
    return df.withColumn("variant", F.when(b, "B").otherwise("A"))


def ab_compare(df: DataFrame, variant: str, success: str, latency: str) -> DataFrame:
    """Per-variant volume, error rate and latency; two-proportion z between
    the two variants' success rates."""
    g = df.groupBy(variant).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(success).cast("double")).alias("rate"),
                                F.avg(latency).alias("mean_latency"))
    a = g.filter(F.col(variant) == "A").select(F.col("n").alias("na"), F.col("rate").alias("pa"), F.col("mean_latency").alias("la"))
    b = g.filter(F.col(variant) == "B").select(F.col("n").alias("nb"), F.col("rate").alias("pb"), F.col("mean_latency").alias("lb"))
    j = a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k")
    p = (F.col("pa") * F.col("na") + F.col("pb") * F.col("nb")) / (F.col("na") + F.col("nb"))
    z = safe_div(F.col("pb") - F.col("pa"), F.sqrt(p * (1 - p) * (1 / F.col("na") + 1 / F.col("nb"))))
    return j.select(F.col("na").cast("long").alias("n_a"), F.col("nb").cast("long").alias("n_b"),
                    rnd(F.col("pa")).alias("rate_a"), rnd(F.col("pb")).alias("rate_b"),
                    rnd(F.col("pb") - F.col("pa")).alias("rate_delta"),
                    rnd(F.col("lb") - F.col("la")).alias("latency_delta"), rnd(z, 6).alias("z"))

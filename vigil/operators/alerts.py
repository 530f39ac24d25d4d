"""Alert rows and retraining decisions (§2.13, drift alerts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drift_alerts(runs: DataFrame) -> DataFrame:
    """One alert row per drifted run."""
    msg = F.format_string("drift detected for %s: score=%.4f, severity=%s",
                          F.col("model_name"), F.col("drift_score"), F.col("severity"))
    return runs.filter("is_drifted").select("model_name", "ts", "drift_score", "severity", msg.alias("message"))


from collections.abc import Sequence  # noqa: E402

from pyspark.errors import AnalysisException  # noqa: E402
from pyspark.sql import Window  # noqa: E402

from vigil.functions.core import cell, materialised, ntz_micros  # noqa: E402
from vigil.session import settings  # noqa: E402

# Default alert rules (name, condition, severity, channels)
DEFAULT_RULES = [
    ("data_drift_detected", "drift_score > 0.1", "high", ["slack", "email"]),
    ("model_performance_degradation", "accuracy < 0.7", "critical", ["slack", "email", "pagerduty"]),
    ("pipeline_failed", "status == 'failed'", "medium", ["slack"]),
    ("resource_usage_high", "cpu_usage > 90 or memory_usage > 90", "warning", ["slack"]),
]
# alert level -> delivery channels; quiet hours 22:00-08:00
LEVEL_CHANNELS = {"critical": ["email", "slack", "webhook"], "high": ["slack", "webhook"], "medium": ["webhook"],
                  "low": []}
QUIET_START, QUIET_END = 22, 8


def evaluate_rules(metrics: DataFrame, rules: Sequence[tuple], keys: Sequence[str], ts: str) -> DataFrame:
    """Evaluate rules (any SQL condition over the columns) over a wide metric
    table; one alert row per firing rule and channel.  A rule that Spark's
    analyzer cannot resolve on the table never fires; see
    :func:`unresolved_rules`.  A condition without a value on a row (a null
    input, a division by zero, a text that is no number) does not fire on that
    row and stops no other rule; see :func:`undecided_rules`."""
    flags = [F.struct(F.lit(name).alias("rule"), F.lit(sev).alias("severity"), F.array(*[F.lit(c) for c in chans]).alias("channels"),
                      F.coalesce(cond, F.lit(False)).alias("fired")) for name, cond, sev, chans in _conditions(metrics, rules)]
    with settings(metrics.sparkSession, LENIENT):
        x = metrics.select(*keys, ts, F.explode(F.array(*flags)).alias("r"))
    return x.filter("r.fired").select(*keys, ts, "r.rule", "r.severity", F.explode("r.channels").alias("channel"))


def undecided_rules(metrics: DataFrame, rules: Sequence[tuple], keys: Sequence[str], ts: str) -> DataFrame:
    """(keys, ts, rule) of the rows on which a rule that resolves has no value:
    the report that goes with :func:`evaluate_rules`."""
    unresolved = {r[0] for r in unresolved_rules(metrics, rules)}
    names = [F.when(cond.isNull(), F.lit(name)) for name, cond, *_ in _conditions(metrics, rules) if name not in unresolved]
    with settings(metrics.sparkSession, LENIENT):
        return metrics.select(*keys, ts, F.explode(F.array_compact(F.array(*names, F.lit(None).cast("string")))).alias("rule"))


#: Conditions are analysed so that what cannot be computed is null (the mode is
#: fixed when an expression is resolved, whatever the session does later).
LENIENT = {"spark.sql.ansi.enabled": "false"}


def _conditions(metrics: DataFrame, rules: Sequence[tuple]) -> list[tuple]:
    unresolved = {r[0] for r in unresolved_rules(metrics, rules)}
    return [(name, F.lit(None).cast("boolean") if name in unresolved else F.expr(_sql(cond)).cast("boolean"), sev, chans)
            for name, cond, sev, chans in rules]


def _sql(condition: str) -> str:
    return condition.replace("==", "=")


def unresolved_rules(metrics: DataFrame, rules: Sequence[tuple]) -> list[tuple[str, str]]:
    """(rule, reason) of the rules whose condition does not resolve on the
    metric table, e.g. for want of a column."""
    out = []
    for name, cond, *_ in rules:
        try:
            metrics.select(F.expr(_sql(cond)).cast("boolean"))
        except AnalysisException as why:
            out.append((name, str(why).split("\n")[0]))
    return out


def greedy_gap(rows: DataFrame, keys: Sequence[str], at: str, gap: int) -> DataFrame:
    """Rows kept by the rule "at least ``gap`` since the last kept row of the
    key" (``at`` and ``gap`` in the same integer unit; of rows at the same
    instant one; null keys are a key of their own; rows without a time are
    dropped).

    A row that follows its predecessor by at least the gap is kept whatever
    happened before, so those start the search.  Every row points to the row
    that would be kept next after it: with buckets as wide as the gap that is
    the first one far enough in the next bucket, or the first one of a later
    bucket, so windows run per (key, bucket) and a key of any size spreads over
    its buckets.  What the starts reach is found by pointer doubling: a round
    per factor of two in the longest chain between two starts."""
    keys = list(keys)
    x = rows.filter(F.col(at).isNotNull()).dropDuplicates([*keys, at])
    if gap <= 0:
        return x
    nodes = materialised(_next_kept(x.select(cell(keys).alias("_key"), F.col(at).cast("long").alias("_at")), gap))
    reach = nodes.filter("_start").select("_key", "_at")
    jump = nodes.select("_key", "_at", "_next").filter(F.col("_next").isNotNull())
    while True:
        step = reach.join(jump, ["_key", "_at"]).select("_key", F.col("_next").alias("_at")).distinct()
        step = materialised(step.join(reach, ["_key", "_at"], "left_anti"))
        if step.isEmpty():
            break
        reach = materialised(reach.unionByName(step))
        far = jump.select("_key", F.col("_at").alias("_next"), F.col("_next").alias("_far"))
        jump = materialised(jump.join(far, ["_key", "_next"]).select("_key", "_at", F.col("_far").alias("_next")))
    own = x.withColumn("_key", cell(keys)).withColumn("_at", F.col(at).cast("long"))
    return own.join(reach, ["_key", "_at"], "left_semi").select(*rows.columns)


def _next_kept(x: DataFrame, gap: int) -> DataFrame:
    """(_key, _at, _next, _start) of the distinct (_key, _at): the first row at
    least ``gap`` later, and whether the row before is at least ``gap`` earlier
    (or there is none)."""
    x = x.withColumn("_b", F.floor(F.col("_at") / F.lit(gap)).cast("long"))
    order = Window.partitionBy("_key").orderBy("_b")  # one row a bucket
    buckets = x.groupBy("_key", "_b").agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi"))
    buckets = buckets.select("_key", "_b", F.lag("_hi").over(order).alias("_before"), F.lead("_b").over(order).alias("_b1"),
                             F.lead("_lo").over(order).alias("_lo1"), F.lead("_lo", 2).over(order).alias("_lo2"))
    asks = x.select("_key", (F.col("_b") + 1).alias("_b"), (F.col("_at") + gap).alias("_at"), F.lit(1).alias("_ask"))
    seen = x.select("_key", "_b", "_at", F.lit(0).alias("_ask")).unionByName(asks)
    down = Window.partitionBy("_key", "_b").orderBy(F.col("_at").desc(), "_ask").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.last(F.when(F.col("_ask") == 0, F.col("_at")), ignorenulls=True).over(down)
    asked = seen.withColumn("_hit", hit).filter("_ask = 1") \
        .select("_key", (F.col("_b") - 1).alias("_b"), (F.col("_at") - gap).alias("_at"), "_hit")
    prev = F.lag("_at").over(Window.partitionBy("_key", "_b").orderBy("_at"))
    asked = asked.withColumn("_prev", prev)
    y = asked.join(buckets, ["_key", "_b"])
    later = F.when(F.col("_b1") == F.col("_b") + 1, F.coalesce("_hit", "_lo2")).otherwise(F.col("_lo1"))
    before = F.coalesce("_prev", "_before")
    return y.select("_key", "_at", later.alias("_next"), (before.isNull() | (F.col("_at") - before >= gap)).alias("_start"))


def cooldown(alerts: DataFrame, keys: Sequence[str], ts: str, minutes: int = 30) -> DataFrame:
    """Suppress repeats: an alert of a key is kept only if at least
    ``minutes`` passed since the last KEPT alert of that key."""
    at = ntz_micros(ts) if alerts.schema[ts].dataType.simpleString() == "timestamp_ntz" else F.unix_micros(ts)
    return greedy_gap(alerts.select(*keys, ts, at.alias("_micros")), keys, "_micros", minutes * 60_000_000).drop("_micros")


def quiet_hours(alerts: DataFrame, ts: str, level: str = "severity") -> DataFrame:
    """Mark alerts raised in 22:00–08:00 and route by level to channels."""
    h = F.hour(ts)
    routes = F.create_map(*[x for k, v in LEVEL_CHANNELS.items()
                            for x in (F.lit(k), F.array(*[F.lit(c) for c in v]).cast("array<string>"))])
    return alerts.withColumn("quiet", (h >= QUIET_START) | (h < QUIET_END)) \
        .withColumn("channels", F.coalesce(F.element_at(routes, F.col(level)), F.array().cast("array<string>")))


def retrain_triggers(drift: DataFrame, accuracy: DataFrame, as_of_days: DataFrame, drift_thr: float = 0.1,
                     acc_thr: float = 0.7, window_days: int = 7, drift_cooldown: int = 1,
                     perf_cooldown: int = 2) -> DataFrame:
    """Retraining decisions per (model, day) from three sources:
    drift score > 0.1; mean accuracy over the trailing 7 days < 0.7; the
    weekly schedule (Mondays).  A drift / performance trigger fires when at
    least its cooldown days passed since it last fired for the model, so a
    run of daily triggers fires again and again at that distance."""
    d = drift.filter(F.col("drift_score") > drift_thr).select("model_name", F.to_date("ts").alias("day"),
                                                               F.lit("drift").alias("trigger"))
    # days since epoch: independent of the session time zone
    w = Window.partitionBy("model_name").orderBy(F.unix_date("day")).rangeBetween(-(window_days - 1), 0)
    acc = accuracy.select("model_name", "day", F.avg("accuracy").over(w).alias("acc7"))
    p = acc.filter(F.col("acc7") < acc_thr).select("model_name", "day", F.lit("performance").alias("trigger"))
    s = as_of_days.filter(F.dayofweek("day") == 2).select("model_name", "day", F.lit("schedule").alias("trigger"))

    def fired(t: DataFrame, days: int) -> DataFrame:
        return greedy_gap(t.withColumn("_d", F.unix_date("day")), ["model_name", "trigger"], "_d", days).drop("_d")

    kept = fired(d, drift_cooldown).unionByName(fired(p, perf_cooldown))
    return kept.unionByName(s)


def failure_rate_gate(checks: DataFrame, key: str = "dataset", limit: float = 0.01) -> DataFrame:
    """Validation failure share per dataset and whether it exceeds 1%."""
    g = checks.groupBy(key).agg(F.count(F.lit(1)).cast("long").alias("n_checks"),
                                F.count_if(F.col("status") == "failed").cast("long").alias("n_failed"))
    r = F.col("n_failed") / F.col("n_checks")
    return g.select(key, "n_checks", "n_failed", F.round(r, 9).alias("failure_rate"), (r > limit).alias("gate_failed"))

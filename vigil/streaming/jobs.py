"""Structured Streaming jobs (§2.12).

Every job is a streaming DataFrame transformation; ``run_to_table`` drives
it to completion with ``availableNow`` into a parquet sink under the shared
checkpoint directory and returns the sink as a batch DataFrame, which is
how the batch twins (oracles) compare.  Naive event times are read as UTC
instants for watermarks and converted back on output.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.core import instant_to_ntz, ntz_to_instant
from vigil.session import settings
from vigil.sources.sinks import scratch_dir
from vigil.sources.versioned import Files, VersionedTable

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, directory: str, name: str = "events", schema: str = EVENTS_SCHEMA,
                 max_files: int | None = None) -> DataFrame:
    """File stream of one table of a directory, with ``ets`` = event time
    as an instant."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(directory).withColumn("ets", ntz_to_instant("ts"))


def run_to_table(stream: DataFrame, name: str, mode: str = "append", conf: Mapping[str, str] | None = None,
                 folder: str | None = None) -> DataFrame:
    """Run a streaming query to completion (availableNow) into a parquet
    sink; return the sink contents.  A ``folder`` given again goes on from its
    checkpoint: only new input is read, and the sink grows."""
    spark = stream.sparkSession
    home = folder or scratch_dir(spark, f"st-{name}")
    with settings(spark, conf or {}):
        q = (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{home}/out")
             .option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/out")


def run_foreach(stream: DataFrame, name: str, fn: Callable[[DataFrame, int], None], folder: str | None = None) -> list[dict]:
    """Run with ``foreachBatch`` (availableNow); returns the progress report
    of every batch.  The query itself only remembers its latest reports, so
    they are gathered during the run.  A ``folder`` given again goes on from
    its checkpoint."""
    spark = stream.sparkSession
    ck = folder or scratch_dir(spark, f"ck-{name}")
    seen: dict[int, dict] = {}
    running: list = []

    def step(batch: DataFrame, batch_id: int) -> None:
        fn(batch, batch_id)
        for q in running:
            seen.update({p["batchId"]: p for p in q.recentProgress})

    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", ck).trigger(availableNow=True).start()
    running.append(q)
    q.awaitTermination()
    seen.update({p["batchId"]: p for p in q.recentProgress})
    return [seen[k] for k in sorted(seen)]


def rows_dropped_late(progress: list[dict]) -> int:
    """Rows behind the watermark over all batches and state operators."""
    return sum(int(o["numRowsDroppedByWatermark"]) for p in progress for o in p["stateOperators"])


def _window_cols(w: str = "window") -> list:
    return [instant_to_ntz(F.col(f"{w}.start")).alias("window_start"), instant_to_ntz(F.col(f"{w}.end")).alias("window_end")]


# ------------------------------------------------------------------ jobs
def windowed_profile(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """st_profile: per window and type — count, null rate, mean, variance."""
    a = (events.withWatermark("ets", delay)
         .groupBy(F.window("ets", window), "event_type")
         .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("value").isNull().cast("double")).alias("null_rate"),
              F.avg("value").alias("mean"), F.var_samp("value").alias("variance")))
    return a.select(*_window_cols(), "event_type", "n", F.round("null_rate", 9).alias("null_rate"),
                    F.round("mean", 9).alias("mean"), F.round("variance", 6).alias("variance"))


def windowed_sketches(events: DataFrame, column: str = "value", distinct: str = "user_id", window: str = "1 hour",
                      delay: str = "10 minutes", k: int = 200) -> DataFrame:
    """st_profile, sketches: per window and type a mergeable row — exact
    count, sum, min and max, a KLL quantile sketch (rank error about 1.65 / k)
    and an HLL distinct sketch (standard error about 1.6 %).  The state of a
    window is its sketches, merged map-side and over batches; rows merge again
    over windows with ``merge_sketches``."""
    x = F.col(column).cast("double")
    x = F.when(~F.isnan(x), x)
    a = events.withWatermark("ets", delay).groupBy(F.window("ets", window), "event_type").agg(
        F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.sum(x).alias("sum"),
        F.kll_sketch_agg_double(x, F.lit(k)).alias("kll"), F.hll_sketch_agg(F.col(distinct)).alias("hll"))
    return a.select(*_window_cols(), "event_type", "n", "min", "max", "sum", "kll", "hll")


#: Rows of slide-wide counts that one task spreads over their windows.
SLIDE_ROWS = 100_000
_SLIDES = "user_id {user}, slide long, page_views long, clicks long, purchases long, events long, latest long"
_COUNTS = ["page_views", "clicks", "purchases", "events"]


def sliding_behaviour(events: DataFrame, length: str = "1 hour", slide: str = "5 minutes", delay: str = "10 minutes",
                      folder: str | None = None) -> DataFrame:
    """st_behavior_1h: sliding-window behaviour counts per user; runs the
    stream and returns its sink.

    A micro-batch adds its counts per user and slide (one row however many
    windows overlap it) to a table, and writes the windows that the watermark
    of the batches before it has closed, each as a sum of slides.  What waits
    for its window is thus files of slides, not a state row per window.  As in
    a windowed aggregation a row counts for every window that is still open,
    late or not, and a null time for none; the windows due after the last batch follow
    at the end of the run.  A batch that is tried again replaces its slides and
    skips windows already written.  A ``folder`` given again goes on from its
    checkpoint."""
    spark = events.sparkSession
    home = folder or scratch_dir(spark, "st-behaviour")
    files, out = Files(spark, home), f"{home}/out"
    length_us, slide_us, delay_us = (_micros(spark, x) for x in (length, slide, delay))
    step_us = math.gcd(length_us, slide_us)
    schema = _SLIDES.format(user=events.schema["user_id"].dataType.simpleString())

    def written() -> list[int]:
        found = [int(x.removeprefix("upto=")) for x in files.names(out) if x.startswith("upto=")]
        return [x for x in found if files.exists(f"{out}/upto={x}/_SUCCESS")]

    def close(session: SparkSession, batch_id: int) -> None:
        """Write the windows closed by the rows of the batches before this one."""
        before = f"{home}/slides/batch_id={batch_id - 1}"
        if not files.exists(before):
            return
        latest = session.read.schema(schema).parquet(before).agg(F.max("latest")).first()[0]
        done = max(written(), default=None)
        if latest is None or (done is not None and latest - delay_us <= done):
            return
        upto = latest - delay_us
        due = F.col("slide") + step_us <= upto
        if done is not None:
            due = due & (F.col("slide") > done - length_us)
        slides = session.read.schema(schema).parquet(f"{home}/slides").select("user_id", "slide", *_COUNTS).filter(due)
        tasks = max(1, -(-slides.count() // SLIDE_ROWS))
        # dealt by user before each slide becomes its windows, which need no second shuffle
        start = F.col("slide") - F.pmod(F.col("slide"), F.lit(slide_us)) - F.col("_back").cast("long") * slide_us
        spread = slides.repartition(tasks, "user_id") \
            .withColumn("_back", F.explode(F.sequence(F.lit(0), F.lit(-(-length_us // slide_us) - 1)))).withColumn("start", start)
        end = F.col("start") + length_us
        open_ = (end > F.col("slide")) & (end <= upto)
        if done is not None:
            open_ = open_ & (end > done)
        windows = spread.filter(open_).groupBy("user_id", "start").agg(*[F.sum(c).alias(c) for c in _COUNTS])
        windows.select(instant_to_ntz(F.timestamp_micros("start")).alias("window_start"),
                       instant_to_ntz(F.timestamp_micros(end)).alias("window_end"), "user_id", *_COUNTS) \
            .write.mode("overwrite").parquet(f"{out}/upto={upto}")

    def step(batch: DataFrame, batch_id: int) -> None:
        t, us = F.col("event_type"), F.unix_micros("ets")
        batch.filter(F.col("ets").isNotNull()).groupBy("user_id", (us - F.pmod(us, F.lit(step_us))).alias("slide")).agg(
            F.count(F.when(t == "view", 1)).alias("page_views"), F.count(F.when(t == "click", 1)).alias("clicks"),
            F.count(F.when(t == "purchase", 1)).alias("purchases"), F.count(F.lit(1)).alias("events"),
            F.max(us).alias("latest")).write.mode("overwrite").parquet(f"{home}/slides/batch_id={batch_id}")
        close(batch.sparkSession, batch_id)

    run_foreach(events, "behaviour", step, folder=f"{home}/checkpoint")
    ids = [int(x.removeprefix("batch_id=")) for x in files.names(f"{home}/slides") if x.startswith("batch_id=")]
    if ids:
        close(spark, max(ids) + 1)
    user = events.schema["user_id"].dataType.simpleString()
    shape = f"window_start timestamp_ntz, window_end timestamp_ntz, user_id {user}, " + ", ".join(f"{c} long" for c in _COUNTS)
    if not written():
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).parquet(out).select("window_start", "window_end", "user_id", *_COUNTS)


def _micros(spark: SparkSession, interval: str) -> int:
    return spark.range(1).select(F.expr(f"INTERVAL {interval}")).first()[0] // dt.timedelta(microseconds=1)


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """st_sessions: inactivity-gap sessions per user with their event mix."""
    a = (events.withWatermark("ets", delay).groupBy(F.session_window("ets", gap), "user_id")
         .agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("event_type") == "view").alias("n_views"),
              F.count_if(F.col("event_type") == "purchase").alias("n_purchases")))
    return a.select(instant_to_ntz(F.col("session_window.start")).alias("session_start"),
                    instant_to_ntz(F.col("session_window.end")).alias("session_end"), "user_id", "n_events",
                    "n_views", "n_purchases")


def reference_shares(ref: DataFrame, column: str, n_bins: int = 10) -> tuple[float, float, list[float]]:
    """(lo, hi, share of each of ``n_bins`` equal-width bins) of a static
    table: what a stream compares its windows with.  Two aggregates; nulls and
    NaN are left out; without values the range is 0 to 1 and all shares 0."""
    x = F.col(column)
    known = ref.filter(x.isNotNull() & ~F.isnan(x))
    lo, hi = known.agg(F.min(x), F.max(x)).first()
    lo, hi = (0.0, 1.0) if lo is None else (float(lo), float(hi))
    counts = known.agg(*[F.count_if(bin_of(x, lo, hi, n_bins) == i).alias(f"b{i}") for i in range(n_bins)]).first()
    total = sum(counts)
    return lo, hi, [c / total if total else 0.0 for c in counts]


def bin_of(x: Column, lo: float, hi: float, n_bins: int) -> Column:
    """Equal-width bin of a value; values outside go to the end bins, and one
    bin holds all where the range is a point."""
    if hi <= lo:
        return F.lit(0)
    return F.least(F.greatest(F.floor(F.lit(float(n_bins)) * (x - lo) / (hi - lo)), F.lit(0)), F.lit(n_bins - 1)).cast("int")


def windowed_psi(events: DataFrame, column: str, lo: float, hi: float, shares: Sequence[float], window: str = "1 day",
                 delay: str = "10 minutes", threshold: float = 0.1) -> DataFrame:
    """st_drift_psi: the PSI of every window against the reference shares,
    emitted by the stream when the watermark closes the window.  A window's
    state is one row of bin counts; shares of 0 count as 1e-4."""
    x, n_bins = F.col(column), len(shares)
    known = events.filter(x.isNotNull() & ~F.isnan(x)).withColumn("bin", bin_of(x, lo, hi, n_bins))
    a = known.withWatermark("ets", delay).groupBy(F.window("ets", window)).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("bin") == i).alias(f"b{i}") for i in range(n_bins)])

    def term(i: int) -> Column:
        p = shares[i] or 1e-4
        q = F.when(F.col(f"b{i}") == 0, 1e-4).otherwise(F.col(f"b{i}") / F.col("n"))
        return (q - p) * F.log(q / p)

    total = term(0)
    for i in range(1, n_bins):
        total = total + term(i)
    return a.select(*_window_cols(), F.round(total, 9).alias("psi"), (total > threshold).alias("drifted"))


# Latency histogram buckets (seconds)
LATENCY_BUCKETS = [0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0]


def bucket_name(b: float) -> str:
    return "le_" + (f"{b:g}".replace(".", "_"))


def request_metrics(requests: DataFrame, window: str = "1 hour", delay: str = "10 minutes",
                    labels: Sequence[str] = ("model",)) -> DataFrame:
    """st_request_metrics: per window and label values (model, version,
    endpoint, status, …) — requests, errors and the cumulative latency
    histogram (Prometheus-style ``le`` buckets, the last of which, unbounded, is the
    number of requests)."""
    lat = F.col("latency_s")
    a = (requests.withWatermark("ets", delay).groupBy(F.window("ets", window), *labels)
         .agg(F.count(F.lit(1)).alias("n_requests"), F.count_if(F.col("status") == "error").alias("n_errors"),
              F.sum(lat).alias("sum_s"), *[F.count_if(lat <= b).alias(bucket_name(b)) for b in LATENCY_BUCKETS]))
    summed = [F.round("sum_s", 6).alias("latency_sum_s")] if tuple(labels) != ("model",) else []
    return a.select(*_window_cols(), *labels, "n_requests", "n_errors", *summed, *[bucket_name(b) for b in LATENCY_BUCKETS])


def request_p95(requests: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Approximate P95 latency per window and model (streaming sketch)."""
    a = (requests.withWatermark("ets", delay).groupBy(F.window("ets", window), "model")
         .agg(F.percentile_approx("latency_s", 0.95, 10000).alias("p95_latency_s")))
    return a.select(*_window_cols(), "model", "p95_latency_s")


def as_requests(events: DataFrame) -> DataFrame:
    """Inference-log view of events: model = event type, latency = value ms,
    status error when latency > 250 ms, three versions by user, two endpoints
    by event."""
    return events.select("ets", "ts", F.col("event_type").alias("model"), (F.col("value") / 1000.0).alias("latency_s"),
                         F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("version"),
                         F.when(F.col("event_id") % 2 == 0, "predict").otherwise("explain").alias("endpoint"),
                         F.when(F.col("value") > 250, "error").otherwise("ok").alias("status"))


def dedup_within_watermark(events: DataFrame, key: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """st_dedup: drop repeats of a key that arrive within the watermark."""
    return events.withWatermark("ets", delay).dropDuplicatesWithinWatermark([key])


def label_join(preds: DataFrame, labels: DataFrame, within: str = "2 hours", delay: str = "10 minutes",
               how: str = "left_outer") -> DataFrame:
    """st_label_join: predictions joined with labels of the same user that
    arrive within ``within`` after the prediction (stream–stream interval
    join, both sides watermarked so state is bounded).  A prediction that got
    no label comes once, with null label columns, when the watermark has
    passed the end of its interval; ``how="inner"`` leaves it out.  A null user
    matches no label."""
    p = preds.select(F.col("event_id").alias("pred_id"), F.col("user_id").alias("p_user"), F.col("ets").alias("p_ets"),
                     F.col("ts").alias("pred_ts")).withWatermark("p_ets", delay)
    lab = labels.select(F.col("event_id").alias("label_id"), F.col("user_id").alias("l_user"), F.col("ets").alias("l_ets"),
                        F.col("ts").alias("label_ts")).withWatermark("l_ets", delay)
    cond = (F.col("p_user") == F.col("l_user")) & (F.col("l_ets") >= F.col("p_ets")) & \
        (F.col("l_ets") <= F.col("p_ets") + F.expr(f"INTERVAL {within}"))
    j = p.join(lab, cond, how)
    return j.select("pred_id", F.col("p_user").alias("user_id"), "pred_ts", "label_id", "label_ts")


def rate_limit(requests: DataFrame, key: str, limit: int, window: str = "1 minute",
               delay: str = "10 minutes") -> DataFrame:
    """st_rate_limit (stream form): keys above ``limit`` requests in a
    tumbling minute."""
    a = requests.withWatermark("ets", delay).groupBy(F.window("ets", window), key).agg(F.count(F.lit(1)).alias("n"))
    return a.filter(F.col("n") > limit).select(*_window_cols(), key, "n")


def online_upsert(online: VersionedTable, ts: str, tie: str | None = None, source: str = "") -> Callable[[DataFrame, int], None]:
    """st_online_upsert: a foreachBatch that merges each micro-batch's latest
    rows per key into the online table (newer ts wins).  A batch rewrites only
    the buckets it touches, and one that is tried again adds nothing; readers
    follow the newest complete version."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        online.merge(batch, ts, tie, batch_id, source)
    return merge


def quality_gate(rules: Mapping[str, str], good_dir: str, bad_dir: str):
    """st_quality_gate: foreachBatch that quarantines failing rows of each
    micro-batch (same one-pass rule tagging as the batch gate).  Each batch
    overwrites its own ``batch_id=<n>`` directories, so a retried batch
    does not write its rows twice."""
    from vigil.sources.sinks import quarantine_write

    def gate(batch: DataFrame, batch_id: int) -> None:
        quarantine_write(batch.drop("ets"), rules, f"{good_dir}/batch_id={batch_id}",
                         f"{bad_dir}/batch_id={batch_id}", mode="overwrite")
    return gate

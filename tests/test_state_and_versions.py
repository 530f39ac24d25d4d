"""Stateful streams over batches out of order, tables whose writers die or try
again, and the one-pass as-of join."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vigil.operators import drift, featurestore as fs
from vigil.operators.features import sliding_rate
from vigil.operators.profile import merge_sketches
from vigil.sources import sinks as sk
from vigil.sources.versioned import VersionedTable, append_batch
from vigil.streaming import breaches as br
from vigil.streaming import jobs as st

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


# --- consecutive breaches -------------------------------------------------------

def batch_streaks(rows, least, ttl, watermark):
    """Rows (key, time, breach) in order of time, those in order first."""
    out, streak, last = [], Counter(), {}
    for k, t, bad in sorted(rows, key=lambda r: (r[1], r[2])):
        if t > watermark:
            continue
        if k in last and (t - last[k]).total_seconds() > ttl:
            streak[k] = 0
        streak[k] = streak[k] + 1 if bad else 0
        last[k] = t
        if streak[k] >= least:
            out.append((k, t, streak[k]))
    return Counter(out)


def run_breaches(spark, steps, least, ttl, delay):
    d, home = sk.scratch_dir(spark, "t-breach"), sk.scratch_dir(spark, "t-breaches")
    schema = "k string, ts timestamp_ntz, bad boolean"
    for step in steps:
        spark.createDataFrame(step, schema).write.mode("append").parquet(d)
        s = spark.readStream.schema(schema).parquet(d).withColumn("ets", st.ntz_to_instant("ts"))
        out = st.run_to_table(br.consecutive_breaches(s, "k", "ets", "bad", least, delay, ttl), "t-breach", conf=br.ROCKSDB, folder=home)
    return Counter(tuple(r) for r in out.collect()), home


def test_breach_runs_do_not_depend_on_batches(spark):
    rng = random.Random(3)
    rows = [(k, at(60 * i + j), rng.random() < 0.8) for k in ("a", "b", None) for i, j in enumerate([0] * 40)]
    rows += [("tie", at(60 * i), b) for i in range(40) for b in (True, False, True)]
    rows += [("gap", at(60 * i), True) for i in (0, 1, 2, 30, 31, 32, 33)]  # a silence ends the run
    rows += [("idle", at(60 * i), True) for i in range(3)]
    rng.shuffle(rows)
    got, _ = run_breaches(spark, [rows[:90], rows[90:]], 2, 600, "50 minutes")
    assert not got  # nothing is passed yet
    rows.append(("end", at(60 * 100), False))
    got, home = run_breaches(spark, [rows[:90], rows[90:]], 2, 600, "45 minutes")
    want = batch_streaks(rows, 2, 600, at(60 * 55))
    assert got == want and any(k == "gap" and n > 2 for k, _, n in got)
    state = spark.read.format("statestore").option("stateVarName", "run").load(f"{home}/checkpoint").count()
    assert state == 0  # all keys but one are silent for longer than the ttl, and that one is not passed yet


def test_no_breach_state_before_the_watermark(spark):
    got, _ = run_breaches(spark, [[("a", at(0), True)], [("a", at(5), True), ("a", at(3), False)], [("a", at(100), True)]], 1, 600, "10 seconds")
    assert got == Counter({("a", at(0), 1): 1, ("a", at(5), 1): 1})


# --- other streams ----------------------------------------------------------------

def test_window_sketches_are_within_their_bounds(spark):
    sf = "/root/testdata/sf0.01"
    hours = st.run_to_table(st.windowed_sketches(st.event_stream(spark, sf), window="1 day"), "t-sketch")
    got = {(r["event_type"], r["window_start"]): r for r in merge_sketches(hours, ["event_type", "window_start"]).collect()}
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("d"), "value", "user_id")
    assert got
    days = {}
    for r in events.collect():
        days.setdefault((r[0], r[1]), []).append((r[2], r[3]))
    for key, row in got.items():
        values = sorted(v for v, _ in days[key])
        assert row["n"] == len(values)
        for p in (25, 50, 75):
            below, upto = sum(v < row[f"q{p}"] for v in values), sum(v <= row[f"q{p}"] for v in values)
            assert below - 0.02 * len(values) <= p / 100 * len(values) <= upto + 0.02 * len(values)
        users = len({u for _, u in days[key]})
        assert abs(row["approx_distinct"] - users) <= max(2, 0.08 * users)


def test_psi_of_a_stream_without_reference_values(spark):
    none = spark.createDataFrame([], "value double")
    assert st.reference_shares(none, "value") == (0.0, 1.0, [0.0] * 10)
    point = spark.createDataFrame([(5.0,), (5.0,), (None,), (float("nan"),)], "value double")
    assert st.reference_shares(point, "value")[2] == [1.0] + [0.0] * 9


def test_sliding_rate_of_a_busy_key(spark):
    rng = random.Random(1)
    rows = [(i, "busy" if i % 4 else rng.choice(["x", None]), at(rng.choice([0, 1]) * 59.999999 + rng.randrange(400))) for i in range(600)]
    rows.append((-1, "x", None))
    df = spark.createDataFrame(rows, "i long, k string, ts timestamp_ntz").repartition(4)
    got = {r["i"]: (r["n_recent"], r["limited"]) for r in sliding_rate(df, ["k"], "ts", 5).collect()}
    assert set(got) == set(range(600))
    for i, k, t in rows[:-1]:
        n = sum(k2 == k and dt.timedelta(0) <= t - t2 < dt.timedelta(seconds=60) for _, k2, t2 in rows[:-1])
        assert got[i] == (n, n > 5)


# --- versioned tables -------------------------------------------------------------

def content(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


def test_merges_touch_their_buckets_and_retries_add_nothing(spark):
    t = VersionedTable(spark, sk.scratch_dir(spark, "t-v"), ["k"], buckets=8)
    with pytest.raises(FileNotFoundError):
        t.read()
    schema = "k long, ts long, v string"
    first = spark.createDataFrame([(i, 1, "a") for i in range(50)] + [(None, 1, "n")], schema)
    assert t.merge(first, "ts", batch_id=0, source="s")
    folders = t.manifest()["folders"]
    assert len(folders) == 8
    second = spark.createDataFrame([(3, 5, "b"), (3, 4, "c"), (4, 0, "late")], schema)
    assert t.merge(second, "ts", batch_id=1, source="s")
    after = t.manifest()["folders"]
    assert sum(after[b] != folders[b] for b in folders) <= 2
    want = sorted([(i, 1, "a") for i in range(50) if i != 3] + [(None, 1, "n"), (3, 5, "b")], key=str)
    assert content(t) == want
    version = t.manifest()["version"]
    assert not t.merge(second, "ts", batch_id=1, source="s") and not t.merge(first, "ts", batch_id=0, source="s")
    assert t.manifest()["version"] == version and content(t) == want
    assert t.merge(spark.createDataFrame([], schema), "ts", batch_id=2, source="s") and content(t) == want
    assert t.merge(second, "ts", batch_id=0, source="other") and content(t) == want


def test_a_writer_that_dies_leaves_the_old_version(spark):
    t = VersionedTable(spark, sk.scratch_dir(spark, "t-v"), ["k"], buckets=4)
    schema = "k long, ts long"
    t.merge(spark.createDataFrame([(1, 1), (2, 1)], schema), "ts", batch_id=0)

    class Dies(VersionedTable):
        def __init__(self, *a, **b):
            super().__init__(*a, **b)
            self.files.put = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))

    with pytest.raises(RuntimeError):
        Dies(spark, t.root, ["k"], buckets=4).merge(spark.createDataFrame([(1, 9), (7, 9)], schema), "ts", batch_id=1)
    assert content(t) == [(1, 1), (2, 1)]
    assert t.merge(spark.createDataFrame([(1, 9), (7, 9)], schema), "ts", batch_id=1)
    assert content(t) == [(1, 9), (2, 1), (7, 9)]
    t.vacuum(keep=1)
    assert content(t) == [(1, 9), (2, 1), (7, 9)] and len(t.files.names(f"{t.root}/manifests")) == 1
    with pytest.raises(RuntimeError):  # two writers of one version: the second one loses
        t.files.put(f"{t.root}/manifests/{t.manifest()['version']:012d}.json", "{}")


def test_batches_written_again_replace_themselves(spark):
    d = sk.scratch_dir(spark, "t-append")
    for batch, n in ((1, 5), (2, 3), (1, 5)):
        append_batch(spark.range(n), d, batch)
    assert spark.read.parquet(d).count() == 8
    snaps = sk.scratch_dir(spark, "t-snap")
    df = spark.createDataFrame([(at(86400 * i), float(i)) for i in range(40)], "ts timestamp_ntz, value double")
    for day in (20, 20, 30):
        drift.reference_snapshot(df, "ts", F.lit(str(at(86400 * day))).cast("timestamp_ntz"), 10, snaps)
    assert spark.read.parquet(snaps).count() == 20
    assert sorted(r["value"] for r in drift.latest_reference(spark, snaps).collect()) == [float(i) for i in range(20, 30)]


def test_purge_in_place(spark):
    d = sk.scratch_dir(spark, "t-purge")
    rows = [(i, at(86400 * (i % 20)).date() if i % 7 else None) for i in range(100)]
    spark.createDataFrame(rows, "i long, day date").write.partitionBy("day").parquet(d)
    as_of = F.lit("2024-01-21 00:00:00").cast("timestamp_ntz")
    stay = [r for r in rows if r[1] and r[1] >= dt.date(2024, 1, 11)]
    for k in range(2):  # the second purge finds nothing to do
        got = {r["retention"]: r for r in sk.purge_partitions(spark, d, "day", as_of, 10).collect()}
        assert got["kept"]["n_rows"] == len(stay) and got["kept"]["first_day"] == dt.date(2024, 1, 11)
        assert ("purged" in got) == (k == 0) and (k or got["purged"]["n_rows"] == 100 - len(stay))
    assert {r["i"] for r in spark.read.parquet(d).collect()} == {i for i, _ in stay}


# --- as-of join -------------------------------------------------------------------

def test_views_of_one_pass(spark):
    rng = random.Random(7)
    keys = ["hot"] * 3 + ["x", None]
    ents = [(i, rng.choice(keys), at(rng.randrange(5 * 86400)) if i % 11 else None) for i in range(150)]
    feats = {v: [(rng.choice(keys), at(rng.randrange(5 * 86400)), j, rng.choice([None, 1.0, 2.0])) for j in range(120)] for v in "ab"}
    e = spark.createDataFrame(ents, "i long, k string, ts timestamp_ntz")
    f = {v: spark.createDataFrame(r, "k string, fts timestamp_ntz, seq long, val double") for v, r in feats.items()}
    views = [{"name": "a", "sources": [f["a"].limit(0), f["a"]], "ts": "fts", "features": ["val"], "ttl": None, "tie": "seq"},
             {"name": "b", "sources": [f["b"]], "ts": "fts", "features": ["val", "seq"], "ttl": 86400, "tie": "seq"}]
    for bucket in (3600, 86400, None):
        out = fs.pit_join_multi(e, views, ["k"], "ts", bucket)
        assert out.columns == ["i", "k", "ts", "a__fts", "a__val", "b__fts", "b__val", "b__seq"]
        got = {r["i"]: r for r in out.collect()}
        assert len(got) == 150
        for i, k, t in ents:
            for v, ttl in (("a", None), ("b", 86400)):
                best = max((r for r in feats[v] if k is not None and t is not None and r[0] == k and r[1] <= t), key=lambda r: (r[1], r[2]), default=None)
                if best and ttl and (t - best[1]).total_seconds() > ttl:
                    best = None
                assert (got[i][f"{v}__fts"], got[i][f"{v}__val"]) == ((best[1], best[3]) if best else (None, None))
    one = fs.pit_join_multi(e, views[:1], ["k"], "ts")
    shuffles = [d._jdf.queryExecution().sparkPlan().toString().count("RepartitionByExpression") + d._jdf.queryExecution().executedPlan().toString().count("Exchange hash")
                for d in (one, fs.pit_join_multi(e, views, ["k"], "ts"))]
    assert shuffles[0] == shuffles[1]


def test_sliding_windows_match_a_windowed_aggregation(spark, tmp_path):
    """Several micro-batches with late rows, null users and null times; the
    stream waits with a row per user and slide, not one per window."""
    import os
    import time

    src, rng = str(tmp_path / "in"), random.Random(5)

    def add(i, lo, hi):
        rows = [(int(k), at(rng.randrange(lo, hi)) if k % 17 else None, int(k) % 5 if k % 11 else None,
                 ["view", "click", "purchase", "error", None][rng.randrange(5)], 1.0, None) for k in range(i * 60, i * 60 + 60)]
        folder = str(tmp_path / f"part{i}")
        spark.createDataFrame(rows, st.EVENTS_SCHEMA).coalesce(1).write.parquet(folder)
        name = next(f for f in os.listdir(folder) if f.endswith(".parquet"))
        os.makedirs(src, exist_ok=True)
        os.rename(f"{folder}/{name}", f"{src}/events{i}.parquet")
        os.utime(f"{src}/events{i}.parquet", (time.time() - 1000 + i * 10,) * 2)

    def plain(folder):
        ev, t = st.event_stream(spark, src, max_files=1), F.col("event_type")
        a = ev.withWatermark("ets", "10 minutes").groupBy(F.window("ets", "1 hour", "5 minutes"), "user_id").agg(
            F.count_if(t == "view").alias("page_views"), F.count_if(t == "click").alias("clicks"),
            F.count_if(t == "purchase").alias("purchases"), F.count(F.lit(1)).alias("events"))
        return st.run_to_table(a.select(*st._window_cols(), "user_id", "page_views", "clicks", "purchases", "events"), "plain", folder=folder)

    def new(folder):
        return st.sliding_behaviour(st.event_stream(spark, src, max_files=1), folder=folder)

    for i, (lo, hi) in enumerate([(0, 7200), (5400, 10800), (1800, 12600)]):  # the third brings late rows
        add(i, lo, hi)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    want = sorted(map(str, plain(a).collect()))
    got = new(b)
    assert got.dtypes == plain(a).dtypes and len(want) > 50
    assert sorted(map(str, got.collect())) == want
    assert sorted(map(str, new(b).collect())) == want  # nothing new: nothing added
    slides = spark.read.parquet(f"{b}/slides")
    assert slides.groupBy("batch_id", "user_id", "slide").count().filter("count > 1").isEmpty()
    assert slides.count() <= 180
    add(3, 9000, 18000)
    assert sorted(map(str, new(b).collect())) == sorted(map(str, plain(a).collect()))


def test_sliding_windows_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], st.EVENTS_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert st.sliding_behaviour(st.event_stream(spark, str(tmp_path))).collect() == []

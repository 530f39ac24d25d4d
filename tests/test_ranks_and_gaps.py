"""Ranking, selection, distinct counts, cooldowns and paging at small sizes that
take the large-size paths, with null groups."""

import datetime as dt
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.functions import core
from vigil.operators import alerts as al
from vigil.operators import clean, drift, expect, history, models, profile, quality, relational

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), None if i % 13 == 0 else float("nan") if i % 17 == 0 else rng.choice([rng.gauss(0, 5), 1.0, 7.0]))
            for i in range(3000)]
    return rows, spark.createDataFrame(rows, "g string, x double").repartition(6)


def known(rows, g=...):
    return [x for k, x in rows if x is not None and not math.isnan(x) and (g is ... or k == g)]


# --- selection and ranking --------------------------------------------------------

@pytest.mark.parametrize("most,accuracy", [(100_000, 10000), (5, 20), (1, 50)])
def test_brackets_are_narrowed_to_the_exact_quantiles(spark, values, most, accuracy):
    rows, df = values
    ps = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    wide = df.select("x", F.lit(3.0).alias("same"), F.lit(None).cast("double").alias("none"))
    got = {(r["feature"], r["p"]): r["q"] for r in core.exact_quantiles(wide, ["x", "same", "none"], ps, accuracy=accuracy, most=most).collect()}
    want = np.quantile(known(rows), ps)
    assert {k for k in got} == {(c, p) for c in ("x", "same") for p in ps}
    for p, q in zip(ps, want):
        assert got["x", p] == pytest.approx(q, abs=1e-12) and got["same", p] == 3.0
    assert core.exact_quantiles(df.limit(0), ["x"], ps).count() == 0


@pytest.mark.parametrize("ranges", [None, 3, 20])
def test_quantiles_by_group_hold_null_groups(values, ranges):
    rows, df = values
    got = {(r["g"], r["p"]): r["q"] for r in core.exact_quantiles(df, ["x"], [0.25, 0.5], ["g"], ranges=ranges).collect()}
    assert len(got) == 6
    for (g, p), q in got.items():
        assert q == pytest.approx(np.quantile(known(rows, g), p), abs=1e-12)


def test_running_sums_over_ranges(spark):
    rows = [(k, i, i % 5 + 1) for k, n in (("hot", 400), (None, 30), ("x", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, v long, n long").repartition(7)
    got = {(r["k"], r["v"]): (r["cum_n"], r["tot_n"]) for r in core.cumulative(df, ["k"], "v", ["n"], 16).collect()}
    assert len(got) == len(rows)
    for k, v, _ in rows:
        own = [n for k2, v2, n in rows if k2 == k and v2 <= v]
        assert got[k, v] == (sum(own), sum(n for k2, _, n in rows if k2 == k))


def brute_ks(a, b):
    pts = sorted(set(a) | set(b))
    return max(abs(sum(x <= p for x in a) / len(a) - sum(x <= p for x in b) / len(b)) for p in pts)


def test_null_segments_are_segments(spark):
    ref = [("s", 1.0), ("s", 2.0), ("s", 3.0), (None, 1.0), (None, 2.0), ("only", 1.0)]
    cur = [("s", 1.0), ("s", 2.0), ("s", 3.0), (None, 5.0), (None, 6.0)]
    r, c = (spark.createDataFrame(x, "seg string, v double") for x in (ref, cur))
    ks = {x["seg"]: x for x in drift.ks_test(r, c, ["v"], ["seg"]).collect()}
    assert ks[None]["statistic"] == 1.0 and ks["s"]["statistic"] == 0.0 and ks["only"]["statistic"] is None
    psi = {x["seg"]: x for x in drift.psi(r, c, ["v"], keys=["seg"]).collect()}
    assert psi[None][[k for k in psi[None].asDict() if k not in ("seg", "feature", "drifted", "threshold", "method")][-1]] is not None
    score = next(k for k in psi["s"].asDict() if "score" in k or k == "psi" or k == "statistic")
    assert psi[None][score] > 1 and psi["s"][score] == 0
    cvm = {x["seg"]: x["statistic"] for x in drift.cvm_test(r, c, ["v"], ["seg"]).collect()}
    assert cvm[None] > 0 and cvm["s"] == 0 and cvm["only"] is None


def test_ks_over_many_ranges(spark, values):
    rows, df = values
    other = df.withColumn("x", F.col("x") * 1.1 + 0.3)
    got = drift.ks_test(df, other, ["x"], ranges=20).first()
    a = known(rows)
    assert got["statistic"] == pytest.approx(brute_ks(a, [x * 1.1 + 0.3 for x in a]), abs=1e-9)


def test_null_groups_of_history_and_fill(spark):
    runs = [(d, 90.0 + i % 3 if i != 7 else 10.0, at(i)) for d in ("d", None) for i in range(12)]
    df = spark.createDataFrame(runs, "dataset string, pass_rate double, ts timestamp_ntz")
    assert Counter((r["dataset"], r["idx"]) for r in history.anomalies_iqr(df).collect()) == {("d", 7): 1, (None, 7): 1}
    rows = [(None, at(1440 * i), 1.0 if i == 0 else None) for i in range(4)] + [("k", at(0), None), ("k", at(2000), 3.0), ("k", at(9000), None)]
    got = clean.ffill(spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double"), ["v"], ["k"], "ts").collect()
    assert [r["v"] for r in got if r["k"] is None] == [1.0] * 4
    assert [r["v"] for r in sorted(got, key=lambda r: r["ts"]) if r["k"]] == [None, 3.0, 3.0]


def test_labels_that_are_missing_are_counted(spark):
    rows = [(1, 0.9, 1), (0, 0.2, 0), (1, 0.6, 1), (0, 0.6, 1), (None, 0.99, 1), (1, None, None), (0, float("nan"), 0)]
    df = spark.createDataFrame(rows, "y int, s double, p int")
    a = models.auc(df, "y", "s").first()
    assert (a["n_pos"], a["n_neg"], a["n_dropped"], a["auc"]) == (2, 2, 3, 0.875)
    m = models.cls_metrics(df, "y", "p").first()
    assert (m["tp"], m["fp"], m["fn"], m["tn"], m["n_dropped"]) == (2, 1, 0, 2, 2)


# --- distinct counts ----------------------------------------------------------------

def test_distinct_counts_without_copying_rows(spark, values):
    rows, df = values
    wide = df.withColumn("z", F.when(F.col("x") > 5, -0.0).otherwise(0.0)).withColumn("d", F.col("x").cast("decimal(20,3)")) \
        .withColumn("a", F.array("g", "g"))
    got = core.distinct_counts(wide, {c: F.col(c) for c in ("g", "z", "a")} | {"x": F.when(~F.isnan("x"), F.col("x"))}).first()
    assert (got["g"], got["z"], got["a"], got["x"]) == (2, 1, 3, len(set(known(rows))))
    assert core.distinct_counts(wide.limit(0), {"g": F.col("g")}).first()["g"] == 0
    suite = [expect.Expectation("distinct_between", c, {"min": 1}) for c in ("g", "x", "z")]
    plans = [quality.quality_metrics(df, "d", families=["profile_uniqueness"]), expect.run_suite(wide, suite),
             profile.profile_class(df), profile.profile_diff(df, df)]
    for p in plans:
        assert "Expand" not in p._jdf.queryExecution().optimizedPlan().toString()
    found = {r["column"]: r["observed_value"] for r in plans[1].collect()}
    assert found == {"g": 2.0, "x": float(len(set(known(rows)))), "z": 1.0}


def test_quantile_expectations(spark, values):
    rows, df = values
    x = known(rows)
    suite = [expect.Expectation(k, "x", kw) for k, kw in (
        ("quantile_between", {"quantile": 0.9, "min": 0, "max": 100}), ("quantile_between", {"quantile": 0.1, "min": 0}),
        ("min_between", {"max": 0}), ("max_between", {"max": 1}), ("sum_between", {}))]
    got = expect.run_suite(df, suite).collect()
    want = [np.quantile(x, 0.9), np.quantile(x, 0.1), min(x), max(x), sum(x)]
    assert [r["observed_value"] for r in got] == pytest.approx(want, abs=1e-6)
    assert [r["success"] for r in got] == [True, want[1] >= 0, want[2] <= 0, want[3] <= 1, True]
    empty = expect.run_suite(df.withColumn("x", F.lit(None).cast("double")), suite[:1]).first()
    assert empty["observed_value"] is None and not empty["success"]


# --- cooldowns ------------------------------------------------------------------------

def brute_gap(rows, gap):
    kept, last = [], {}
    for k, t in sorted(set(rows), key=lambda r: (str(r[0]), r[1])):
        if k not in last or t - last[k] >= gap:
            kept.append((k, t))
            last[k] = t
    return Counter(kept)


@pytest.mark.parametrize("gap", [1, 7, 30])
def test_greedy_gaps_of_dense_and_sparse_keys(spark, gap):
    rng = random.Random(gap)
    rows = [("dense", rng.randrange(400)) for _ in range(900)] + [(None, rng.randrange(-300, 300)) for _ in range(60)]
    rows += [("sparse", i * 100) for i in range(20)] + [("steps", i * (gap - 1) if gap > 1 else i) for i in range(100)] + [("one", 5)]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "k string, t long, _key string").repartition(5)
    got = Counter((r["k"], r["t"]) for r in al.greedy_gap(df, ["k"], "t", gap).collect())
    assert got == brute_gap(rows, gap)
    assert al.greedy_gap(df.limit(0), ["k"], "t", gap).count() == 0


def test_a_busy_key_spreads_over_tasks(spark):
    busy = spark.range(60_000).select(F.lit("k").alias("_key"), (F.col("id") * 3).alias("_at"))
    nodes = al._next_kept(busy, 1000)
    per_task = nodes.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) > 1 or "SinglePartition" not in nodes._jdf.queryExecution().executedPlan().toString()
    windows = nodes._jdf.queryExecution().optimizedPlan().toString()
    assert windows.count("[_key#") >= 1 and al.greedy_gap(busy.select("_key", "_at"), ["_key"], "_at", 1000).count() == math.ceil(60_000 / 334)


# --- rules ------------------------------------------------------------------------------

def test_a_rule_that_fails_stops_no_other(spark):
    df = spark.createDataFrame([("m", at(0), 0.0, "7"), ("m", at(1), 0.25, "no"), ("n", at(2), None, None)], "k string, ts timestamp_ntz, x double, s string")
    rules = [("inverse", "1 / x > 2", "high", ["a"]), ("number", "cast(s as int) > 5", "low", ["a", "b"]), ("low", "x < 1", "low", ["c"]),
             ("gone", "missing_column > 1", "low", ["c"])]
    got = Counter((r["ts"], r["rule"], r["channel"]) for r in al.evaluate_rules(df, rules, ["k"], "ts").collect())
    assert got == Counter({(at(1), "inverse", "a"): 1, (at(0), "number", "a"): 1, (at(0), "number", "b"): 1, (at(0), "low", "c"): 1, (at(1), "low", "c"): 1})
    errors = Counter((r["ts"], r["rule"]) for r in al.undecided_rules(df, rules, ["k"], "ts").collect())
    assert errors == Counter({(at(0), "inverse"): 1, (at(1), "number"): 1, (at(2), "inverse"): 1, (at(2), "number"): 1, (at(2), "low"): 1})
    assert [r for r, _ in al.unresolved_rules(df, rules)] == ["gone"]


# --- pages --------------------------------------------------------------------------------

def test_pages_and_cursors(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b"]), i, at(i)) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i long, ts timestamp_ntz").repartition(6)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    for offset, limit in ((0, 7), (123, 40), (495, 20), (500, 5), (900, 5), (0, 600)):
        got = relational.page(df, ["g", "i"], offset, limit).collect()
        assert [(r["g"], r["i"], r["ts"]) for r in got] == ordered[offset:offset + limit]
        assert all(r["total"] == 500 and r["has_more"] == (500 > offset + limit) for r in got)
    assert relational.page(df.limit(0), ["i"], 0, 5).count() == 0
    last, seen = None, []
    while True:
        got = [tuple(r) for r in relational.page_after(df, ["g", "ts"], last, 160).collect()]
        if not got:
            break
        seen += got
        last = (got[-1][0], got[-1][2])
    assert seen == ordered

"""Merged sketches of daily slices against exact counts, at two skews."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vigil.operators import sketches as sk


def skewed(power, n=6000):
    rng = random.Random(int(power * 10))
    return [(rng.randrange(7), f"v{int(3000 * rng.random() ** power)}" if rng.random() > 0.01 else None) for _ in range(n)]


@pytest.fixture(scope="module", params=[1.0, 6.0])
def slices(request, spark):
    rows = skewed(request.param)
    return rows, spark.createDataFrame(rows, "day int, v string").repartition(5)


def test_frequencies(spark, slices):
    rows, df = slices
    true = Counter(v for _, v in rows if v is not None)
    daily = sk.count_min(df, "v", ["day"], width=512, depth=5)
    assert daily.groupBy("day").count().agg(F.max("count")).first()[0] <= 512 * 5 + 1
    merged = sk.merge_count_min(daily)
    whole = sk.count_min(df, "v", width=512, depth=5)
    assert Counter(tuple(r) for r in merged.collect()) == Counter(tuple(r) for r in whole.collect())
    probes = df.union(spark.createDataFrame([(0, f"absent{i}") for i in range(200)], "day int, v string"))
    got = {r["value"]: r for r in sk.frequencies(probes, "v", merged, width=512, depth=5).collect()}
    bound = next(iter(got.values()))["bound"]
    assert bound <= 0.0054 * sum(true.values()) + 1
    assert all(got[v]["estimate"] >= n for v, n in true.items())
    over = [v for v, r in got.items() if r["estimate"] - true[v] > bound]
    assert len(over) <= 0.02 * len(got)
    per_day = sk.frequencies(df, "v", daily, ["day"], width=512, depth=5)
    by_day = Counter((d, v) for d, v in rows if v is not None)
    est = {(r["day"], r["value"]): r["estimate"] for r in per_day.collect()}
    assert all(est[k] >= n for k, n in by_day.items())


def test_heavy_hitters(slices):
    rows, df = slices
    true, n = Counter(v for _, v in rows), len(rows)
    daily = sk.top_items(df, "v", ["day"], capacity=1024)
    assert daily.count() == 7
    got = sk.merge_top_items(daily, 10).collect()
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1))
    found = {r["value"]: r["estimate"] for r in got}
    heavy = [v for v, c in true.most_common(10) if c > n / 256 and v is not None]
    assert set(heavy) <= set(found)
    assert all(abs(found[v] - true[v]) <= n / 256 for v in heavy)


def test_membership(spark, slices):
    rows, df = slices
    daily = sk.bloom(df, "v", ["day"], blocks=2, hashes=4)
    assert daily.groupBy("day").count().agg(F.max("count")).first()[0] <= 2
    merged = sk.merge_bloom(daily)
    held = {v for _, v in rows if v is not None}
    probes = spark.createDataFrame([(v,) for v in held | {f"absent{i}" for i in range(4000)}] + [(None,)], "v string")
    got = {r["value"] for r in sk.members(probes, "v", merged, blocks=2, hashes=4).collect()}
    assert held <= got
    rate = sk.false_positive_rate(len(held), 2, 4)
    assert len(got - held) <= 4000 * rate * 3 + 5
    by_day = {(d, v) for d, v in rows if v is not None}
    assert by_day <= {tuple(r) for r in sk.members(df, "v", daily, ["day"], blocks=2, hashes=4).collect()}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "day int, v string")
    assert sk.count_min(none, "v", ["day"]).count() == 0 and sk.bloom(none, "v").count() == 0
    assert sk.frequencies(none, "v", sk.count_min(none, "v")).count() == 0
    assert sk.members(none, "v", sk.bloom(none, "v")).count() == 0

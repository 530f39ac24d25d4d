"""Property tests (hypothesis) for the scale idioms: bucketed running sums,
salted top-k, bucketed forward fill and KS symmetry must equal their
single-window / pandas definitions on arbitrary data with hot values."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from vigil.functions.core import cumulative, top_k
from vigil.operators.clean import ffill
from vigil.operators.drift import ks_test

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
values = st.lists(st.integers(min_value=-5, max_value=5), min_size=1, max_size=60)


@SETTINGS
@given(values, st.integers(min_value=1, max_value=6))
def test_cumulative_equals_pandas_cumsum(spark, vals, buckets):
    pdf = pd.DataFrame({"k": [v % 2 for v in vals], "v": [float(v) for v in vals]})
    counts = pdf.groupby(["k", "v"]).size().reset_index(name="n")
    df = spark.createDataFrame(counts)
    got = {(r["k"], r["v"]): (r["cum_n"], r["tot_n"]) for r in cumulative(df, ["k"], "v", ["n"], ranges=buckets).collect()}
    for k, g in counts.sort_values("v").groupby("k"):
        for v, c in zip(g["v"], g["n"].cumsum()):
            assert got[(k, v)] == (c, g["n"].sum())


@SETTINGS
@given(st.lists(st.sampled_from(list("abcdefgh")), min_size=1, max_size=80), st.integers(min_value=1, max_value=4))
def test_salted_top_k_equals_sort(spark, items, k):
    counts = pd.Series(items).value_counts().reset_index()
    counts.columns = ["value", "count"]
    counts["g"] = 1
    df = spark.createDataFrame(counts)
    got = [(r["value"], r["count"]) for r in
           top_k(df, ["g"], k, [F.col("count").desc(), F.col("value")], "value", salts=3).orderBy("rank").collect()]
    exp = counts.sort_values(["count", "value"], ascending=[False, True]).head(k)
    assert got == list(zip(exp["value"], exp["count"]))


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 500), st.one_of(st.none(), st.integers(0, 9))),
                min_size=1, max_size=50, unique_by=lambda t: (t[0], t[1])))
def test_bucketed_ffill_equals_plain_window(spark, rows):
    df = spark.createDataFrame([(k, t, float(v) if v is not None else None) for k, t, v in rows],
                               "k long, t long, v double")
    got = {(r["k"], r["t"]): r["v"] for r in ffill(df, ["v"], ["k"], "t", bucket=F.floor(F.col("t") / 60)).collect()}
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    exp = {(r["k"], r["t"]): r["v"] for r in df.select("k", "t", F.last("v", ignorenulls=True).over(w).alias("v")).collect()}
    assert got == exp


@SETTINGS
@given(values, values)
def test_ks_is_symmetric(spark, a, b):
    ra = spark.createDataFrame(pd.DataFrame({"x": np.array(a, dtype=float)}))
    rb = spark.createDataFrame(pd.DataFrame({"x": np.array(b, dtype=float)}))
    assert ks_test(ra, rb, ["x"]).collect()[0]["statistic"] == ks_test(rb, ra, ["x"]).collect()[0]["statistic"]

"""Per-operator checks on tiny literal frames: nulls, NaN, empty frames,
constant columns, ties, one-sided categories, metamorphic properties
(drift(x, x) = 0, repartitioning changes nothing, no future leakage) and
NumPy re-derivations of the reference formulas."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigil.functions.core import exact_quantiles, missing
from vigil.operators import drift as dr
from vigil.operators import featurestore as fs
from vigil.operators import profile as pr
from vigil.operators import quality as q


def test_missing_counts_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "x double")
    assert df.filter(missing(df, "x")).count() == 2


def test_exact_quantiles_match_numpy_with_ties(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.integers(0, 20, 500), rng.normal(size=300)])
    df = spark.createDataFrame(pd.DataFrame({"x": vals.astype(float)}))
    got = {r["p"]: r["q"] for r in exact_quantiles(df, ["x"], [0.1, 0.25, 0.5, 0.9, 1.0]).collect()}
    for p, v in got.items():
        assert v == pytest.approx(np.quantile(vals, p), rel=1e-12, abs=1e-12)


def test_quantiles_invariant_to_partitioning(spark):
    vals = np.arange(1000, dtype=float) % 37
    df = spark.createDataFrame(pd.DataFrame({"x": vals}))
    a = exact_quantiles(df.repartition(1), ["x"], [0.5]).collect()[0]["q"]
    b = exact_quantiles(df.repartition(16), ["x"], [0.5]).collect()[0]["q"]
    assert a == b == np.quantile(vals, 0.5)


def test_ks_matches_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=700), rng.normal(0.3, 1.2, size=500)
    ref = spark.createDataFrame(pd.DataFrame({"x": a}))
    cur = spark.createDataFrame(pd.DataFrame({"x": b}))
    got = dr.ks_test(ref, cur, ["x"]).collect()[0]["statistic"]
    allv = np.sort(np.concatenate([a, b]))
    ecdf = lambda s: np.searchsorted(np.sort(s), allv, side="right") / len(s)
    assert got == pytest.approx(np.max(np.abs(ecdf(a) - ecdf(b))), abs=1e-9)


def test_drift_of_identical_samples_is_zero(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": np.linspace(0, 1, 200)}))
    assert dr.ks_test(df, df, ["x"]).collect()[0]["statistic"] == 0.0
    assert dr.psi(df, df, ["x"]).collect()[0]["psi"] == 0.0


def test_psi_constant_column_is_zero_and_matches_numpy(spark):
    const = spark.createDataFrame([(1.0,)] * 10, "x double")
    assert dr.psi(const, const, ["x"]).collect()[0]["psi"] == 0.0
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=400), rng.normal(0.5, 1, size=300)
    got = dr.psi(spark.createDataFrame(pd.DataFrame({"x": a})), spark.createDataFrame(pd.DataFrame({"x": b})),
                 ["x"]).collect()[0]["psi"]
    edges = np.linspace(min(a.min(), b.min()), max(a.max(), b.max()), 11)
    p = np.histogram(a, edges)[0] / len(a)
    qq = np.histogram(b, edges)[0] / len(b)
    p, qq = np.where(p == 0, 1e-4, p), np.where(qq == 0, 1e-4, qq)
    assert got == pytest.approx(np.sum((qq - p) * np.log(qq / p)), abs=1e-8)


def test_chi2_survival_known_values():
    # chi-square upper tail: P(X > 3.841459) = 0.05 at 1 dof; P(X > 18.307) = 0.05 at 10 dof
    assert dr.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert dr.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert dr.chi2_sf(0.0, 3) == 1.0


def test_category_chi2_drops_cells_empty_on_both_sides(spark):
    ref = spark.createDataFrame([("a",)] * 30 + [("b",)] * 10, "c string")
    cur = spark.createDataFrame([("a",)] * 10 + [("b",)] * 30 + [("c",)] * 5, "c string")
    r = dr.chi2_from_cells(dr.category_cells(ref, cur, ["c"]), ["feature"]).collect()[0]
    assert r["dof"] == 2 and r["drifted"]


def test_pit_join_never_returns_future_rows(spark):
    ents = spark.createDataFrame([(1, 1, "2024-01-02 00:00:00"), (2, 1, "2024-01-05 00:00:00"),
                                  (3, 2, "2024-01-01 00:00:00")], "eid long, k long, ets string") \
        .withColumn("ets", F.col("ets").cast("timestamp_ntz"))
    feats = spark.createDataFrame([(1, "2024-01-01 00:00:00", 10.0), (1, "2024-01-03 00:00:00", 20.0),
                                   (1, "2024-01-06 00:00:00", 30.0), (2, "2024-01-01 00:00:00", 5.0)],
                                  "k long, fts string, v double").withColumn("fts", F.col("fts").cast("timestamp_ntz"))
    for bucket in (None, 86400, 3600):
        got = {r["eid"]: r["v"] for r in fs.pit_join(ents, feats, ["k"], "ets", "fts", ["v"],
                                                       bucket_seconds=bucket).collect()}
        assert got == {1: 10.0, 2: 20.0, 3: 5.0}
    ttl = {r["eid"]: r["v"] for r in fs.pit_join(ents, feats, ["k"], "ets", "fts", ["v"], ttl_seconds=86400).collect()}
    assert ttl == {1: 10.0, 2: None, 3: 5.0}


def test_quality_metrics_on_empty_frame_give_no_rows(spark):
    df = spark.createDataFrame([], "a double, b string")
    assert q.quality_metrics(df, "empty", families=["overall", "missing", "zero"]).count() == 0


def test_score_and_status_follow_direction(spark):
    m = spark.createDataFrame([("d", "missing_rate_x", "x", "completeness", 0.0, 0.10, "le"),
                               ("d", "overall_completeness", None, "completeness", 1.0, 0.95, "ge")],
                              q.METRIC_SCHEMA)
    m = m.withColumn("status", q.pass_status(F.col("value"), F.col("threshold"), F.col("direction")))
    r = q.dq_score(m).collect()[0]
    assert r["overall_score"] == 100.0 and r["status"] == "excellent"


def test_skew_kurtosis_are_bias_corrected(spark):
    rng = np.random.default_rng(5)
    x = rng.gamma(2.0, size=300)
    r = pr.profile_numeric(spark.createDataFrame(pd.DataFrame({"x": x}))).collect()[0]
    s = pd.Series(x)
    assert r["skewness"] == pytest.approx(s.skew(), abs=1e-6)
    assert r["kurtosis"] == pytest.approx(s.kurt(), abs=1e-6)
    assert r["median"] == pytest.approx(np.median(x), abs=1e-9)


def test_sketch_merge_close_to_whole(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"day": rng.integers(0, 10, 5000), "x": rng.normal(size=5000)})
    df = spark.createDataFrame(pdf)
    merged = pr.merge_sketches(pr.profile_sketch(df, "x", ["day"])).collect()[0]
    assert merged["n"] == 5000
    assert merged["q50"] == pytest.approx(np.median(pdf.x), abs=0.1)


def test_fingerprint_is_order_insensitive(spark):
    df = spark.range(100).withColumn("y", F.col("id") * 2)
    a = pr.profile_fingerprint(df).collect()[0]
    b = pr.profile_fingerprint(df.orderBy(F.col("id").desc()).repartition(7)).collect()[0]
    assert a == b


def test_cooldown_is_greedy(spark):
    from vigil.operators.alerts import cooldown
    ts = ["2024-01-01 00:00:00", "2024-01-01 00:20:00", "2024-01-01 00:35:00", "2024-01-01 00:50:00"]
    df = spark.createDataFrame([(1, t) for t in ts], "k long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    kept = sorted(str(r["ts"]) for r in cooldown(df, ["k"], "ts", 30).collect())
    assert kept == ["2024-01-01 00:00:00", "2024-01-01 00:35:00"]


def test_strftime_mapping():
    from vigil.operators.expect import strftime_to_spark
    assert strftime_to_spark("%Y-%m-%d %H:%M:%S") == "yyyy-MM-dd HH:mm:ss"
    assert strftime_to_spark("%d/%m/%yT") == "dd/MM/yy'T'"


def test_range_window_matches_plain_window(spark):
    from pyspark.sql import Window
    from vigil.operators.features import range_window_agg
    rng = np.random.default_rng(2)
    n = 400
    base = pd.Timestamp("2024-01-01")
    pdf = pd.DataFrame({"k": rng.integers(0, 3, n), "ts": [base + pd.Timedelta(minutes=int(m)) for m in rng.integers(0, 4000, n)],
                        "i": np.arange(n)})
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r["i"]: r["n"] for r in range_window_agg(df, ["k"], "ts", 3600, {"n": F.count(F.lit(1))}).collect()}
    w = Window.partitionBy("k").orderBy(F.col("ts").cast("timestamp").cast("long")).rangeBetween(-3600, 0)
    exp = {r["i"]: r["n"] for r in df.select("i", F.count(F.lit(1)).over(w).alias("n")).collect()}
    assert got == exp


def test_exact_quantiles_fallback_when_bracket_misses(spark):
    rng = np.random.default_rng(9)
    vals = rng.normal(size=2000)
    df = spark.createDataFrame(pd.DataFrame({"x": vals}))
    got = {r["p"]: r["q"] for r in exact_quantiles(df, ["x"], [0.3, 0.5], accuracy=10, margin=0.0).collect()}
    for p, v in got.items():
        assert v == pytest.approx(np.quantile(vals, p), abs=1e-12)


def test_duplicates_treat_signed_zero_and_nan_as_equal(spark):
    from vigil.functions.core import duplicate_rows
    df = spark.createDataFrame([(0.0, "a"), (-0.0, "a"), (float("nan"), "b"), (float("nan"), "b"), (1.0, None),
                                (1.0, None)], "x double, s string")
    assert duplicate_rows(df).collect()[0]["_dups"] == 3


def test_materialised_tables_keep_all_rows(spark):
    from vigil.functions.core import materialised
    kept = materialised(spark.range(300_000))
    assert kept.count() == 300_000 and spark.range(100).join(kept, "id").count() == 100


def test_ks_p_value_of_nearly_equal_samples_is_one(spark):
    from vigil.operators import drift as dr
    ref = spark.range(100_000).select(F.col("id").cast("double").alias("x"))
    cur = spark.range(100_000).select((F.col("id") + F.when(F.col("id") == 7, 0.5).otherwise(0.0)).alias("x"))
    r = dr.ks_test(ref, cur, ["x"]).first()
    assert 0 < r["statistic"] < 1e-4 and r["p_value"] == 1.0 and not r["drifted"]
    lam = [0.0, 0.005, 0.3, 0.8, 1.1799, 1.18, 1.5, 3.0]
    got = [x[0] for x in spark.createDataFrame([(v,) for v in lam], "l double").select(dr.kolmogorov_sf(F.col("l"))).collect()]
    assert got[:3] == pytest.approx([1.0, 1.0, 0.99999069], abs=1e-7) and abs(got[4] - got[5]) < 1e-3
    assert got[6] == pytest.approx(0.022217963, abs=1e-8) and got[7] == pytest.approx(2 * 2.718281828459045 ** -18, rel=1e-6)


def test_segments_on_one_side_only_have_no_statistic(spark):
    from vigil.operators import drift as dr
    ref = spark.createDataFrame([("a", float(i)) for i in range(50)] + [("b", 1.0), ("b", 2.0)], "g string, x double")
    cur = spark.createDataFrame([("a", float(i)) for i in range(50)] + [("c", 1.0), ("c", 3.0)], "g string, x double")
    for f, col in ((dr.ks_test, "statistic"), (dr.psi, "psi"), (dr.kl_divergence, "kl"), (dr.cvm_test, "statistic")):
        got = {r["g"]: r[col] for r in f(ref, cur, ["x"], ["g"]).collect()}
        assert got["a"] is not None and got["b"] is None and got["c"] is None


def test_chi2_tail_at_many_degrees():
    from vigil.operators import drift as dr
    assert dr.chi2_sf(1e6, 1_000_000) == pytest.approx(0.49981, abs=1e-3)
    assert dr.chi2_sf(19_999.0, 19_999) == pytest.approx(dr.chi2_sf(20_000.0, 20_000), abs=1e-4)


def test_lineage_has_no_depth_limit(spark):
    from vigil.operators.lineage import reachable
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(90)], "src string, dst string")
    got = reachable(edges, spark.createDataFrame([("0",)], "node string"))
    assert got.count() == 91 and got.agg(F.max("depth")).first()[0] == 90


def test_lineage_levels_are_computed_once(spark, monkeypatch):
    from vigil.operators import lineage
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), (None, "e"), ("a", "b"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("a",)], "node string")
    for rows in (lineage.FRONTIER_ROWS, 0):  # frontier sent to the edges, or met in a shuffle
        monkeypatch.setattr(lineage, "FRONTIER_ROWS", rows)
        got = lineage.reachable(edges, seeds)
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == [("a", 0), ("b", 1), ("c", 2), ("d", 2)]
    up = lineage.reachable(edges, spark.createDataFrame([("d",)], "node string"), "up", max_depth=1)
    assert sorted(map(tuple, up.collect())) == [("b", 1), ("d", 0)]


def test_null_keys_match_nothing_in_point_in_time_joins(spark):
    import datetime as dt

    from vigil.operators.featurestore import pit_join
    t = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([(None, t), (1, t)], "k int, ts timestamp_ntz")
    f = spark.createDataFrame([(None, t, 5), (1, t, 6)], "k int, fts timestamp_ntz, v int")
    for b in (86400, None):
        assert {r["k"]: r["v"] for r in pit_join(e, f, ["k"], "ts", "fts", bucket_seconds=b).collect()} == {None: None, 1: 6}


def test_moved_nulls_change_fingerprints_and_diffs(spark):
    from vigil.operators.profile import dataset_diff, profile_fingerprint
    a = spark.createDataFrame([(1, "x", None)], "k int, p string, q string")
    b = spark.createDataFrame([(1, None, "x")], "k int, p string, q string")
    assert profile_fingerprint(a).first() != profile_fingerprint(b).first()
    assert dataset_diff(a, b, ["k"]).first()["change"] == "changed"


def test_cooldown_counts_from_the_last_kept_row(spark):
    from vigil.operators import alerts as al
    days = spark.createDataFrame([("m", d) for d in range(1, 11)] + [("n", 1), ("n", 9), (None, 3), (None, 4)], "k string, d int")
    got = sorted((str(r["k"]), r["d"]) for r in al.greedy_gap(days, ["k"], "d", 2).collect())
    assert got == sorted([("m", d) for d in (1, 3, 5, 7, 9)] + [("n", 1), ("n", 9), ("None", 3)])


def test_alert_rules_with_functions_and_nulls(spark):
    from vigil.operators import alerts as al
    m = spark.createDataFrame([(1, -3.0, None)], "t int, x double, y double")
    rules = [("f", "abs(x) > 1", "high", ["a"]), ("n", "x < 0 and y is null", "low", ["b"]), ("u", "zz > 1", "low", ["c"])]
    assert {r["rule"] for r in al.evaluate_rules(m, rules, [], "t").collect()} == {"f", "n"}
    assert [r[0] for r in al.unresolved_rules(m, rules)] == ["u"]


def test_bins_do_not_gather_a_feature_in_one_task(spark, monkeypatch):
    from vigil.session import settings
    df = spark.createDataFrame([("a" if i % 3 else None, float(i % 50), float(i)) for i in range(900)], "seg string, x double, y double")
    ref, cur = df.filter("y < 500"), df.filter("y >= 500")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        h = dr.bin_counts(ref, cur, ["x", "y"], ["seg"])
        plan = h._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 1
        got = sorted(map(str, h.collect()))
        monkeypatch.setattr(dr, "BROADCAST_CELLS", 0)  # many segments: joined by shuffle
        assert sorted(map(str, dr.bin_counts(ref, cur, ["x", "y"], ["seg"]).collect())) == got
    assert len(got) == 40


def test_candidates_are_fitted_once_each(spark, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit

    from vigil.operators import ml
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    df = spark.createDataFrame([(float(a), float(b), float(a + 0.5 * b + e > 0)) for (a, b), e in zip(x, rng.normal(size=300))], "a double, b double, label double")
    asm, rf = VectorAssembler(inputCols=["a", "b"], outputCol="features"), ml.RandomForestClassifier(seed=42)
    grid = ParamGridBuilder().addGrid(rf.maxDepth, [2, 3]).addGrid(rf.numTrees, [3]).build()
    want = TrainValidationSplit(estimator=Pipeline(stages=[asm, rf]), estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(),
                                trainRatio=0.75, seed=42).fit(df).validationMetrics
    ref, cur = df.filter("label = 0"), df.filter("label = 1")
    both = ref.unionByName(cur)
    folds = CrossValidator(estimator=Pipeline(stages=[asm, rf.copy({rf.numTrees: 3})]), estimatorParamMaps=[{}], evaluator=BinaryClassificationEvaluator(),
                           numFolds=3, seed=42).fit(both).avgMetrics[0]
    fits, fit = [], ml.RandomForestClassifier._fit
    monkeypatch.setattr(ml.RandomForestClassifier, "_fit", lambda self, rows: fits.append(1) or fit(self, rows))
    got = ml.tune(df, ["a", "b"], depths=(2, 3), trees=(3,))
    assert len(fits) == 2 and [r["auc"] for r in got.collect()] == [round(w, 6) for w in want]
    fits.clear()
    got = ml.domain_classifier(ref, cur, ["a", "b"], trees=3, folds=3).first()
    assert len(fits) == 3 and got["auc"] == round(folds, 6)
    fits.clear()
    space = {"maxDepth": ("int", 2, 3), "numTrees": ("choice", [2])}
    assert ml.tune_random(df, ["a", "b"], space, 2).count() == 2 and len(fits) == 2


def test_boosted_trees_pass_over_groups_of_equal_bins(spark):
    """The model of the rows, fitted on one weighted row for equal bins (rounds over all rows before)."""
    from pyspark.sql import functions as F

    from vigil.operators import ml
    df = spark.range(4000).select("id", (F.col("id") % 3).cast("double").alias("a"), (F.col("id") * 7919 % 1000 / 10).alias("b")) \
        .withColumn("label", ((F.col("a") + F.col("b") / 30 + F.pmod(F.hash("id"), F.lit(3))) > 3).cast("double"))
    fitted = []
    fit = ml.GBTClassifier.fit
    ml.GBTClassifier.fit = lambda self, rows: (fitted.append(rows.count()), fit(self, rows))[1]
    try:
        got = ml.boosted_model(df, ["a", "b"], max_iter=4)
    finally:
        ml.GBTClassifier.fit = fit
    assert fitted[0] <= 3 * 32 * 2
    expected = ml.classifier_pipeline(["a", "b"], boosted=True, max_iter=4).fit(df)
    rows = df.unionByName(spark.createDataFrame([(-1, 9.0, -5.0, 0.0), (-2, 1.0, 1e9, 1.0)], df.schema))
    p = {r["id"]: r["p"] for r in got.transform(rows).select("id", ml.vector_to_array("probability")[1].alias("p")).collect()}
    q = {r["id"]: r["p"] for r in expected.transform(rows).select("id", ml.vector_to_array("probability")[1].alias("p")).collect()}
    assert len(p) == 4002 and max(abs(p[i] - q[i]) for i in p) < 1e-6
    with pytest.raises(ValueError, match="b"):
        ml.boosted_model(df.withColumn("b", F.when(F.col("id") > 5, F.col("b"))), ["a", "b"])


def _many_rows(spark, n=120_000):
    from pyspark.sql import functions as F
    a, b, noise = F.col("id") % 7, F.col("id") * 7919 % 100_003 / 1000, F.pmod(F.hash("id"), F.lit(100)) / 50
    return spark.range(n).select("id", a.cast("double").alias("a"), b.alias("b"), (a / 3 + b / 50 + noise > 3).cast("double").alias("label"))


def _no_fit_of_many_rows(monkeypatch):
    from vigil.operators import ml
    fit = ml.RandomForestClassifier._fit

    def checked(self, rows):
        assert rows.count() <= ml.ROWS_ALONE
        return fit(self, rows)
    monkeypatch.setattr(ml.RandomForestClassifier, "_fit", checked)


def test_forest_of_many_rows_grows_over_groups_of_equal_bins(spark, monkeypatch):
    """train_classifier: the bagged rows of every tree were kept and read one by one at each level."""
    from vigil.operators import ml
    df = _many_rows(spark, 150_000)
    train, val = (ml.hash_split(df, "id", 0.2, 42).filter(f"split = '{s}'") for s in ("train", "validation"))
    want = ml.score_summary("m", train, ml.classifier_pipeline(["a", "b"], trees=5).fit(train).transform(val)).first()
    _no_fit_of_many_rows(monkeypatch)
    model, train, scored = ml.train_and_score(df, "id", ["a", "b"], trees=5)
    got = ml.score_summary("m", train, scored).first()
    assert (got["n_train"], got["n_val"]) == (want["n_train"], want["n_val"]) and abs(got["accuracy"] - want["accuracy"]) < 0.01
    forest = model.stages[-1]
    assert forest.getNumTrees == 5 and forest.numFeatures == 2 and forest.numClasses == 2
    assert abs(sum(r["importance"] for r in ml.importances(model, ["a", "b"]).collect()) - 1) < 1e-9
    taken = [t._java_obj.rootNode().impurityStats().count() for t in forest.trees]  # a bootstrap: about as many rows, never the same
    assert len(set(taken)) > 1 and all(abs(t - got["n_train"]) < 6 * got["n_train"] ** 0.5 for t in taken)
    with pytest.raises(ValueError, match="b"):
        ml.forest_model(train.withColumn("b", ml.F.when(ml.F.col("id") > 5, ml.F.col("b"))), ["a", "b"])


def test_grouped_tree_is_sparkmls_of_the_drawn_rows(spark, monkeypatch):
    """One tree (all features a node) equals SparkML's of the groups weighted by their draws."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import functions as F

    from vigil.operators import forest, ml
    cuts = [[0.5, 1.5, 2.5, 3.5, 4.5, 5.5], [float(x) for x in range(5, 100, 5)]]
    groups, numbers = ml._bin_groups(_many_rows(spark, 20_000), ["a", "b"], cuts, "label")
    between = [[j + 0.5 for j in range(len(c))] for c in cuts]
    rf = ml.RandomForestClassifier(numTrees=1, maxDepth=4, seed=7)
    got = forest.grouped_forest(groups, numbers, between, rf)
    drawn = [(*r[:4], float(np.random.Generator(np.random.Philox(key=r["k"] % 2**64)).poisson(r["_rows"])))
             for r in groups.select(*numbers, "label", "_rows", F.xxhash64(*numbers, "label", F.lit(7)).alias("k")).collect()]
    rows = spark.createDataFrame([(r[0], r[1], r[2], r[4]) for r in drawn if r[4] > 0], [*numbers, "label", "w"])
    rows = VectorAssembler(inputCols=numbers, outputCol="features").transform(rows)
    want = rf.copy({rf.bootstrap: False, rf.featureSubsetStrategy: "all", rf.weightCol: "w"}).fit(rows)
    assert got.trees[0].toDebugString.split("\n")[1:] == want.trees[0].toDebugString.split("\n")[1:]
    p, q = ([(r["rawPrediction"], r["prediction"]) for r in m.transform(rows.coalesce(1)).collect()] for m in (got, want))
    assert len(p) > 100 and all(np.allclose(x.toArray(), y.toArray()) and a == b for (x, a), (y, b) in zip(p, q))
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray())
    rf = ml.RandomForestClassifier(numTrees=3, maxDepth=3, seed=7)
    whole = forest.grouped_forest(groups, numbers, between, rf).toDebugString
    monkeypatch.setattr(forest, "HISTOGRAM_BYTES", 1)  # a tree at a time
    assert forest.grouped_forest(groups.repartition(3), numbers, between, rf).toDebugString == whole
    with pytest.raises(ValueError, match="labels"):
        forest.grouped_forest(groups.withColumn("label", F.lit(0.5)), numbers, between, rf)


def test_domain_classifier_of_many_rows_reads_groups(spark, monkeypatch):
    """drift_classifier: each fold's forest took all rows of the others, one by one."""
    from pyspark.sql import functions as F

    from vigil.operators import ml
    df = _many_rows(spark, 220_000)
    ref, cur = df.filter("label = 0"), df.filter("label = 1").withColumn("b", F.col("b") * 1.01)
    seen = {}
    monkeypatch.setattr(ml, "_grouped_fold_aucs", lambda *a, f=ml._grouped_fold_aucs: seen.setdefault("got", f(*a)) and seen.setdefault("want", ml._fold_aucs(*a)) and seen["got"])
    ml.domain_classifier(ref, cur, ["a", "b"], trees=5, folds=2)
    assert len(seen["got"]) == 2 and all(abs(g - w) < 0.01 and g > 0.7 for g, w in zip(seen["got"], seen["want"]))
    monkeypatch.undo()
    _no_fit_of_many_rows(monkeypatch)
    row = ml.domain_classifier(ref, cur, ["a", "b"], trees=5, folds=2).first()
    assert row["is_drifted"] and row["auc"] == round(float(np.mean(seen["got"])), 6)


def test_fold_split_points_leave_the_fold_out(spark):
    from pyspark.sql import functions as F

    from vigil.operators import ml
    df = spark.range(9000).select((F.col("id") % 50).cast("double").alias("few"), (F.col("id") * 7919 % 9001 / 10).alias("many"), (F.col("id") % 3).alias("part"))
    by_fold = ml.fold_split_points(df, ["few", "many"], F.col("part"), 3, listed=1000)
    for i, (cuts, tops) in enumerate(by_fold):
        want, top = ml.split_points(df.filter(F.col("part") != i), ["few", "many"], listed=1000)
        assert cuts[0] == want[0] and tops == top and len(cuts[1]) == len(want[1]) and np.allclose(cuts[1], want[1], atol=900 / 320 * 2)

"""Scoring post-processing and SparkML training / scoring (§2.11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sigmoid_label(logit: Column, cut: float = 0.5) -> tuple[Column, Column]:
    p = 1 / (1 + F.exp(-logit))
    return p, F.when(p >= cut, 1).otherwise(0)


def argmax_softmax(logits: Column) -> tuple[Column, Column]:
    """0-based argmax and its softmax probability of an array of logits."""
    mx = F.array_max(logits)
    am = (F.array_position(logits, mx) - 1).cast("int")
    denom = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x))
    return am, F.exp(mx) / denom


import time  # noqa: E402
from collections import Counter  # noqa: E402
from multiprocessing.pool import ThreadPool  # noqa: E402

import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402
from pyspark import inheritable_thread_target  # noqa: E402
from pyspark.ml import Pipeline, PipelineModel  # noqa: E402
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier  # noqa: E402
from pyspark.ml.evaluation import BinaryClassificationEvaluator  # noqa: E402
from pyspark.ml.feature import Bucketizer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler  # noqa: E402
from pyspark.ml.functions import vector_to_array  # noqa: E402
from pyspark.ml.tuning import ParamGridBuilder  # noqa: E402

from vigil.operators.features import hash_split  # noqa: E402
from vigil.operators.forest import grouped_forest  # noqa: E402


def classifier_pipeline(features: Sequence[str], label: str = "label", trees: int = 100, seed: int = 42,
                        boosted: bool = False, max_iter: int = 20) -> Pipeline:
    """VectorAssembler + RandomForest (100 trees, seed 42) or GBT."""
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    clf = (GBTClassifier(labelCol=label, featuresCol="features", maxIter=max_iter, seed=seed) if boosted else
           RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, seed=seed))
    return Pipeline(stages=[asm, clf])


def split_points(df: DataFrame, features: Sequence[str], bins: int = 32, listed: int = 10_000) -> tuple[list[list[float]], list[float]]:
    """Per feature the thresholds between ``bins`` bins of about equal rows
    (between all neighbours, where there are no more values than bins), and its
    greatest value: by SparkML's rule over all rows for features of up to about
    ``listed`` values, by quantiles of all rows for others.  Null, NaN and infinite values are refused, as SparkML's
    trees refuse them."""
    return fold_split_points(df, features, F.lit(-1), 1, bins, listed)[0]


def fold_split_points(df: DataFrame, features: Sequence[str], fold: Column, folds: int, bins: int = 32,
                      listed: int = 10_000) -> list[tuple[list[list[float]], list[float]]]:
    """:func:`split_points` of the rows outside each of the folds 0, 1, ...; all
    folds share their passes over the rows."""
    x = df.select(fold.alias("fold"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    columns, outside = x.columns[1:], [F.col("fold") != i for i in range(folds)]
    seen = x.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in columns],
                 *[F.max(F.when(o, F.col(c))).alias(f"top{i}_{c}") for i, o in enumerate(outside) for c in columns],
                 *[F.count_if(F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True))).alias(f"bad_{c}") for c in columns]).first()
    refused = [f for f, c in zip(features, columns) if seen[f"bad_{c}"]]
    if refused:
        raise ValueError(f"null, NaN or infinite values in training: {', '.join(refused)}")
    found: dict[tuple[int, str], list[float]] = {}
    for c in [c for c in columns if seen[c] <= listed]:
        counts = x.groupBy(c, "fold").count().collect()
        for i in range(folds):
            rows: Counter = Counter()
            for v, part, n in counts:
                if part != i:
                    rows[v] += n
            found[i, c] = _strided(sorted(rows.items()), bins)
    many = [(i, c) for i in range(folds) for c in columns if (i, c) not in found]
    if many:
        # a null, here a row of the fold, is no value of the column
        others = x.select(*[F.when(outside[i], F.col(c)).alias(f"{c}_{i}") for i, c in many])
        for (i, c), cuts in zip(many, others.approxQuantile(others.columns, [j / bins for j in range(1, bins)], 0.1 / bins)):
            found[i, c] = sorted(t for t in set(cuts) if t < seen[f"top{i}_{c}"])
    return [([found[i, c] for c in columns], [0.0 if seen[f"top{i}_{c}"] is None else seen[f"top{i}_{c}"] for c in columns]) for i in range(folds)]


def _strided(counts: list[tuple[float, int]], bins: int) -> list[float]:
    """Thresholds halfway between neighbours of the (value, rows) in order, each
    where the rows before it come nearest to the next share."""
    values, rows = zip(*counts) if counts else ((), ())
    if len(values) <= bins:
        return [(a + b) / 2 for a, b in zip(values, values[1:])]
    share = sum(rows) / bins
    out, upto, target = [], rows[0], share
    for i in range(1, len(values)):
        before, upto = upto, upto + rows[i]
        if abs(before - target) < abs(upto - target):
            out.append((values[i - 1] + values[i]) / 2)
            target += share
    return out


def boosted_model(train: DataFrame, features: Sequence[str], label: str = "label", seed: int = 42, max_iter: int = 20) -> PipelineModel:
    """Boosted trees over the binned rows, equal ones as one row of their weight.

    SparkML's trees see a feature by its bin alone (``maxBins``, 32), so rows of
    the same bins and label count alike in every split of every round; grouped
    first, a round passes over the groups.  A null or NaN to be scored goes with
    the greatest values, as in SparkML."""
    cuts, tops = split_points(train, features)
    filled, bins, numbers = ([f"_{f}_{x}" for f in features] for x in ("filled", "bin", "number"))
    fill = SQLTransformer(statement="SELECT *, " + ", ".join(
        f"coalesce(nanvl(cast(`{f}` AS double), NULL), double('{top!r}')) AS `{x}`" for f, x, top in zip(features, filled, tops)) + " FROM __THIS__")
    # a tree sends value <= threshold to the left, a bucket ends before its upper edge
    edges = [[-np.inf, *sorted({float(np.nextafter(t, np.inf)) for t in c or [top]} - {np.inf}), np.inf] for c, top in zip(cuts, tops)]
    bucketizer = Bucketizer(inputCols=filled, outputCols=bins, splitsArray=edges)
    # buckets are marked as categories without order: their numbers are not
    order = SQLTransformer(statement="SELECT *, " + ", ".join(f"`{b}` + 0D AS `{x}`" for b, x in zip(bins, numbers)) + " FROM __THIS__")
    assembler = VectorAssembler(inputCols=numbers, outputCol="features")
    groups = order.transform(bucketizer.transform(fill.transform(train))).groupBy(*numbers, label).agg(F.count(F.lit(1)).cast("double").alias("_rows")).persist()
    try:
        trees = GBTClassifier(labelCol=label, featuresCol="features", weightCol="_rows", maxIter=max_iter, seed=seed).fit(assembler.transform(groups))
    finally:
        groups.unpersist()
    return PipelineModel([fill, bucketizer, order, assembler, trees])


ROWS_ALONE = 100_000  # a forest takes up to so many rows one by one


def _taken_alone(df: DataFrame) -> bool:
    return df.limit(ROWS_ALONE + 1).count() <= ROWS_ALONE


def _bin_groups(df: DataFrame, features: Sequence[str], cuts: Sequence[Sequence[float]], *keys: str) -> tuple[DataFrame, list[str]]:
    """One row for each group of equal bins and keys, with its ``_rows``, and
    the names of the columns that hold the features' bin numbers."""
    def found(x: Column, cut: Sequence[float], low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(x <= cut[mid], found(x, cut, low, mid)).otherwise(found(x, cut, mid + 1, high))
    numbers = [f"_{f}_number" for f in features]
    binned = df.select(*keys, *[found(F.col(f).cast("double"), c, 0, len(c)).alias(x) for f, c, x in zip(features, cuts, numbers)])
    return binned.groupBy(*numbers, *keys).agg(F.count(F.lit(1)).cast("double").alias("_rows")), numbers


def forest_model(train: DataFrame, features: Sequence[str], label: str = "label", trees: int = 100, seed: int = 42) -> PipelineModel:
    """A random forest, of more than ``ROWS_ALONE`` rows over their groups of equal bins
    (:func:`grouped_forest`)."""
    pipeline = classifier_pipeline(features, label, trees=trees, seed=seed)
    if _taken_alone(train):
        return pipeline.fit(train)
    assembler, rf = pipeline.getStages()
    cuts, _ = split_points(train, features)
    groups, numbers = _bin_groups(train, features, cuts, label)
    groups = groups.persist()
    try:
        return PipelineModel([assembler, grouped_forest(groups, numbers, cuts, rf)])
    finally:
        groups.unpersist()


def train_and_score(df: DataFrame, key: str, features: Sequence[str], label: str = "label", boosted: bool = False,
                    trees: int = 100) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Deterministic 80/20 split, fit, score the validation rows."""
    s = hash_split(df, key, 0.2, 42)
    train, val = s.filter("split = 'train'"), s.filter("split = 'validation'")
    model = boosted_model(train, features, label) if boosted else forest_model(train, features, label, trees)
    return model, train, model.transform(val)


def score_summary(model_name: str, train: DataFrame, scored: DataFrame, label: str = "label") -> DataFrame:
    """Accuracy and sample counts of a fitted model on its held-out rows."""
    acc = scored.agg(F.count(F.lit(1)).cast("long").alias("n_val"),
                     F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy"))
    n = train.agg(F.count(F.lit(1)).cast("long").alias("n_train"))
    return acc.withColumn("_k", F.lit(1)).join(n.withColumn("_k", F.lit(1)), "_k").drop("_k") \
        .select(F.lit(model_name).alias("model"), "n_train", "n_val", F.round("accuracy", 6).alias("accuracy"))


def evaluate(scored: DataFrame, label: str = "label", gate: float = 0.9) -> DataFrame:
    """accuracy / precision / recall / F1 / AUC of scored rows; passed when
    every metric but AUC exceeds the gate."""
    from vigil.operators.models import auc, cls_metrics
    s = scored.withColumn("p1", vector_to_array("probability")[1]).withColumn("pred", F.col("prediction").cast("int"))
    m = cls_metrics(s, label, "pred")
    a = auc(s, label, "p1").drop("n_dropped")
    j = m.withColumn("_k", F.lit(1)).join(a.withColumn("_k", F.lit(1)), "_k").drop("_k")
    ok = (F.col("accuracy") > gate) & (F.col("precision") > gate) & (F.col("recall") > gate) & (F.col("f1") > gate)
    return j.withColumn("passed", ok)


def importances(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Feature importances of the fitted forest (one value per feature)."""
    imp = model.stages[-1].featureImportances.toArray()
    spark = SparkSession_active()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")


def SparkSession_active():
    from pyspark.sql import SparkSession
    return SparkSession.active()


def held_out_aucs(df: DataFrame, features: Sequence[str], label: str, rf: RandomForestClassifier, maps: Sequence[dict], train_ratio: float,
                  parallelism: int, seed: int) -> list[float]:
    """Validation AUC of every candidate on one random split: the metrics that
    ``TrainValidationSplit`` gives for the same seed, without its last fit of
    the best candidate on all rows, whose model nobody reads."""
    draw = df.select(*features, label, F.rand(seed).alias("_draw"))
    train, validation = (_assembled(draw.filter(c), features, label).persist() for c in
                         (F.col("_draw") < train_ratio, F.col("_draw") >= train_ratio))

    def one(m: dict) -> float:
        return _auc(rf.fit(train, m), validation, label)
    try:
        with ThreadPool(min(parallelism, len(maps))) as pool:
            return pool.map(inheritable_thread_target(df.sparkSession)(one), maps)
    finally:
        train.unpersist()
        validation.unpersist()


def _assembled(df: DataFrame, features: Sequence[str], *kept: str) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df).select("features", *kept)


def _auc(model, rows: DataFrame, label: str, **weighted: str) -> float:
    return float(BinaryClassificationEvaluator(labelCol=label, **weighted).evaluate(model.transform(rows)))


def tune(df: DataFrame, features: Sequence[str], label: str = "label", depths=(3, 5), trees=(10, 20),
         parallelism: int = 4, seed: int = 42) -> DataFrame:
    """Grid search (one 75/25 split) over depth x trees; one row per candidate
    with its validation AUC and the best flagged."""
    rf = RandomForestClassifier(labelCol=label, featuresCol="features", seed=seed)
    grid = ParamGridBuilder().addGrid(rf.maxDepth, list(depths)).addGrid(rf.numTrees, list(trees)).build()
    found = held_out_aucs(df, features, label, rf, grid, 0.75, parallelism, seed)
    rows = []
    for pm, metric in zip(grid, found):
        d = {p.name: v for p, v in pm.items()}
        rows.append((int(d["maxDepth"]), int(d["numTrees"]), float(metric)))
    best = max(rows, key=lambda r: r[2])
    spark = df.sparkSession
    return spark.createDataFrame([(a, b, round(c, 6), (a, b, c) == best) for a, b, c in rows],
                                 "max_depth int, num_trees int, auc double, best boolean")


def _fold_aucs(u: DataFrame, features: Sequence[str], held: Sequence[Column], rf: RandomForestClassifier) -> list[float]:
    aucs = []
    for h in held:
        train, validation = (_assembled(u.filter(c), features, "label").persist() for c in (~h, h))
        aucs.append(_auc(rf.fit(train), validation, "label"))
        train.unpersist()
        validation.unpersist()
    return aucs


def _grouped_fold_aucs(u: DataFrame, features: Sequence[str], held: Sequence[Column], rf: RandomForestClassifier) -> list[float]:
    """The AUC of each fold by a forest of the other folds' groups of equal bins
    (:func:`grouped_forest`); a fold's own rows of equal bins have one score and
    are scored once, with their weight."""
    u = u.withColumn("_fold", F.coalesce(*[F.when(h, i) for i, h in enumerate(held)], F.lit(-1)))
    aucs = []
    for i, (cuts, _) in enumerate(fold_split_points(u, features, F.col("_fold"), len(held))):
        groups, numbers = _bin_groups(u.withColumn("_held", F.col("_fold") == i), features, cuts, "label", "_held")
        groups = groups.persist()
        try:
            between = [[j + 0.5 for j in range(len(c))] for c in cuts]  # a group's features are the numbers of its bins
            model = grouped_forest(groups.filter(~F.col("_held")), numbers, between, rf)
            aucs.append(_auc(model, _assembled(groups.filter("_held"), numbers, "label", "_rows"), "label", weightCol="_rows"))
        finally:
            groups.unpersist()
    return aucs


def domain_classifier(ref: DataFrame, cur: DataFrame, features: Sequence[str], trees: int = 50, folds: int = 5,
                      seed: int = 42, threshold: float = 0.7) -> DataFrame:
    """Drift by a domain classifier: label reference 0 / current 1, random
    forest (50 trees, seed 42), 5-fold cross-validated ROC AUC; drifted when
    the AUC exceeds 0.7."""
    u = ref.select(*features).withColumn("label", F.lit(0.0)).unionByName(
        cur.select(*features).withColumn("label", F.lit(1.0)))
    rf = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, seed=seed)
    # the folds of CrossValidator for this seed, without its last fit on all rows, whose model nobody reads
    u = u.withColumn("_draw", F.rand(seed))
    held = [(F.col("_draw") >= i * (1.0 / folds)) & (F.col("_draw") < (i + 1) * (1.0 / folds)) for i in range(folds)]
    aucs = _fold_aucs(u, features, held, rf) if _taken_alone(u) else _grouped_fold_aucs(u, features, held, rf)
    a = float(np.mean(aucs))
    return ref.sparkSession.createDataFrame([(round(a, 6), a > threshold)], "auc double, is_drifted boolean")


def feature_chain(categorical: Sequence[str], numeric: Sequence[str]) -> Pipeline:
    """Fit/transform chain reused for retraining and serving: index + one-hot
    categoricals, assemble, standardise (population-free SparkML scaler)."""
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep", stringOrderType="alphabetAsc")
           for c in categorical]
    ohe = OneHotEncoder(inputCols=[f"{c}_idx" for c in categorical], outputCols=[f"{c}_vec" for c in categorical])
    asm = VectorAssembler(inputCols=[f"{c}_vec" for c in categorical] + list(numeric), outputCol="raw",
                          handleInvalid="keep")
    sc = StandardScaler(inputCol="raw", outputCol="features", withMean=False, withStd=True)
    return Pipeline(stages=[*idx, ohe, asm, sc])


def batch_score(df: DataFrame, features: Sequence[str], coef: np.ndarray, intercept: float,
                id_col: str) -> DataFrame:
    """Score every row in Arrow batches with a linear model (NumPy inside the
    task); a failing batch yields null scores instead of failing the job.
    Output: id, score, batch id and per-batch latency."""
    w, b = np.asarray(coef, dtype=float), float(intercept)
    feats = list(features)

    def run(it):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        for i, pdf in enumerate(it):
            t0 = time.perf_counter()
            try:
                x = pdf[feats].to_numpy(dtype=float)
                s = 1.0 / (1.0 + np.exp(-(x @ w + b)))
            except Exception:  # noqa: BLE001 - a bad batch becomes nulls
                s = np.full(len(pdf), np.nan)
            ms = (time.perf_counter() - t0) * 1000.0
            yield pd.DataFrame({id_col: pdf[id_col], "score": s, "batch": f"{part}-{i}", "latency_ms": ms})
    return df.select(id_col, *feats).mapInPandas(run, f"{id_col} long, score double, batch string, latency_ms double")


def batch_summary(scored: DataFrame) -> DataFrame:
    """Batches, records, failed (null or NaN) scores, mean score and mean
    latency of a batch, of what :func:`batch_score` returns."""
    failed = F.col("score").isNull() | F.isnan("score")
    per = scored.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("bad"), F.sum(F.when(~failed, F.col("score"))).alias("s"),
                                      F.max("latency_ms").alias("ms"))
    return per.agg(F.count(F.lit(1)).alias("n_batches"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_records"),
                   F.coalesce(F.sum("bad"), F.lit(0)).alias("n_failed"), F.round(F.try_divide(F.sum("s"), F.sum("n") - F.sum("bad")), 6).alias("mean_score"),
                   F.round(F.avg("ms"), 3).alias("mean_batch_latency_ms"))


def draws(space: dict, n: int, seed: int = 42) -> list[dict]:
    """``n`` random candidates of a search space: per name ("choice", values),
    ("int", lo, hi), ("uniform", lo, hi) or ("loguniform", lo, hi), ends
    included.  The same seed draws the same candidates."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        row = {}
        for name, (kind, *args) in sorted(space.items()):
            if kind == "choice":
                row[name] = args[0][int(rng.integers(len(args[0])))]
            elif kind == "int":
                row[name] = int(rng.integers(args[0], args[1] + 1))
            elif kind == "uniform":
                row[name] = float(rng.uniform(*args))
            elif kind == "loguniform":
                row[name] = float(np.exp(rng.uniform(np.log(args[0]), np.log(args[1]))))
            else:
                raise ValueError(f"unknown distribution {kind}")
        out.append(row)
    return out


def tune_random(df: DataFrame, features: Sequence[str], space: dict, n: int = 6, label: str = "label", parallelism: int = 4,
                seed: int = 42) -> DataFrame:
    """Random search of a gradient-free space of forest parameters (their
    SparkML names, e.g. maxDepth, numTrees, minInfoGain): one row per drawn
    candidate with its validation AUC and the best flagged."""
    rf = RandomForestClassifier(labelCol=label, featuresCol="features", seed=seed)
    drawn = draws(space, n, seed)
    maps = [{rf.getParam(k): v for k, v in d.items()} for d in drawn]
    found = held_out_aucs(df, features, label, rf, maps, 0.75, parallelism, seed)
    best = max(range(n), key=lambda i: (found[i], -i))
    rows = [(i, ", ".join(f"{k}={v:g}" if isinstance(v, float) else f"{k}={v}" for k, v in sorted(d.items())), round(found[i], 6), i == best)
            for i, d in enumerate(drawn)]
    return df.sparkSession.createDataFrame(rows, "candidate int, params string, auc double, best boolean")


def fit_logistic(df: DataFrame, features: Sequence[str], label: str = "label") -> tuple[np.ndarray, float]:
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    m = LogisticRegression(labelCol=label, featuresCol="features", maxIter=50).fit(asm.transform(df))
    return m.coefficients.toArray(), float(m.intercept)

"""§2.11 training and scoring queries on lineitem (label = return flag R).
Model results depend on SparkML's randomised learners: rows-only checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.core import ts_lit
from vigil.operators import ml
from vigil.plans.registry import query
from vigil.sources import sinks as sk
from vigil.sources.readers import table

FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def training_frame(spark, sf):
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", *FEATS, "l_returnflag", "l_shipdate"])
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_key"), *FEATS, "l_shipdate",
                     F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("label"))


@query("train_classifier")
def q_train_classifier(spark, sf):
    model, train, scored = ml.train_and_score(training_frame(spark, sf), "row_key", FEATS, trees=100)
    return ml.score_summary("random_forest", train, scored)


@query("train_boosted")
def q_train_boosted(spark, sf):
    model, train, scored = ml.train_and_score(training_frame(spark, sf), "row_key", FEATS, boosted=True)
    return ml.score_summary("gbt", train, scored)


@query("evaluate_model")
def q_evaluate_model(spark, sf):
    model, train, scored = ml.train_and_score(training_frame(spark, sf), "row_key", FEATS, trees=20)
    return ml.evaluate(scored)


@query("feature_importance")
def q_feature_importance(spark, sf):
    model, _, _ = ml.train_and_score(training_frame(spark, sf), "row_key", FEATS, trees=20)
    return ml.importances(model, FEATS)


@query("tune_grid")
def q_tune_grid(spark, sf):
    return ml.tune(training_frame(spark, sf), FEATS)


@query("tune_random")
def q_tune_random(spark, sf):
    """Six drawn forests: integer, chosen and log-uniform parameters."""
    space = {"maxDepth": ("int", 2, 6), "numTrees": ("choice", [5, 10, 20]), "minInfoGain": ("loguniform", 1e-6, 1e-2),
             "subsamplingRate": ("uniform", 0.5, 1.0)}
    return ml.tune_random(training_frame(spark, sf), FEATS, space, 6)


@query("drift_classifier")
def q_drift_classifier(spark, sf):
    t = training_frame(spark, sf)
    ref = t.filter(F.col("l_shipdate") < ts_lit("1998-01-01"))
    cur = t.filter(F.col("l_shipdate") >= ts_lit("1998-01-01"))
    return ml.domain_classifier(ref, cur, FEATS)


@query("fe_chain")
def q_fe_chain(spark, sf):
    """Fit the chain on the training period, save, reload, apply to the
    serving period."""
    from pyspark.ml import PipelineModel
    li = table(spark, sf, "lineitem", ["l_orderkey", "l_returnflag", "l_linestatus", *FEATS, "l_shipdate"])
    train = li.filter(F.col("l_shipdate") < ts_lit("1998-01-01"))
    serve = li.filter(F.col("l_shipdate") >= ts_lit("1998-01-01"))
    model = ml.feature_chain(["l_returnflag", "l_linestatus"], FEATS).fit(train)
    path = sk.scratch_dir(spark, "chain")
    model.write().overwrite().save(path)
    out = PipelineModel.load(path).transform(serve)
    from pyspark.ml.functions import vector_to_array
    return out.select("l_orderkey", F.size(vector_to_array("features")).alias("n_features"))


@query("batch_score")
def q_batch_score(spark, sf):
    """Fit a logistic model, then score every row in Arrow batches; summary
    of batches, records, failed (null) scores and mean batch latency."""
    t = training_frame(spark, sf)
    coef, icpt = ml.fit_logistic(t, FEATS)
    return ml.batch_summary(ml.batch_score(t, FEATS, coef, icpt, "row_key"))

"""Composite ingest job: validate → profile → clean by issue → features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.core import is_numeric
from vigil.operators import clean as cl
from vigil.operators import expect as ex
from vigil.operators import features as fe
from vigil.operators import quality as q


def clean_frame(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Issue strategy: missing numeric → mean, exact duplicates dropped,
    IQR outliers removed, then z-score features."""
    d = cl.dedup(df)
    d = cl.fill_mean(d, numeric)
    d = cl.outliers(d, numeric, "remove")
    return fe.zscore(d, numeric)


def ingest_clean(df: DataFrame, dataset: str = "batch") -> DataFrame:
    """One summary row: rows in / out, suite success %, issues, score, passed."""
    numeric = [c for c in df.columns if is_numeric(df, c) and not c.endswith("_id")]
    suite = ex.suite_result(ex.run_suite(df, ex.default_suite(df)))
    score = q.dq_score(q.quality_metrics(df, dataset, families=["overall", "duplicate", "missing", "zero", "outlier"]))
    cleaned = clean_frame(df, numeric)
    n_in = df.agg(F.count(F.lit(1)).alias("rows_in"))
    n_out = cleaned.agg(F.count(F.lit(1)).alias("rows_out"))
    parts = [n_in, n_out, suite.select("success_percent", "issues"), score.select("overall_score", "status")]
    out = parts[0].withColumn("_k", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k").withColumn("passed", F.col("status").isin("excellent", "good", "fair"))

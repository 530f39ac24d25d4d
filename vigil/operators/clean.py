"""Cleaning operators (§2.3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.core import cell, exact_quantiles, is_float, missing, ntz_seconds


def drop_null(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null (or NaN) in the subset."""
    return df.na.drop(subset=list(subset) if subset else None)


def _with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Attach a one-row statistics frame to every row (broadcast of one row)."""
    return df.withColumn("_k1", F.lit(1)).join(F.broadcast(row.withColumn("_k1", F.lit(1))), "_k1").drop("_k1")


def fill_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill missing numeric values with the column mean (one aggregate,
    broadcast back as a single row)."""
    stats = df.agg(*[F.avg(F.when(~missing(df, c), F.col(c))).alias(f"_mean_{c}") for c in columns])
    j = _with_row(df, stats)
    return j.select(*[F.when(missing(df, c), F.col(f"_mean_{c}")).otherwise(F.col(c)).alias(c) if c in columns
                      else F.col(c) for c in df.columns])


def fill_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill missing values with the exact median (:func:`exact_quantiles`)."""
    q = exact_quantiles(df, columns, [0.5])
    row = q.groupBy().pivot("feature", list(columns)).agg(F.first("q"))
    row = row.select(*[F.col(c).alias(f"_med_{c}") for c in columns])
    j = _with_row(df, row)
    return j.select(*[F.when(missing(df, c), F.col(f"_med_{c}")).otherwise(F.col(c)).alias(c) if c in columns
                      else F.col(c) for c in df.columns])


def ffill(df: DataFrame, columns: Sequence[str], keys: Sequence[str], order: str,
          bucket: Column | None = None, tie: str | None = None) -> DataFrame:
    """Forward fill per key in ``order``.

    With ``bucket`` (default: the day of a timestamp order column) the
    window runs per (key, bucket) and the last non-null value of each
    earlier bucket is carried from a compact (key, bucket) table, so a key
    holding a large share of rows is still spread over many tasks.  Null keys
    are a key of their own."""
    keys = list(keys)
    if bucket is None and dict(df.dtypes)[order].startswith("timestamp"):
        bucket = F.floor(ntz_seconds(order) / 86400)
    ordc = [F.col(order)] + ([F.col(tie)] if tie else [])
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*ordc).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(*[F.last(F.col(c), ignorenulls=True).over(w).alias(c) if c in columns else F.col(c)
                           for c in df.columns])
    d = df.withColumn("_b", bucket.cast("long"))
    w = Window.partitionBy(*keys, "_b").orderBy(*ordc).rowsBetween(Window.unboundedPreceding, 0)
    within = d.select(*[F.last(F.col(c), ignorenulls=True).over(w).alias(c) if c in columns else F.col(c)
                        for c in df.columns], "_b")
    okey = F.struct(*ordc)
    last_b = d.groupBy(*keys, "_b").agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), okey)).alias(f"_l_{c}")
                                          for c in columns])
    wc = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = last_b.select(*keys, "_b", *[F.last(F.col(f"_l_{c}"), ignorenulls=True).over(wc).alias(f"_c_{c}")
                                         for c in columns])
    carry = carry.select(cell([*keys, "_b"]).alias("_cell"), *[f"_c_{c}" for c in columns])
    j = within.withColumn("_cell", cell([*keys, "_b"])).join(carry, "_cell", "left")
    return j.select(*[F.coalesce(F.col(c), F.col(f"_c_{c}")).alias(c) if c in columns else F.col(c)
                      for c in df.columns])


def dedup(df: DataFrame, subset: Sequence[str] | None = None, keep_first_by: str | None = None) -> DataFrame:
    """Drop exact duplicates (or duplicates on ``subset``).  With
    ``keep_first_by`` the earliest row per subset key is kept, via
    ``min(struct(order, row))`` (partial aggregation, skew safe)."""
    if keep_first_by is None:
        return df.dropDuplicates(list(subset)) if subset else df.dropDuplicates()
    rest = [c for c in df.columns if c not in set(subset or [])]
    agg = df.groupBy(*subset).agg(F.min(F.struct(F.col(keep_first_by).alias("_o"), F.struct(*rest).alias("_r"))).alias("_m"))
    return agg.select(*subset, *[F.col(f"_m._r.{c}").alias(c) for c in rest]).select(*df.columns)


def safe_cast(df: DataFrame, column: str, to: str, flag: str = "cast_failed") -> DataFrame:
    """``try_cast`` a column; rows whose non-null source did not convert are
    flagged."""
    src = F.col(column)
    dst = F.try_cast(src, to) if hasattr(F, "try_cast") else F.expr(f"try_cast(`{column}` AS {to})")
    return df.withColumn(flag, src.isNotNull() & dst.isNull()).withColumn(column, dst)


def iqr_fences(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """One row of lo/hi fences per column from exact quartiles."""
    q = exact_quantiles(df, columns, [0.25, 0.75])
    q = q.groupBy("feature").agg(F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q1"),
                                 F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q3"))
    f = q.select("feature", (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("lo"),
                 (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("hi"))
    row = f.groupBy().pivot("feature", list(columns)).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    return row


def outliers(df: DataFrame, columns: Sequence[str], mode: str = "remove", k: float = 1.5) -> DataFrame:
    """Flag or remove rows outside the IQR fence in any listed column
    (missing values are not outliers)."""
    row = iqr_fences(df, columns, k)
    j = _with_row(df, row)
    out = F.lit(False)
    for c in columns:
        x = F.col(c)
        o = ~missing(df, c) & ((x < F.col(f"{c}_lo")) | (x > F.col(f"{c}_hi")))
        out = out | F.coalesce(o, F.lit(False))
    j = j.withColumn("is_outlier", out).select(*df.columns, "is_outlier")
    return j.filter(~F.col("is_outlier")).drop("is_outlier") if mode == "remove" else j

"""Profiling, fingerprints and sketches (§2.7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.core import (distinct_counts, duplicate_rows, exact_quantiles, is_float, is_numeric, is_string, is_time, missing, rnd,
                                  safe_div, top_k, with_row)


def _explode_structs(wide: DataFrame, structs: list[Column]) -> DataFrame:
    return wide.select(F.explode(F.array(*structs)).alias("_s")).select("_s.*")


def skew_corrected(g1: Column, n: Column) -> Column:
    """Bias-corrected sample skewness G1 from Spark's population g1."""
    n = n.cast("double")
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def kurt_corrected(g2: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis G2 from Spark's population g2."""
    n = n.cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def profile_table(df: DataFrame) -> DataFrame:
    """rows, columns, missing cells, duplicate rows (first occurrence not
    counted; nulls compare equal, as pandas ``duplicated``)."""
    cols = df.columns
    miss = sum((F.count_if(missing(df, c)) for c in cols), F.lit(0))
    base = df.agg(F.count(F.lit(1)).cast("long").alias("n_rows"), miss.cast("long").alias("missing_cells"))
    j = base.withColumn("_k", F.lit(1)).join(duplicate_rows(df).withColumn("_k", F.lit(1)), "_k")
    return j.select("n_rows", F.lit(len(cols)).cast("long").alias("n_columns"), "missing_cells",
                    F.col("_dups").alias("duplicate_rows"))


def profile_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """dtype, non-null, null, null ratio, min, max, mean, std (ddof 1),
    exact median, bias-corrected skewness and kurtosis per numeric column.
    One aggregate pass plus :func:`exact_quantiles` for the median."""
    cols = list(columns) if columns else [c for c in df.columns if is_numeric(df, c)]
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in cols:
        x = F.when(~missing(df, c), F.col(c).cast("double"))
        aggs += [F.count(x).alias(f"{c}__n"), F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max"),
                 F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__std"),
                 F.skewness(x).alias(f"{c}__g1"), F.kurtosis(x).alias(f"{c}__g2")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                     F.col(f"{c}__n").cast("long").alias("count"),
                     (F.col("_rows") - F.col(f"{c}__n")).cast("long").alias("null_count"),
                     rnd(safe_div(F.col("_rows") - F.col(f"{c}__n"), F.col("_rows"))).alias("null_ratio"),
                     F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max"),
                     rnd(F.col(f"{c}__mean")).alias("mean"), rnd(F.col(f"{c}__std")).alias("std"),
                     rnd(skew_corrected(F.col(f"{c}__g1"), F.col(f"{c}__n")), 6).alias("skewness"),
                     rnd(kurt_corrected(F.col(f"{c}__g2"), F.col(f"{c}__n")), 6).alias("kurtosis"))
            for c in cols]
    stats = _explode_structs(wide, rows)
    med = exact_quantiles(df, cols, [0.5]) \
        .select(F.col("feature").alias("column"), rnd(F.col("q")).alias("median"))
    return stats.join(F.broadcast(med), "column", "left")


def profile_shape(df: DataFrame, columns: Sequence[str] | None = None, of: str = "skewness") -> DataFrame:
    """(column, skewness) or (column, kurtosis), bias-corrected, of the numeric
    columns: one aggregate, no quantiles."""
    cols = list(columns) if columns else [c for c in df.columns if is_numeric(df, c)]
    raw, corrected = {"skewness": (F.skewness, skew_corrected), "kurtosis": (F.kurtosis, kurt_corrected)}[of]
    aggs = []
    for c in cols:
        x = F.when(~missing(df, c), F.col(c).cast("double"))
        aggs += [F.count(x).alias(f"{c}__n"), raw(x).alias(f"{c}__g")]
    return _explode_structs(df.agg(*aggs), [F.struct(F.lit(c).alias("column"), rnd(corrected(F.col(f"{c}__g"), F.col(f"{c}__n")), 6).alias(of)) for c in cols])


def profile_datetime(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    cols = list(columns) if columns else [c for c in df.columns if is_time(df, c)]
    wide = df.agg(*[x for c in cols for x in (F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max"),
                                              F.count(c).alias(f"{c}__n"))])
    return _explode_structs(wide, [F.struct(F.lit(c).alias("column"),
                                            F.col(f"{c}__n").cast("long").alias("count"),
                                            F.col(f"{c}__min").cast("timestamp_ntz").alias("min"),
                                            F.col(f"{c}__max").cast("timestamp_ntz").alias("max")) for c in cols])


def profile_class(df: DataFrame, columns: Sequence[str] | None = None, max_distinct: int = 50,
                  max_ratio: float = 0.5, approx: bool = False) -> DataFrame:
    """String columns: categorical when distinct < 50 and < 0.5 x rows, else
    text; also the mean length of non-null values (``profile_text_len``)."""
    cols = list(columns) if columns else [c for c in df.columns if is_string(df, c)]
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in cols:
        aggs += [F.count(c).alias(f"{c}__n"), F.avg(F.length(c)).alias(f"{c}__len")]
        if approx:
            aggs.append(F.approx_count_distinct(c).alias(f"{c}__d"))
    wide = df.agg(*aggs)
    if not approx:
        wide = with_row(wide, distinct_counts(df, {f"{c}__d": F.col(c) for c in cols}))
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__d").cast("long").alias("n_distinct"),
                     F.col(f"{c}__n").cast("long").alias("count"),
                     F.when((F.col(f"{c}__d") < max_distinct) & (F.col(f"{c}__d") < max_ratio * F.col("_rows")),
                            "categorical").otherwise("text").alias("kind"),
                     rnd(F.col(f"{c}__len")).alias("mean_length")) for c in cols]
    return _explode_structs(wide, rows)


def profile_top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """Top k values with counts per string column (ties by value); salted
    two-level ranking so a column with many distinct values is not ranked
    in one task."""
    cols = list(columns) if columns else [c for c in df.columns if is_string(df, c)]
    lf = df.select(*[F.col(c).cast("string") for c in cols]).unpivot([], cols, "column", "value") \
        .filter(F.col("value").isNotNull())
    counts = lf.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    return top_k(counts, ["column"], k, [F.col("count").desc(), F.col("value")], "value") \
        .select("column", "rank", "value", F.col("count").cast("long"))


def row_hash(columns: Sequence[str]) -> Column:
    """64-bit hash of the columns that tells apart where nulls stand (the hash
    function itself skips nulls)."""
    cols = [F.col(f"`{c}`") for c in columns]
    return F.xxhash64(*cols, *[c.isNull() for c in cols]) if cols else F.lit(0).cast("long")


def profile_fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive content hash: row count, sum and xor of 64-bit row
    hashes.  Equal data in any order or partitioning gives equal output."""
    h = row_hash(df.columns)
    return df.agg(F.count(F.lit(1)).cast("long").alias("n_rows"),
                  F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"),
                  F.bit_xor(h).alias("hash_xor"))


def profile_sketch(df: DataFrame, column: str, by: Sequence[str], k: int = 200) -> DataFrame:
    """Mergeable per-slice sketch row: KLL quantile sketch, HLL distinct
    sketch, exact count/min/max/sum; store per day/partition and merge."""
    x = F.col(column).cast("double")
    return df.groupBy(*by).agg(
        F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.sum(x).alias("sum"),
        F.kll_sketch_agg_double(x, F.lit(k)).alias("kll"),
        F.hll_sketch_agg(_hll_input(df, column)).alias("hll"))


def _hll_input(df: DataFrame, column: str) -> Column:
    dt = df.schema[column].dataType
    if isinstance(dt, (T.IntegerType, T.LongType, T.StringType, T.BinaryType)):
        return F.col(column)
    if isinstance(dt, (T.ShortType, T.ByteType)):
        return F.col(column).cast("int")
    return F.col(column).cast("string")


def merge_sketches(sketches: DataFrame, by: Sequence[str] = (), probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Merge stored sketch rows; returns count, min, max, mean, approximate
    distinct count and approximate quantiles."""
    g = sketches.groupBy(*by) if by else sketches.groupBy()
    merged = g.agg(F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"),
                   F.sum("sum").alias("sum"), F.kll_merge_agg_double("kll").alias("kll"),
                   F.hll_union_agg("hll").alias("hll"))
    return merged.select(*by, F.col("n").cast("long"), "min", "max", (F.col("sum") / F.col("n")).alias("mean"),
                         F.hll_sketch_estimate("hll").alias("approx_distinct"),
                         *[F.kll_sketch_get_quantile_double("kll", F.lit(p)).alias(f"q{int(p * 100)}") for p in probs])


def profile_diff(before: DataFrame, after: DataFrame, columns: Sequence[str] | None = None,
                 null_jump: float = 0.05, distinct_ratio: float = 0.2) -> DataFrame:
    """Compare two profiles: null-rate jump and relative distinct change per
    column; flags anomalies by the two thresholds."""
    cols = list(columns) if columns else [c for c in before.columns if c in after.columns]

    def prof(df, tag):
        aggs = [F.count(F.lit(1)).alias("_rows")]
        for c in cols:
            aggs.append(F.count_if(missing(df, c)).alias(f"{c}__m"))
        w = with_row(df.agg(*aggs), distinct_counts(df, {f"{c}__d": F.when(~missing(df, c), F.col(c)) for c in cols}))
        return _explode_structs(w, [F.struct(F.lit(c).alias("column"),
                                             safe_div(F.col(f"{c}__m"), F.col("_rows")).alias(f"null_rate_{tag}"),
                                             F.col(f"{c}__d").cast("long").alias(f"distinct_{tag}")) for c in cols])
    j = prof(before, "before").join(prof(after, "after"), "column")
    jump = F.col("null_rate_after") - F.col("null_rate_before")
    dchg = safe_div(F.col("distinct_after") - F.col("distinct_before"), F.col("distinct_before"))
    return j.select("column", rnd(F.col("null_rate_before")).alias("null_rate_before"),
                    rnd(F.col("null_rate_after")).alias("null_rate_after"), "distinct_before", "distinct_after",
                    rnd(jump).alias("null_rate_jump"), rnd(dchg).alias("distinct_change"),
                    ((F.abs(jump) > null_jump) | (F.abs(F.coalesce(dchg, F.lit(0.0))) > distinct_ratio)).alias("anomaly"))


def dataset_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows added / removed / changed / unchanged between two versions: full
    outer join on the key, row hash comparison of the other columns."""
    rest = [c for c in old.columns if c not in set(keys)]
    o = old.select(*keys, row_hash(rest).alias("_ho"), F.lit(True).alias("_in_o"))
    n = new.select(*keys, row_hash(rest).alias("_hn"), F.lit(True).alias("_in_n"))
    j = o.join(n, list(keys), "full_outer")
    kind = (F.when(F.col("_in_o").isNull(), "added").when(F.col("_in_n").isNull(), "removed")
            .when(F.col("_ho") == F.col("_hn"), "unchanged").otherwise("changed"))
    return j.groupBy(kind.alias("change")).agg(F.count(F.lit(1)).cast("long").alias("n_rows"))


def dataset_diff_keyless(old: DataFrame, new: DataFrame) -> DataFrame:
    """Multiset difference without a key: added = new EXCEPT ALL old,
    removed = old EXCEPT ALL new, unchanged = INTERSECT ALL."""
    added = new.exceptAll(old).agg(F.count(F.lit(1)).alias("n")).select(F.lit("added").alias("change"), F.col("n").cast("long").alias("n_rows"))
    removed = old.exceptAll(new).agg(F.count(F.lit(1)).alias("n")).select(F.lit("removed").alias("change"), F.col("n").cast("long").alias("n_rows"))
    same = old.intersectAll(new).agg(F.count(F.lit(1)).alias("n")).select(F.lit("unchanged").alias("change"), F.col("n").cast("long").alias("n_rows"))
    return added.unionByName(removed).unionByName(same)


def latest_profile(history: DataFrame, key: str = "dataset", ts: str = "ts") -> DataFrame:
    """Newest stored profile row per dataset (``max(struct(ts, row))``)."""
    from vigil.operators.featurestore import latest_per_key
    return latest_per_key(history, [key], ts)


__all__ = ["profile_table", "profile_numeric", "profile_datetime", "profile_class", "profile_top_values",
           "profile_fingerprint", "profile_sketch", "merge_sketches", "profile_diff", "dataset_diff",
           "dataset_diff_keyless", "latest_profile", "skew_corrected", "kurt_corrected"]

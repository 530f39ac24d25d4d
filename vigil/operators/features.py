"""Feature engineering: projections, encoders, scalers, windowed
behaviour features (§2.4)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.core import ntz_micros, ntz_seconds, numbered


def square(c: str) -> Column:
    return F.pow(F.col(c), 2)


def log1p_abs(c: str) -> Column:
    return F.log1p(F.abs(F.col(c)))


def interaction(a: str, b: str) -> Column:
    return F.col(a) * F.col(b)


def ratio(a: str, b: str) -> Column:
    """a / (b + 1)."""
    return F.col(a) / (F.col(b) + 1)


def date_parts(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(f"{col}_year", F.year(col)).withColumn(f"{col}_month", F.month(col)) \
        .withColumn(f"{col}_day", F.dayofmonth(col))


def category_codes(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """code = rank of the value among the sorted distinct values (0-based),
    null → −1 (``pd.Categorical(x).codes``).  The distinct values are sorted
    over range partitions and numbered, not ranked in one global window; the
    code table is joined back on the value (shuffle or AQE broadcast)."""
    out = out or f"{col}_code"
    d = df.select(F.col(col).alias("_v")).filter(F.col("_v").isNotNull()).distinct()
    codes = numbered(d.orderBy("_v"), "_code")
    j = df.join(codes.select(F.col("_v").alias(col), "_code"), col, "left")
    return j.withColumn(out, F.coalesce(F.col("_code"), F.lit(-1)).cast("long")).drop("_code").select(*df.columns, out)


def zscore(df: DataFrame, columns: Sequence[str], eps: float = 1e-8) -> DataFrame:
    """(x − mean) / (std_sample + 1e-8) per column."""
    st = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))])
    j = df.withColumn("_k1", F.lit(1)).join(F.broadcast(st.withColumn("_k1", F.lit(1))), "_k1")
    return j.select(*df.columns, *[((F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + eps)).alias(f"{c}_z")
                                   for c in columns])


def scaler_fit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fitted standard scaler: one row per column with mean and population
    std (the scaler library's convention).  Store it; reuse for serving."""
    st = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s"))])
    return st.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__m").alias("mean"),
                                                  F.col(f"{c}__s").alias("std")) for c in columns])).alias("s")).select("s.*")


def scaler_transform(df: DataFrame, params: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Apply a fitted scaler (params pivoted to one broadcast row); a zero
    std leaves the centred value."""
    row = params.groupBy().pivot("feature", list(columns)).agg(F.first("mean").alias("m"), F.first("std").alias("s"))
    j = df.withColumn("_k1", F.lit(1)).join(F.broadcast(row.withColumn("_k1", F.lit(1))), "_k1")
    outs = []
    for c in columns:
        s = F.col(f"{c}_s")
        outs.append(F.when(s == 0, F.col(c) - F.col(f"{c}_m")).otherwise((F.col(c) - F.col(f"{c}_m")) / s).alias(f"{c}_scaled"))
    return j.select(*df.columns, *outs)


def one_hot_columns(df: DataFrame, col: str, categories: Sequence | None = None, most: int = 1000) -> DataFrame:
    """One 0/1 column per category: the given ones, else all values (sorted).
    A column per value only suits few values: more than ``most`` of them are an
    error, found without bringing them to the driver; :func:`one_hot_vector` is
    for open-ended categories."""
    if categories is not None:
        cats = [str(c) for c in categories]
    else:
        values = df.select(F.col(col).cast("string").alias("c")).filter(F.col("c").isNotNull()).distinct()
        cats = sorted(r[0] for r in values.limit(most + 1).collect())
        if len(cats) > most:
            raise ValueError(f"{col} has more than {most} values: use one_hot_vector")
    return df.select(*df.columns, *[(F.col(col).cast("string") == F.lit(v)).cast("int").alias(f"{col}_{v}") for v in cats])


def one_hot_vector(df: DataFrame, col: str):
    """SparkML StringIndexer + OneHotEncoder (sparse vector, any cardinality)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    p = Pipeline(stages=[StringIndexer(inputCol=col, outputCol=f"{col}_idx", stringOrderType="alphabetAsc",
                                       handleInvalid="keep"),
                         OneHotEncoder(inputCol=f"{col}_idx", outputCol=f"{col}_vec")])
    return p.fit(df)


def range_window_agg(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, aggs: Mapping[str, Column],
                     bucket_seconds: int = 86400, open_start: bool = False) -> DataFrame:
    """Per row, aggregates over the same key's rows in [ts − seconds, ts], or
    in (ts − seconds, ts] with ``open_start``.

    Windows run per (key, time bucket).  A row near the end of a bucket is
    also copied, as context only, into the next bucket, so each bucket sees
    every row of its look-back range: the window partition size is bounded
    by the bucket even for a hot key, and rows are at most duplicated once
    (``seconds`` ≤ ``bucket_seconds``)."""
    if seconds > bucket_seconds:
        raise ValueError("look-back longer than the bucket")
    keys = list(keys)
    us = ntz_micros(ts)
    b = F.floor(ntz_seconds(ts) / bucket_seconds).cast("long")
    base = df.withColumn("_us", us).withColumn("_b", b).withColumn("_real", F.lit(True))
    nxt_start = (F.col("_b") + 1) * bucket_seconds * 1_000_000
    ctx = base.filter(F.col("_us") >= nxt_start - seconds * 1_000_000) \
        .withColumn("_b", F.col("_b") + 1).withColumn("_real", F.lit(False))
    u = base.unionByName(ctx)
    w = Window.partitionBy(*keys, "_b").orderBy("_us").rangeBetween(-seconds * 1_000_000 + int(open_start), 0)
    out = u.select(*df.columns, "_real", *[a.over(w).alias(name) for name, a in aggs.items()])
    return out.filter("_real").drop("_real")


def sliding_rate(requests: DataFrame, keys: Sequence[str], ts: str, limit: int, seconds: int = 60,
                 bucket_seconds: int = 60) -> DataFrame:
    """All columns, ``n_recent`` and ``limited``: each request's number of
    requests of its key in the last ``seconds``, itself and those of the same
    instant included, the one exactly ``seconds`` ago not; ``limited`` where
    that exceeds ``limit``.

    Windows run per (key, bucket) over the bucket and the tail of the bucket
    before it, so the requests of one busy key spread over as many tasks as
    it has buckets.  Null keys are a key of their own; rows without a time are
    dropped."""
    known = requests.filter(F.col(ts).isNotNull())
    w = range_window_agg(known, keys, ts, seconds, {"n_recent": F.count(F.lit(1))}, bucket_seconds, open_start=True)
    return w.withColumn("limited", F.col("n_recent") > limit)


def user_profile(events: DataFrame, user: str = "user_id", ts: str = "ts", etype: str = "event_type",
                 value: str = "value", purchase: str = "purchase") -> DataFrame:
    """Per-user profile: events, purchases, lifetime value, mean value,
    distinct event types, first / last seen, active days."""
    return events.groupBy(user).agg(
        F.count(F.lit(1)).cast("long").alias("n_events"),
        F.count_if(F.col(etype) == purchase).cast("long").alias("n_purchases"),
        F.round(F.coalesce(F.sum(F.when(F.col(etype) == purchase, F.col(value))), F.lit(0.0)), 6).alias("lifetime_value"),
        F.round(F.avg(value), 9).alias("avg_value"),
        F.count_distinct(etype).cast("long").alias("n_types"),
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"),
        F.count_distinct(F.to_date(ts)).cast("long").alias("active_days"))


def hash_split(df: DataFrame, key: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Deterministic train / validation split: validation when
    pmod(xxhash64(key, seed), 10000) < fraction × 10000."""
    v = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(10000)) < int(fraction * 10000)
    return df.withColumn("split", F.when(v, "validation").otherwise("train"))

"""Feature-store joins (§2.8): point-in-time join, online lookup,
materialisation, feature statistics, skew and freshness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.core import missing, ntz_seconds, rnd, safe_div
from vigil.sources.sinks import replace_partitions
from vigil.sources.versioned import VersionedTable, append_batch


def pit_join(entities: DataFrame, features: DataFrame, keys: Sequence[str],
             entity_ts: str, feature_ts: str, feature_cols: Sequence[str] | None = None,
             ttl_seconds: int | None = None, tie: str | None = None,
             bucket_seconds: int | None = 86400, prefix: str = "") -> DataFrame:
    """Point-in-time (as-of) left join without leakage: for every entity row,
    the newest feature row of the same key with ``feature_ts <= entity_ts`` (a
    feature stamped at the same instant is visible).  ``tie`` orders feature
    rows that share key and time (the larger wins).  With ``ttl_seconds`` a
    feature older than the TTL is null.  See :func:`_as_of` for the plan."""
    view = {"sources": [features], "ts": feature_ts, "features": feature_cols, "ttl": ttl_seconds, "tie": tie, "prefix": prefix}
    return _as_of(entities, [view], list(keys), entity_ts, bucket_seconds)


def pit_join_multi(entities: DataFrame, views: Sequence[Mapping], keys: Sequence[str],
                   entity_ts: str, bucket_seconds: int | None = 86400) -> DataFrame:
    """:func:`pit_join` of several feature views in one pass over all of them.

    ``views``: ``{"name", "sources": [df, ...], "ts", "features", "ttl", "tie"}``;
    several sources of one view (history + fresh) are unioned first.  Output
    feature columns are named ``<view>__<feature>``; each view keeps its TTL.
    """
    return _as_of(entities, [{**v, "prefix": f"{v['name']}__"} for v in views], list(keys), entity_ts, bucket_seconds)


def _as_of(entities: DataFrame, views: Sequence[Mapping], keys: list[str], entity_ts: str, bucket_seconds: int | None) -> DataFrame:
    """The as-of join of any number of views.

    Entities and features go into one narrow union, shuffled once by (key,
    time bucket); one window in time order keeps the last feature of each
    view, so a key that holds a third of all rows spreads over its buckets.
    What earlier buckets pass on comes from a compact table with one row a
    (key, bucket), aggregated from the same shuffle, where the carry is a
    window by key; it is joined on (key, bucket).  Rows cross the network once,
    however many views there are; null keys match nothing."""
    parts, plans = [], []
    ent_type = entities.select(F.struct(*[F.col(f"`{c}`") for c in entities.columns]).alias("e")).schema["e"].dataType
    sources = []
    for v in views:
        src = v["sources"][0]
        for more in v["sources"][1:]:
            src = src.unionByName(more, allowMissingColumns=True)
        src = src.dropna(subset=keys)
        tie, ts = v.get("tie"), v["ts"]
        cols = list(v["features"]) if v.get("features") is not None else [c for c in src.columns if c not in {*keys, ts, tie}]
        rank = F.col(tie).cast("long") if tie else F.lit(0).cast("long")
        payload = F.struct(F.col(ts).alias("_fts"), rank.alias("_tie"), *[F.col(c).alias(c) for c in cols])
        sources.append((src, ts, rank, payload, src.select(payload.alias("p")).schema["p"].dataType))
        plans.append((v, ts, cols))
    slots = [f"_f{i}" for i in range(len(views))]
    none = [F.lit(None).cast(kind).alias(slot) for slot, (*_, kind) in zip(slots, sources)]
    whole = F.struct(*[F.col(f"`{c}`") for c in entities.columns])
    parts.append(entities.select(*keys, F.col(entity_ts).alias("_ts"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_tie"),
                                 whole.alias("_e"), *none))
    for i, (src, ts, rank, payload, _) in enumerate(sources):
        own = [payload.alias(slots[i]) if j == i else none[j] for j in range(len(slots))]
        parts.append(src.select(*keys, F.col(ts).alias("_ts"), F.lit(0).alias("_side"), rank.alias("_tie"),
                                F.lit(None).cast(ent_type).alias("_e"), *own))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    # one struct holds key and bucket: it is never null, and null keys meet in it
    bucket = F.floor(ntz_seconds("_ts") / F.lit(bucket_seconds or 1)).cast("long") if bucket_seconds else F.lit(0).cast("long")
    u = u.withColumn("_cell", F.struct(*keys, bucket.alias("_b"))).drop(*keys).repartition("_cell")
    w = Window.partitionBy("_cell").orderBy("_ts", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    hits = [F.last(s, ignorenulls=True).over(w).alias(f"_h{i}") for i, s in enumerate(slots)]
    res = u.select("_cell", "_ts", "_side", "_e", *hits).filter("_side = 1")
    if bucket_seconds:
        # reads every column of the shuffle above, so that both use the same one
        newest = [F.max(F.when(F.col(s).isNotNull(), F.struct(F.col("_ts").alias("t"), F.col("_tie").alias("k"), F.col(s).alias("f")))).alias(s)
                  for s in slots]
        per = u.groupBy("_cell").agg(*newest, (F.count("_e") + F.sum("_side")).alias("_n"))
        back = Window.partitionBy(*[F.col(f"_cell.`{k}`") for k in keys]).orderBy("_cell._b").rowsBetween(Window.unboundedPreceding, -1)
        carry = per.select("_cell", "_n", *[F.last(F.col(f"{s}.f"), ignorenulls=True).over(back).alias(f"_c{i}") for i, s in enumerate(slots)]) \
            .filter("_n > 0").drop("_n")
        res = res.join(carry, "_cell", "left") \
            .select("_ts", "_e", *[F.coalesce(f"_h{i}", f"_c{i}").alias(f"_h{i}") for i in range(len(slots))])
    out = [F.col(f"_e.`{c}`").alias(c) for c in entities.columns]
    for i, (v, ts, cols) in enumerate(plans):
        ttl, hit = v.get("ttl"), F.col(f"_h{i}")
        if ttl is not None:
            hit = F.when(hit["_fts"] >= F.timestamp_add("SECOND", F.lit(-int(ttl)), F.col("_ts")), hit)
        out += [hit["_fts"].alias(f"{v['prefix']}{ts}"), *[hit[c].alias(f"{v['prefix']}{c}") for c in cols]]
    return res.select(*out)


def feature_select(df: DataFrame, keys: Sequence[str], requested: Sequence[str] | None,
                   online: bool = False, online_default_n: int = 10) -> DataFrame:
    """Requested feature names, else all (offline) or the first 10 (online)."""
    feats = [c for c in df.columns if c not in set(keys)]
    if requested:
        unknown = [r for r in requested if r not in df.columns]
        if unknown:
            raise ValueError(f"unknown features: {unknown}")
        feats = list(requested)
    elif online:
        feats = feats[:online_default_n]
    return df.select(*keys, *feats)


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str, tie: str | None = None,
                   start=None, end=None) -> DataFrame:
    """Newest row per key inside [start, end] (``materialize``).

    ``max(struct(ts, tie, row))`` is a hash aggregate with map-side partial
    aggregation, so a hot key is reduced before the shuffle (a
    ``row_number`` window would pull the whole key into one task)."""
    keys = list(keys)
    if start is not None:
        df = df.filter(F.col(ts) >= start)
    if end is not None:
        df = df.filter(F.col(ts) <= end)
    rest = [c for c in df.columns if c not in set(keys)]
    order = [F.col(ts)] + ([F.col(tie)] if tie else [])
    agg = df.groupBy(*keys).agg(F.max(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)],
                                               F.struct(*rest).alias("_r"))).alias("_m"))
    return agg.select(*keys, *[F.col(f"_m._r.{c}").alias(c) for c in rest])


def materialize_incremental(latest: DataFrame, new_rows: DataFrame, keys: Sequence[str], ts: str,
                            tie: str | None = None) -> DataFrame:
    """Merge a new window into the latest table; the newer ts wins."""
    return latest_per_key(latest.unionByName(new_rows, allowMissingColumns=True), keys, ts, tie)


KIND_DEFAULTS = {"numeric": 0.0, "string": "unknown", "boolean": False}


def online_lookup(entities: DataFrame, latest: DataFrame, keys: Sequence[str],
                  features: Sequence[str] | None = None) -> DataFrame:
    """Latest value per entity with kind defaults (0.0 / 'unknown' / false)
    when the key or value is absent.  A set-based left join instead of a
    lookup per row; no broadcast hint on the latest table (it grows with
    the entity count), so AQE chooses from measured sizes."""
    feats = list(features) if features else [c for c in latest.columns if c not in set(keys)]
    j = entities.join(latest.select(*keys, *feats), list(keys), "left")
    outs = []
    for c in feats:
        dt = latest.schema[c].dataType
        if isinstance(dt, T.NumericType):
            outs.append(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c))
        elif isinstance(dt, T.BooleanType):
            outs.append(F.coalesce(F.col(c), F.lit(False)).alias(c))
        elif isinstance(dt, T.StringType):
            outs.append(F.coalesce(F.col(c), F.lit("unknown")).alias(c))
        else:
            outs.append(F.col(c))
    return j.select(*[c for c in entities.columns], *outs)


def feature_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std (sample), min, max, missing, zeros per feature, one
    aggregate pass, long form."""
    aggs = []
    for c in columns:
        x = F.when(~missing(df, c), F.col(c).cast("double"))
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"),
                 F.max(x).alias(f"{c}__max"), F.count_if(missing(df, c)).alias(f"{c}__missing"),
                 F.count_if(x == 0).alias(f"{c}__zeros")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("feature"),
                     F.col(f"{c}__count").cast("long").alias("count"),
                     rnd(F.col(f"{c}__mean")).alias("mean"), rnd(F.col(f"{c}__std")).alias("std"),
                     F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max"),
                     F.col(f"{c}__missing").cast("long").alias("missing"),
                     F.col(f"{c}__zeros").cast("long").alias("zeros")) for c in columns]
    return wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def feature_skew(offline: DataFrame, online: DataFrame, keys: Sequence[str],
                 features: Sequence[str], tol: float = 1e-9) -> DataFrame:
    """Training/serving skew: share of keys whose offline (latest) and online
    value differ, per feature.  Missing on one side counts as a mismatch."""
    o = offline.select(*keys, *[F.col(c).alias(f"off__{c}") for c in features])
    n = online.select(*keys, *[F.col(c).alias(f"on__{c}") for c in features])
    j = o.join(n, list(keys), "full_outer")
    rows = []
    for c in features:
        a, b = F.col(f"off__{c}"), F.col(f"on__{c}")
        if isinstance(offline.schema[c].dataType, T.NumericType):
            mism = ~(a.isNotNull() & b.isNotNull() & (F.abs(a.cast("double") - b.cast("double")) <= tol))
        else:
            mism = ~(a.isNotNull() & b.isNotNull() & (a == b))
        rows.append((c, mism))
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count_if(m).alias(f"{c}__m") for c, m in rows]
    wide = j.agg(*aggs)
    st = [F.struct(F.lit(c).alias("feature"), F.col("_n").cast("long").alias("n_keys"),
                   F.col(f"{c}__m").cast("long").alias("n_mismatch"),
                   rnd(safe_div(F.col(f"{c}__m"), F.col("_n"))).alias("mismatch_rate")) for c, _ in rows]
    return wide.select(F.explode(F.array(*st)).alias("s")).select("s.*")


def feature_freshness(values: DataFrame, feature_set: str, ts: str, as_of: Column) -> DataFrame:
    """Age (seconds and hours) of the newest value per feature set: one
    aggregate over the table that holds all sets (column ``feature_set``)."""
    u = values.groupBy(F.col(feature_set).alias("feature_set")).agg(F.max(ts).alias("latest_ts"))
    age_us = F.timestamp_diff("MICROSECOND", F.col("latest_ts"), as_of)
    return u.select("feature_set", "latest_ts",
                    F.floor(age_us / 1e6).cast("long").alias("age_seconds"),
                    rnd(age_us / 3.6e9, 6).alias("age_hours"))


def feature_validate(df: DataFrame, expected: Mapping[str, str], keys: Sequence[str], ts: str) -> DataFrame:
    """Feature-set column check before a write: one row per problem
    (missing column, type family mismatch, null key or timestamp count)."""
    from vigil.operators.expect import type_family
    spark = df.sparkSession
    actual = {f.name: f.dataType for f in df.schema.fields}
    lit_rows = []
    for c, fam in expected.items():
        if c not in actual:
            lit_rows.append((c, "missing_column", 1))
        elif type_family(actual[c]) != fam:
            lit_rows.append((c, "type_mismatch", 1))
    schema_df = spark.createDataFrame(lit_rows, "column string, problem string, n long")
    req = list(keys) + [ts]
    present_req = [c for c in req if c in actual]
    if present_req:
        nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in present_req])
        nl = nulls.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit("null_values").alias("problem"),
                                                        F.col(c).cast("long").alias("n")) for c in present_req])).alias("s")).select("s.*")
        schema_df = schema_df.unionByName(nl.filter("n > 0"))
    return schema_df


def feature_write(df: DataFrame, expected: Mapping[str, str], keys: Sequence[str], ts: str, online: VersionedTable,
                  table_name: str | None, parquet_dir: str, batch_id: int) -> DataFrame:
    """Validate a feature batch, then write it to the online store (latest row
    per key), the warehouse table and the offline parquet history (partitioned
    by batch and ingest day).  Each sink knows the batch by its number, so a
    batch that is written again after a failure adds nothing to any of them; a
    batch with problems is not written and its problems are returned.  The
    table's last column is its partition column ``batch_id``."""
    problems = feature_validate(df, expected, keys, ts)
    if problems.take(1):
        return problems
    batch = df.persist()
    try:
        online.merge(batch, ts, batch_id=batch_id, source="features")
        if table_name:
            replace_partitions(batch.withColumn("batch_id", F.lit(batch_id)), table_name)
        append_batch(batch.withColumn("ingest_date", F.to_date(ts)), parquet_dir, batch_id, ["ingest_date"])
    finally:
        batch.unpersist()
    return problems

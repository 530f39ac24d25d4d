"""Expectations, declared schemas and constraint checks (§2.6).

A suite is compiled into ONE aggregate over the data (plus one grouping per
uniqueness expectation and an exact-quantile job per median expectation),
then stacked into one row per expectation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.core import distinct_counts, exact_quantiles, missing, rnd, safe_div

# Strftime directive -> Spark datetime pattern letters.
STRFTIME_TO_SPARK = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm",
    "%S": "ss", "%f": "SSSSSS", "%p": "a", "%b": "MMM", "%B": "MMMM", "%a": "EEE",
    "%j": "DDD", "%z": "Z", "%Z": "z", "%%": "%",
}


def strftime_to_spark(fmt: str) -> str:
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            d = fmt[i:i + 2]
            if d not in STRFTIME_TO_SPARK:
                raise ValueError(f"unsupported directive {d}")
            out.append(STRFTIME_TO_SPARK[d])
            i += 2
        else:
            ch = fmt[i]
            out.append(f"'{ch}'" if ch.isalpha() else ch)
            i += 1
    return "".join(out)


@dataclass
class Expectation:
    kind: str                      # not_null | between | in_set | unique | strftime | distinct_between
    column: str                    # | length_between | mean, median, stdev, min, max, sum or quantile _between (``quantile``: 0 to 1)
    kwargs: dict = field(default_factory=dict)

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.column}"


def default_suite(df: DataFrame) -> list[Expectation]:
    """not-null and at least one distinct value for every column."""
    out = []
    for c in df.columns:
        out.append(Expectation("not_null", c))
        out.append(Expectation("distinct_between", c, {"min": 1}))
    return out


def run_suite(df: DataFrame, suite: Sequence[Expectation]) -> DataFrame:
    """One row per expectation: element_count, unexpected_count,
    unexpected_percent, observed_value, success."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("_rows")]
    rows: list[Column] = []
    extra: list[DataFrame] = []
    distinct: dict[str, Column] = {}
    for i, e in enumerate(suite):
        c, kw, p = F.col(e.column), e.kwargs, f"_e{i}"
        miss = missing(df, e.column)
        elem, unexp, obs, succ = None, None, None, None
        if e.kind == "not_null":
            aggs.append(F.count_if(miss).alias(f"{p}u"))
            elem, unexp = F.col("_rows"), F.col(f"{p}u")
        elif e.kind in ("between", "length_between"):
            x = F.length(c) if e.kind == "length_between" else c
            bad = F.lit(False)
            if kw.get("min") is not None:
                bad = bad | (x < F.lit(kw["min"]))
            if kw.get("max") is not None:
                bad = bad | (x > F.lit(kw["max"]))
            aggs += [F.count_if(~miss).alias(f"{p}n"), F.count_if(~miss & bad).alias(f"{p}u")]
            elem, unexp = F.col(f"{p}n"), F.col(f"{p}u")
        elif e.kind == "in_set":
            aggs += [F.count_if(~miss).alias(f"{p}n"),
                     F.count_if(~miss & ~c.isin(*kw["values"])).alias(f"{p}u")]
            elem, unexp = F.col(f"{p}n"), F.col(f"{p}u")
        elif e.kind == "strftime":
            fmt = strftime_to_spark(kw["format"])
            aggs += [F.count_if(~miss).alias(f"{p}n"),
                     F.count_if(~miss & F.try_to_timestamp(c.cast("string"), F.lit(fmt)).isNull()).alias(f"{p}u")]
            elem, unexp = F.col(f"{p}n"), F.col(f"{p}u")
        elif e.kind == "unique":
            g = df.filter(~miss).groupBy(e.column).agg(F.count(F.lit(1)).alias("_n"))
            extra.append(g.agg(F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias(f"{p}u"),
                               F.coalesce(F.sum("_n"), F.lit(0)).alias(f"{p}n")))
            elem, unexp = F.col(f"{p}n"), F.col(f"{p}u")
        elif e.kind == "distinct_between":
            distinct[f"{p}o"] = F.when(~miss, c)
            obs = F.col(f"{p}o").cast("double")
        elif e.kind in ("mean_between", "median_between", "quantile_between", "stdev_between", "min_between", "max_between", "sum_between"):
            x = F.when(~miss, c.cast("double"))
            if e.kind in ("median_between", "quantile_between"):
                # exact, by distributed selection, not a per-group value map; an empty column has none
                q = 0.5 if e.kind == "median_between" else float(kw["quantile"])
                extra.append(exact_quantiles(df, [e.column], [q]).agg(F.max("q").alias(f"{p}o")))
            else:
                f = {"mean_between": F.avg(x), "stdev_between": F.stddev_samp(x), "min_between": F.min(x), "max_between": F.max(x),
                     "sum_between": F.sum(x)}[e.kind]
                aggs.append(f.alias(f"{p}o"))
            obs = F.col(f"{p}o")
        else:
            raise ValueError(f"unknown expectation {e.kind}")
        if obs is not None:
            ok = F.lit(True)
            if kw.get("min") is not None:
                ok = ok & (obs >= kw["min"])
            if kw.get("max") is not None:
                ok = ok & (obs <= kw["max"])
            succ = F.coalesce(ok, F.lit(False))
            elem, unexp = F.col("_rows"), F.lit(None).cast("long")
        else:
            mostly = float(kw.get("mostly", 1.0))
            succ = F.coalesce(unexp <= (1 - mostly) * elem + 1e-9, F.lit(True)) if mostly < 1 else (unexp == 0)
        rows.append(F.struct(F.lit(e.kind).alias("expectation"), F.lit(e.column).alias("column"),
                             elem.cast("long").alias("element_count"), unexp.cast("long").alias("unexpected_count"),
                             rnd(safe_div(unexp, elem) * 100).alias("unexpected_percent"),
                             rnd(obs if obs is not None else F.lit(None)).alias("observed_value"),
                             succ.alias("success")))
    wide = df.agg(*aggs)
    if distinct:
        extra.append(distinct_counts(df, distinct))
    for x in extra:
        wide = wide.withColumn("_k", F.lit(1)).join(x.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def suite_result(results: DataFrame) -> DataFrame:
    """success, success percent and issue count of a suite run."""
    return results.agg(
        F.coalesce(F.bool_and("success"), F.lit(True)).alias("success"),
        rnd(F.coalesce(F.avg(F.col("success").cast("double")) * 100, F.lit(100.0))).alias("success_percent"),
        F.count(F.lit(1)).cast("long").alias("evaluated"),
        F.count_if(~F.col("success")).cast("long").alias("issues"))


# ------------------------------------------------------------------ schema
FAMILIES = {
    # friendly names and Spark names -> type family
    "int": "integer", "integer": "integer", "bigint": "integer", "long": "integer", "smallint": "integer",
    "tinyint": "integer", "int64": "integer", "int32": "integer",
    "float": "float", "double": "float", "float64": "float", "float32": "float", "decimal": "float",
    "str": "string", "string": "string", "object": "string", "category": "string",
    "bool": "boolean", "boolean": "boolean",
    "datetime": "datetime", "timestamp": "datetime", "timestamp_ntz": "datetime", "date": "datetime",
    "datetime64": "datetime", "datetime64[ns]": "datetime",
}


def type_family(dt: T.DataType | str) -> str:
    if isinstance(dt, T.DataType):
        if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return "integer"
        if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
            return "float"
        if isinstance(dt, T.StringType):
            return "string"
        if isinstance(dt, T.BooleanType):
            return "boolean"
        if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return "datetime"
        return dt.simpleString()
    return FAMILIES.get(dt.lower().split("(")[0], dt.lower())


def compatible(actual: T.DataType, declared: str) -> bool:
    a, d = type_family(actual), type_family(declared)
    return a == d or (d == "float" and a == "integer")


@dataclass
class DatasetSchema:
    columns: dict[str, str]
    primary_keys: list[str] = field(default_factory=list)
    required_columns: list[str] = field(default_factory=list)
    constraints: dict[str, dict] = field(default_factory=dict)


def schema_violations(df: DataFrame, schema: DatasetSchema) -> DataFrame:
    """One row per violation kind and column with its count: missing
    required columns and type mismatches (from ``df.schema``), duplicate
    primary keys, not-null / unique / range constraint violations (from
    the data, one aggregate + one grouping per key set)."""
    spark = df.sparkSession
    actual = {f.name: f.dataType for f in df.schema.fields}
    lit_rows = []
    for c in schema.required_columns:
        if c not in actual:
            lit_rows.append(("missing_column", c, 1))
    for c, t in schema.columns.items():
        if c in actual and not compatible(actual[c], t):
            lit_rows.append(("type_mismatch", c, 1))
    out = spark.createDataFrame(lit_rows, "kind string, column string, n long")
    aggs, names = [], []
    for c, cons in schema.constraints.items():
        if c not in actual:
            continue
        if cons.get("not_null"):
            aggs.append(F.count_if(missing(df, c)).alias(f"not_null__{c}"))
            names.append(("not_null", c))
        if cons.get("min") is not None or cons.get("max") is not None:
            bad = F.lit(False)
            if cons.get("min") is not None:
                bad = bad | (F.col(c) < cons["min"])
            if cons.get("max") is not None:
                bad = bad | (F.col(c) > cons["max"])
            aggs.append(F.count_if(~missing(df, c) & bad).alias(f"range__{c}"))
            names.append(("range", c))
    if aggs:
        w = df.agg(*aggs)
        st = [F.struct(F.lit(k).alias("kind"), F.lit(c).alias("column"), F.col(f"{k}__{c}").cast("long").alias("n"))
              for k, c in names]
        out = out.unionByName(w.select(F.explode(F.array(*st)).alias("s")).select("s.*"))
    groups = []
    pk = [c for c in schema.primary_keys if c in actual]
    if pk:
        groups.append(("primary_key", ",".join(pk), pk))
    for c, cons in schema.constraints.items():
        if cons.get("unique") and c in actual:
            groups.append(("unique", c, [c]))
    for kind, label, keys in groups:
        g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        out = out.unionByName(g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("n"))
                              .select(F.lit(kind).alias("kind"), F.lit(label).alias("column"), "n"))
    return out.filter(F.col("n") > 0)


def schema_report(violations: DataFrame) -> DataFrame:
    """valid flag, violation count and the list of violations."""
    return violations.agg(
        (F.count(F.lit(1)) == 0).alias("valid"),
        F.count(F.lit(1)).cast("long").alias("n_violations"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_bad_values"),
        F.concat_ws(";", F.sort_array(F.collect_list(F.concat_ws(":", "kind", "column")))).alias("violations"))

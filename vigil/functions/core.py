"""Column-level building blocks shared by all operators."""

from __future__ import annotations

import datetime as _dt
import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)

EPOCH = _dt.datetime(1970, 1, 1)
ROUND = 9


def col_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(col_type(df, name), NUMERIC_TYPES)


def is_float(df: DataFrame, name: str) -> bool:
    return isinstance(col_type(df, name), FLOAT_TYPES)


def is_time(df: DataFrame, name: str) -> bool:
    return isinstance(col_type(df, name), TIME_TYPES)


def is_string(df: DataFrame, name: str) -> bool:
    return isinstance(col_type(df, name), T.StringType)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in ex]


def missing(df: DataFrame, name: str) -> Column:
    """pandas ``isna`` semantics: null, and NaN for floating columns."""
    c = F.col(name)
    if is_float(df, name):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def present(df: DataFrame, name: str) -> Column:
    return ~missing(df, name)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null when b is 0 (ANSI-safe)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def rnd(c: Column, digits: int = ROUND) -> Column:
    return F.round(c.cast("double"), digits)


def _epoch_ntz() -> Column:
    # built from text: a Python datetime literal would pass through the
    # session time zone on its way to TIMESTAMP_NTZ
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def ntz_seconds(c: Column | str) -> Column:
    """Whole seconds since 1970-01-01 of a naive timestamp, independent of the
    session time zone."""
    return F.timestamp_diff("SECOND", _epoch_ntz(), F.col(c) if isinstance(c, str) else c)


def ntz_micros(c: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", _epoch_ntz(), F.col(c) if isinstance(c, str) else c)


def ntz_to_instant(c: Column | str) -> Column:
    """Read a naive timestamp as UTC and return a TIMESTAMP (instant); needed
    for watermarks, which reject TIMESTAMP_NTZ."""
    return F.timestamp_micros(ntz_micros(c))


def instant_to_ntz(c: Column | str) -> Column:
    cc = F.col(c) if isinstance(c, str) else c
    return F.timestamp_add("MICROSECOND", F.unix_micros(cc), _epoch_ntz())


def ts_lit(value: str | _dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal, independent of the session time zone."""
    if isinstance(value, str):
        value = _dt.datetime.fromisoformat(value)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def long_form(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = (),
              name_col: str = "feature", value_col: str = "value",
              cast: str = "double") -> DataFrame:
    """Unpivot ``columns`` to (ids..., feature, value) with a common type."""
    if not columns:
        raise ValueError("no columns to unpivot")
    sel = [F.col(i) for i in ids] + [F.col(c).cast(cast).alias(c) for c in columns]
    return df.select(*sel).unpivot(list(ids), list(columns), name_col, value_col)


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Every row of ``df`` with the columns of the one-row table ``row`` (a
    keyed join on a constant, so no cartesian product is planned)."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(row.withColumn("_one", F.lit(1))), "_one").drop("_one")


def materialised(small: DataFrame) -> DataFrame:
    """A derived table (edges, brackets, per-segment statistics) computed once
    and kept in the shared checkpoint folder.  Its size is known when it is
    joined, so the engine's own limits decide between broadcast and shuffle;
    no row passes the driver."""
    from vigil.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(small.sparkSession)
    return small.checkpoint()


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The rows with their position (0-based, in partition and row order) as
    column ``name``: positions in a partition plus the sizes of the partitions
    before it (one row per partition is summed up).  The rows are kept in the
    checkpoint folder, so the order that was numbered is the one returned."""
    x = materialised(df.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33).alias("_part")
    per = x.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = per.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return x.withColumn("_part", part).join(first, "_part").select(
        (F.col("_first") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).alias(name), *[F.col(f"`{c}`") for c in df.columns])


def check_unique_columns(df: DataFrame) -> None:
    seen, dup = set(), []
    for c in df.columns:
        if c in seen:
            dup.append(c)
        seen.add(c)
    if dup:
        raise ValueError(f"duplicate column names: {sorted(set(dup))}")


# ---------------------------------------------------------------------------
# Ordered cumulative counts without a single-partition window.
# ---------------------------------------------------------------------------

def cell(columns: Sequence[str]) -> Column:
    """The columns as one struct: a join or window key that is never null, in
    which null parts equal each other."""
    return F.struct(*[F.col(c) for c in columns]) if columns else F.struct(F.lit(0).alias("all"))


def cumulative(counts: DataFrame, keys: Sequence[str], order_col: str, sum_cols: Sequence[str],
               ranges: int | None = None) -> DataFrame:
    """Running sums of ``sum_cols`` ordered by ``order_col`` within ``keys``
    (null keys are a group of their own).

    ``counts`` should hold one row per (keys, order value) — e.g. the output
    of a ``groupBy(keys, value).count()`` — so a hot value is one row.  A
    plain ``Window.partitionBy(keys)`` would put each key's rows into one
    task; instead the rows are range-partitioned by (keys, order value) and kept
    in the checkpoint folder, so a large key spans as many ranges as its size
    asks for (``ranges`` in all, by default the engine's choice from the
    data's size).  The sums of each (key, range) are prefix-summed — a key's
    rows there are the ranges it spans — and joined back as offsets, and the window
    runs per (key, range).  Output columns: all input columns, ``cum_<c>``
    (running sum including the row) and ``tot_<c>`` (the key's total)."""
    by = [F.col("_cell"), F.col(order_col)]
    x = counts.withColumn("_cell", cell(list(keys)))
    x = x.repartitionByRange(ranges, *by) if ranges else x.repartitionByRange(*by)
    x = materialised(x.withColumn("_range", F.spark_partition_id()))
    part = x.groupBy("_cell", "_range").agg(*[F.sum(c).alias(f"_s_{c}") for c in sum_cols])
    key = Window.partitionBy("_cell")
    before = key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part.select("_cell", "_range",
                          *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sum_cols],
                          *[F.sum(f"_s_{c}").over(key).alias(f"tot_{c}") for c in sum_cols])
    w = Window.partitionBy("_cell", "_range").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    return x.join(offsets, ["_cell", "_range"]).select(
        *[F.col(c) for c in counts.columns],
        *[(F.sum(c).over(w) + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in sum_cols],
        *[F.col(f"tot_{c}") for c in sum_cols])


def distinct_counts(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """One row with the exact number of distinct values of each named
    expression, nulls left out.

    Every value becomes (column number, 128 bits of hash): grouping those
    combines repeats before the shuffle and spreads any column over all tasks,
    and a second, tiny aggregate counts the groups.  Several ``count(DISTINCT)``
    in one aggregate would copy whole rows once a column instead.  Two values
    are taken for one only if both 64-bit hashes agree."""
    names = list(columns)
    if not names:
        return df.sparkSession.range(1).select()
    values = df.select(*[columns[n].alias(f"v{i}") for i, n in enumerate(names)])
    each = []
    for i, field in enumerate(values.schema.fields):
        v = F.col(field.name)
        if isinstance(field.dataType, FLOAT_TYPES):
            v = F.when(v == 0, F.lit(0.0).cast(field.dataType)).otherwise(v)  # -0.0 is 0.0
        each.append(F.when(F.col(field.name).isNotNull(), F.struct(F.lit(i).alias("i"), F.xxhash64(v).alias("h1"),
                                                                   F.xxhash64(F.lit(i + 1), v).alias("h2"))))
    groups = values.select(F.explode(F.array_compact(F.array(*each))).alias("x")).groupBy("x.i", "x.h1", "x.h2").agg(F.lit(1).alias("one"))
    return groups.agg(*[F.count_if(F.col("i") == i).alias(n) for i, n in enumerate(names)])


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row ``_dups``: rows beyond the first occurrence of each distinct
    row (nulls equal, as pandas ``duplicated``).

    First pass groups only a 64-bit hash of the row (8 bytes per row cross
    the shuffle, not the row); rows whose hash occurs once cannot be
    duplicates.  Only rows of repeated hashes are grouped again on all
    columns, which settles hash collisions exactly."""
    cols = df.columns
    # grouping treats -0.0 and 0.0 (and all NaNs) as equal: hash them alike
    hk = [F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c)) if is_float(df, c) else F.col(c) for c in cols]
    h = df.select("*", F.xxhash64(*hk).alias("_h"))
    rep = h.groupBy("_h").agg(F.count(F.lit(1)).alias("_hn")).filter(F.col("_hn") > 1).select("_h")
    cand = h.join(rep, "_h", "left_semi").drop("_h")
    return cand.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")) \
        .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("_dups"))


def value_counts(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., feature, value, n): multiplicity of every non-missing value
    of every column, as doubles.  Map-side partial aggregation collapses
    repeated values before the shuffle."""
    lf = long_form(df, columns, keys)
    lf = lf.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return lf.groupBy(*keys, "feature", "value").agg(F.count(F.lit(1)).alias("n"))


def quantiles_from_counts(counts: DataFrame, probs: Sequence[float], keys: Sequence[str] = (),
                          ranges: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles (numpy/pandas default, DuckDB
    ``quantile_cont``) from :func:`value_counts` output.

    Scales past the memory of one task: distinct values are ranked with
    :func:`cumulative` and the two order statistics around each position are
    picked by a rank-range filter in the same pass, then one small grouping.
    Returns (keys..., feature, p, q).
    """
    keys = list(keys)
    jk = keys + ["feature"]
    cum = cumulative(counts, jk, "value", ["n"], ranges)
    # a distinct value covers ranks [cum_n - n, cum_n - 1] of its feature
    rng = cum.select(*jk, "value", (F.col("cum_n") - F.col("n")).alias("r0"),
                     (F.col("cum_n") - 1).alias("r1"), F.col("tot_n").alias("total"))
    ps = F.array(*[F.lit(float(p)) for p in probs])
    # each value row is tested against every requested position in one
    # pass; only the (at most 2 per position) covering rows survive
    x = rng.select(*jk, "value", "r0", "r1", "total", F.explode(ps).alias("p"))
    x = x.withColumn("h", (F.col("total") - 1) * F.col("p"))
    lo, hi = F.floor("h"), F.ceil("h")
    x = x.filter(((F.col("r0") <= lo) & (F.col("r1") >= lo)) | ((F.col("r0") <= hi) & (F.col("r1") >= hi)))
    g = x.groupBy(*jk, "p").agg(
        F.max(F.when((F.col("r0") <= lo) & (F.col("r1") >= lo), F.col("value"))).alias("v_lo"),
        F.max(F.when((F.col("r0") <= hi) & (F.col("r1") >= hi), F.col("value"))).alias("v_hi"),
        F.first("h").alias("h"))
    return g.select(*jk, "p", (F.col("v_lo") + (F.col("h") - F.floor("h")) * (F.col("v_hi") - F.col("v_lo"))).alias("q"))


#: Values that a bracket holds at most when its quantile is picked.
BRACKET_ROWS = 100_000


def _table_quantiles(df: DataFrame, columns: Sequence[str], ps: list[float], accuracy: int, margin: float, most: int) -> DataFrame:
    """:func:`exact_quantiles` of whole columns, by distributed selection.

    A bracket [lo, hi] per column and probability is verified by counting the
    values below and inside it, and narrowed by a sketch of the values inside
    until it holds at most ``most`` of them (or one value alone): a round
    leaves some 1 / 1000 of them, so a trillion rows take three.  Brackets are
    literals of wide aggregates; only the values of the last ones leave their
    row.  A bracket that misses its ranks or stops halving is given up, and its
    quantile comes from the full ranking in ranges."""
    spark = df.sparkSession
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("p", T.DoubleType()), T.StructField("q", T.DoubleType())])
    x = [F.when(present(df, c), F.col(c).cast("double")) for c in columns]
    eps = margin / accuracy

    def around(rank: float, n: int) -> list[float]:
        return [min(1.0, max(0.0, rank / max(1, n - 1) + d)) for d in (-eps, eps)]

    first = df.agg(*[e for i in range(len(columns)) for e in (
        F.count(x[i]).alias(f"n{i}"),
        F.percentile_approx(x[i], [b for p in ps for b in (max(0.0, p - eps), min(1.0, p + eps))], accuracy).alias(f"b{i}"))]).first()
    cells = {}  # (feature number, p): bracket, target position, values below and inside
    for i in range(len(columns)):
        for j, p in enumerate(ps):
            if first[f"n{i}"]:
                lo, hi = first[f"b{i}"][2 * j:2 * j + 2]
                cells[i, p] = {"lo": lo, "hi": hi, "h": (first[f"n{i}"] - 1) * p}
    if not cells:
        return spark.createDataFrame([], schema)
    todo, left_over = list(cells), set()
    while todo:
        got = df.agg(*[e for k, c in enumerate(todo) for e in (
            F.count_if(x[c[0]] < cells[c]["lo"]).alias(f"b{k}"), F.count_if(x[c[0]].between(cells[c]["lo"], cells[c]["hi"])).alias(f"i{k}"))]).first()
        wide = []
        for k, c in enumerate(todo):
            below, inside = got[f"b{k}"], got[f"i{k}"]
            held = below <= math.floor(cells[c]["h"]) and math.ceil(cells[c]["h"]) < below + inside
            if not held or 2 * inside > cells[c].get("inside", math.inf):
                left_over.add(c)  # the sketch missed, or the values inside are too alike to part: ranked below
                continue
            cells[c].update(below=below, inside=inside)
            if inside > most and cells[c]["lo"] < cells[c]["hi"]:
                wide.append(c)
        if not wide:
            break
        got = df.agg(*[F.percentile_approx(F.when(x[c[0]].between(cells[c]["lo"], cells[c]["hi"]), x[c[0]]),
                                           around(cells[c]["h"] - cells[c]["below"], cells[c]["inside"]), accuracy).alias(f"b{k}")
                       for k, c in enumerate(wide)]).first()
        for k, c in enumerate(wide):
            cells[c].update(lo=got[f"b{k}"][0], hi=got[f"b{k}"][1])
        todo = wide
    full = None
    if left_over:
        names = [columns[i] for i in sorted({i for i, _ in left_over})]
        full = quantiles_from_counts(value_counts(df, names), ps).select("feature", F.col("p").cast("double"), "q")
        full = full.join(F.broadcast(spark.createDataFrame([(columns[i], p) for i, p in left_over], "feature string, p double")), ["feature", "p"], "left_semi")
        for c in left_over:
            del cells[c]
        if not cells:
            return full
    order = list(cells)
    inside = F.array(*[F.when(x[c[0]].between(cells[c]["lo"], cells[c]["hi"]), F.struct(F.lit(k).alias("k"), x[c[0]].alias("v")))
                       for k, c in enumerate(order)])
    each = df.select(F.explode(F.array_compact(inside)).alias("x")).groupBy("x.k", "x.v").agg(F.count(F.lit(1)).alias("c"))

    def by_cell(values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("k") + 1)

    w = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)  # at most `most` values a bracket
    low, high = by_cell([math.floor(cells[c]["h"]) for c in order]), by_cell([math.ceil(cells[c]["h"]) for c in order])
    upto = by_cell([cells[c]["below"] for c in order]) + F.col("cum") - 1
    since = upto - F.col("c") + 1
    got = {r["k"]: r for r in each.withColumn("cum", F.sum("c").over(w)).groupBy("k").agg(
        F.max(F.when((since <= low) & (upto >= low), F.col("v"))).alias("lo"),
        F.max(F.when((since <= high) & (upto >= high), F.col("v"))).alias("hi")).collect()}
    out = spark.createDataFrame([(columns[c[0]], c[1], got[k]["lo"] + (cells[c]["h"] - math.floor(cells[c]["h"])) * (got[k]["hi"] - got[k]["lo"]))
                                 for k, c in enumerate(order)], schema)
    return out if full is None else out.unionByName(full)


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    keys: Sequence[str] = (), accuracy: int = 10000, margin: float = 4.0,
                    ranges: int | None = None, most: int = BRACKET_ROWS) -> DataFrame:
    """Exact linear-interpolated quantiles (numpy/pandas default, DuckDB
    ``quantile_cont``) of several columns as doubles, missing values dropped:
    (keys..., feature, p, q).  A column or group without values has no row;
    null keys are a group like any other.

    Whole columns are selected by narrowing brackets
    (:func:`_table_quantiles`): two scans for up to some 10^8 rows, one more
    for each further factor of 1000, and a result of one row per (feature, p).
    With ``keys`` the distinct values are ranked in ranges
    (:func:`quantiles_from_counts`), so a group of any size spreads over many tasks;
    that result is an ordinary table, of as many rows as there are groups."""
    ps = [float(p) for p in probs]
    if not keys:
        return _table_quantiles(df, columns, ps, accuracy, margin, most)
    keys = list(keys)
    return quantiles_from_counts(value_counts(df, columns, keys), ps, keys, ranges).select(*keys, "feature", F.col("p").cast("double"), "q")


def top_k(counts: DataFrame, group: Sequence[str], k: int, order: Sequence[Column],
          salt_col: str, salts: int = 16) -> DataFrame:
    """Top-k rows per group without pulling a whole group into one task:
    rank inside (group, hash(salt_col) mod salts) first, keep k per slice,
    then rank the k x salts survivors per group.  Adds column ``rank``."""
    g = list(group)
    sl = counts.withColumn("_s", F.pmod(F.xxhash64(F.col(salt_col)), F.lit(salts)))
    w1 = Window.partitionBy(*g, "_s").orderBy(*order)
    pre = sl.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k).drop("_r", "_s")
    w2 = Window.partitionBy(*g).orderBy(*order)
    return pre.withColumn("rank", F.row_number().over(w2).cast("long")).filter(F.col("rank") <= k)

"""Mergeable sketches of a column: frequencies, heavy hitters, membership.

Each is a small table keyed by slice (a day, a partition), so sketches of
slices merge by grouping their rows again, and a report over any span reads
sketch rows instead of data.  Values are counted per (slice, value) first,
so a value that holds a third of the rows reaches a sketch as one row.

* Count-min: ``depth`` rows of ``width`` counters; an estimate is never below the
  true count and exceeds it by at most ``e / width`` of the slice's rows, with
  probability ``1 - exp(-depth)``.
* Heavy hitters: every value above ``1 / capacity`` of the rows is found; its
  estimated count is off by at most that share.
* Membership: a Bloom filter of ``blocks`` bitmaps of 32,768 bits: no false
  negatives, and false positives at ``(1 - exp(-hashes * n / bits)) ** hashes``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.core import cell

#: Bits of one bitmap row (the engine's bitmap functions).
BITMAP_BITS = 32_768


def _counts(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """(by, value, n) of the values that are not null."""
    return df.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def _slot(value: Column, row: Column | int, width: int) -> Column:
    seed = F.lit(row) if isinstance(row, int) else row
    return F.pmod(F.xxhash64(seed.cast("long"), value), F.lit(width)).cast("int")


# --- frequencies ------------------------------------------------------------------

def count_min(df: DataFrame, column: str, by: Sequence[str] = (), width: int = 2048, depth: int = 5) -> DataFrame:
    """(by, row, slot, n): the counters that are not 0, at most ``width *
    depth`` rows a slice, and row -1 with the slice's number of values."""
    values = _counts(df, column, by)
    rows = F.explode(F.sequence(F.lit(-1), F.lit(depth - 1))).alias("row")
    slots = values.select(*by, "value", "n", rows)
    slot = F.when(F.col("row") < 0, 0).otherwise(_slot(F.col("value"), F.col("row"), width))
    return slots.groupBy(*by, "row", slot.alias("slot")).agg(F.sum("n").alias("n"))


def merge_count_min(sketch: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of slices summed up per ``by`` (fewer columns than before)."""
    return sketch.groupBy(*by, "row", "slot").agg(F.sum("n").alias("n"))


def frequencies(probes: DataFrame, column: str, sketch: DataFrame, by: Sequence[str] = (), width: int = 2048, depth: int = 5) -> DataFrame:
    """(by, value, estimate, bound) of each distinct probe value in each slice:
    the least of its counters (0 where one is empty), and the most the estimate
    exceeds the truth by, with probability 1 - exp(-depth).  Null probes are
    left out."""
    rows = F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("row")
    asked = probes.select(F.col(column).alias("value")).filter("value IS NOT NULL").distinct().select("value", rows)
    asked = asked.withColumn("slot", _slot(F.col("value"), F.col("row"), width))
    totals = sketch.filter("row = -1").select(cell(by).alias("_cell"), *by, F.col("n").alias("_total"))
    hits = asked.join(sketch.filter("row >= 0").select(cell(by).alias("_cell"), "row", "slot", "n"), ["row", "slot"]) \
        .groupBy("_cell", "value").agg(F.min("n").alias("_least"), F.count(F.lit(1)).alias("_rows"))
    found = totals.join(hits, "_cell").filter(F.col("_rows") == depth)
    return found.select(*by, "value", F.col("_least").alias("estimate"), F.ceil(F.col("_total") * F.lit(math.e / width)).alias("bound"))


# --- heavy hitters ------------------------------------------------------------------

def top_items(df: DataFrame, column: str, by: Sequence[str] = (), capacity: int = 1024) -> DataFrame:
    """(by, top): the state of a frequent-items sketch a slice; nulls count as
    an item."""
    return df.groupBy(*by).agg(F.expr(f"approx_top_k_accumulate(`{column}`, {int(capacity)})").alias("top"))


def merge_top_items(sketch: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, rank, value, estimate): the ``k`` most frequent items over the
    slices of each ``by`` (ties by value)."""
    merged = sketch.groupBy(*by).agg(F.expr("approx_top_k_combine(top)").alias("top"))
    items = merged.select(*by, F.expr(f"approx_top_k_estimate(top, {int(k)})").alias("items"))
    order = F.transform("items", lambda i: F.struct((-i["count"]).alias("c"), i["item"].alias("v")))
    return items.select(*by, F.posexplode(F.array_sort(order)).alias("rank", "x")) \
        .select(*by, (F.col("rank") + 1).alias("rank"), F.col("x.v").alias("value"), (-F.col("x.c")).alias("estimate"))


# --- membership -----------------------------------------------------------------------

def bloom(df: DataFrame, column: str, by: Sequence[str] = (), blocks: int = 4, hashes: int = 4) -> DataFrame:
    """(by, block, bits): the filter's bitmaps that are not empty, at most
    ``blocks`` rows a slice."""
    bits = blocks * BITMAP_BITS
    seeds = F.explode(F.sequence(F.lit(0), F.lit(hashes - 1))).alias("seed")
    spots = _counts(df, column, by).select(*by, "value", seeds).select(*by, _slot(F.col("value"), F.col("seed"), bits).cast("long").alias("spot")).distinct()
    return spots.groupBy(*by, F.floor(F.col("spot") / BITMAP_BITS).cast("int").alias("block")) \
        .agg(F.bitmap_construct_agg(F.col("spot") % BITMAP_BITS).alias("bits"))


def merge_bloom(sketch: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Filters of slices united per ``by``."""
    return sketch.groupBy(*by, "block").agg(F.bitmap_or_agg("bits").alias("bits"))


def members(probes: DataFrame, column: str, sketch: DataFrame, by: Sequence[str] = (), blocks: int = 4, hashes: int = 4) -> DataFrame:
    """(by, value) of the distinct probe values that a slice's filter may hold:
    all that it does hold, and few others."""
    bits = blocks * BITMAP_BITS
    seeds = F.explode(F.sequence(F.lit(0), F.lit(hashes - 1))).alias("seed")
    asked = probes.select(F.col(column).alias("value")).filter("value IS NOT NULL").distinct().select("value", seeds)
    spot = _slot(F.col("value"), F.col("seed"), bits)
    asked = asked.withColumn("block", F.floor(spot / BITMAP_BITS).cast("int")).withColumn("bit", F.pmod(spot, F.lit(BITMAP_BITS)))
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.pow(F.lit(2), F.col("bit") % 8).cast("int")) != 0
    hits = asked.join(sketch, "block").filter(hit).groupBy(*by, "value").agg(F.count(F.lit(1)).alias("_hits"))
    return hits.filter(F.col("_hits") == hashes).select(*by, "value")


def false_positive_rate(n: int, blocks: int = 4, hashes: int = 4) -> float:
    """What :func:`members` errs by after ``n`` distinct values."""
    return (1 - math.exp(-hashes * n / (blocks * BITMAP_BITS))) ** hashes

"""Conversation / trace analytics (§2.14): timelines, token totals and
deterministic response checks.  LLM-as-judge evaluation is not built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.core import rnd, safe_div


def tokens(text: Column) -> Column:
    """Whitespace tokens of a text (empty pieces dropped)."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def timeline(turns: DataFrame, trace: str = "conv_id", step: str = "turn") -> DataFrame:
    """Steps of each trace in order with the previous step's role and the
    running token count."""
    w = Window.partitionBy(trace).orderBy(step)
    t = turns.withColumn("n_tokens", token_count(F.col("text")))
    return t.select(trace, step, "role", "n_tokens", F.lag("role").over(w).alias("prev_role"),
                    F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum_tokens"))


def totals(turns: DataFrame, trace: str = "conv_id") -> DataFrame:
    """Per trace: turns, tokens in total and by role, empty responses."""
    t = turns.withColumn("_n", token_count(F.col("text")))
    r = F.col("role")
    return t.groupBy(trace).agg(
        F.count(F.lit(1)).cast("long").alias("n_turns"), F.sum("_n").cast("long").alias("n_tokens"),
        F.coalesce(F.sum(F.when(r == "user", F.col("_n"))), F.lit(0)).cast("long").alias("user_tokens"),
        F.coalesce(F.sum(F.when(r == "assistant", F.col("_n"))), F.lit(0)).cast("long").alias("assistant_tokens"),
        F.count_if((r == "assistant") & (F.col("_n") == 0)).cast("long").alias("n_empty_responses"))


def response_checks(turns: DataFrame, trace: str = "conv_id", step: str = "turn") -> DataFrame:
    """Each assistant turn against the latest user turn before it: length
    ratio and the share of the response's distinct lower-cased tokens that
    also occur in the prompt."""
    w = Window.partitionBy(trace).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    t = turns.withColumn("_prompt", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w))
    a = t.filter((F.col("role") == "assistant") & F.col("_prompt").isNotNull())
    rt = F.array_distinct(tokens(F.lower("text")))
    pt = F.array_distinct(tokens(F.lower("_prompt")))
    return a.select(trace, step, token_count(F.col("text")).alias("response_tokens"),
                    token_count(F.col("_prompt")).alias("prompt_tokens"),
                    rnd(safe_div(token_count(F.col("text")), token_count(F.col("_prompt")))).alias("length_ratio"),
                    rnd(safe_div(F.size(F.array_intersect(rt, pt)), F.size(rt))).alias("overlap"))

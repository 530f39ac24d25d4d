"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import ensure_checkpoint_dir

#: Words are maximal runs of other characters than these (Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared checkpoint folder:
    later stages, and retries after a lost executor, read the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def whole(text: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def utf8(text: str = "text") -> Column:
    """The text as UTF-8 bytes, null read as empty."""
    return whole(text).cast("binary")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]):
    """An object of a Python worker (a vocabulary, its caches) that later
    tasks use again; a worker holds one at a time."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Free what :func:`held` keeps: workers outlive stages, and the next
    stage should not find its memory taken."""
    if _HELD:
        _HELD.clear()
        gc.collect()

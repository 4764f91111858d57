"""Assertions that run as one action and tell how many rows fail, with examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assert_empty(df: DataFrame, message: str, examples: int = 3) -> None:
    found = df.limit(examples).collect()
    if found:
        raise ValueError(f"{message}: {df.count()} rows, such as {[r.asDict() for r in found]}")


def assert_unique(df: DataFrame, *keys: str) -> None:
    assert_empty(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), f"{', '.join(keys)} must be unique")


def coverage(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has, "missing" or "extra"."""
    a, b = expected.select(key).distinct(), found.select(key).distinct()
    return a.join(b, key, "left_anti").select(key, F.lit("missing").alias("side")).union(b.join(a, key, "left_anti").select(key, F.lit("extra")))

"""Dedup, conflicts and split policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPLITS = ("test", "validation", "train")  # by precedence


def split_rank(split: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SPLITS)), split)


def by_precedence(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Of a key's rows only those of its highest split stay: others are dropped, not moved.

    The keys' best splits are found by partial aggregation, so a key with a large share of the rows is no hot window.
    """
    best = df.groupBy(key).agg(F.min(split_rank(F.col(split))).alias("_best"))
    return df.join(best, key).filter(split_rank(F.col(split)) == F.col("_best")).drop("_best")


def winners(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_no", F.row_number().over(w)).filter("_no = 1").drop("_no")


def without_conflicts(df: DataFrame, key: str, label: str, order: list[str]) -> DataFrame:
    """Keys with two labels lose all their rows; other keys keep their first row."""
    one = df.groupBy(key).agg(F.min(label).alias("_a"), F.max(label).alias("_b")).filter(F.col("_a").eqNullSafe(F.col("_b"))).select(key)
    return winners(df.join(one, key, "left_semi"), [key], order)


def in_one_split(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Rows of keys that only one split holds."""
    one = df.groupBy(key).agg(F.min(split).alias("_a"), F.max(split).alias("_b")).filter("_a = _b").select(key)
    return df.join(one, key, "left_semi")


def audit(df: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """For each key column: rows, distinct keys, repeated rows, and keys that more than one split holds."""
    out = None
    for k in keys:
        by_key = df.groupBy(k).agg(F.count(F.lit(1)).alias("n"), F.min(split).alias("a"), F.max(split).alias("b"))
        one = by_key.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum(F.when(F.col("a") != F.col("b"), 1).otherwise(0)), F.lit(0)).alias("n_shared"))
        one = one.select(F.lit(k).alias("key"), "n_rows", "n_keys", (F.col("n_rows") - F.col("n_keys")).alias("n_repeated"), "n_shared")
        out = one if out is None else out.union(one)
    return out


def matched_controls(df: DataFrame, split: str, key: str, label: str) -> DataFrame:
    """df with `matched`: whether the split holds the key with both labels."""
    seen = df.groupBy(split, key).agg(F.min(label).alias("_a"), F.max(label).alias("_b"))
    return df.join(seen, [split, key]).withColumn("matched", F.col("_a") != F.col("_b")).drop("_a", "_b")


def overlaps(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """(split_a, split_b, n): distinct keys that two splits share."""
    k = df.select(split, key).distinct().groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s")).filter("size(s) > 1")  # as many as there are splits
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("split_a"), b.alias("split_b")))))
    return k.select(F.explode(pairs).alias("p")).groupBy("p.split_a", "p.split_b").agg(F.count(F.lit(1)).alias("n"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], loaded: str) -> DataFrame:
    """The ledger after new rows: by key, the row loaded last."""
    w = Window.partitionBy(*key).orderBy(F.col(loaded).desc())
    return old.unionByName(new).withColumn("_no", F.row_number().over(w)).filter("_no = 1").drop("_no")


def known_rows(rows: DataFrame, known: DataFrame, cheap: list[str], fingerprint: Column, row_id: str) -> DataFrame:
    """Ids of rows that `known` holds as well: first those whose cheap key it has, then, of these alone, those whose
    fingerprint agrees. The fingerprint is worked out for the few that are left of either side.

    Fingerprints that `known` repeats are joined as they are: a hash table of distinct ones would hold all of a task's.
    """
    few = rows.join(known.select(*cheap).distinct(), cheap, "left_semi")
    other = known.join(rows.select(*cheap).distinct(), cheap, "left_semi").select(*cheap, fingerprint.alias("_f"))
    return few.withColumn("_f", fingerprint).join(other, [*cheap, "_f"], "left_semi").select(row_id)

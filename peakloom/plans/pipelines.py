"""Composite operators: corpora, benchmarks and splits from candidate rows. Each is a plan of the single operators, lazy unless it says that it stores a step."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.functions.vectors import hash_rank
from peakloom.operators import dedup, joins, metrics, sampling
from peakloom.operators.checks import assert_empty
from peakloom.operators.circle import negatives
from peakloom.plans.scratch import new_folder, stored


@dataclass(frozen=True)
class CorpusPlan:
    """Column names and bounds of a corpus build."""

    row_id: str
    key: str  # what may be in one split only
    label: str  # what rows of one key must agree on
    project: str
    run: str
    bucket: str
    gates: dict[str, str] = field(default_factory=dict)  # reason -> SQL condition that rejects
    bucket_limit: int = 1000
    project_limit: int = 1000
    run_limit: int = 100
    seed: str = "corpus"
    validation: float = 0.1
    test: float = 0.1


def judged(rows: DataFrame, gates: dict[str, str]) -> DataFrame:
    """rows with `reason`: the first gate that rejects a row, null if none does."""
    reason = F.lit(None).cast("string")
    for name, condition in reversed(gates.items()):
        reason = F.when(F.expr(condition), name).otherwise(reason)
    return rows.withColumn("reason", reason)


def reject_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def build_corpus(candidates: DataFrame, plan: CorpusPlan) -> DataFrame:
    """Gates, the first rows of each bucket, caps by project and run, no conflicting labels, one row and one split a key."""
    able = judged(candidates, plan.gates).filter("reason is null").drop("reason")
    able = able.withColumn("priority", hash_rank(plan.seed, F.col(plan.row_id)))
    few = sampling.first_by_group(able, [plan.bucket], [F.col("priority"), F.col(plan.row_id).desc()], plan.bucket_limit)
    kept = sampling.capped(few, plan.project, plan.run, ["priority", plan.row_id], plan.project_limit, plan.run_limit)
    agreed = dedup.without_conflicts(kept, plan.key, plan.label, ["priority", plan.row_id])
    return agreed.withColumn("split", sampling.hash_split(F.col(plan.key), plan.seed, plan.validation, plan.test))


def clean_splits(corpus: DataFrame, key: str, fingerprint: str, order: list[str]) -> DataFrame:
    """Keys stay in their highest split; then, among those, each fingerprint's first row stays."""
    return dedup.winners(dedup.by_precedence(corpus, key), [fingerprint], order)


def carve_validation(train: DataFrame, group: str, target: int, seed: str) -> DataFrame:
    """train with `split`: whole groups in hash order are validation until the target is reached."""
    chosen = sampling.until_target(train, [], group, target, seed).select(group, F.lit("validation").alias("_split"))
    return train.join(chosen, group, "left").withColumn("split", F.coalesce("_split", F.lit("train"))).drop("_split")


def retrieval_benchmark(rows: DataFrame, partition: str, label: str, row_id: str, labels: int, rows_each: int, seed: str, exclude: DataFrame | None = None) -> DataFrame:
    """Per partition some labels that two rows or more hold, and some rows of each; excluded labels are left out."""
    able = rows.join(exclude.select(label).distinct(), label, "left_anti") if exclude is not None else rows
    many = able.groupBy(partition, label).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return sampling.first_groups(able.join(many, [partition, label], "left_semi"), [partition], label, labels, rows_each, seed, row_id)


def pair_benchmark(rows: DataFrame, *, partition: str, row_id: str, label: str, mz: str, charge: str, ppm: float, per_label: int, seed: str) -> DataFrame:
    """(partition, pair_set, left_id, right_id, label, ppm): balanced pairs of three protocols.

    Positive pairs share a label, at most per_label of each, drawn from all of its pairs; "random" negatives are any other row of the
    partition, "charge" ones have the same charge (both the first of another label along a circle in hash order), "hard"
    ones also lie within ppm. A protocol has as many negatives as positives. Positives and each protocol's negatives are
    stored in the shared folder: balancing reads them more than once.
    """
    def negative(found: DataFrame, name: str, other: str) -> DataFrame:
        return stored(found.select(partition, F.lit(name).alias("pair_set"), F.col(row_id).alias("left_id"), F.col(other).alias("right_id"), F.lit(0).alias("label")), f"pairs-{name}")

    positive = stored(joins.pairs_in_groups(rows, [partition, label], row_id, seed, per_label).select(partition, "left_id", "right_id", F.lit(1).alias("label")), "pairs-positive")
    hard = negative(joins.ppm_first(rows, row_id=row_id, mz=mz, label=label, on=[partition, charge], ppm=ppm, seed=seed), "hard", "partner_id")
    around = [negative(negatives(rows, group, row_id, label, f"{seed} {name}"), name, "negative_id") for name, group in (("random", [partition]), ("charge", [partition, charge]))]
    sets = F.explode(F.array(*map(F.lit, ("random", "charge", "hard"))))
    every = reduce(DataFrame.union, around, positive.select(partition, sets.alias("pair_set"), "left_id", "right_id", "label")).union(hard)
    pairs = every.withColumn("pair_id", F.concat_ws("|", "pair_set", "left_id", "right_id"))
    chosen = sampling.balanced(pairs, [partition, "pair_set"], "label", "pair_id", seed)
    full = joins.endpoints(chosen, rows, row_id, [mz])
    off = F.abs(F.col(f"left_{mz}") - F.col(f"right_{mz}")) / ((F.col(f"left_{mz}") + F.col(f"right_{mz}")) / 2) * 1e6
    return full.select(partition, "pair_set", "left_id", "right_id", "label", off.alias("ppm"))


def charge_filtered(rows: DataFrame, pairs: DataFrame, row_id: str, condition: Column, balance_by: list[str], seed: str) -> tuple[DataFrame, DataFrame]:
    """(rows, pairs): pairs whose ends both meet the condition, balanced again, and the rows that they name."""
    able = joins.both_qualified(pairs, rows.filter(condition), row_id)
    kept = sampling.balanced(able.withColumn("pair_id", F.concat_ws("|", "left_id", "right_id")), balance_by, "label", "pair_id", seed).drop("pair_id")
    return joins.referenced(rows, kept, row_id), kept


def probe_split(rows: DataFrame, *, run: str, key: str, length: str, row_id: str, sizes: dict[str, int], seed: str) -> DataFrame:
    """rows with `split`: validation and test from whole runs, in this order, then train; each split's lengths as in rows.

    sizes: rows of "val", "test" and "train". Each has a quota of every length by largest remainder, met to the row; a
    quota that the rows can't meet stops the job. Validation and test take rows only of keys that a single run holds, by
    `sampling.quota_holdout`; what validation used, test can't use. Train takes the first rows in hash order of other
    runs and other keys. So no run, key or row is in two splits. Saves each step in the shared folder. Rows without a
    run, key or length take no part.
    """
    spark = rows.sparkSession

    def saved(df: DataFrame, name: str) -> DataFrame:
        path = new_folder(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    able = rows.filter(F.col(run).isNotNull() & F.col(key).isNotNull() & F.col(length).isNotNull())
    lengths = saved(able.groupBy(length).agg(F.count(F.lit(1)).alias("_n")), "lengths")
    # One run: its smallest and its largest name are the same.
    single = able.join(able.groupBy(key).agg(F.min(run).alias("_a"), F.max(run).alias("_z")).filter("_a = _z").select(key), key, "left_semi")
    used, parts = None, []

    def whole(chosen: DataFrame, quotas: DataFrame, split: str) -> DataFrame:
        short = quotas.join(chosen.groupBy(length).agg(F.count(F.lit(1)).alias("_got")), length, "left").filter(F.coalesce("_got", F.lit(0)) < F.col("quota"))
        assert_empty(short, f"too few rows for {split}")
        return chosen.withColumn("split", F.lit(split))

    for split in ("val", "test"):
        quotas = saved(sampling.largest_remainder(lengths, length, "_n", sizes[split]).select(length, "quota"), "quotas")
        chosen, runs = sampling.quota_holdout(single, quotas, used, run=run, length=length, row_id=row_id, seed=seed, split=split)
        chosen, runs = saved(chosen, split), saved(runs, "used")
        parts.append(whole(chosen, quotas, split))
        used = runs if used is None else used.union(runs)
    quotas = saved(sampling.largest_remainder(lengths, length, "_n", sizes["train"]).select(length, "quota"), "quotas")
    held = parts[0].select(key).union(parts[1].select(key)).distinct()
    rest = able.join(used, run, "left_anti").join(held, key, "left_anti")
    numbered = sampling.hash_numbers(rest, [length], hash_rank(seed, "train", F.col(row_id)), row_id).join(quotas.withColumnRenamed("quota", "_quota"), length)
    train = saved(numbered.filter(F.col("_no") <= F.col("_quota")).drop("_no", "_quota"), "train")
    parts.append(whole(train, quotas, "train"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def pooled_and_macro(pairs: DataFrame, pair_set: str, partition: str, distance: str, label: str) -> DataFrame:
    """(pair_set, scope, partition, metric, value): every metric of pairs in each partition, their "macro" mean over
    partitions where it is finite, and "pooled", ranked over all pairs of a set.

    Each pair counts in its partition's group and in the pooled one; all groups are ranked in the same running counts.
    Null partitions are one partition.
    """
    groups = F.array(F.struct(F.lit("partition").alias("scope"), F.col(partition).alias("part")), F.struct(F.lit("pooled").alias("scope"), F.lit(None).cast(pairs.schema[partition].dataType).alias("part")))
    each = pairs.select(F.col(pair_set).alias("_set"), F.explode(groups).alias("_g"), F.col(distance).alias("_distance"), F.col(label).alias("_label"))
    # Joins between the metrics' tables are by equality, which a null partition has not: groups go by a text of their own.
    each = each.withColumn("_key", F.to_json("_g", {"ignoreNullFields": "false"}))
    got = metrics.pair_report(each, ["_set", "_key"], "_distance", "_label")
    names = each.select("_key", "_g").distinct()
    long = got.join(names, "_key").select("_set", "_g.scope", "_g.part", "metric", "value")
    fine = long.filter((F.col("scope") == "partition") & F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    mean = fine.groupBy("_set", "metric").agg(F.avg("value").alias("value")).select("_set", F.lit("macro").alias("scope"), F.lit(None).cast(pairs.schema[partition].dataType).alias("part"), "metric", "value")
    return long.unionByName(mean).toDF(pair_set, "scope", partition, "metric", "value")

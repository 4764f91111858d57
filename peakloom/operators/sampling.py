"""Deterministic sampling: hash ranks, quotas, caps and balance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peakloom.functions.vectors import hash_fraction, hash_rank


#: Rows of a cut, about, and cuts at most: beyond their product cuts grow with the input.
CUT_ROWS, MOST_CUTS = 100_000, 1024
#: So many edges are compared one by one.
FEW_EDGES = 48


def cut_edges(df: DataFrame, column: str, buckets: int | None = None) -> list[float]:
    """Values of a numeric column that cut df into parts of about CUT_ROWS rows (or into `buckets`): no edge, one part."""
    many = min(MOST_CUTS, -(-df.count() // CUT_ROWS)) if buckets is None else buckets
    return sorted(set(df.approxQuantile(column, [k / many for k in range(1, many)], 0.25 / many))) if many > 1 else []


def place(edges: list[float] | Column, value: Column, equal: bool = False) -> Column:
    """How many of the ascending edges (a list, or an array column of less than two million) lie below the value, with
    `equal` at it as well; 0 for null.

    Few edges are counted, more are halved: the work for a row grows with the logarithm of the edges.
    """
    at = F.array(*map(F.lit, edges)) if isinstance(edges, list) else edges
    below = (lambda e: e <= value) if equal else (lambda e: e < value)
    if isinstance(edges, list) and len(edges) <= FEW_EDGES:
        return F.size(F.filter(at, below)) if edges else F.lit(0)
    top = len(edges).bit_length() - 1 if isinstance(edges, list) else 20
    steps = F.array(*(F.lit(1 << k) for k in range(top, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda got, step: F.when(below(F.get(at, got + step - 1)), got + step).otherwise(got))


def with_place(df: DataFrame, edges: list[float], value: str, into: str) -> DataFrame:
    """df with `into`: how many of the edges lie below the value. As the row of a generator, it is worked out once: grouping
    and windows refer to a column, not to the expression."""
    return df.select("*", F.explode(F.array(place(edges, F.col(value)))).alias(into)) if edges else df.withColumn(into, F.lit(0))


def first_by_group(df: DataFrame, group: list[str], order: list[Column], k: int | Column) -> DataFrame:
    """The first k rows of each group. Spark cuts each partition's groups to k rows before it shuffles them."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_no", F.row_number().over(w)).filter(F.col("_no") <= k).drop("_no")


def first_groups(df: DataFrame, partition: list[str], group: str, k: int, m: int, seed: str, row_id: str) -> DataFrame:
    """The k groups of smallest hash in each partition, and the m rows of smallest hash in each of those."""
    groups = first_by_group(df.select(*partition, group).distinct(), partition, [hash_rank(seed, "group", F.col(group)), F.col(group)], k)
    rows = df.join(groups, [*partition, group], "left_semi")
    return first_by_group(rows, [*partition, group], [hash_rank(seed, "row", F.col(row_id)), F.col(row_id)], m)


def hash_numbers(df: DataFrame, partition: list[str], rank: Column, row_id: str, total: str | None = None) -> DataFrame:
    """df with `_no`: each row's place (from 1) in its partition by (rank, id), rank being a hash in hex. total: column for the partition's count.

    A partition is cut at the hash's first three digits: each of the 4096 cuts is numbered on its own and starts from the
    count of those before it, so a label that half of all rows have is no single task.
    """
    cut = df.withColumn("_rank", rank).withColumn("_cut", F.substring("_rank", 1, 3))
    sizes = cut.groupBy(*partition, "_cut").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*partition).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum("_n").over(Window.partitionBy(*partition)).alias(total)] if total else []
    offsets = sizes.select(*partition, "_cut", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), *whole)
    own = F.row_number().over(Window.partitionBy(*partition, "_cut").orderBy("_rank", row_id))
    return cut.withColumn("_own", own).join(offsets, [*partition, "_cut"]).withColumn("_no", F.col("_before") + F.col("_own")).drop("_rank", "_cut", "_own", "_before")


def until_target(df: DataFrame, partition: list[str], group: str, target: int, seed: str) -> DataFrame:
    """Whole groups in hash order until their rows reach the target, the group that crosses it included: (partition, group, n).

    As a group has a row at least, only a partition's first `target` groups are summed up.
    """
    sizes = df.groupBy(*partition, group).agg(F.count(F.lit(1)).alias("n"))
    order = [hash_rank(seed, F.col(group)), F.col(group)]
    able = first_by_group(sizes, partition, order, target) if partition else sizes.orderBy(*order).limit(target)
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return able.withColumn("_sum", F.sum("n").over(w)).filter(F.col("_sum") - F.col("n") < target).drop("_sum")


def balanced(df: DataFrame, partition: list[str], label: str, row_id: str, seed: str, labels: int = 2) -> DataFrame:
    """As many rows of each label in every partition as its rarest label has; partitions without all labels go."""
    counts = df.groupBy(*partition, label).agg(F.count(F.lit(1)).alias("n"))
    least = counts.groupBy(*partition).agg(F.min("n").alias("_least"), F.count(F.lit(1)).alias("_labels")).filter(F.col("_labels") == labels).drop("_labels")
    numbered = hash_numbers(df, [*partition, label], hash_rank(seed, F.col(row_id)), row_id)
    joined = numbered.join(least, partition) if partition else numbered.join(F.broadcast(least))  # one row without partitions
    return joined.filter(F.col("_no") <= F.col("_least")).drop("_no", "_least")


def hash_split(row_id: Column, seed: str, validation: float, test: float) -> Column:
    """train, validation or test by the id's hash."""
    x = hash_fraction(hash_rank(seed, row_id))
    return F.when(x < test, "test").when(x < test + validation, "validation").otherwise("train")


def budgets(df: DataFrame, label: str, row_id: str, seed: str, shares: list[float]) -> DataFrame:
    """df with, for each share, whether a row is in that budget: nested, of floor(n * share) rows a label, one at least."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    out = hash_numbers(df, [label], hash_rank(seed, F.col(row_id)), row_id).join(sizes, label)
    for s in shares:
        out = out.withColumn(f"budget_{s:g}".replace(".", "p"), F.col("_no") <= F.greatest(F.lit(1), F.floor(F.col("_n") * s)))
    return out.drop("_no", "_n")


def largest_remainder(sizes: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """(key, n, quota): total dealt in proportion to n; what is left after rounding down goes to the largest fractions.

    sizes has one row a key, so one task holds as many rows as there are keys.
    """
    whole = sizes.withColumn("_share", F.col(n).cast("double") * total / F.sum(n).over(Window.partitionBy()))
    whole = whole.withColumn("_floor", F.floor("_share").cast("long"))
    rest = F.lit(total) - F.sum("_floor").over(Window.partitionBy())
    no = F.row_number().over(Window.orderBy((F.col("_share") - F.col("_floor")).desc(), F.col(n).desc(), F.col(key)))
    return whole.withColumn("quota", F.col("_floor") + F.when(no <= rest, 1).otherwise(0)).select(key, n, "quota")


def contiguous_shards(df: DataFrame, order: str, n: int) -> DataFrame:
    """df with `shard`: n runs of neighbouring rows, sizes one apart at most, larger ones first. Rows are numbered by part first."""
    numbered = row_numbers(df, order)
    total = numbered.count()
    small, more = divmod(total, n)
    cut = more * (small + 1)
    at = F.col("row_number")
    return numbered.withColumn("shard", F.when(at < cut, F.floor(at / (small + 1))).otherwise(more + F.floor((at - cut) / max(small, 1))).cast("int"))


def row_numbers(df: DataFrame, order: str, buckets: int | None = None) -> DataFrame:
    """df with `row_number` from 0 by a numeric column of distinct values, without one task that holds all rows."""
    edges = cut_edges(df, order, buckets)
    placed = with_place(df, edges, order, "_bucket")
    sizes = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = placed.withColumn("_no", F.row_number().over(Window.partitionBy("_bucket").orderBy(order)))
    return own.join(F.broadcast(before), "_bucket").withColumn("row_number", F.col("_before") + F.col("_no") - 1).drop("_bucket", "_before", "_no")


def capped(df: DataFrame, project: str, run: str, order: list[str], project_cap: int, run_cap: int) -> DataFrame:
    """Rows kept in order of priority while their project and their run have room.

    A row that its run's cap rejects uses no room of the project. So the rows with room in their run are its first run_cap,
    and the first project_cap of those are kept: two ranks, each cut to its cap before rows are shuffled.
    """
    able = first_by_group(df, [project, run], [F.col(c) for c in order], run_cap)
    if project_cap > 1000:  # Spark itself cuts before the shuffle up to here: beyond, the parts of a project come first
        part = "_part"
        able = first_by_group(able.withColumn(part, F.pmod(F.xxhash64(run), F.lit(256))), [project, part], [F.col(c) for c in order], project_cap).drop(part)
    return first_by_group(able, [project], [F.col(c) for c in order], project_cap)


def length_holdout(df: DataFrame, run: str, length: str, quota: int, seed: str) -> DataFrame:
    """Whole runs, in hash order, that any length still has need of: (run).

    A run is taken while some length it holds has fewer than `quota` rows so far. When `quota` runs that hold a length
    have passed it needs no more, so only each length's first `quota` runs are judged one after the other: at most as
    many as quota times the number of lengths.
    """
    counts = df.groupBy(F.col(run).alias("_run"), F.col(length).alias("_length")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_rank", hash_rank(seed, F.col("_run")))
    able = first_by_group(counts, ["_length"], [F.col("_rank"), F.col("_run")], quota).select("_run").distinct()
    profile = counts.join(able, "_run", "left_semi").groupBy("_run", "_rank").agg(F.map_from_entries(F.collect_list(F.struct("_length", "_n"))).alias("_have"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: dict = {}
        for pdf in batches:
            taken = []
            for r, have in zip(pdf["_run"], pdf["_have"]):
                have = dict(have)
                if any(got.get(k, 0) < quota for k in have):
                    taken.append(r)
                    for k, n in have.items():
                        got[k] = got.get(k, 0) + n
            yield pd.DataFrame({run: taken})

    return profile.repartition(1).sortWithinPartitions("_rank", "_run").select("_run", "_have").mapInPandas(choose, df.select(run).schema)


def quota_holdout(rows: DataFrame, quotas: DataFrame, used: DataFrame | None, *, run: str, length: str, row_id: str, seed: str, split: str) -> tuple[DataFrame, DataFrame]:
    """(rows chosen, runs used): rows of whole runs until each length's quota is met to the row.

    Runs come in hash order, those in `used` left out; a run gives its rows in hash order, of each length as many as are
    still needed, and is used up for other splits if it gives any. Rows of the first `quota` runs that hold a length meet
    its need, so only these runs are judged one after the other: at most as many as rows are asked for. quotas: (length,
    quota), a row a length.
    """
    able = rows.join(used, run, "left_anti") if used is not None else rows
    able = able.join(quotas.filter("quota > 0").select(length, F.col("quota").alias("_quota")), length)
    counts = able.groupBy(F.col(run).alias("_run"), F.col(length).alias("_length"), "_quota").agg(F.count(F.lit(1)).alias("_n")).withColumn("_rank", hash_rank(seed, split, "run", F.col("_run")))
    first = Window.partitionBy("_length").orderBy("_rank", "_run")
    runs = counts.withColumn("_no", F.row_number().over(first)).filter(F.col("_no") <= F.col("_quota")).select("_run").distinct()
    need = F.map_from_entries(F.collect_list(F.struct("_length", F.struct("_n", "_quota"))))
    profile = counts.join(runs, "_run", "left_semi").groupBy("_run", "_rank").agg(need.alias("_have"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: dict = {}
        for pdf in batches:
            out = []
            for r, have in zip(pdf["_run"], pdf["_have"]):
                for k, x in dict(have).items():
                    n = min(x["_n"], x["_quota"] - got.get(k, 0))
                    if n > 0:
                        out.append((r, k, n))
                        got[k] = got.get(k, 0) + n
            yield pd.DataFrame(out, columns=["_run", "_length", "_take"])

    kinds = {c: counts.schema[c].dataType.simpleString() for c in ("_run", "_length")}
    taken = profile.repartition(1).sortWithinPartitions("_rank", "_run").select("_run", "_have").mapInPandas(choose, f"_run {kinds['_run']}, _length {kinds['_length']}, _take long")
    order = Window.partitionBy(run, length).orderBy(hash_rank(seed, split, "row", F.col(row_id)), row_id)
    met = able.drop("_quota").withColumn("_no", F.row_number().over(order)).join(taken, (F.col(run) == F.col("_run")) & (F.col(length) == F.col("_length")))
    return met.filter(F.col("_no") <= F.col("_take")).drop("_no", "_run", "_length", "_take"), taken.select(F.col("_run").alias(run)).distinct()


def replayed(df: DataFrame, row_id: str, n: int, seed: str, epoch: int) -> DataFrame:
    """n rows of a pool for an epoch (column draw, from 0): the first in hash order, or, where the pool is smaller, drawn
    with replacement."""
    numbered = hash_numbers(df, [], hash_rank(f"{seed} {epoch}", F.col(row_id)), row_id, total="_pool").withColumn("_no", F.col("_no") - 1)
    pool = df.count()
    if n <= pool:
        return numbered.filter(F.col("_no") < n).withColumnRenamed("_no", "draw").drop("_pool")
    draw = hash_rank(f"{seed} {epoch} draw", F.col("draw"))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw")).withColumn("_no", F.conv(F.substring(draw, 1, 8), 16, 10).cast("long") % max(pool, 1))
    return draws.join(numbered, "_no").drop("_no", "_pool")


def modulo_shard(df: DataFrame, order: str, rank: int, n: int) -> DataFrame:
    """Every n-th row from rank on, by a numeric column of distinct values: nothing is padded or given twice."""
    return row_numbers(df, order).filter(F.pmod("row_number", F.lit(n)) == rank).drop("row_number")


def forced_split(df: DataFrame, key: str, seeds: DataFrame, seed: str, validation: float, test: float) -> DataFrame:
    """df with `split`: keys that a seed's training rows hold are train, others by their hash."""
    known = seeds.select(key).distinct().withColumn("_known", F.lit(True))
    return df.join(known, key, "left").withColumn("split", F.when(F.col("_known"), "train").otherwise(hash_split(F.col(key), seed, validation, test))).drop("_known")


def derived_seed(name: Column, seed: int) -> Column:
    """A seed of a name's own."""
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") + seed


def first_groups_whole(df: DataFrame, partition: str, group: str, seed: str) -> DataFrame:
    """All rows of one group of each partition, the one of smallest hash."""
    groups = df.select(partition, group).distinct()
    best = groups.groupBy(partition).agg(F.min(F.struct(hash_rank(seed, F.col(group)).alias("h"), F.col(group).alias("g"))).alias("_b")).select(partition, F.col("_b.g").alias(group))
    return df.join(best, [partition, group], "left_semi")

"""Joins within a relative tolerance (parts per million), and others that equality alone doesn't express."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from peakloom.functions.vectors import hash_fraction, hash_rank
from peakloom.operators.sampling import hash_numbers


def ppm_join(left: DataFrame, right: DataFrame, left_mz: Column, right_mz: Column, ppm: float, on: list[tuple[Column, Column]] = (), residual: Column | None = None, how: str = "inner") -> DataFrame:
    """Pairs with |right - left| <= left * ppm / 1e6 (the tolerance is the left side's), positive values only.

    Both sides fall into logarithmic buckets as wide as the tolerance, the left into the three that its window may
    touch: an equality join on the bucket (and on `on`), which Spark shuffles and splits as any other, then the exact
    condition. A value meets only its neighbours, whatever the number of rows.
    """
    width = math.log1p(ppm / 1e6) * 1.01
    bucket = lambda x: F.floor(F.log(F.when(x > 0, x)) / width)
    a = left.withColumn("_bucket", F.explode(F.sequence(bucket(left_mz) - 1, bucket(left_mz) + 1)))
    b = right.withColumn("_near", bucket(right_mz))
    near = (F.col("_bucket") == F.col("_near")) & (F.abs(right_mz - left_mz) <= left_mz * ppm / 1e6)
    for x, y in on:
        near = near & (x == y)
    if residual is not None:
        near = near & residual
    return a.join(b, near, how).drop("_bucket", "_near") if how == "inner" else a.join(b, near, how).drop("_bucket")


#: Rows of a cell that one block holds, and how many tolerances a cell spans.
LISTED, SPAN = 4096, 16
#: Pairs that a task compares at once.
AT_ONCE = 1 << 18


def ppm_first(rows: DataFrame, *, row_id: str, mz: str, label: str, on: list[str], ppm: float, seed: str, among: DataFrame | None = None) -> DataFrame:
    """(on, row_id, partner_id): for each row the one of another label within ppm (of its own value) and equal in `on` that
    has the smallest hash of both ids, `hash_rank(seed, "pair", row, partner)`; ids are distinct. With `among` only its rows
    (on, row_id, mz, label) look. Values are positive and finite; rows without one, a label or what `on` names take no part.

    Every candidate is hashed once, as the rule asks, but no pair is a row: cells of SPAN tolerances' width are gathered with
    what lies a tolerance beyond their edges, and a task finds each row's candidates in the cell by halving. So what is
    shuffled are little more than the rows. Cells of over LISTED rows are dealt as blocks, each pair of blocks a key of its
    own; which cells those are is broadcast, a row for LISTED rows at most. Hashes are made by Python, in a third of the
    time that an expression takes for each element of a list.
    """
    if not 0 <= ppm < 1e6:
        raise ValueError("a tolerance is at least 0 and less than 1e6 ppm")
    reach = max(-math.log1p(-ppm / 1e6) * 1.01, 1e-9)  # of a candidate's logarithm, rounding included
    cell = lambda shift: F.floor((F.log("_mz") + shift) / (reach * SPAN))
    key = [f"_on{k}" for k in range(len(on))]
    text = F.coalesce(F.concat(F.lit("\x1f"), F.col(row_id).cast("string")), F.lit("")).alias("_text")
    fields = [*(F.col(c).alias(k) for c, k in zip(on, key)), F.col(row_id).alias("_id"), F.col(mz).cast("double").alias("_mz"), F.col(label).alias("_y"), text]
    able = lambda x: x.select(*fields).filter((F.col("_mz") > 0) & (F.col("_mz") < float("inf"))).dropna(subset=[*key, "_y"])
    there = able(rows).withColumn("_cell", F.explode(F.sequence(cell(-reach), cell(reach)))).withColumn("_near", F.lit(True))
    there = there.withColumn("_looks", F.lit(among is None) & (F.col("_cell") == cell(0)))
    if among is not None:
        there = there.unionByName(able(among).withColumn("_cell", cell(0)).withColumn("_near", F.lit(False)).withColumn("_looks", F.lit(True)))
    cells = [*key, "_cell"]
    full = there.groupBy(*cells).agg(F.ceil(F.count(F.lit(1)) / LISTED).alias("_n")).filter("_n > 1")
    there = there.join(F.broadcast(full), cells, "left").withColumn("_n", F.coalesce("_n", F.lit(1).cast("long"))).withColumn("_own", F.pmod(F.xxhash64("_id"), F.col("_n")))
    # A pair of blocks: candidates of one, rows that look of the other.
    pair = lambda a, b, near, looks: F.struct(a.alias("_a"), b.alias("_b"), near.alias("_near"), looks.alias("_looks"))
    own, near, looks = F.col("_own"), F.col("_near"), F.col("_looks")
    pairs = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda k: F.array(pair(own, k, near, looks & (k == own)), pair(k, own, F.lit(False), looks & (k != own)))))
    dealt = there.withColumn("_pair", F.explode(pairs)).select(*cells, "_id", "_mz", "_y", "_text", "_pair.*").filter("_near or _looks")
    # Costs lie in the pairs, not in the bytes that partitions are made by: more tasks than cores, so that they end together.
    spark, block = rows.sparkSession, [*cells, "_a", "_b"]
    tasks = max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = dealt.repartition(tasks, *block).groupBy(*block).agg(F.collect_list(F.struct("_mz", "_y", "_id", "_text", "_near", "_looks")).alias("_rows"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = hashlib.sha256("\x1f".join((seed, "pair")).encode())
        for batch in batches:
            lists, at = batch.column(len(key)), batch.column(len(key)).flatten()
            m, looks, near = (at.field(c).to_numpy(zero_copy_only=False) for c in ("_mz", "_looks", "_near"))
            y, texts = at.field("_y").dictionary_encode().indices.to_numpy(), at.field("_text").cast(pa.binary()).to_pylist()
            group = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            asks, has = np.flatnonzero(looks), np.flatnonzero(near)
            has = has[np.lexsort((m[has], group[has]))]

            def places(rows: np.ndarray, value: np.ndarray) -> np.ndarray:
                out = np.empty(len(rows), complex)  # complex numbers sort as (block, value)
                out.real, out.imag = group[rows], value  # noqa: B023
                return out

            off = m[asks] * ppm / 1e6
            wide = off * (1 + 1e-6) + m[asks] * 1e-15
            ordered = places(has, m[has])
            low, high = np.searchsorted(ordered, places(asks, m[asks] - wide), "left"), np.searchsorted(ordered, places(asks, m[asks] + wide), "right")
            upto = np.cumsum(high - low)
            # A row that looks has at most a block's candidates, so no part is much over AT_ONCE.
            cuts = np.searchsorted(upto, np.arange(AT_ONCE, upto[-1], AT_ONCE)).tolist() if len(upto) else []
            found, partner, ranks = [], [], []
            for p, q in zip([0, *cuts], [*cuts, len(asks)]):
                n = high[p:q] - low[p:q]
                i = np.repeat(np.arange(p, q), n)
                j = has[np.arange(len(i)) - np.repeat(np.cumsum(n) - n - low[p:q], n)]
                fits = (np.abs(m[j] - m[asks[i]]) <= off[i]) & (y[j] != y[asks[i]])
                i, j = asks[i[fits]], j[fits].tolist()
                turns = np.flatnonzero(np.diff(i, prepend=-1))
                for row, s, e in zip(i[turns].tolist(), turns.tolist(), [*turns[1:].tolist(), len(j)]):
                    one = start.copy()
                    one.update(texts[row])
                    copy, got = one.copy, []
                    for k in j[s:e]:
                        h = copy()
                        h.update(texts[k])
                        got.append(h.digest())
                    least = min(got)
                    found.append(row)
                    partner.append(j[s + got.index(least)])
                    ranks.append(least)
            found, ids = np.array(found, np.int64), at.field("_id")
            chosen = lambda x, k: x.take(pa.array(k, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(chosen(batch.column(k), group[found]) for k in range(len(key))), chosen(ids, found), pa.array(ranks, pa.binary()), chosen(ids, partner)], names=[*key, "_id", "_rank", "_partner"])

    kind = dealt.schema
    schema = StructType([*(kind[k] for k in key), kind["_id"], StructField("_rank", BinaryType()), StructField("_partner", kind["_id"].dataType)])
    met = blocks.filter("size(_rows) > 1").select(*key, "_rows").mapInArrow(first, schema)
    best = met.groupBy(*key, "_id").agg(F.min(F.struct("_rank", "_partner")).alias("x"))
    return best.select(*(F.col(k).alias(c) for c, k in zip(on, key)), F.col("_id").alias(row_id), F.col("x._partner").alias("partner_id"))


#: Rows of a group in a block: a key of the join below gives at most this, squared, pairs.
BLOCK = 256


def pairs_in_groups(df: DataFrame, group: list[str], row_id: str, seed: str, most: int | None = None) -> DataFrame:
    """(group, left_id, right_id): pairs of different rows of a group, left_id < right_id. Ids are distinct in a group.

    All pairs, whatever the group's size: rows are numbered in hash order and cut into blocks, and each pair of blocks is
    a key of its own, so that a large group's pairs are dealt over tasks. With `most` a group gives min(most, all) pairs:
    its pairs are numbered, and pair numbers are drawn at even steps from a start that the group's hash decides, so that
    each pair is as likely as any other. That draw makes no other pairs: its work is linear, by one rule for every size.
    Null groups have no pairs.
    """
    rows = df.select(*group, F.col(row_id).alias("_id"))
    at = hash_numbers(rows, group, hash_rank(seed, "row", F.col("_id")), "_id", total="_n").withColumn("_no", F.col("_no") - 1)
    ordered = [F.least("_a", "_b").alias("left_id"), F.greatest("_a", "_b").alias("right_id")]
    if most is None:
        own, blocks = F.floor(F.col("_no") / BLOCK), F.ceil(F.col("_n") / BLOCK)
        first = at.select(*group, F.col("_id").alias("_a"), F.col("_no").alias("_i"), own.alias("_x"), F.explode(F.sequence(own, blocks - 1)).alias("_y"))
        second = at.select(*group, F.col("_id").alias("_b"), F.col("_no").alias("_j"), F.explode(F.sequence(F.lit(0).cast("long"), own)).alias("_x"), own.alias("_y"))
        return first.join(second, [*group, "_x", "_y"]).filter("_i < _j").select(*group, *ordered)
    total = (F.col("_n") * (F.col("_n") - 1) / 2).cast("long")
    start = hash_fraction(hash_rank(seed, "pairs", *(F.col(g) for g in group)))
    draws = F.transform(F.sequence(F.lit(0), F.least(F.lit(most).cast("long"), total) - 1), lambda k: F.when(total <= most, k).otherwise(F.floor((k + start) * total / most)))
    # Pair number p is that of the rows i < j with p = j (j - 1) / 2 + i.
    drawn = at.filter("_no = 0 and _n > 1").select(*group, F.explode(draws).alias("_p"))
    guess = F.floor((1 + F.sqrt(1 + 8 * F.col("_p").cast("double"))) / 2).cast("long")
    below = lambda j: (j * (j - 1) / 2).cast("long")
    j = F.when(below(F.col("_g")) > F.col("_p"), F.col("_g") - 1).when(below(F.col("_g") + 1) <= F.col("_p"), F.col("_g") + 1).otherwise(F.col("_g"))
    numbers = drawn.withColumn("_g", guess).withColumn("_j", j).withColumn("_i", F.col("_p") - below(F.col("_j")))
    left, right = at.select(*group, F.col("_no").alias("_i"), F.col("_id").alias("_a")), at.select(*group, F.col("_no").alias("_j"), F.col("_id").alias("_b"))
    return numbers.join(left, [*group, "_i"]).join(right, [*group, "_j"]).select(*group, *ordered)


def endpoints(pairs: DataFrame, rows: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """Pairs with both ends' columns, as left_ and right_. An id that no row has, or a pair of a row with itself, stops the job."""
    out = pairs.withColumn("left_id", F.when(F.col("left_id") == F.col("right_id"), F.raise_error(F.concat(F.lit("a pair of one row: "), F.col("left_id").cast("string"))).cast(pairs.schema["left_id"].dataType)).otherwise(F.col("left_id")))
    for s in ("left", "right"):
        side = rows.select(F.col(row_id).alias(f"{s}_id"), *(F.col(c).alias(f"{s}_{c}") for c in columns), F.lit(True).alias("_here"))
        kind = pairs.schema[f"{s}_id"].dataType
        here = F.when(F.col("_here").isNull(), F.raise_error(F.concat(F.lit("no row has the id "), F.coalesce(F.col(f"{s}_id").cast("string"), F.lit("null")))).cast(kind)).otherwise(F.col(f"{s}_id"))
        out = out.join(side, f"{s}_id", "left").withColumn(f"{s}_id", here).drop("_here")
    return out


def referenced(rows: DataFrame, pairs: DataFrame, row_id: str) -> DataFrame:
    """Rows that a pair names."""
    named = pairs.select(F.explode(F.array("left_id", "right_id")).alias(row_id)).distinct()
    return rows.join(named, row_id, "left_semi")


def both_qualified(pairs: DataFrame, rows: DataFrame, row_id: str) -> DataFrame:
    """Pairs whose ends are both among the rows."""
    ids = rows.select(row_id).distinct()
    return pairs.join(ids.withColumnRenamed(row_id, "left_id"), "left_id", "left_semi").join(ids.withColumnRenamed(row_id, "right_id"), "right_id", "left_semi")


def with_neighbour(df: DataFrame, row_id: str, mz: str, charge: str, label: str, ppm: float) -> DataFrame:
    """df with `has_hard_negative`: whether another label lies within ppm at the same charge."""
    left, right = df.select(*(F.col(c).alias(f"l_{c}") for c in (row_id, mz, charge, label))), df.select(*(F.col(c).alias(f"r_{c}") for c in (row_id, mz, charge, label)))
    found = ppm_join(left, right, F.col(f"l_{mz}"), F.col(f"r_{mz}"), ppm, [(F.col(f"l_{charge}"), F.col(f"r_{charge}"))], F.col(f"l_{label}") != F.col(f"r_{label}"))
    ids = found.select(F.col(f"l_{row_id}").alias(row_id)).distinct().withColumn("_found", F.lit(True))
    return df.join(ids, row_id, "left").withColumn("has_hard_negative", F.coalesce("_found", F.lit(False))).drop("_found")


def distractor_ok(a: tuple[Column, Column], b: tuple[Column, Column], ppm: float, proton: float = 1.00727646688) -> Column:
    """Whether (m/z, charge) b may be mixed into a: neither the same ion within ppm nor the same neutral mass."""
    (mz_a, z_a), (mz_b, z_b) = a, b
    mid = (mz_a + mz_b) / 2
    mass = lambda mz, z: z * (mz - proton)
    mid_mass = (mass(mz_a, z_a) + mass(mz_b, z_b)) / 2
    return ~((z_a == z_b) & (F.abs(mz_a - mz_b) < mid * ppm / 1e6)) & ~(F.abs(mass(mz_a, z_a) - mass(mz_b, z_b)) < mid_mass * ppm / 1e6)

"""Whether a mixture's vector follows the source that it was conditioned on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.functions.vectors import cosine_distance, dot, doubles, euclidean_distance, unit


def jensen_shannon(p: Column, q: Column) -> Column:
    """Divergence of two distributions (natural logarithm); both are scaled to sum to one."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    share = lambda v: F.transform(F.array(total(doubles(v))), lambda n: F.transform(doubles(v), lambda x: x / n))[0]  # noqa: E731  the total once, not for each component
    part = lambda x, m: F.when(x > 0, x * F.log(x / m)).otherwise(0.0)
    return total(F.zip_with(share(p), share(q), lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2))


DISTANCES = {"cosine": lambda a, b: cosine_distance(unit(a), unit(b)), "euclidean": euclidean_distance, "jensen_shannon": jensen_shannon}


def source_selection(df: DataFrame, group: list[str], kind: str, clean_a: str, clean_b: str, mixed_a: str, mixed_b: str) -> DataFrame:
    """(group, n, condition_distance, accuracy, paired_accuracy) of mixtures conditioned on A and on B.

    condition_distance is between the two conditionings; accuracy is the share of conditionings that lie nearer to
    their own source, paired_accuracy that of pairs in which both do.
    """
    d = lambda x, y: DISTANCES[kind](F.col(x), F.col(y))
    rows = df.select(*group, d(mixed_a, mixed_b).alias("_far"), (d(mixed_a, clean_a) < d(mixed_a, clean_b)).cast("int").alias("_own_a"), (d(mixed_b, clean_b) < d(mixed_b, clean_a)).cast("int").alias("_own_b"))
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg("_far").alias("condition_distance"), F.avg((F.col("_own_a") + F.col("_own_b")) / 2).alias("accuracy"), F.avg((F.col("_own_a") * F.col("_own_b")).cast("double")).alias("paired_accuracy"))


def dense_source_selection(df: DataFrame, row_id: str, clean_a: str, clean_b: str, mixed: str, source: str) -> DataFrame:
    """(row_id, n, accuracy) by peak: arrays of token vectors, and each token's source, 0 or 1.

    A mixed token counts if its cosine to the clean token at its place in its own source is the larger one.
    """
    tokens = df.select(row_id, F.posexplode(F.arrays_zip(F.col(clean_a).alias("a"), F.col(clean_b).alias("b"), F.col(mixed).alias("m"), F.col(source).alias("s"))).alias("k", "t"))
    d = lambda x: cosine_distance(unit(F.col("t.m")), unit(F.col(f"t.{x}")))
    right = F.when(F.col("t.s") == 0, d("a") < d("b")).otherwise(d("b") < d("a"))
    return tokens.filter("t.s in (0, 1)").groupBy(row_id).agg(F.count(F.lit(1)).alias("n"), F.avg(right.cast("double")).alias("accuracy"))


def null_local(df: DataFrame, group: list[str], source: str, negative: str, one: str, two: str) -> DataFrame:
    """(group, pairs, accuracies, margins and distances) of two local views without a precursor, against their clean source.

    A view is right if it lies nearer to its source than to the negative; a margin is how much nearer.
    """
    units = df.select(*group, *(unit(F.col(c)).alias(f"_{k}") for k, c in enumerate((source, negative, one, two))))
    v = {c: F.col(f"_{k}") for k, c in enumerate((source, negative, one, two))}
    d = lambda a, b: 1.0 - dot(v[a], v[b])
    rows = units.select(*group, d(one, source).alias("s1"), d(one, negative).alias("n1"), d(two, source).alias("s2"), d(two, negative).alias("n2"), d(one, two).alias("local"), d(source, negative).alias("clean"))
    right1, right2 = (F.col("s1") < F.col("n1")).cast("double"), (F.col("s2") < F.col("n2")).cast("double")
    m1, m2 = F.col("n1") - F.col("s1"), F.col("n2") - F.col("s2")
    means = {
        "accuracy_1": right1, "accuracy_2": right2, "paired_accuracy": right1 * right2, "mean_accuracy": (right1 + right2) / 2, "margin_1": m1, "margin_2": m2, "mean_margin": (m1 + m2) / 2,
        "local_distance": F.col("local"), "clean_distance": F.col("clean"), "distance_ratio": F.col("local") / F.greatest(F.col("clean"), F.lit(1e-8)),
    }
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("pairs"), *(F.avg(x).alias(k) for k, x in means.items()))


def coprime_stride(size: Column, seed: Column) -> Column:
    """The first step from 1 + seed mod (size - 1) on, round to 1, that has no divisor in common with size; 1 below two."""
    def gcd(a: Column, b: Column) -> Column:
        pair = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
        turn = lambda x, _: F.struct(F.when(x["b"] == 0, x["a"]).otherwise(x["b"]).alias("a"), F.when(x["b"] == 0, F.lit(0).cast("long")).otherwise(x["a"] % F.greatest(x["b"], F.lit(1))).alias("b"))
        # Euclid's turns are at most log(b) / log(1.618) and two more: 92 for a long.
        turns = F.least(F.lit(92), F.ceil(F.log2(F.greatest(b, F.lit(2)).cast("double")) * 1.4405) + 3).cast("int")
        return F.aggregate(F.sequence(F.lit(1), turns), pair, turn, lambda x: x["a"])

    # Among any 400 neighbours one is coprime to a 64-bit number; once one is found no other is tried.
    step = lambda k: (F.pmod(F.pmod(seed, size - 1) + k, size - 1) + 1).cast("long")
    none = F.lit(None).cast("long")
    first = lambda a, z: F.aggregate(F.sequence(F.lit(a), F.lit(z)), none, lambda got, k: F.when(got.isNotNull(), got).when(gcd(step(k), size) == 1, step(k)))
    return F.when(size < 2, F.lit(1).cast("long")).otherwise(F.coalesce(first(0, 15), first(16, 400)))

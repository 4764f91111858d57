"""Functions of embedding vectors (arrays of numbers), and hash ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Of length one; a zero vector stays zero."""
    norm = lambda w: F.greatest(F.sqrt(dot(w, w)), F.lit(1e-12))
    # Arrays of one element name the vector and its length: inside transform an expression is worked out for each component.
    scaled = lambda w: F.transform(F.array(norm(w)), lambda n: F.transform(w, lambda x: x / n))[0]
    return F.transform(F.array(doubles(v)), scaled)[0]


def cosine_distance(a: Column, b: Column) -> Column:
    """Of unit vectors; never negative."""
    return F.greatest(F.lit(0.0), 1.0 - dot(a, b))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def two_view_distance(a_one: Column, a_two: Column, b_one: Column, b_two: Column) -> Column:
    """Of unit vectors in two views: the mean of both directions, a's first view to b's second and a's second to b's first."""
    return (cosine_distance(a_one, b_two) + cosine_distance(a_two, b_one)) / 2


def hash_rank(*parts: Column | str) -> Column:
    """A stable rank: SHA-256 of the parts' texts, joined by the unit separator. Hex sorts as bytes do."""
    return F.sha2(F.concat_ws("\x1f", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)), 256)


def hash_fraction(rank: Column) -> Column:
    """0 up to 1 from the first eight hex digits of a rank."""
    return F.conv(F.substring(rank, 1, 8), 16, 10).cast("double") / float(1 << 32)


def random_hit_chance(n_positive: Column, n: Column, k: int) -> Column:
    """Chance that k draws without replacement from n hold one of n_positive."""
    steps = F.sequence(F.lit(0), F.least(F.lit(k), n).cast("int") - 1)
    miss = F.aggregate(steps, F.lit(1.0), lambda p, i: p * F.greatest(F.coalesce(F.try_divide(n - n_positive - i, (n - i).cast("double")), F.lit(0.0)), F.lit(0.0)))
    return F.when(n > 0, 1.0 - miss).otherwise(0.0)

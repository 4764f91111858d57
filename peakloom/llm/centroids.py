"""Centroid clustering: exact rounds of assignment that scan again only vectors whose bounds have expired.

A vector's gap is its lower bound to the second nearest centroid less its upper bound to its own. A round moves the
centroids, so it shrinks a gap by at most how far the vector's own centroid moved and how far any other one did. The
sum of these is the cluster's drift. A gap is kept with its cluster's drift at that time added, hence it expires when
the drift has reached it, and nothing need be touched until then.

Each cluster's heap is kept as runs: tables whose files are sorted by (cluster, kept gap), smallest first, so that what
expires is read from the front of a cluster's part. A popped vector enters the next run with its new gap. As drifts
only grow, a kept gap that is not above the drift tells that its row was popped: runs are never rewritten.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.llm.shared import saved, trimmed
from peakloom.llm.vectors import integers, matrix, products
from peakloom.session import bounded_batches

#: Bounds are widened by this share, far more than what rounding can take.
SLACK = 1e-9
#: Squares are summed in two halves, so that a task's sums stay within 64 bits.
HALF = 30


def cluster_vectors(
    vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: str = "1"
) -> DataFrame:
    """(id_col, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>), a row a kept vector.

    Vectors become floor(scale * x); those with another length than dim, null or non-finite components are left out.
    Centroids start as the k vectors with the smallest SHA-256 of "seed:id" (null ids come last, equal hashes go by
    vector), in that order. Each round assigns all vectors to the nearest centroid by squared distance (ties: the
    smaller number) and moves every non-empty centroid to the floor of its vectors' mean; a last assignment follows.
    All of it is exact. Fewer than k vectors make as many clusters; repeated rows are clustered each; an empty table gives
    an empty one. Other columns don't matter. Stores its runs in the shared folder: each vector once, and once again
    for each time that its gap expired. The driver holds k centroids and k * (dim + 3) sums.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = integers(vectors, id_col, vec_col, scale, dim)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(digest.asc_nulls_last(), "v").limit(k).collect()
    kind = rows.schema["id"].dataType
    if not first:
        fields = "cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
        return spark.createDataFrame([], T.StructType([T.StructField(id_col, kind), *T._parse_datatype_string(fields).fields]))
    centroids = np.array([r.v for r in first], np.int64)
    drift = [0.0] * len(centroids)
    count, sums, squares = [0] * len(centroids), [[0] * dim for _ in centroids], [0] * len(centroids)

    def add(totals: list[tuple[int, int, int]]) -> None:
        for c, place, total in totals:
            if place < dim:
                sums[c][place] += total
            elif place == dim:
                count[c] += total
            else:
                squares[c] += total << (HALF if place == dim + 1 else 0)

    runs = [saved(scanned(rows.withColumn("was", F.lit(None).cast("int")), centroids, drift), "heaps")]
    for _ in range(rounds):
        add(changes(runs[-1], dim))
        moved = np.array([[s // n for s in own] if n else old.tolist() for own, n, old in zip(sums, count, centroids)], np.int64)
        way = [math.sqrt(sum(int(x) ** 2 for x in step)) * (1 + SLACK) for step in moved - centroids]
        before, centroids = drift, moved
        drift = [d + way[c] + max((w for j, w in enumerate(way) if j != c), default=0.0) for c, d in enumerate(before)]
        # The last run's rows have entered since `before`; of older ones those up to it were popped earlier.
        popped = [expired(run, drift, before if run is not runs[-1] else None) for run in runs]
        runs.append(saved(scanned(reduce(DataFrame.unionByName, popped), centroids, drift), "heaps"))
    add(changes(runs[-1], dim))

    # The sum of |v - c|**2 from what is summed already.
    inertia = [q - 2 * sum(int(x) * s for x, s in zip(c, own)) + n * sum(int(x) ** 2 for x in c) for q, own, n, c in zip(squares, sums, count, centroids)]
    final = spark.createDataFrame(
        [(c, inertia[c], sum(inertia), centroids[c].tolist()) for c in range(len(centroids))], "cluster int, cluster_inertia long, inertia long, centroid array<long>"
    )
    live = [run.filter(~gone(drift)) for run in runs[:-1]] + [runs[-1]]
    own = reduce(DataFrame.unionByName, live)

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column(1)
            step = matrix(b.column(2), dim) - centroids[c.to_numpy()]
            yield pa.RecordBatch.from_arrays([b.column(0), c, pa.array(np.einsum("id,id->i", step, step))], names=["id", "cluster", "distance"])

    fields = T.StructType([T.StructField("id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    got = own.select("id", "cluster", "v").mapInArrow(trimmed(distances), fields)
    return got.join(F.broadcast(final), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def scanned(rows: DataFrame, centroids: np.ndarray, drift: list[float]) -> DataFrame:
    """(id, v, was, cluster, kept): rows (id, v, was) with their exact nearest centroid and their gap, in heap order."""
    offset = np.array(drift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = (centroids * centroids).sum(axis=1)
        for b in batches:
            v = matrix(b.column(1), centroids.shape[1])
            d = (v * v).sum(axis=1)[:, None] - 2 * products(v, centroids) + norms
            nearest = d.argmin(axis=1)  # the first of equal ones
            at = np.arange(len(v))
            upper = np.sqrt(d[at, nearest].astype(float)) * (1 + SLACK)
            d[at, nearest] = np.iinfo(np.int64).max
            lower = np.sqrt(d.min(axis=1).astype(float)) * (1 - SLACK)
            kept = (lower - upper if len(centroids) > 1 else np.full(len(v), np.inf)) + offset[nearest]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nearest.astype(np.int32)), pa.array(kept)], names=[*b.schema.names, "cluster", "kept"])

    schema = T.StructType([*rows.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("kept", T.DoubleType())])
    return rows.mapInArrow(trimmed(run), schema).sortWithinPartitions("cluster", "kept")


def gone(drift: list[float]) -> Column:
    """Whether a row's kept gap has expired: the front of its cluster's heap."""
    return reduce(Column.__or__, [(F.col("cluster") == c) & (F.col("kept") <= d) for c, d in enumerate(drift)])


def expired(run: DataFrame, drift: list[float], before: list[float] | None) -> DataFrame:
    """(id, v, was): what is popped now from a run, not what was popped before."""
    popped = run.filter(gone(drift))
    if before is not None:
        popped = popped.filter(~gone(before))
    return popped.select("id", "v", F.col("cluster").alias("was"))


def changes(run: DataFrame, dim: int) -> list[tuple[int, int, int]]:
    """(cluster, place, total): what the rows of a run that changed their cluster add to the clusters' sums.

    Places: the components, then the count, then the squares' upper and lower halves.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}
        for b in batches:
            v = matrix(b.column(0), dim)
            q = (v * v).sum(axis=1)
            full = np.c_[v, np.ones(len(v), np.int64), q >> HALF, q & ((1 << HALF) - 1)]
            for column, sign in ((b.column(1), 1), (b.column(2), -1)):
                c = column.fill_null(-1).to_numpy(zero_copy_only=False)
                for own in np.unique(c[c >= 0]).tolist():
                    got[own] = got.get(own, 0) + sign * full[c == own].sum(axis=0)
        for own, total in got.items():
            n = len(total)
            yield pa.RecordBatch.from_arrays([pa.array([own] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(total)], names=["cluster", "place", "total"])

    moved = run.filter("was is null or was <> cluster").select("v", "cluster", "was")
    parts = moved.mapInArrow(trimmed(summed), "cluster int, place int, total long")
    totals = parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"))
    return [(r.cluster, r.place, int(r.total)) for r in totals.collect()]

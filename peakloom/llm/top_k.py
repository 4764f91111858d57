"""Exact top-k by inner product: ball trees by shard, branch and bound, the kth score shared.

Vectors near a common pivot make a shard of bounded size; each shard keeps a ball tree. A ball (centre c, radius r)
bounds the inner product of a query q with all that it holds by q.c + |q| r. Queries visit shards in rounds, the shards
with the largest bounds first; the kth score that a round finds goes along to the next one, which asks only shards
whose bound reaches it. In a shard the tree's nodes are taken by their bounds, largest first, until the largest one
lies below the kth score.

Scores are whole numbers and exact; bounds are rounded up.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peakloom.llm.shared import saved, trimmed
from peakloom.llm.vectors import integers, matrix, products
from peakloom.session import bounded_batches

SLACK = 1e-9
#: Components of a shard, and of all shards' centres (what is broadcast: 8 bytes each).
SHARD_CELLS, CENTRE_CELLS = 1 << 20, 1 << 21
PIVOTS = 256
#: Vectors of a leaf of a tree, queries of a shard that one task answers, and cells of a table of bounds.
LEAF, ASKED, BOUND_CELLS = 128, 8192, 1 << 21


@dataclass
class Tree:
    """Node 0 is the root, node i has the children 2i + 1 and 2i + 2; leaves hold rows start to end of the vectors."""

    centres: np.ndarray
    radii: np.ndarray
    starts: np.ndarray
    ends: np.ndarray  # start = end where there is no node
    leaf: np.ndarray


def ball(v: np.ndarray) -> tuple[np.ndarray, float]:
    centre = np.rint(v.mean(axis=0)).astype(np.int64)
    far = ((v - centre) ** 2).sum(axis=1).max()
    return centre, float(np.sqrt(float(far)) * (1 + SLACK))


def grown(v: np.ndarray) -> tuple[np.ndarray, Tree]:
    """The order of rows in the tree, and the tree: halves along the line between two far points, down to LEAF rows."""
    levels = max(0, int(np.ceil(np.log2(max(1, len(v) / LEAF)))))
    m = 2 ** (levels + 1) - 1
    tree = Tree(np.zeros((m, v.shape[1]), np.int64), np.zeros(m), np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, bool))
    order = np.arange(len(v))
    spans = [(0, 0, len(v))]
    while spans:
        i, start, end = spans.pop()
        if start == end:
            continue
        own = v[order[start:end]]
        tree.centres[i], tree.radii[i] = ball(own)
        tree.starts[i], tree.ends[i] = start, end
        if 2 * i + 2 >= m or end - start <= LEAF:
            tree.leaf[i] = True
            continue
        a = own[((own - tree.centres[i]) ** 2).sum(axis=1).argmax()]
        b = own[((own - a) ** 2).sum(axis=1).argmax()]
        order[start:end] = order[start:end][np.argsort((own * (b - a)).sum(axis=1), kind="stable")]
        half = (start + end) // 2
        spans += [(2 * i + 1, start, half), (2 * i + 2, half, end)]
    return order, tree


def best_of(q: np.ndarray, norm: float, own: int, kth: int | None, bounds: np.ndarray, ids: np.ndarray, v: np.ndarray, tree: Tree, k: int) -> list[tuple[int, int]]:
    """(score, id) of a shard's k best for a query, only those that reach kth: nodes by bound until none can help."""
    found: list[tuple[int, int]] = []  # a heap of (score, -id): the worst of the k first
    waits = [(-bounds[0], 0)]
    while waits:
        bound, i = heapq.heappop(waits)
        least = found[0][0] if len(found) == k else None
        least = kth if least is None else least if kth is None else max(least, kth)
        if least is not None and -bound < least:
            break
        if not tree.leaf[i]:
            for j in (2 * i + 1, 2 * i + 2):
                if tree.ends[j] > tree.starts[j]:
                    heapq.heappush(waits, (max(bound, -bounds[j]), j))  # a part's bound is at most the whole's
            continue
        rows = slice(tree.starts[i], tree.ends[i])
        scores = products(q[None, :], v[rows])[0]
        here = np.flatnonzero((ids[rows] != own) & (scores >= (scores.min() if least is None else least)))
        if len(here) > k:  # the leaf's k best
            here = here[np.lexsort((ids[rows][here], -scores[here]))[:k]]
        for j in here.tolist():
            x = (int(scores[j]), -int(ids[rows][j]))
            if len(found) < k:
                heapq.heappush(found, x)
            elif x > found[0]:
                heapq.heapreplace(found, x)
    return [(s, -i) for s, i in found]


def search(
    vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", queries: str = "id % 50 = 0", k: int = 5, scale: int = 256
) -> DataFrame:
    """(query_id long, rank int from 1, id_col long, score long): each query's k rows with the largest inner products.

    Vectors become floor(scale * x); those that are null or hold null or non-finite components take no part. Queries
    are the rows for which the condition `queries` on `id` holds; candidates are all rows with another id than the
    query's and as many components. Ties go to the smaller id; fewer candidates give fewer rows. Rows without an id
    take no part. A repeated id is one query, with its smallest vector; each of its rows is a candidate. Empty tables
    give no rows; other columns don't matter. Stores shards and each round's questions in the shared folder.

    A shard's vectors and tree fit one task by their number of cells; the shards' balls, which are broadcast, by
    CENTRE_CELLS: beyond some billion cells shards grow instead. Queries stream past a shard, ASKED to a task.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    empty = spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score long")
    base = integers(vectors, id_col, vec_col, scale).filter("id is not null").select(F.col("id").cast("long").alias("id"), "v", F.size("v").alias("dim"))
    sizes = {r.dim: r.n for r in base.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [of_length(base.filter(F.col("dim") == dim), dim, n, queries, k) for dim, n in sorted(sizes.items()) if dim]
    parts += [of_nothing(base.filter("dim = 0"), queries, k)] if 0 in sizes else []
    out = empty
    for p in parts:
        out = p.toDF("query_id", "rank", id_col, "score") if out is empty else out.unionByName(p.toDF("query_id", "rank", id_col, "score"))
    return out


def of_nothing(base: DataFrame, queries: str, k: int) -> DataFrame:
    """Vectors without components: all scores are 0, so the smallest other ids win."""
    low = [r.id for r in base.orderBy("id").limit(k).collect()]
    # A query may have rows among these itself; then the next ids follow.
    asked = base.filter(queries).select("id").distinct()
    more = [r.id for r in base.join(F.broadcast(base.sparkSession.createDataFrame([(i,) for i in set(low)], "id long")), "id", "left_anti").orderBy("id").limit(k).collect()]
    able = F.array([F.lit(i).cast("long") for i in low + more])
    found = asked.select("id", F.posexplode(F.slice(F.filter(able, lambda x: x != F.col("id")), 1, k)).alias("place", "other"))
    return found.select(F.col("id").alias("query_id"), (F.col("place") + 1).alias("rank"), "other", F.lit(0).cast("long").alias("score"))


def of_length(base: DataFrame, dim: int, n: int, queries: str, k: int) -> DataFrame:
    """The search among n vectors of one length."""
    spark = base.sparkSession
    least = max(1, SHARD_CELLS // dim, -(-n * dim // CENTRE_CELLS))
    shards = saved(sharded(base, dim, n, least), "top-k-shards")
    balls = shards.select("shard", "centre", "radius").orderBy("shard").collect()  # at most CENTRE_CELLS and PIVOTS vectors
    ball_of = spark.sparkContext.broadcast(([r.shard for r in balls], np.array([np.frombuffer(r.centre, np.int64) for r in balls]).reshape(-1, dim), np.array([r.radius for r in balls])))
    asked = saved(base.filter(queries).groupBy("id").agg(F.min("v").alias("v")), "top-k-queries")
    best: DataFrame | None = None
    done, width = 0, 1
    while done < len(balls):
        known = asked.withColumn("kth", F.lit(None).cast("long")) if best is None else asked.join(best.filter(F.col("rank") == k).select("id", F.col("score").alias("kth")), "id", "left")
        questions = saved(asking(known, ball_of, dim, done, done + width), "top-k-questions")
        if best is not None and not questions.head(1):
            break  # bounds only fall from here on
        many = questions.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
        here = shards.join(many, "shard")
        copies = F.ceil(F.col("n") / ASKED).cast("int")
        # What a shard is asked is dealt to as many copies of it as it takes.
        one = here.select("shard", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"), F.lit(0).alias("kind"), "ids", "vectors", "tree", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("q"), F.lit(None).cast("long").alias("kth"))
        to = questions.join(F.broadcast(many) if len(balls) < 1 << 16 else many, "shard").withColumn("copy", F.pmod(F.xxhash64("id"), copies).cast("int"))
        two = to.select("shard", "copy", F.lit(1).alias("kind"), *(F.lit(None).cast("binary").alias(c) for c in ("ids", "vectors", "tree")), "id", "q", "kth")
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(balls) // 4)
        rows = one.unionByName(two).repartition(tasks, "shard", "copy").sortWithinPartitions("shard", "copy", "kind")
        found = rows.select("kind", "ids", "vectors", "tree", "id", "q", "kth").mapInArrow(trimmed(answering(dim, k)), "id long, other long, score long")
        if best is not None:
            found = found.unionByName(best.select("id", "other", "score"))
        rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("score").desc(), "other"))
        best = saved(found.withColumn("rank", rank).filter(F.col("rank") <= k), "top-k-best")
        done, width = done + width, width * 4
    return best.select(F.col("id").alias("query_id"), "rank", "other", "score")


def sharded(base: DataFrame, dim: int, n: int, least: int) -> DataFrame:
    """(shard, ids, vectors, tree, centre, radius): vectors dealt to the nearest pivot, large crowds in pieces."""
    spark = base.sparkSession
    many = min(PIVOTS, max(1, CENTRE_CELLS // dim), -(-n // least))
    pivots = np.array(sorted({tuple(r.v) for r in base.orderBy(F.xxhash64("id"), "id").limit(many).collect()}), np.int64).reshape(-1, dim)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = (pivots * pivots).sum(axis=1)
        for b in batches:
            v = matrix(b.column(1), dim)
            cell = (norms - 2 * products(v, pivots)).argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), packed(v), pa.array(cell)], names=["id", "v", "cell"])

    rows = saved(base.select("id", "v").mapInArrow(trimmed(dealt), "id long, v binary, cell int").withColumn("no", F.monotonically_increasing_id()), "top-k-cells")
    start, offsets = 0, []
    for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).orderBy("cell").collect():  # at most PIVOTS rows
        pieces = -(-r.n // least)
        offsets.append((r.cell, start, pieces))
        start += pieces
    cells = F.broadcast(spark.createDataFrame(offsets, "cell int, first int, pieces int"))
    placed = rows.join(cells, "cell").select((F.col("first") + F.pmod(F.xxhash64("no"), F.col("pieces"))).cast("int").alias("shard"), "id", "v")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), start // 4)

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, parts = None, [], []
        for b in batches:
            shard, own = b.column(0).to_numpy(), b.column(1).to_numpy()
            v = unpacked(b.column(2), dim)
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                if now is not None and shard[x] != now:
                    yield finished(now, ids, parts)
                    ids, parts = [], []
                now = int(shard[x])
                ids.append(own[x:y])
                parts.append(v[x:y])
        if now is not None:
            yield finished(now, ids, parts)

    return placed.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(trimmed(built), "shard int, ids binary, vectors binary, tree binary, centre binary, radius double")


def packed(v: np.ndarray) -> pa.Array:
    """Each row as little-endian 32-bit integers."""
    whole = np.ascontiguousarray(v, "<i4").tobytes()
    n = v.shape[1] * 4
    return pa.array([whole[i : i + n] for i in range(0, len(whole), n)], pa.binary())


def unpacked(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64).reshape(-1, dim)


def finished(shard: int, ids: list[np.ndarray], parts: list[np.ndarray]) -> pa.RecordBatch:
    v, own = np.concatenate(parts), np.concatenate(ids)
    order, tree = grown(v)
    cells = np.c_[tree.centres, tree.starts, tree.ends, tree.leaf].astype("<i8").tobytes() + tree.radii.astype("<f8").tobytes()
    row = [[shard], [own[order].astype("<i8").tobytes()], [v[order].astype("<i4").tobytes()], [cells], [tree.centres[0].astype("<i8").tobytes()], [float(tree.radii[0])]]
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], names=["shard", "ids", "vectors", "tree", "centre", "radius"])


def tree_of(cells: bytes, dim: int) -> Tree:
    m = len(cells) // (8 * (dim + 4))
    whole = np.frombuffer(cells, "<i8", m * (dim + 3)).reshape(m, dim + 3)
    return Tree(whole[:, :dim], np.frombuffer(cells, "<f8", m, m * (dim + 3) * 8), whole[:, dim], whole[:, dim + 1], whole[:, dim + 2] == 1)


def bounds_of(q: np.ndarray, norms: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Rounded up; the same whatever else is in the batch: the products are whole numbers."""
    x = products(q, centres).astype(np.float64)
    return x + norms[:, None] * radii[None, :] * (1 + SLACK) + np.abs(x) * SLACK + 1e-6


def asking(known: DataFrame, ball_of, dim: int, start: int, end: int) -> DataFrame:
    """(shard, id, q, kth): the queries with the shards from place `start` to `end` in their order that can reach kth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, centres, radii = ball_of.value
        step = max(1, BOUND_CELLS // max(len(names), dim))
        for b in batches:
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                q = matrix(part.column(1), dim)
                norms = np.sqrt((q * q).sum(axis=1).astype(float))
                bound = bounds_of(q, norms, centres, radii)
                places = np.argsort(-bound, axis=1, kind="stable")[:, start:end]
                kth = [-np.inf if x is None else x for x in part.column(2).to_pylist()]
                row, place = np.nonzero(np.take_along_axis(bound, places, axis=1) >= np.array(kth, float)[:, None])
                if len(row):
                    at = pa.array(row)
                    shard = pa.array(np.array(names, np.int32)[places[row, place]])
                    yield pa.RecordBatch.from_arrays([shard, part.column(0).take(at), packed(q).take(at), part.column(2).take(at)], names=["shard", "id", "q", "kth"])

    return known.select("id", "v", "kth").mapInArrow(trimmed(run), "shard int, id long, q binary, kth long")


def answering(dim: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = v = tree = None
        for b in batches:
            kinds = b.column(0).to_numpy()
            cuts = sorted({0, len(kinds), *np.flatnonzero(kinds == 0).tolist(), *(np.flatnonzero(kinds == 0) + 1).tolist()})
            for x, y in zip(cuts, cuts[1:]):
                if kinds[x] == 0:  # the next shard
                    ids = np.frombuffer(b.column(1)[x].as_py(), "<i8")
                    v = np.frombuffer(b.column(2)[x].as_py(), "<i4").astype(np.int64).reshape(-1, dim)
                    tree = tree_of(b.column(3)[x].as_py(), dim)
                    continue
                step = max(1, BOUND_CELLS // max(len(tree.radii), dim))
                for i in range(x, y, step):
                    part = b.slice(i, min(step, y - i))
                    q = unpacked(part.column(5), dim)
                    norms = np.sqrt((q * q).sum(axis=1).astype(float))
                    bounds = bounds_of(q, norms, tree.centres, tree.radii)
                    own, kth = part.column(4).to_pylist(), part.column(6).to_pylist()
                    out = [(o, i, s) for j, o in enumerate(own) for s, i in best_of(q[j], norms[j], o, kth[j], bounds[j], ids, v, tree, k)]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["id", "other", "score"])

    return run

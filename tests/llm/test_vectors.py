"""Clusters, manifests and searches against brute-force versions, on given and odd tables."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.llm import centroids, merkle, top_k
from peakloom.llm.vectors import MOST, products

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
VECTORS = "vec_id long, embedding array<float>"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def kept(rows, scale, dim=None):
    out = []
    for i, v in rows:
        if v is not None and (dim is None or len(v) == dim) and all(x is not None and math.isfinite(x) for x in v):
            out.append((i, [math.floor(scale * float(np.float32(x))) for x in v]))
    return out


def brute_clusters(rows, dim, scale, k, rounds, seed="1"):
    own = kept(rows, scale, dim)
    first = sorted(own, key=lambda r: (r[0] is None, sha(f"{seed}:{r[0]}") if r[0] is not None else "", r[1]))[:k]
    c = [v for _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        near = [min(range(len(c)), key=lambda j: (far(v, c[j]), j)) for _, v in own]
        if turn < rounds:
            for j in range(len(c)):
                mine = [v for (_, v), n in zip(own, near) if n == j]
                c[j] = [sum(x) // len(mine) for x in zip(*mine)] if mine else c[j]
    d = [far(v, c[n]) for (_, v), n in zip(own, near)]
    return [(i, n, x, sum(y for y, m in zip(d, near) if m == n), sum(d), c[n]) for (i, _), n, x in zip(own, near, d)]


def odd_vectors(dim, n, seed=3):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(i % 5, 0.3) for _ in range(dim)]) for i in range(n)]
    rows += [(1000 + i, [0.5] * dim) for i in range(n)]  # copies of one vector
    rows += [(7, [1.0] * dim), (7, [1.0] * dim), (None, [0.25] * dim), (2000, None), (2001, []), (2002, [1.0] * (dim + 1)), (2003, [None] * dim), (2004, [float("nan")] * dim), (2005, [float("inf")] * dim), (-100, [-2.0] * dim)]
    return rows


@pytest.mark.parametrize("k,rounds", [(1, 2), (4, 0), (4, 3), (16, 6), (500, 2)])
def test_clusters(spark, k, rounds):
    rows = odd_vectors(6, 60)
    df = spark.createDataFrame(rows, VECTORS).withColumn("cluster", F.lit("x")).withColumn("a.b", F.lit(1)).withColumn("ID", F.lit(2)).repartition(5)
    got = centroids.cluster_vectors(df, dim=6, scale=16, k=k, rounds=rounds)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_clusters(rows, 6, 16, k, rounds)))


def test_no_vectors(spark):
    none = spark.createDataFrame([(1, None), (2, [1.0])], VECTORS)
    assert centroids.cluster_vectors(none, dim=3).count() == 0 and centroids.cluster_vectors(none.limit(0)).columns[:3] == ["vec_id", "cluster", "distance"]
    assert top_k.search(none.limit(0)).columns == ["query_id", "rank", "vec_id", "score"]
    assert top_k.search(none).count() == 0


def test_only_expired_gaps_are_scanned(spark):
    """Far clusters that hardly move: rounds after the first pop next to nothing, and clusters stay right."""
    rnd = random.Random(5)
    rows = [(i, [100.0 * (i % 4 == j) + rnd.random() for j in range(4)]) for i in range(400)]
    popped = []
    whole = centroids.scanned

    def watch(df, *more):
        popped.append(df.count())
        return whole(df, *more)

    centroids.scanned = watch
    try:
        got = centroids.cluster_vectors(spark.createDataFrame(rows, VECTORS), dim=4, scale=16, k=4, rounds=8).collect()
    finally:
        centroids.scanned = whole
    assert popped[0] == 400 and popped[-1] == 0 and sum(popped[1:]) < 8 * 400 / 2
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_clusters(rows, 4, 16, 4, 8)))


def test_large_components(spark):
    big = [(i, [float(i * 2**20), 1.0]) for i in range(8)]
    got = centroids.cluster_vectors(spark.createDataFrame(big, VECTORS), dim=2, scale=16, k=3, rounds=2)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_clusters(big, 2, 16, 3, 2)))
    with pytest.raises(Exception, match="too large"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [float(MOST), 0.0])], VECTORS), dim=2, scale=16).collect()
    a = np.array([[MOST, -MOST, 3]])
    assert products(a, a)[0, 0] == 2 * MOST**2 + 9


def brute_search(rows, every, k, scale):
    own = [(i, v) for i, v in kept(rows, scale) if i is not None]
    asked = {}
    for i, v in own:
        if i % every == 0:
            asked[i, len(v)] = min(v, asked.get((i, len(v)), v))
    out = []
    for (i, n), q in asked.items():
        near = sorted((-sum(x * y for x, y in zip(q, v)), j) for j, v in own if j != i and len(v) == n)
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize("k,cells,asked", [(5, 1 << 20, 8192), (3, 64, 2), (1000, 256, 4)])
def test_search(spark, monkeypatch, k, cells, asked):
    monkeypatch.setattr(top_k, "SHARD_CELLS", cells)
    monkeypatch.setattr(top_k, "ASKED", asked)
    rows = odd_vectors(6, 80) + [(i, [float(i)] * 3) for i in range(4000, 4020)] + [(9000, []), (9001, []), (10, [5.0] * 6)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("x")).withColumn("a.b", F.lit(1)).withColumn("shard", F.lit(2)).repartition(5)
    got = top_k.search(df, queries="id % 10 = 0", k=k, scale=64)
    assert sorted(map(tuple, got.collect())) == brute_search(rows, 10, k, 64)


def test_trees_hold_all_rows():
    rnd = np.random.default_rng(1)
    for n in (1, 127, 128, 129, 1000):
        v = rnd.integers(-50, 50, (n, 5))
        order, tree = top_k.grown(v)
        leaves = sorted((int(s), int(e)) for s, e, leaf in zip(tree.starts, tree.ends, tree.leaf) if leaf)
        assert sorted(order.tolist()) == list(range(n)) and leaves[0][0] == 0 and leaves[-1][1] == n and all(a[1] == b[0] for a, b in zip(leaves, leaves[1:]))
        for i in np.flatnonzero(tree.ends > tree.starts):
            own = v[order[tree.starts[i] : tree.ends[i]]]
            assert (np.sqrt(((own - tree.centres[i]) ** 2).sum(axis=1)) <= tree.radii[i]).all()


def brute_tree(leaves, arity):
    levels = [leaves]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([sha("".join(x[i : i + arity])) for i in range(0, len(x), arity)])
    return levels


def brute_path(levels, p, arity):
    out = []
    for level in levels[:-1]:
        first = p - p % arity
        run = level[first : first + arity]
        out.append(("".join(run[: p - first]), "".join(run[p - first + 1 :])))
        p //= arity
    return out


def brute_manifest(rows, arity):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, sha("".join(field(r[c]) for c in FIELDS))))
    trees = {g: brute_tree([x[2] for x in sorted(own)], arity) for g, own in groups.items()}
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    upper = brute_tree([trees[g][-1][0] for g in order], arity)
    out = []
    for g, own in groups.items():
        for p, (some, i, h) in enumerate(sorted(own)):
            path = brute_path(trees[g], p, arity) + brute_path(upper, order.index(g), arity)
            out.append((i if some else None, g, h, trees[g][-1][0], upper[-1][0], path))
    return out


@pytest.mark.parametrize("arity,every", [(2, 4), (2, 1), (2, 3), (3, 2), (16, 1)])
def test_manifest(spark, monkeypatch, arity, every):
    rnd = random.Random(11)
    rows = [(i, f"text {i}", rnd.choice(["de", "en", "en", "en"]), rnd.choice(["a", None]), i) for i in range(150)]
    rows += [(1000 + i, "é" * i, f"lang{i}", "s", None) for i in range(23)]  # groups of one
    rows += [(None, None, None, None, None), (None, None, None, None, None), (5, "again", "en", "a", 1), (5, "again", "en", "a", 1), (6, "", "", "", 0), (-3, "x" * 300_000, "de", "a", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumn("tree", F.lit("x")).withColumn("pos", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("H", F.lit(3)).repartition(6)
    monkeypatch.setattr(merkle, "PART_ROWS", 20)
    got = merkle.manifest(df, fields=FIELDS, arity=arity, every=every).withColumn("up", merkle.climbed(F.col("leaf"), F.col("path"))).collect()
    assert all(r.up == r.root for r in got)
    assert sorted(str((r.doc_id, r.lang, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path])) for r in got) == sorted(map(str, brute_manifest(df.collect(), arity)))


def test_tampering_shows(spark):
    rows = [(i, f"t{i}", "en", "s", i) for i in range(37)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    shown = merkle.leaf([F.when(F.col("doc_id") == 20, "other").otherwise(F.col(c)) if c == "text" else F.col(c) for c in FIELDS])
    got = merkle.manifest(df, fields=FIELDS, carry={"shown": shown}).withColumn("up", merkle.climbed(F.col("shown"), F.col("path"))).collect()
    assert [r.doc_id for r in got if r.up != r.root] == [20]


def test_empty_and_lone(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert merkle.manifest(spark.createDataFrame([], schema), fields=FIELDS).count() == 0
    r = merkle.manifest(spark.createDataFrame([(1, None, None, None, None)], schema), fields=FIELDS).first()
    assert r.leaf == sha("1:1----") == r.subroot == r.root and r.path == []

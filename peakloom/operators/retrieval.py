"""Vector retrieval: a stated set of queries against all rows of their partition.

The queries are one a group. `ranked` scores them by counts: a query's positives are ranked among themselves, and rows that
stream past are only counted between them. `distances` lists neighbours, for what needs the list.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peakloom.functions.vectors import cosine_distance, hash_rank, random_hit_chance, unit
from peakloom.operators.sampling import first_by_group
from peakloom.plans.scratch import new_folder, remove

DIGITS = 9


def queries_of(rows: DataFrame, group: str, row_id: str, seed: str, partition: list[str] = ()) -> DataFrame:
    """One row of each group of two or more (of each partition): the one with the smallest hash."""
    by = [*partition, group]
    many = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*by)
    return first_by_group(rows.join(many, by, "left_semi"), by, [hash_rank(seed, F.col(row_id)), F.col(row_id)], 1)


def distances(queries: DataFrame, rows: DataFrame, row_id: str, group: str, vector: str, ppm: float | None = None, mz: str | None = None, charge: str | None = None, same_charge: bool = True, query_vector: str | None = None, block: int = 256, partition: str | None = None, keep: int | None = None) -> DataFrame:
    """(query_id, query_group, id, group, distance): cosine distances, rounded to nine digits, of queries to all other rows.

    With ppm only rows within the tolerance of the query's mz, at the same charge or at another one; with a partition
    column only rows of the query's own. query_vector names another view of the queries than `vector` in the rows. With
    keep, each batch of rows gives a query its `keep` nearest only (by distance, then id), which is all that the nearest of
    all can come from. Queries are broadcast by block of about `block`, and rows stream past it. Rows and queries without a
    vector take no part; all other vectors have one length.
    """
    queries, rows = queries.filter(F.col(query_vector or vector).isNotNull()), rows.filter(F.col(vector).isNotNull())
    part = F.col(partition).cast("string") if partition else F.lit("")
    cols = lambda v: [F.col(row_id).alias("id"), F.col(group).alias("g"), unit(F.col(v)).alias("v"), part.alias("p")]
    extra = [F.col(mz).cast("double").alias("mz"), F.col(charge).alias("z")] if ppm else []
    q, r = queries.select(*cols(query_vector or vector), *extra), rows.select(*cols(vector), *extra)
    blocks = int(np.ceil(queries.count() / block)) or 1
    out = None
    for k in range(blocks):
        own = q.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).toArrow() if blocks > 1 else q.toArrow()
        sent = queries.sparkSession.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q = sent.value
            a = np.array(q.column("v").to_pylist(), float).reshape(q.num_rows, -1)
            qi, qg, qp = q.column("id").combine_chunks(), q.column("g").combine_chunks(), np.array(q.column("p").to_pylist(), object)
            for b in batches:
                v = np.array(b.column(2).to_pylist(), float).reshape(b.num_rows, -1)
                if not q.num_rows or not b.num_rows:
                    continue
                d = np.round(np.maximum(0.0, 1.0 - a @ v.T), DIGITS)
                ids = np.array(b.column(0).to_pylist(), object)
                ok = np.array(qi.to_pylist(), object)[:, None] != ids[None]
                if partition:
                    ok &= qp[:, None] == np.array(b.column(3).to_pylist(), object)[None]
                if ppm:
                    am, bm = np.array(q.column("mz")), b.column(4).to_numpy()
                    az, bz = np.array(q.column("z")), np.array(b.column(5))
                    ok &= (np.abs(bm[None] - am[:, None]) <= am[:, None] * ppm / 1e6) & ((az[:, None] == bz[None]) == same_charge)
                if keep:
                    by_id = np.empty(len(ids), np.int64)
                    by_id[np.argsort(ids, kind="stable")] = np.arange(len(ids))
                    for i in range(len(d)):
                        at = np.flatnonzero(ok[i])
                        if len(at) > keep:
                            ok[i, at[np.lexsort((by_id[at], d[i, at]))[keep:]]] = False
                for first in range(0, len(d), 64):
                    i, j = np.nonzero(ok[first : first + 64])
                    row, col = pa.array(i + first, pa.int64()), pa.array(j, pa.int64())
                    yield pa.RecordBatch.from_arrays([qi.take(row), qg.take(row), b.column(0).take(col), b.column(1).take(col), pa.array(d[i + first, j])], names=["query_id", "query_group", "id", "group", "distance"])

        kinds = {f.name: f.dataType.simpleString() for f in r.schema.fields}
        got = r.mapInArrow(run, f"query_id {kinds['id']}, query_group {kinds['g']}, id {kinds['id']}, group {kinds['g']}, distance double")
        out = got if out is None else out.union(got)
    return out


def ranked_metrics(near: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(query_id, query_group, n, n_positive, ap, rr, hit and recall at each k, chance of a hit) of queries' neighbours by (distance, id)."""
    # A query's neighbours are cut by distance; a cut is numbered on its own and starts from the count of those before it.
    cut = near.withColumn("_cut", F.floor(F.col("distance") * 1024).cast("int"))
    sizes = cut.groupBy("query_id", "_cut").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("query_id").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("query_id", "_cut", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("query_id", "_cut").orderBy("distance", "id"))
    positive = F.col("group") == F.col("query_group")
    ranked = cut.withColumn("_own", own).filter(positive).join(offsets, ["query_id", "_cut"]).withColumn("rank", F.col("_before") + F.col("_own"))
    ranked = ranked.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    totals = near.groupBy("query_id", "query_group").agg(F.count(F.lit(1)).alias("n"))
    at = [F.sum((F.col("rank") <= k).cast("int")).alias(f"_{k}") for k in ks]
    found = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_positive"), F.avg(F.col("k") / F.col("rank")).alias("ap"), (1.0 / F.min("rank")).alias("rr"), *at)
    return _at_ranks(totals.join(found, "query_id"), ks)


def _tallied(sent, parted: bool, ppm: float | None, same_charge: bool):
    """Counts, over a task's rows (id, g, v, p and with ppm mz, z), the negatives between the positives of each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        n = q.num_rows
        if not n:
            return
        a = np.array(q.column("v").to_pylist(), float).reshape(n, -1)
        near = [np.array(x, float) for x in q.column("near").to_pylist()]
        ids = [np.array(x, object) for x in q.column("ids").to_pylist()]
        start = np.cumsum([0, *(len(x) + 1 for x in near)])
        tally = np.zeros(start[-1], np.int64)
        own = {}
        for name in ("query_id", "g", "p"):
            values = q.column(name).to_pylist()
            known = {x: k for k, x in enumerate(dict.fromkeys(values))}
            own[name] = known, np.array([known[x] for x in values], np.int64)
        codes = lambda name, column: np.array([own[name][0].get(x, -1) for x in column.to_pylist()], np.int64)
        if ppm:
            mz, z = np.array(q.column("mz").to_pylist(), float), q.column("z").to_pylist()
        for b in batches:
            if not b.num_rows:
                continue
            v = np.array(b.column(2).to_pylist(), float).reshape(b.num_rows, -1)
            bi, bg, bp = codes("query_id", b.column(0)), codes("g", b.column(1)), codes("p", b.column(3))
            names = np.array(b.column(0).to_pylist(), object)
            if ppm:
                bm = np.array(b.column(4).to_pylist(), float)
                order = np.argsort(bm, kind="stable")
                v, bi, bg, bp, names, bm = v[order], bi[order], bg[order], bp[order], names[order], bm[order]
                bz = np.array(b.column(5).to_pylist(), object)[order]
            for first in range(0, n, 64):
                tile = None if ppm else np.round(np.maximum(0.0, 1.0 - a[first : first + 64] @ v.T), DIGITS)
                for i in range(first, min(first + 64, n)):
                    here = slice(None)
                    if ppm:
                        # A little more than the tolerance is looked up; the exact condition follows.
                        reach = abs(mz[i]) * ppm / 1e6 * (1 + 1e-9) + 1e-9
                        here = slice(*np.searchsorted(bm, [mz[i] - reach, mz[i] + reach + 1e-9]))
                    ok = (bg[here] != own["g"][1][i]) & (bi[here] != own["query_id"][1][i])
                    if parted:
                        ok &= bp[here] == own["p"][1][i]
                    if ppm:
                        ok &= (np.abs(bm[here] - mz[i]) <= mz[i] * ppm / 1e6) & ((bz[here] == z[i]) == same_charge)
                        if z[i] is None or not ok.any():
                            continue
                        ok &= np.array([x is not None for x in bz[here]], bool)
                        d = np.round(np.maximum(0.0, 1.0 - v[here][ok] @ a[i]), DIGITS)
                    else:
                        d = tile[i - first][ok]
                    at, end = np.searchsorted(near[i], d, "left"), np.searchsorted(near[i], d, "right")
                    tied = np.flatnonzero(at < end)
                    if len(tied):
                        others, runs = names[here][ok], at[tied]
                        for lo in np.unique(runs):
                            some = tied[runs == lo]
                            at[some] += np.searchsorted(ids[i][lo : end[some[0]]], others[some])
                    tally[start[i] : start[i + 1]] += np.bincount(at, minlength=len(near[i]) + 1)
        some = np.flatnonzero(tally)
        which = np.searchsorted(start, some, "right") - 1
        taken = pa.array(which, pa.int64())
        yield pa.RecordBatch.from_arrays([q.column("query_id").combine_chunks().take(taken), q.column("slice").combine_chunks().take(taken), pa.array(some - start[which], pa.int64()), pa.array(tally[some])], names=["query_id", "slice", "place", "n"])

    return run


def ranked(queries: DataFrame, rows: DataFrame, row_id: str, group: str, vector: str, *, ks: tuple[int, ...] = (1, 5, 10), ppm: float | None = None, mz: str | None = None, charge: str | None = None, same_charge: bool = True, query_vector: str | None = None, partition: str | None = None, both: bool = False, most_bytes: int = 32 << 20, most_places: int = 1 << 16) -> DataFrame:
    """What ranked_metrics gives of distances, without any list of neighbours: the same columns, a row a query with a positive.

    A query's positives are found by a join on the group, ranked by (distance, id) and cut into slices of at most
    `most_places`. Slices go to all tasks in blocks of about `most_bytes`; a task counts how many of its rows that are no
    positives lie before each place, and tasks' counts are summed. So what is shuffled grows with positives, not with
    queries times rows, and rows are read once a block. A positive's rank is its own place plus the counts up to it.
    Distances, ppm, charges, views and partitions as in distances. both: only queries with a negative, too. Rows without a
    group are negatives of all; rows and queries without a vector, m/z or charge that is asked for take no part. Places
    and counts are written to the shared folder.
    """
    spark = rows.sparkSession
    part = F.col(partition).cast("string") if partition else F.lit("")
    extra = [F.col(mz).cast("double").alias("mz"), F.col(charge).alias("z")] if ppm else []
    asked = [F.col(c).isNotNull() for c in ((mz, charge) if ppm else ())]
    able = lambda df, v: reduce(DataFrame.filter, [F.col(v).isNotNull(), *asked], df)
    cols = lambda v: [F.col(row_id).alias("id"), F.col(group).alias("g"), unit(F.col(v)).alias("v"), part.alias("p"), *extra]
    q = able(queries, query_vector or vector).select(*cols(query_vector or vector)).toDF(*(f"query_{c}" for c in ("id", "g", "v", "p", *(("mz", "z") if ppm else ()))))
    r = able(rows, vector).select(*cols(vector))
    asking, places, slices, counted = (new_folder(spark, f"ranked-{what}") for what in ("queries", "places", "slices", "counts"))

    def stored(df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    q = stored(q, asking)

    on = (F.col("query_g") == F.col("g")) & (F.col("query_id") != F.col("id"))
    if partition:
        on &= F.col("query_p") == F.col("p")
    met = q.join(r, on)
    if ppm:
        met = met.filter((F.abs(F.col("mz") - F.col("query_mz")) <= F.col("query_mz") * ppm / 1e6) & ((F.col("z") == F.col("query_z")) == F.lit(same_charge)))
    met = met.select("query_id", "id", F.round(cosine_distance(F.col("query_v"), F.col("v")), DIGITS).alias("distance"))
    # Places are numbered cut by cut, so a group that a third of all rows have is no single task.
    met = met.withColumn("_cut", F.floor(F.when(F.isnan("distance"), 3.0).otherwise(F.col("distance")) * 4096).cast("int"))
    met = stored(met, places)
    before = Window.partitionBy("query_id").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    cuts = met.groupBy("query_id", "_cut").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("query_id", "_cut").orderBy("distance", "id"))
    placed = met.withColumn("_own", own).join(cuts, ["query_id", "_cut"]).withColumn("k", F.col("_before") + F.col("_own"))
    placed = placed.withColumn("slice", F.floor((F.col("k") - 1) / most_places).cast("long")).select("query_id", "slice", "k", "distance", "id")
    sliced = placed.groupBy("query_id", "slice").agg(F.array_sort(F.collect_list(F.struct("k", "distance", "id"))).alias("x"))
    sliced = sliced.select("query_id", "slice", F.col("x.distance").alias("near"), F.col("x.id").alias("ids"), F.col("x.k").alias("ks")).join(q, "query_id").withColumnsRenamed({f"query_{c}": c for c in ("g", "v", "p", "mz", "z")})
    weight = F.size("near") * (16 + F.coalesce(F.octet_length(F.element_at("ids", 1).cast("string")), F.lit(0))) + F.size("v") * 8 + 128
    sliced = stored(sliced.withColumn("weight", weight), slices)
    for folder in (asking, places):
        remove(spark, folder)
    blocks = -(-(sliced.agg(F.sum("weight")).first()[0] or 1) // most_bytes)
    kind = {f.name: f.dataType.simpleString() for f in sliced.schema.fields}
    for k in range(blocks):
        mine = sliced.drop("ks", "weight").filter(F.pmod(F.xxhash64("query_id", "slice"), F.lit(blocks)) == k).toArrow()  # about most_bytes
        sent = spark.sparkContext.broadcast(mine)
        tallied = r.mapInArrow(_tallied(sent, bool(partition), ppm, same_charge), f"query_id {kind['query_id']}, slice long, place long, n long")
        tallied.groupBy("query_id", "slice", "place").agg(F.sum("n").alias("n")).write.mode("append").parquet(counted)
        sent.destroy()
    counts = spark.read.schema(f"query_id {kind['query_id']}, slice long, place long, n long").parquet(counted)

    # A slice's rows in the order of its places: what was counted before a place, then the place itself.
    key = ["query_id", "slice"]
    at = sliced.select(*key, F.posexplode("ks").alias("place", "k"))
    ahead = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(*key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    ranks = at.join(counts, [*key, "place"], "left").select("query_id", "k", (F.col("k") + ahead).alias("rank"))
    found = ranks.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_positive"), F.avg(F.col("k") / F.col("rank")).alias("ap"), (1.0 / F.min("rank")).alias("rr"), *(F.sum((F.col("rank") <= k).cast("int")).alias(f"_{k}") for k in ks))
    # Every slice meets all negatives; the first one's count for the query.
    others = counts.filter("slice = 0").groupBy("query_id").agg(F.sum("n").alias("_others"))
    found = found.join(others, "query_id", "inner" if both else "left").withColumn("n", F.col("n_positive") + F.coalesce("_others", F.lit(0)))
    groups = sliced.filter("slice = 0").select("query_id", F.col("g").alias("query_group"))
    return _at_ranks(found.join(groups, "query_id"), ks)


def _at_ranks(found: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Queries' counts (n, n_positive, ap, rr and positives up to each k as _k) with hit, recall and chance at each k."""
    hits = [(F.col(f"_{k}") > 0).cast("double").alias(f"hit_at_{k}") for k in ks] + [(F.col(f"_{k}") / F.col("n_positive")).alias(f"recall_at_{k}") for k in ks]
    chance = [random_hit_chance(F.col("n_positive"), F.col("n"), k).alias(f"random_hit_at_{k}") for k in ks]
    return found.select("query_id", "query_group", "n", "n_positive", "ap", "rr", *hits, *chance)


def report(rows: DataFrame, partition: str, group: str, row_id: str, vector: str, seed: str, ks: tuple[int, ...] = (1, 5, 10), **how) -> DataFrame:
    """(partition, metric, value, n): means over a partition's queries, one of each group of two or more rows, and under
    the partition null the mean of the partitions' means. `how` goes to ranked (ppm, mz, charge, same_charge)."""
    from peakloom.operators.metrics import macro

    queries = queries_of(rows, group, row_id, seed, [partition])
    each = ranked(queries, rows, row_id, group, vector, ks=ks, partition=partition, both=bool(how.get("ppm")), **how).join(queries.select(F.col(row_id).alias("query_id"), partition), "query_id")
    names = ["ap", "rr", *(f"{what}_at_{k}" for what in ("hit", "recall", "random_hit") for k in ks)]
    means = each.groupBy(partition).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in names))
    long = means.unpivot([partition, "n"], names, "metric", "value").select(partition, "metric", "value", "n")
    whole = macro(means, [], names).select(F.lit(None).cast(rows.schema[partition].dataType).alias(partition), "metric", F.col("mean").alias("value"), "n")
    return long.union(whole)


def eligible(near: DataFrame) -> DataFrame:
    """Neighbours of queries that have a positive and a negative among them."""
    positive = (F.col("group") == F.col("query_group")).cast("int")
    both = near.groupBy("query_id").agg(F.min(positive).alias("a"), F.max(positive).alias("b")).filter("a < b").select("query_id")
    return near.join(both, "query_id", "left_semi")


def alignment(rows: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """(group, n, mean_cosine, least_cosine) of two views of the same rows."""
    from peakloom.functions.vectors import dot

    c = dot(unit(F.col(a)), unit(F.col(b)))
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean_cosine"), F.min(c).alias("least_cosine"))


def knn_labels(train: DataFrame, test: DataFrame, row_id: str, label: str, vector: str, k: int) -> DataFrame:
    """(id, label, predicted): the label most frequent among the k nearest training rows; ties go to the smallest label."""
    near = distances(test, train, row_id, label, vector, keep=k)
    first = first_by_group(near, ["query_id", "query_group"], [F.col("distance"), F.col("id")], k)
    votes = first.groupBy("query_id", "query_group", "group").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("query_id", "query_group").agg(F.min(F.struct((-F.col("n")).alias("n"), "group")).alias("b"))
    return best.select(F.col("query_id").alias("id"), F.col("query_group").alias("label"), F.col("b.group").alias("predicted"))


def knn_accuracy(train: DataFrame, test: DataFrame, row_id: str, label: str, vector: str, k: int) -> DataFrame:
    """(n, n_right, accuracy) of knn_labels, one row. Fewer than k training rows with a vector stop the job."""
    if k < 1 or train.filter(F.col(vector).isNotNull()).limit(k).count() < k:
        raise ValueError(f"there are fewer than {k} training rows")
    got = knn_labels(train, test, row_id, label, vector, k)
    right = F.coalesce(F.sum(F.col("label").eqNullSafe(F.col("predicted")).cast("long")), F.lit(0).cast("long"))
    return got.agg(F.count(F.lit(1)).alias("n"), right.alias("n_right")).withColumn("accuracy", F.try_divide(F.col("n_right").cast("double"), F.col("n").cast("double")))


def centroids(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, n, centroid): mean of the unit vectors, place by place."""
    long = rows.select(F.col(group).alias("group"), F.posexplode(unit(F.col(vector))).alias("k", "x"))
    mean = long.groupBy("group", "k").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    return mean.groupBy("group").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("centroid"))


def compactness(rows: DataFrame, row_id: str, group: str, vector: str) -> DataFrame:
    """(group, n, radius, within, between, ratio): mean cosine distance to the centroid, over all pairs of different rows,
    and over all pairs of a row with one of another group; within / between, null where the latter is 0 or missing.

    For unit vectors both means follow from the groups' sums: a group's sum S_g and that of all, S, give the mean of
    S_g * (S - S_g) over n_g * (N - n_g) pairs. So no pairs are made or sampled. Works out S, as long as a vector, at once.
    """
    c = centroids(rows, group, vector)
    from peakloom.functions.vectors import cosine_distance, dot

    off = rows.select(F.col(group).alias("group"), unit(F.col(vector)).alias("v")).join(c, "group")
    radius = off.groupBy("group").agg(F.avg(cosine_distance(F.col("v"), unit(F.col("centroid")))).alias("radius"))
    n = F.col("n").cast("double")
    mean_dot = F.try_divide(n * n * dot(F.col("centroid"), F.col("centroid")) - n, n * (n - 1))
    sums = c.select("n", F.posexplode("centroid").alias("k", "x")).groupBy("k").agg(F.sum(F.col("n") * F.col("x")).alias("x"), F.sum("n").alias("n")).orderBy("k").collect()
    whole, total = F.array([F.lit(r.x) for r in sums]), float(sums[0].n if sums else 0)
    rest = F.zip_with(whole, F.col("centroid"), lambda x, y: x - n * y)
    between = F.when(F.lit(total) > n, 1 - n * dot(F.col("centroid"), rest) / (n * (total - n)))
    within = 1 - mean_dot
    return c.join(radius, "group").select("group", "n", "radius", within.alias("within"), between.alias("between"), F.when(between > 0, within / between).alias("ratio"))


def gram(rows: DataFrame, vector: str, center: bool = False) -> tuple[int, np.ndarray]:
    """(rows, WᵀW): each partition sends one matrix as large as the vectors' length squared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, None, None
        for b in batches:
            v = np.array(b.column(0).to_pylist(), float).reshape(b.num_rows, -1)
            if len(v):
                n, s, g = n + len(v), v.sum(0) + (0 if s is None else s), v.T @ v + (0 if g is None else g)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([g.ravel().tolist()])], names=["n", "s", "g"])

    parts = rows.select(F.col(vector).cast("array<double>")).mapInArrow(run, "n long, s array<double>, g array<double>")
    total = parts.groupBy().agg(F.sum("n").alias("n")).first().n or 0
    if not total:
        return 0, np.zeros((0, 0))
    add = lambda c: [r.x for r in parts.select(F.posexplode(c).alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").collect()]  # noqa: E731  as long as a vector, or that squared
    s, g = np.array(add("s")), np.array(add("g"))
    g = g.reshape(len(s), len(s))
    return total, g - np.outer(s, s) / total if center else g


def spectrum_metrics(rows: DataFrame, vector: str) -> dict[str, float]:
    """Of the singular values of all vectors: RankMe, stable rank, condition number, NESum, the eigenvalues' power, self-cluster score."""
    n, g = gram(rows, vector)
    if not n:
        return {"n": 0.0}
    e = np.sort(np.clip(np.linalg.eigvalsh(g), 0, None))[::-1]
    s = np.sqrt(e)
    p = s / s.sum() + 1e-12
    entropy = float(-(p * np.log(p)).sum())
    held = np.arange(1, len(e) + 1)[e > 1e-12]
    slope = float(-np.polyfit(np.log(held), np.log(e[e > 1e-12]), 1)[0]) if len(held) > 1 else float("nan")
    return {"n": float(n), "rankme_entropy": entropy, "rankme": float(np.exp(entropy)), "stable_rank": float(e.sum() / e[0]), "condition": float(s[0] / max(s[-1], 1e-12)), "nesum": float((e / e[0]).sum()), "alpha": slope, "self_cluster": float((g * g).sum())}


def coherence(rows: DataFrame, vector: str, center: bool = True, rank: int | None = None, tolerance: float | None = None) -> dict[str, float]:
    """How far the singular vectors of all rows lean on single rows (left) or components (right): 1 for none.

    left is the largest leverage of a row times rows / rank, right the largest of a component times components / rank.
    Singular values up to `tolerance` (largest times max(rows, components) times the machine's epsilon unless given) do
    not count. Each partition sends the triangle of its QR decomposition, which loses no precision as squares would;
    leverages are taken in a second pass with the right vectors sent out. No rows, or rank 0, give zeros.
    """
    v = rows.select(F.col(vector).cast("array<double>").alias("v")).filter("v is not null")
    length = v.agg(F.max(F.size("v")).alias("d"), F.min(F.size("v")).alias("e"), F.count(F.lit(1)).alias("n")).first()
    none = {"left": 0.0, "right": 0.0, "max": 0.0, "rank": 0.0}
    if not length.n or not length.d:
        return none
    if length.d != length.e:
        raise ValueError("vectors must have one length")
    n, d = length.n, length.d
    mean = np.zeros(d)
    if center:
        for r in v.select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("x")).collect():
            mean[r.k] = r.x

    def numbers(b: pa.RecordBatch) -> np.ndarray:
        return b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)

    def triangles(shift: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r = np.zeros((0, d))
            for b in batches:
                r = np.linalg.qr(np.vstack([r, numbers(b) - shift]), mode="r")
            yield pa.RecordBatch.from_arrays([pa.array(r.tolist(), pa.list_(pa.float64()))], names=["v"])

        return run

    parts = v.mapInArrow(triangles(mean), "v array<double>")
    few = parts.repartition(16).mapInArrow(triangles(np.zeros(d)), "v array<double>").collect()  # at most 16 triangles
    r = np.linalg.qr(np.array([x.v for x in few], float).reshape(-1, d), mode="r")
    _, s, vh = np.linalg.svd(r, full_matrices=False)
    least = s.max(initial=0) * max(n, d) * np.finfo(float).eps if tolerance is None else tolerance
    k = int((s > least).sum()) if rank is None else max(0, min(rank, len(s), n))
    if not k or not s[0]:
        return none
    back = (vh[:k] / s[:k, None]).T

    def leverages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = (numbers(b) - mean) @ back
            yield pa.RecordBatch.from_arrays([pa.array([float((u * u).sum(axis=1).max(initial=0))])], names=["x"])

    left = n / k * v.mapInArrow(leverages, "x double").agg(F.max("x")).first()[0]
    right = d / k * float((vh[:k] ** 2).sum(axis=0).max())
    return {"left": left, "right": right, "max": max(left, right), "rank": float(k)}

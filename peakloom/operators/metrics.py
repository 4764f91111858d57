"""Metrics of scored rows. Running sums over scores go through buckets, so that no task holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peakloom.operators.sampling import cut_edges, with_place
from peakloom.plans.scratch import stored


def cumulative(df: DataFrame, group: list[str], score: str, sums: dict[str, Column], descending: bool, buckets: int | None = None) -> DataFrame:
    """(group, score, each sum's own and cum_ value) by distinct score, running from the best score.

    Equal scores are one step. Scores fall into buckets at approximate quantiles, more of them the more steps there are; a
    bucket starts from the totals of those before it, which are as many as buckets and groups. Unless `buckets` is given,
    the steps are stored in the shared folder first, so that df is worked out once.
    """
    steps = df.groupBy(*group, score).agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    if buckets is None:
        steps = stored(steps, "steps")
    edges = cut_edges(steps, score, buckets)
    steps = with_place(steps, edges, score, "_at").withColumn("_bucket", -F.col("_at") if descending else F.col("_at"))
    totals = steps.groupBy(*group, "_bucket").agg(*(F.sum(k).alias(f"_{k}") for k in sums))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "_bucket", *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums))
    order = F.col(score).desc() if descending else F.col(score).asc()
    own = Window.partitionBy(*group, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = steps.join(offsets, [*group, "_bucket"])
    return out.select(*group, score, *sums, *((F.sum(k).over(own) + F.col(f"_{k}")).alias(f"cum_{k}") for k in sums))


def quantiles(df: DataFrame, group: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """(group, a column for each entry of `at`): exact quantiles with linear interpolation, nulls left out.

    From running counts by distinct value, so that no task or buffer holds a group.
    """
    steps = cumulative(df.filter(F.col(value).isNotNull()), group, value, {"n": F.lit(1).cast("long")}, descending=False)
    total = steps.groupBy(*group).agg((F.sum("n") - 1).alias("_last"))
    steps = steps.join(total, group) if group else steps.join(F.broadcast(total))  # one row
    place = lambda q: F.col("_last") * F.lit(float(q))
    ends = [F.min(F.when(F.col("cum_n") > f(place(q)), F.col(value))).alias(f"_{side}_{k}") for k, q in at.items() for side, f in (("low", F.floor), ("high", F.ceil))]
    found = steps.groupBy(*group).agg(F.first("_last").alias("_last"), *ends)
    part = lambda q: place(q) - F.floor(place(q))
    # Shares of both ends: the median is rounded once, as SQL's is. A low end and a part of the difference round otherwise.
    low, high = (lambda k, side=side: F.col(f"_{side}_{k}").cast("double") for side in ("low", "high"))
    between = lambda k, q: F.when(low(k) == high(k), low(k)).otherwise(low(k) * (1 - part(q)) + high(k) * part(q))
    return found.select(*group, *(between(k, q).alias(k) for k, q in at.items()))


def _with(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    """Both have one row a group."""
    return a.join(b, group) if group else a.crossJoin(F.broadcast(b))


def roc_auc(df: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """(group, n_pos, n_neg, auroc): higher scores mean label 1; ties count half; null where a label is missing.

    Rows whose score is null or NaN have no rank and are left out, as are those without a label.
    """
    fine = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
    steps = cumulative(fine, group, score, {"pos": F.col(label).cast("long"), "neg": (1 - F.col(label)).cast("long")}, descending=True)
    wins = (F.col("cum_neg") - F.col("neg")) * F.col("pos") + F.col("pos") * F.col("neg") / 2.0
    out = steps.groupBy(*group).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(wins).alias("_lost"))
    return out.select(*group, "n_pos", "n_neg", (1 - F.try_divide("_lost", (F.col("n_pos") * F.col("n_neg")).cast("double"))).alias("auroc"))


def average_precision(df: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """(group, average_precision): precision after each distinct score, weighted by its positives."""
    steps = cumulative(df, group, score, {"pos": F.col(label).cast("long"), "neg": (1 - F.col(label)).cast("long")}, descending=True)
    gain = F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return steps.groupBy(*group).agg(F.try_divide(F.sum(gain), F.sum("pos").cast("double")).alias("average_precision"))


def operating_points(df: DataFrame, group: list[str], distance: str, label: str, rates: list[float]) -> DataFrame:
    """(group, fdr, fnr, threshold): the largest distance at which the share of false pairs is at most the rate.

    With balanced labels. The share isn't monotone: the last valid distance counts. None valid: fnr 1, no threshold.
    """
    steps = cumulative(df, group, distance, {"pos": F.col(label).cast("long"), "neg": (1 - F.col(label)).cast("long")}, descending=False)
    total = steps.groupBy(*group).agg(F.sum("pos").alias("_n"))
    share = F.col("cum_neg") / (F.col("cum_pos") + F.col("cum_neg"))
    by_rate = steps.withColumn("fdr", F.explode(F.array(*map(F.lit, rates)))).filter(share <= F.col("fdr"))
    best = by_rate.groupBy(*group, "fdr").agg(F.max(F.struct(distance, "cum_pos")).alias("_best"))
    every = total.withColumn("fdr", F.explode(F.array(*map(F.lit, rates))))
    return every.join(best, [*group, "fdr"], "left").select(*group, "fdr", F.coalesce(1 - F.try_divide("_best.cum_pos", F.col("_n").cast("double")), F.lit(1.0)).alias("fnr"), F.col(f"_best.{distance}").alias("threshold"))


def purity_curve(df: DataFrame, group: list[str], distance: str, label: str, targets: list[float]) -> DataFrame:
    """(group, target, coverage, purity): at the first distance that covers a target share of all pairs."""
    steps = cumulative(df, group, distance, {"pos": F.col(label).cast("long"), "all": F.lit(1).cast("long")}, descending=False)
    total = steps.groupBy(*group).agg(F.sum("all").alias("_n"))
    steps = steps.join(total, group) if group else steps.join(F.broadcast(total))  # one row
    steps = steps.withColumn("coverage", F.col("cum_all") / F.col("_n")).withColumn("purity", F.col("cum_pos") / F.col("cum_all"))
    at = steps.withColumn("target", F.explode(F.array(*map(F.lit, targets)))).filter(F.col("coverage") >= F.col("target"))
    return at.groupBy(*group, "target").agg(F.min(F.struct("coverage", "purity")).alias("_first")).select(*group, "target", "_first.coverage", "_first.purity")


def precision_coverage(df: DataFrame, group: list[str], score: str, correct: str) -> DataFrame:
    """(group, score, n, coverage, precision) by distinct score from the best; null scores come last, as one step."""
    scored = df.withColumn(score, F.coalesce(score, F.lit(float("-inf"))))
    steps = cumulative(scored, group, score, {"hit": F.col(correct).cast("long"), "all": F.lit(1).cast("long")}, descending=True)
    total = steps.groupBy(*group).agg(F.sum("all").alias("_n"))
    steps = steps.join(total, group) if group else steps.join(F.broadcast(total))  # one row
    return steps.select(*group, score, F.col("cum_all").alias("n"), (F.col("cum_all") / F.col("_n")).alias("coverage"), (F.col("cum_hit") / F.col("cum_all")).alias("precision"))


def auc_tie_anchored(df: DataFrame, group: list[str], score: str, correct: str) -> DataFrame:
    """(group, auc_tie_anchored): trapezoids under precision by coverage from the anchor (0, 1); ties are one step.

    A step is known by the running counts before it, so no row needs its neighbour.
    """
    scored = df.withColumn(score, F.coalesce(score, F.lit(float("-inf"))))
    steps = cumulative(scored, group, score, {"hit": F.col(correct).cast("long"), "all": F.lit(1).cast("long")}, descending=True)
    prev_all, prev_hit = F.col("cum_all") - F.col("all"), F.col("cum_hit") - F.col("hit")
    height = (F.col("cum_hit") / F.col("cum_all") + F.when(prev_all > 0, prev_hit / prev_all).otherwise(1.0)) / 2
    return steps.groupBy(*group).agg((F.sum(F.col("all") * height) / F.sum("all")).alias("auc_tie_anchored"))


def auc_rowwise(df: DataFrame, group: list[str], score: str, order: str, correct: str) -> DataFrame:
    """(group, auc_rowwise): trapezoids row by row (ties by `order`), without an anchor, over the full count of rows.

    Rows that tie are numbered within their score; the counts before it come from the distinct scores.
    """
    scored = df.withColumn(score, F.coalesce(score, F.lit(float("-inf"))))
    steps = cumulative(scored, group, score, {"hit": F.col(correct).cast("long"), "all": F.lit(1).cast("long")}, descending=True)
    w = Window.partitionBy(*group, score).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = scored.select(*group, score, F.col(correct).cast("long").alias("_own"), F.sum(F.col(correct).cast("long")).over(w).alias("_h"), F.count(F.lit(1)).over(w).alias("_k")).join(steps, [*group, score])
    n, h = F.col("cum_all") - F.col("all") + F.col("_k"), F.col("cum_hit") - F.col("hit") + F.col("_h")
    area = F.when(n > 1, (h / n + (h - F.col("_own")) / (n - 1)) / 2).otherwise(0.0)
    return rows.groupBy(*group).agg((F.sum(area) / F.count(F.lit(1))).alias("auc_rowwise"))


def binary_scores(df: DataFrame, group: list[str], score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """(group, accuracy, precision, recall, f1) at score > threshold; 0 where nothing is divided."""
    p = (F.col(score) > threshold).cast("int")
    y = F.col(label).cast("int")
    c = df.groupBy(*group).agg(F.sum(p * y).alias("tp"), F.sum(p * (1 - y)).alias("fp"), F.sum((1 - p) * y).alias("fn"), F.count(F.lit(1)).alias("n"), F.sum((p == y).cast("int")).alias("ok"))
    over = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(*group, over(F.col("ok"), F.col("n")).alias("accuracy"), over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"), over(2 * tp, 2 * tp + fp + fn).alias("f1"))


def regression_scores(df: DataFrame, group: list[str], predicted: str, target: str) -> DataFrame:
    """(group, n, mae, dt95, pearson, r2): dt95 is the 95th percentile of the absolute error."""
    p, t = F.col(predicted), F.col(target)
    df = df.withColumn("_off", F.abs(p - t))
    means = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_off").alias("mae"), F.corr(p, t).alias("pearson"), F.sum((p - t) * (p - t)).alias("_sse"), (F.var_pop(t) * F.count(F.lit(1))).alias("_sst")
    )
    full = _with(means, quantiles(df, group, "_off", {"dt95": 0.95}), group)
    return full.select(*group, "n", "mae", "dt95", "pearson", (1 - F.try_divide("_sse", "_sst")).alias("r2"))


def macro(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by, metric, mean, std, n) over the partitions where the metric is a finite number."""
    long = df.unpivot(by, metrics, "metric", "value") if by else df.unpivot([], metrics, "metric", "value")
    fine = long.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    return fine.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("n"))


def distribution(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, n, min, max, mean, p25, median, p75, p90), exact percentiles with linear interpolation."""
    means = df.groupBy(*group).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    return _with(means, quantiles(df, group, value, {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}), group)


def replicate_spread(df: DataFrame, group: str, run: str, value: str) -> DataFrame:
    """(n_groups, mean, p95) of absolute differences from the group's median, over groups that two runs or more hold."""
    many = df.groupBy(group).agg(F.count_distinct(run).alias("_runs")).filter("_runs >= 2").select(group)
    medians = quantiles(df, [group], value, {"_m": 0.5}).join(many, group, "left_semi")
    off = df.join(medians, group).select(group, F.abs(F.col(value) - F.col("_m")).alias("d"))
    return _with(off.agg(F.count_distinct(group).alias("n_groups"), F.avg("d").alias("mean")), quantiles(off, [], "d", {"p95": 0.95}), [])


def spearman(df: DataFrame, group: list[str], a: str, b: str, row_id: str) -> DataFrame:
    """(group, n, spearman): correlation of ordinal ranks, ties by id. Ranks are numbered in cuts, not in one window."""
    ranked = ordinal_ranks(ordinal_ranks(df.select(*group, a, b, row_id), group, a, row_id, "_ra"), group, b, row_id, "_rb")
    return ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.corr(F.col("_ra").cast("double"), F.col("_rb").cast("double")).alias("spearman"))


def ordinal_ranks(df: DataFrame, group: list[str], value: str, row_id: str, into: str, buckets: int | None = None) -> DataFrame:
    """df with `into`: places from 1 by (value, id) in each group. Null values come first, NaN after all numbers."""
    edges = cut_edges(df, value, buckets)
    cut = with_place(df, edges, value, "_cut")
    sizes = cut.groupBy(*group, "_cut").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, "_cut", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*group, "_cut").orderBy(value, row_id))
    return cut.withColumn("_own", own).join(offsets, [*group, "_cut"]).withColumn(into, F.col("_before") + F.col("_own")).drop("_cut", "_own", "_before")


def contrastive_loss(rows: DataFrame, batch: str, row_id: str, label: str, vector: str, temperature: float) -> DataFrame:
    """(batch, n, n_valid, loss): supervised contrastive loss of each batch's rows; rows without a positive don't count.

    Batches are the caller's, and small: a row meets the others of its batch.
    """
    from peakloom.functions.vectors import dot, unit

    side = lambda s: rows.select(F.col(batch).alias("b"), F.col(row_id).alias(f"{s}i"), F.col(label).alias(f"{s}y"), unit(F.col(vector)).alias(f"{s}v"))
    pairs = side("l").join(side("r"), "b").filter("li <> ri").select("b", "li", (dot(F.col("lv"), F.col("rv")) / temperature).alias("s"), (F.col("ly") == F.col("ry")).alias("same"))
    each = pairs.groupBy("b", "li").agg(F.log(F.sum(F.exp("s"))).alias("z"), F.avg(F.when(F.col("same"), F.col("s"))).alias("p"))
    return each.groupBy(F.col("b").alias(batch)).agg(F.count(F.lit(1)).alias("n"), F.count("p").alias("n_valid"), F.avg(F.when(F.col("p").isNotNull(), F.col("z") - F.col("p"))).alias("loss"))


def silhouette(rows: DataFrame, row_id: str, label: str, vector: str, most: int, seed: str) -> DataFrame:
    """(label, n, silhouette) with cosine distances, over the `most` rows of smallest hash, all of which meet each other."""
    from peakloom.functions.vectors import cosine_distance, hash_rank, unit

    few = rows.orderBy(hash_rank(seed, F.col(row_id)), row_id).limit(most).select(F.col(row_id).alias("i"), F.col(label).alias("y"), unit(F.col(vector)).alias("v"))
    # All meet all, in tasks of their own: each row's block meets every row.
    blocks = 16
    few = few.withColumn("block", F.pmod(F.xxhash64("i"), F.lit(blocks)))
    other = few.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.col("i").alias("j"), F.col("y").alias("w"), F.col("v").alias("u"))
    mean = few.join(other, "block").filter("i <> j").groupBy("i", "y", "w").agg(F.avg(cosine_distance(F.col("v"), F.col("u"))).alias("d"))
    each = mean.groupBy("i", "y").agg(F.max(F.when(F.col("w") == F.col("y"), F.col("d"))).alias("a"), F.min(F.when(F.col("w") != F.col("y"), F.col("d"))).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return each.groupBy(F.col("y").alias(label)).agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("silhouette"))


def flattened(report: DataFrame, by: list[str]) -> DataFrame:
    """(by, metric, value): a wide report, structs included, as one row a finite number; nested names are joined by "/"."""
    def leaves(schema, path: str = "", name: str = ""):
        for f in schema.fields:
            at, full = f"{path}`{f.name}`", f"{name}{f.name}"
            if hasattr(f.dataType, "fields"):
                yield from leaves(f.dataType, f"{at}.", f"{full}/")
            elif full not in by and f.dataType.typeName() in ("double", "float", "long", "integer", "short", "decimal", "boolean"):
                yield at, full

    cells = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("value")) for c, n in leaves(report.schema)))
    rows = report.select(*by, F.explode(cells).alias("x")).select(*by, "x.metric", "x.value")
    return rows.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))


def thresholds(df: DataFrame, group: list[str], score: str, correct: str, n_total: str, at: list[float]) -> DataFrame:
    """(group, threshold, precision, recall) of residues whose score is above each threshold; n_total: column or expression
    of the true residues' number, the same in all rows of a group. Null where nothing is above it."""
    c = df.groupBy(*group).agg(
        F.max(F.expr(n_total)).alias("_n"), *(F.sum((F.col(score) > t).cast("long")).alias(f"_all_{k}") for k, t in enumerate(at)), *(F.sum(((F.col(score) > t) & F.col(correct).cast("boolean")).cast("long")).alias(f"_ok_{k}") for k, t in enumerate(at))
    )
    cells = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.try_divide(F.col(f"_ok_{k}").cast("double"), F.col(f"_all_{k}").cast("double")).alias("precision"), F.try_divide(F.col(f"_ok_{k}").cast("double"), F.col("_n").cast("double")).alias("recall")) for k, t in enumerate(at)))
    return c.select(*group, F.explode(cells).alias("x")).select(*group, "x.*")


def array_sums(df: DataFrame, group: list[str], values: str) -> DataFrame:
    """(group, sums): arrays of counts added up place by place."""
    long = df.select(*group, F.posexplode(values).alias("k", "x")).groupBy(*group, "k").agg(F.sum("x").alias("x"))
    return long.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("sums"))


def pair_report(pairs: DataFrame, group: list[str], distance: str, label: str, rates: tuple[float, ...] = (0.01, 0.05, 0.1), targets: tuple[float, ...] = (0.1, 0.5)) -> DataFrame:
    """(group, metric, value): AUC, average precision, false negatives and threshold at each rate, purity at each coverage.

    Labels must be as many of one kind as of the other in each group; else the job stops.
    """
    scored = pairs.select(*group, F.col(distance).alias("_d"), (-F.col(distance)).alias("_s"), F.col(label).cast("int").alias("_y"))
    auc, ap = roc_auc(scored, group, "_s", "_y"), average_precision(scored, group, "_s", "_y")
    uneven = F.when(F.col("n_pos") != F.col("n_neg"), F.raise_error(F.lit("labels must be 1:1")).cast("double")).otherwise(F.col("auroc"))
    parts = [auc.select(*group, F.lit("auc").alias("metric"), uneven.alias("value")), ap.select(*group, F.lit("average_precision").alias("metric"), F.col("average_precision").alias("value"))]
    points = operating_points(scored, group, "_d", "_y", list(rates))
    name = lambda what, c: F.concat(F.lit(f"{what}_at_"), F.regexp_replace(F.col(c).cast("string"), r"\.", "p")).alias("metric")
    parts += [points.select(*group, name("fnr", "fdr"), F.col("fnr").alias("value")), points.select(*group, name("threshold", "fdr"), F.col("threshold").alias("value"))]
    parts.append(purity_curve(scored, group, "_d", "_y", list(targets)).select(*group, name("purity", "target"), F.col("purity").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out

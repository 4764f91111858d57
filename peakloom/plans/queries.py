"""The operators over the given tables, each with equivalent SQL where SQL expresses it.

Stand-ins: an order is a spectrum, its lines are the peaks (extended price is m/z, quantity is intensity), its total
price the precursor's m/z, its customer the label, its priority the partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peakloom.functions import peaks, text, vectors
from peakloom.operators import dedup, joins, metrics, retrieval, sampling, sequences
from peakloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(x, name: str | None = None):
    c = F.col(x) if isinstance(x, str) else x
    return F.round(c, 6).alias(name or x)


def spectra(spark: SparkSession, d: str) -> DataFrame:
    """spectrum_id, peaks by line number, precursor_mz, charge (2 to 4), label, partition."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_extendedprice").alias("mz"), F.col("l_quantity").alias("intensity")))).alias("lines"))
    p = F.transform("lines", lambda x: F.struct(x["mz"].alias("mz"), x["intensity"].alias("intensity"))).alias("peaks")
    return lines.join(precursors(spark, d), F.col("l_orderkey") == F.col("spectrum_id")).select("spectrum_id", p, "precursor_mz", "charge", "label", "partition")


def precursors(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("spectrum_id"), F.col("o_totalprice").alias("precursor_mz"), (F.col("o_orderkey") % 3 + 2).cast("int").alias("charge"), F.col("o_custkey").alias("label"), F.col("o_orderpriority").alias("partition"))


def peak_sums(df: DataFrame, column: str = "peaks") -> DataFrame:
    """spectrum_id, and what tells one peak list from another: count, sums, and a sum weighted by place."""
    df, p = df.select("spectrum_id", F.col(column).alias("p")), F.col("p")
    total = lambda f: F.aggregate(F.transform(p, f), F.lit(0.0), lambda a, x: a + x)
    return df.select(
        "spectrum_id", F.size(p).cast("long").alias("n_peaks"), F.round(total(lambda x: x["mz"]), 7).alias("sum_mz"), F.round(total(lambda x: x["intensity"]), 7).alias("sum_intensity"), F.round(total(lambda x, i: x["intensity"] * (i + 1)), 7).alias("placed_intensity")
    )


PEAKS_SQL = """
    WITH p AS (SELECT l_orderkey AS spectrum_id, l_extendedprice AS mz, l_quantity AS intensity,
                      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_quantity) AS pos
               FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
    ids AS (SELECT DISTINCT spectrum_id FROM p), {steps}
    SELECT spectrum_id, count(mz) AS n_peaks, round(coalesce(sum(mz), 0), 7) AS sum_mz, round(coalesce(sum(intensity), 0), 7) AS sum_intensity,
           round(coalesce(sum(intensity * no), 0), 7) AS placed_intensity
    FROM ids LEFT JOIN (SELECT spectrum_id, mz, intensity, row_number() OVER (PARTITION BY spectrum_id ORDER BY {order}) AS no FROM {last}) USING (spectrum_id)
    GROUP BY spectrum_id"""


def peaks_sql(steps: str, last: str, order: str = "pos") -> str:
    return PEAKS_SQL.format(steps=steps, last=last, order=order)


@query(peaks_sql("t AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, pos) AS k FROM p), s AS (SELECT * FROM t WHERE k <= 3)", "s"))
def peaks_topn(spark, d):
    """The three strongest peaks in the spectrum's order."""
    return peak_sums(spectra(spark, d).withColumn("peaks", peaks.strongest(F.col("peaks"), 3)))


@query(peaks_sql("t AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, pos) AS k FROM p), s AS (SELECT * FROM t WHERE k <= 3)", "s", "k"))
def peaks_by_intensity(spark, d):
    """The three strongest peaks by descending intensity."""
    return peak_sums(spectra(spark, d).withColumn("peaks", peaks.strongest(F.col("peaks"), 3, in_order=False)))


@query(peaks_sql("w AS (SELECT * FROM p WHERE mz BETWEEN 5000 AND 60000 AND intensity >= 5), s AS (SELECT spectrum_id, pos, mz, intensity / (max(intensity) OVER (PARTITION BY spectrum_id) + 1e-12) AS intensity FROM w)", "s"))
def peaks_window_basepeak(spark, d):
    """Peaks of an m/z and intensity window over the base peak."""
    return peak_sums(spectra(spark, d).withColumn("peaks", peaks.to_base_peak(peaks.windowed(F.col("peaks"), 5000, 60000, 5))))


@query(peaks_sql(
    "w AS (SELECT p.*, o_totalprice AS pm FROM p JOIN orders ON spectrum_id = o_orderkey WHERE mz BETWEEN 5000 AND 100000), c AS (SELECT *, max(intensity) OVER (PARTITION BY spectrum_id) AS top FROM w WHERE abs(mz - pm) > 2000), "
    "t AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, pos) AS k FROM c WHERE intensity > 0.1 * top), "
    "s AS (SELECT spectrum_id, pos, mz, sqrt(intensity) / (sum(sqrt(intensity)) OVER (PARTITION BY spectrum_id) + 1e-11) AS intensity FROM t WHERE k <= 4)", "s"))
def peaks_search_filter(spark, d):
    """Window, precursor removal, relative intensity, strongest peaks, shares of roots."""
    return peak_sums(spectra(spark, d).withColumn("peaks", peaks.search_filter(F.col("peaks"), F.col("precursor_mz"), 5000, 100000, 2000, 0.1, 4)))


@query(peaks_sql(
    "o AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY mz, intensity) AS g FROM p), "
    "l AS (SELECT *, CASE WHEN mz - lag(mz) OVER (PARTITION BY spectrum_id ORDER BY g) <= mz * 0.05 THEN 0 ELSE 1 END AS new FROM o), "
    "c AS (SELECT *, sum(new) OVER (PARTITION BY spectrum_id ORDER BY g) AS cluster FROM l), "
    "s AS (SELECT spectrum_id, cluster AS pos, CASE WHEN sum(intensity) > 0 THEN sum(mz * intensity) / sum(intensity) ELSE avg(mz) END AS mz, sum(intensity) AS intensity FROM c GROUP BY spectrum_id, cluster)", "s"))
def peaks_ppm_merge(spark, d):
    """Neighbouring peaks joined by single linkage."""
    return peak_sums(spectra(spark, d).withColumn("peaks", peaks.merged(F.col("peaks"), 50_000)))


@query("""
    WITH b AS (SELECT l_orderkey AS spectrum_id, greatest(0, least(31, ceil(l_extendedprice / (105000.0 / 32))::INT - 1)) AS bin, sum(l_quantity) AS x FROM lineitem
               WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY ALL),
    n AS (SELECT *, x / max(x) OVER (PARTITION BY spectrum_id) AS y FROM b)
    SELECT spectrum_id, count(*) AS n_held, round(sum(y), 6) AS total, round(sum(y * (bin + 1)), 6) AS placed FROM n GROUP BY spectrum_id""")
def peaks_binned(spark, d):
    """Intensities in 32 bins, over the largest."""
    df = spectra(spark, d).select("spectrum_id", peaks.binned(F.col("peaks"), 105000.0, 32).alias("v"))
    total = lambda f: F.aggregate(F.transform("v", f), F.lit(0.0), lambda a, x: a + x)
    return df.select("spectrum_id", F.size(F.filter("v", lambda x: x > 0)).cast("long").alias("n_held"), r6(total(lambda x: x), "total"), r6(total(lambda x, i: x * (i + 1)), "placed"))


@query(peaks_sql(
    "t AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, pos) AS k FROM p WHERE mz BETWEEN 3000 AND 90000 AND intensity >= 10), "
    "u AS (SELECT spectrum_id, pos, mz / 90000 AS mz, sqrt(intensity) / sqrt(sum(intensity) OVER (PARTITION BY spectrum_id)) AS intensity FROM t WHERE k <= 3), "
    "s AS (SELECT * FROM u UNION ALL SELECT spectrum_id, 1, 0.0, 1.0 FROM ids WHERE spectrum_id NOT IN (SELECT spectrum_id FROM u))", "s"))
def peaks_released_model(spark, d):
    """Preprocessing of a released model: floor, strongest, roots of unit length, sentinel."""
    return peak_sums(spectra(spark, d).withColumn("peaks", peaks.released_model_peaks(F.col("peaks"), 3000, 90000, 10, 3)))


@query("""
    WITH w AS (SELECT l_orderkey AS spectrum_id, l_quantity AS i,
                      l_extendedprice AS mz, o_totalprice AS pm, o_orderkey % 3 + 2 AS z FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE abs(l_extendedprice - o_totalprice) <= 20000)
    SELECT o_orderkey AS spectrum_id, round(sum(CASE WHEN len(list_filter(range(4), lambda k: abs(mz - (pm + k * 1.0033548 / z)) <= (pm + k * 1.0033548 / z) * 0.05)) > 0 THEN i ELSE 0 END) / sum(i), 6) AS purity
    FROM orders LEFT JOIN w ON o_orderkey = spectrum_id WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY o_orderkey""")
def window_purity(spark, d):
    """Share of the isolation window's intensity at the precursor's isotope places."""
    return spectra(spark, d).select("spectrum_id", r6(peaks.window_purity(F.col("peaks"), F.col("precursor_mz"), F.col("charge"), 20000, 50_000), "purity"))


@query(peaks_sql(
    "o AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY mz, intensity) AS g FROM p WHERE intensity > 0), "
    "r AS (SELECT spectrum_id, g, 1 AS cluster, mz, intensity FROM o WHERE g = 1 UNION ALL "
    "SELECT o.spectrum_id, o.g, CASE WHEN o.mz - r.mz <= o.mz * 0.05 THEN r.cluster ELSE r.cluster + 1 END, "
    "CASE WHEN o.mz - r.mz <= o.mz * 0.05 THEN (r.mz * r.intensity + o.mz * o.intensity) / (r.intensity + o.intensity) ELSE o.mz END, "
    "CASE WHEN o.mz - r.mz <= o.mz * 0.05 THEN r.intensity + o.intensity ELSE o.intensity END FROM r JOIN o ON o.spectrum_id = r.spectrum_id AND o.g = r.g + 1), "
    "s AS (SELECT spectrum_id, cluster AS pos, mz, intensity FROM (SELECT *, max(g) OVER (PARTITION BY spectrum_id, cluster) AS last FROM r) WHERE g = last)", "s").replace("WITH p AS", "WITH RECURSIVE p AS"))
def peaks_running_merge(spark, d):
    """Peaks joined while they lie near their cluster's centroid so far."""
    return peak_sums(spectra(spark, d).withColumn("peaks", peaks.running_merge(F.col("peaks"), 50_000)))


@query()
def peaks_augmented(spark, d):
    """Seeded crops: a run of neighbours, an even subset, and one weighted by intensity."""
    key = F.concat_ws("|", F.lit("seed 1"), F.col("spectrum_id"))
    df = spectra(spark, d)
    n = peaks.crop_size(F.col("peaks"), 0.6)
    return df.select("spectrum_id", n.alias("n"), peaks.random_window(F.col("peaks"), key, 0.6).alias("run"), peaks.uniform_subset(F.col("peaks"), key, n).alias("subset"), peaks.weighted_subset(F.col("peaks"), key, n).alias("weighted"))


@query("""
    SELECT a.o_orderkey AS spectrum_id, count(*) AS n_neighbours, round(sum(abs(b.o_totalprice - a.o_totalprice) / a.o_totalprice * 1e6), 4) AS sum_ppm
    FROM orders a JOIN orders b ON a.o_orderpriority = b.o_orderpriority AND a.o_orderkey % 3 = b.o_orderkey % 3 AND a.o_orderkey <> b.o_orderkey AND abs(b.o_totalprice - a.o_totalprice) <= a.o_totalprice * 200 / 1e6
    GROUP BY a.o_orderkey""")
def ppm_neighbours(spark, d):
    """Spectra within 200 ppm at the same charge and partition."""
    p = precursors(spark, d)
    a, b = p.select(*(F.col(c).alias(f"a_{c}") for c in p.columns)), p.select(*(F.col(c).alias(f"b_{c}") for c in p.columns))
    near = joins.ppm_join(a, b, F.col("a_precursor_mz"), F.col("b_precursor_mz"), 200, [(F.col("a_partition"), F.col("b_partition")), (F.col("a_charge"), F.col("b_charge"))], F.col("a_spectrum_id") != F.col("b_spectrum_id"))
    return near.groupBy(F.col("a_spectrum_id").alias("spectrum_id")).agg(F.count(F.lit(1)).alias("n_neighbours"), F.round(F.sum(F.abs(F.col("b_precursor_mz") - F.col("a_precursor_mz")) / F.col("a_precursor_mz") * 1e6), 4).alias("sum_ppm"))


@query("""
    WITH h AS (SELECT DISTINCT a.o_orderkey AS k FROM orders a JOIN orders b ON a.o_orderkey % 3 = b.o_orderkey % 3 AND a.o_custkey <> b.o_custkey AND abs(b.o_totalprice - a.o_totalprice) <= a.o_totalprice * 10 / 1e6)
    SELECT o_orderpriority AS partition, count(*) AS n, sum((k IS NOT NULL)::INT)::BIGINT AS n_hard FROM orders LEFT JOIN h ON o_orderkey = k GROUP BY o_orderpriority""")
def hard_negative_coverage(spark, d):
    """How many spectra have one of another label within 10 ppm at the same charge."""
    df = joins.with_neighbour(precursors(spark, d), "spectrum_id", "precursor_mz", "charge", "label", 10)
    return df.groupBy("partition").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("has_hard_negative").cast("long")).alias("n_hard"))


@query("""
    WITH p AS (SELECT o_orderkey AS id, o_custkey AS label, o_totalprice AS mz, o_orderkey % 3 + 2 AS z FROM orders)
    SELECT a.id AS left_id, b.id AS right_id, round(abs(a.mz - b.mz) / ((a.mz + b.mz) / 2) * 1e6, 4) AS ppm,
           NOT (a.z = b.z AND abs(a.mz - b.mz) < (a.mz + b.mz) / 2 * 5000 / 1e6)
           AND NOT (abs(a.z * (a.mz - 1.00727646688) - b.z * (b.mz - 1.00727646688)) < (a.z * (a.mz - 1.00727646688) + b.z * (b.mz - 1.00727646688)) / 2 * 5000 / 1e6) AS may_mix
    FROM p a JOIN p b ON a.label = b.label AND a.id < b.id""")
def positive_pairs(spark, d):
    """All pairs of a label's spectra, with their distance and whether one may be mixed into the other."""
    rows = precursors(spark, d)
    pairs = joins.endpoints(joins.pairs_in_groups(rows, ["label"], "spectrum_id", "p").drop("label"), rows, "spectrum_id", ["precursor_mz", "charge"])
    a, b = F.col("left_precursor_mz"), F.col("right_precursor_mz")
    return pairs.select("left_id", "right_id", F.round(F.abs(a - b) / ((a + b) / 2) * 1e6, 4).alias("ppm"), joins.distractor_ok((a, F.col("left_charge")), (b, F.col("right_charge")), 5000).alias("may_mix"))


UNIT_SQL = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
SHA = "sha256(concat_ws(chr(31), {}))"


@query(f"""
    WITH {UNIT_SQL},
    q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {SHA.format("'0', vec_id::VARCHAR")}, vec_id) AS no, count(*) OVER (PARTITION BY label) AS n FROM v) WHERE no = 1 AND n > 1),
    near AS (SELECT q.vec_id AS query_id, q.label AS query_label, v.vec_id, v.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(greatest(0, 1 - list_cosine_similarity(q.e, v.e)), 9), v.vec_id) AS rank
             FROM q, v WHERE q.vec_id <> v.vec_id),
    hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM near WHERE label = query_label)
    SELECT query_id, query_label AS label, count(*) AS n_positive, round(avg(k / rank), 6) AS ap, round(1.0 / min(rank), 6) AS rr, (count(*) FILTER (rank <= 5) > 0)::INT::DOUBLE AS hit_at_5, round(count(*) FILTER (rank <= 10) / count(*), 6) AS recall_at_10
    FROM hits GROUP BY query_id, query_label""")
def retrieval_map(spark, d):
    """Average precision, reciprocal rank, hits and recall of one query a label against all vectors."""
    rows = table(spark, d, "embeddings")
    m = retrieval.ranked(retrieval.queries_of(rows, "label", "vec_id", "0"), rows, "vec_id", "label", "embedding")
    return m.select("query_id", F.col("query_group").alias("label"), "n_positive", r6("ap"), r6("rr"), "hit_at_5", r6("recall_at_10"))


@query(f"""
    WITH {UNIT_SQL},
    near AS (SELECT q.vec_id, q.label, t.label AS g, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(greatest(0, 1 - list_cosine_similarity(q.e, t.e)), 9), t.vec_id) AS rank FROM v q, v t WHERE q.vec_id % 100 = 0 AND q.vec_id <> t.vec_id),
    votes AS (SELECT vec_id, label, g, count(*) AS n FROM near WHERE rank <= 10 GROUP BY ALL)
    SELECT vec_id AS id, label, g AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, g) AS no FROM votes) WHERE no = 1""")
def knn_accuracy(spark, d):
    """The label that ten nearest neighbours vote for; queries are the ids divisible by 100, against all other rows."""
    rows = table(spark, d, "embeddings")
    return retrieval.knn_labels(rows, rows.filter("vec_id % 100 = 0"), "vec_id", "label", "embedding", 10)


@query(f"""
    WITH {UNIT_SQL},
    u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
    c AS (SELECT label, k, avg(x) AS x FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS k FROM u) GROUP BY ALL),
    m AS (SELECT label, list(x ORDER BY k) AS c FROM c GROUP BY label),
    r AS (SELECT u.label, count(*) AS n, avg(greatest(0, 1 - list_cosine_similarity(e, c))) AS radius FROM u JOIN m USING (label) GROUP BY u.label),
    w AS (SELECT a.label, avg(1 - list_dot_product(a.e, b.e)) AS within FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.label),
    o AS (SELECT a.label, avg(1 - list_dot_product(a.e, b.e)) AS between_ FROM u a JOIN u b ON a.label <> b.label GROUP BY a.label)
    SELECT r.label AS "group", n, round(radius, 6) AS radius, round(within, 6) AS within, round(between_, 6) AS "between", round(within / between_, 6) AS ratio FROM r LEFT JOIN w USING (label) LEFT JOIN o USING (label)""")
def compactness(spark, d):
    """Distance to the centroid, mean distance of a label's vectors to each other and to all others."""
    return retrieval.compactness(table(spark, d, "embeddings"), "vec_id", "label", "embedding").select("group", "n", r6("radius"), r6("within"), r6("between"), r6("ratio"))


@query()
def embedding_spectrum(spark, d):
    """Numbers from the singular values of all vectors."""
    got = retrieval.spectrum_metrics(table(spark, d, "embeddings"), "embedding")
    return spark.createDataFrame([(k, float(v)) for k, v in got.items()], "metric string, value double")


def scored_pairs(spark, d) -> DataFrame:
    """Vectors with those one to five ids on: whether labels agree, and the distance to four digits; balanced by steps."""
    v = table(spark, d, "embeddings").select("vec_id", "label", vectors.unit(F.col("embedding")).alias("v"))
    a = v.select(F.col("vec_id").alias("left_id"), F.col("label").alias("la"), F.col("v").alias("va"), F.explode(F.array(*map(F.lit, range(1, 6)))).alias("step"))
    b = v.select(F.col("vec_id").alias("right_id"), F.col("label").alias("lb"), F.col("v").alias("vb"))
    pairs = a.join(b, F.col("left_id") + F.col("step") == F.col("right_id"))
    rows = pairs.select("step", "left_id", F.concat_ws("-", "left_id", "right_id").alias("pair_id"), (F.col("la") == F.col("lb")).cast("int").alias("label"), F.round(vectors.cosine_distance(F.col("va"), F.col("vb")), 4).alias("distance"))
    return sampling.balanced(rows, ["step"], "label", "pair_id", "pairs")


PAIRS_SQL = f"""
    {UNIT_SQL},
    pr AS (SELECT b.vec_id - a.vec_id AS step, a.vec_id || '-' || b.vec_id AS pair_id, (a.label = b.label)::INT AS label, round(greatest(0, 1 - list_cosine_similarity(a.e, b.e)), 4) AS distance FROM v a JOIN v b ON b.vec_id - a.vec_id BETWEEN 1 AND 5),
    ct AS (SELECT step, min(n) AS least FROM (SELECT step, label, count(*) AS n FROM pr GROUP BY ALL) GROUP BY step HAVING count(*) = 2),
    pairs AS (SELECT * FROM (SELECT pr.*, least, row_number() OVER (PARTITION BY step, label ORDER BY {SHA.format("'pairs', pair_id")}, pair_id) AS no FROM pr JOIN ct USING (step)) WHERE no <= least)"""


@query(f"""
    WITH {PAIRS_SQL},
    r AS (SELECT *, rank() OVER (PARTITION BY step ORDER BY distance DESC) + (count(*) OVER (PARTITION BY step, distance) - 1) / 2.0 AS rk FROM pairs),
    auc AS (SELECT step, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, (sum(rk) FILTER (label = 1) - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) AS auroc FROM r GROUP BY step),
    g AS (SELECT step, distance, sum(label) AS pos, count(*) AS n FROM pairs GROUP BY ALL),
    c AS (SELECT *, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM g WINDOW w AS (PARTITION BY step ORDER BY distance)),
    ap AS (SELECT step, sum(pos * cp / cn) / sum(pos) AS ap FROM c GROUP BY step)
    SELECT step, n_pos, n_neg, round(auroc, 6) AS auroc, round(ap, 6) AS average_precision FROM auc JOIN ap USING (step)""")
def pair_auc_ap(spark, d):
    """Area under the ROC curve with ties, and average precision, of balanced pairs."""
    rows = scored_pairs(spark, d).withColumn("score", -F.col("distance"))
    return metrics.roc_auc(rows, ["step"], "score", "label").join(metrics.average_precision(rows, ["step"], "score", "label"), "step").select("step", "n_pos", "n_neg", r6("auroc"), r6("average_precision"))


CUM_SQL = "g AS (SELECT step, distance, sum(label) AS pos, count(*) AS n FROM pairs GROUP BY ALL), c AS (SELECT *, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM g WINDOW w AS (PARTITION BY step ORDER BY distance))"


@query(f"""
    WITH {PAIRS_SQL}, {CUM_SQL},
    e AS (SELECT step, sum(label) AS total, fdr FROM pairs, (VALUES (0.01), (0.05), (0.1), (0.4)) f(fdr) GROUP BY step, fdr),
    b AS (SELECT step, fdr, max(distance) AS threshold, max(cp) AS cp FROM c, (VALUES (0.01), (0.05), (0.1), (0.4)) f(fdr) WHERE (cn - cp) / cn <= fdr GROUP BY step, fdr)
    SELECT step, fdr::DOUBLE AS fdr, round(coalesce(1 - cp / total, 1), 6) AS fnr, round(threshold, 6) AS threshold FROM e LEFT JOIN b USING (step, fdr)""")
def fdr_operating_point(spark, d):
    """Missed pairs and distance at false discovery rates."""
    return metrics.operating_points(scored_pairs(spark, d), ["step"], "distance", "label", [0.01, 0.05, 0.1, 0.4]).select("step", "fdr", r6("fnr"), r6("threshold"))


@query(f"""
    WITH {PAIRS_SQL}, {CUM_SQL}, t AS (SELECT step, count(*) AS total FROM pairs GROUP BY step)
    SELECT step, target::DOUBLE AS target, round(min(cn / total), 6) AS coverage, round(arg_min(cp / cn, cn), 6) AS purity
    FROM c JOIN t USING (step), (VALUES (0.1), (0.25), (0.5), (1.0)) x(target) WHERE cn / total >= target GROUP BY step, target""")
def purity_curve(spark, d):
    """Share of true pairs at the first distance that covers a share of all."""
    return metrics.purity_curve(scored_pairs(spark, d), ["step"], "distance", "label", [0.1, 0.25, 0.5, 1.0]).select("step", "target", r6("coverage"), r6("purity"))


def scored_documents(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")


@query("""
    WITH r AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS rk FROM documents JOIN labels USING (doc_id))
    SELECT lang, count(*) FILTER (quality = 1) AS n_pos, count(*) FILTER (quality = 0) AS n_neg,
           round((sum(rk) FILTER (quality = 1) - n_pos * (n_pos + 1) / 2.0) / nullif(n_pos * n_neg, 0), 6) AS auroc FROM r GROUP BY lang""")
def auroc_ties(spark, d):
    """How well a document's length tells its quality, by language."""
    return metrics.roc_auc(scored_documents(spark, d), ["lang"], "n_chars", "quality").select("lang", "n_pos", "n_neg", r6("auroc"))


@query("""
    WITH c AS (SELECT lang, sum((n_chars > 1000)::INT * quality) AS tp, sum((n_chars > 1000)::INT * (1 - quality)) AS fp, sum((n_chars <= 1000)::INT * quality) AS fn, count(*) AS n, sum(((n_chars > 1000)::INT = quality)::INT) AS ok
               FROM documents JOIN labels USING (doc_id) GROUP BY lang)
    SELECT lang, round(ok / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def binary_metrics(spark, d):
    rows = scored_documents(spark, d).withColumn("score", F.col("n_chars") / 2000.0)
    return metrics.binary_scores(rows, ["lang"], "score", "quality").select("lang", r6("accuracy"), r6("precision"), r6("recall"), r6("f1"))


@query("""
    WITH g AS (SELECT lang, n_chars, sum(quality) AS hit, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL),
    c AS (SELECT *, sum(hit) OVER w AS ch, sum(n) OVER w AS cn FROM g WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC))
    SELECT lang, round(sum(n * (ch / cn + CASE WHEN cn > n THEN (ch - hit) / (cn - n) ELSE 1.0 END) / 2) / sum(n), 6) AS auc_tie_anchored FROM c GROUP BY lang""")
def precision_coverage_tie(spark, d):
    rows = scored_documents(spark, d).withColumn("score", F.col("n_chars").cast("double"))
    return metrics.auc_tie_anchored(rows, ["lang"], "score", "quality").select("lang", r6("auc_tie_anchored"))


@query("""
    WITH r AS (SELECT lang, row_number() OVER w AS n, sum(quality) OVER w AS h, quality FROM documents JOIN labels USING (doc_id) WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING))
    SELECT lang, round(sum(CASE WHEN n > 1 THEN (h / n + (h - quality) / (n - 1)) / 2 ELSE 0 END) / count(*), 6) AS auc_rowwise FROM r GROUP BY lang""")
def precision_coverage_rowwise(spark, d):
    rows = scored_documents(spark, d).withColumn("score", F.col("n_chars").cast("double"))
    return metrics.auc_rowwise(rows, ["lang"], "score", "doc_id", "quality").select("lang", r6("auc_rowwise"))


@query("""
    SELECT l_returnflag, count(*) AS n, round(avg(abs(1000 * l_quantity - l_extendedprice)), 4) AS mae, round(quantile_cont(abs(1000 * l_quantity - l_extendedprice), 0.95), 4) AS dt95,
           round(corr(1000 * l_quantity, l_extendedprice), 6) AS pearson, round(1 - sum((1000 * l_quantity - l_extendedprice) ** 2) / (var_pop(l_extendedprice) * count(*)), 6) AS r2
    FROM lineitem GROUP BY l_returnflag""")
def regression_metrics(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_quantity") * 1000).alias("p"), F.col("l_extendedprice").alias("t"))
    return metrics.regression_scores(rows, ["l_returnflag"], "p", "t").select("l_returnflag", "n", F.round("mae", 4).alias("mae"), F.round("dt95", 4).alias("dt95"), r6("pearson"), r6("r2"))


@query("""
    WITH s AS (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS quantity, avg(l_discount) AS discount FROM lineitem GROUP BY ALL),
    u AS (UNPIVOT s ON quantity, discount INTO NAME metric VALUE value)
    SELECT l_returnflag, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM u GROUP BY ALL""")
def macro_average(spark, d):
    """Means over partitions of what each partition has."""
    rows = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    return metrics.macro(rows, ["l_returnflag"], ["quantity", "discount"]).select("l_returnflag", "metric", r6("mean"), r6("std"), "n")


@query("""
    SELECT l_linestatus, count(l_extendedprice) AS n, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25,
           round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_linestatus""")
def distribution(spark, d):
    got = metrics.distribution(table(spark, d, "lineitem"), ["l_linestatus"], "l_extendedprice")
    return got.select("l_linestatus", "n", "min", "max", *(F.round(c, 4).alias(c) for c in ("mean", "p25", "median", "p75", "p90")))


@query("""
    WITH m AS (SELECT user_id, median(value) AS m FROM events GROUP BY user_id HAVING count(DISTINCT event_type) >= 2)
    SELECT count(DISTINCT user_id) AS n_groups, round(avg(abs(value - m)), 6) AS mean, round(quantile_cont(abs(value - m), 0.95), 6) AS p95 FROM events JOIN m USING (user_id)""")
def replicate_spread(spark, d):
    return metrics.replicate_spread(table(spark, d, "events"), "user_id", "event_type", "value").select("n_groups", r6("mean"), r6("p95"))


@query("""
    WITH w AS (SELECT user_id, quantile_cont(value, 0.005) AS a, quantile_cont(value, 0.995) AS z FROM events GROUP BY user_id)
    SELECT event_id, round(CASE WHEN z > a THEN greatest(0, least(1, (value - a) / (z - a))) END, 6) AS x FROM events JOIN w USING (user_id)""")
def run_normalized(spark, d):
    """Values on the scale of their run's 0.5 and 99.5 percentiles, clipped."""
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    w = metrics.quantiles(e, ["user_id"], "value", {"a": 0.005, "z": 0.995})
    x = F.when(F.col("z") > F.col("a"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("value") - F.col("a")) / (F.col("z") - F.col("a")))))
    return e.join(w, "user_id").select("event_id", r6(x, "x"))


@query("""
    SELECT CASE WHEN l_quantity IS NULL OR l_extendedprice <= 0 THEN 'no value' WHEN l_discount > 0.08 THEN 'discount' WHEN l_tax > 0.07 THEN 'tax' WHEN l_returnflag = 'R' THEN 'returned' ELSE 'ok' END AS reason,
           count(*) AS n, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY reason""")
def quality_reasons(spark, d):
    """The first gate that a row fails."""
    from peakloom.plans.pipelines import judged

    gates = {"no value": "l_quantity IS NULL OR l_extendedprice <= 0", "discount": "l_discount > 0.08", "tax": "l_tax > 0.07", "returned": "l_returnflag = 'R'"}
    rows = judged(table(spark, d, "lineitem"), gates)
    return rows.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("n_suppliers"))


@query(f"""
    SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, CASE WHEN c_nationkey BETWEEN 0 AND 9 THEN '0-9' WHEN c_nationkey = 10 THEN '10' WHEN c_nationkey >= 11 THEN '11+' END
        ORDER BY {SHA.format("'7', c_custkey::VARCHAR")}, c_custkey DESC) AS no FROM customer) WHERE no <= 5""")
def bucket_topk(spark, d):
    """The five rows of smallest hash in each bucket; ties keep the larger id."""
    c = table(spark, d, "customer").withColumn("bucket", text.charge_bucket(F.col("c_nationkey"), "0-9,10,11+"))
    return sampling.first_by_group(c, ["c_mktsegment", "bucket"], [vectors.hash_rank("7", F.col("c_custkey")), F.col("c_custkey").desc()], 5).select("c_mktsegment", "c_custkey")


@query(f"""
    WITH g AS (SELECT * FROM (SELECT o_orderpriority, o_custkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {SHA.format("'s', 'group', o_custkey::VARCHAR")}, o_custkey) AS no FROM (SELECT DISTINCT o_orderpriority, o_custkey FROM orders)) WHERE no <= 20)
    SELECT o_orderpriority, o_custkey, o_orderkey FROM (SELECT o.*, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY {SHA.format("'s', 'row', o_orderkey::VARCHAR")}, o_orderkey) AS k FROM orders o SEMI JOIN g USING (o_orderpriority, o_custkey)) WHERE k <= 3""")
def two_level_topk(spark, d):
    return sampling.first_groups(table(spark, d, "orders"), ["o_orderpriority"], "o_custkey", 20, 3, "s", "o_orderkey").select("o_orderpriority", "o_custkey", "o_orderkey")


@query(f"""
    WITH s AS (SELECT o_orderpriority, o_custkey, count(*) AS n FROM orders GROUP BY ALL),
    c AS (SELECT *, sum(n) OVER (PARTITION BY o_orderpriority ORDER BY {SHA.format("'t', o_custkey::VARCHAR")}, o_custkey ROWS UNBOUNDED PRECEDING) AS cum FROM s)
    SELECT o_orderpriority, o_custkey, n FROM c WHERE cum - n < 100""")
def groups_until_target(spark, d):
    """Whole groups in hash order until a hundred rows are reached."""
    return sampling.until_target(table(spark, d, "orders"), ["o_orderpriority"], "o_custkey", 100, "t")


@query(f"""
    WITH x AS (SELECT doc_id, lang, toxic FROM labels JOIN documents USING (doc_id)),
    c AS (SELECT lang, min(n) AS least FROM (SELECT lang, toxic, count(*) AS n FROM x GROUP BY ALL) GROUP BY lang HAVING count(*) = 2)
    SELECT lang, toxic, doc_id FROM (SELECT x.*, least, row_number() OVER (PARTITION BY lang, toxic ORDER BY {SHA.format("'b', doc_id::VARCHAR")}, doc_id) AS no FROM x JOIN c USING (lang)) WHERE no <= least""")
def balanced_labels(spark, d):
    """As many documents of each label in every language."""
    return sampling.balanced(scored_documents(spark, d).select("doc_id", "lang", "toxic"), ["lang"], "toxic", "doc_id", "b").select("lang", "toxic", "doc_id")


@query(f"""
    WITH x AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {SHA.format("'n', doc_id::VARCHAR")}, doc_id) AS no, count(*) OVER (PARTITION BY quality) AS n FROM labels)
    SELECT doc_id, no <= greatest(1, floor(n * 0.01)) AS budget_0p01, no <= greatest(1, floor(n * 0.1)) AS budget_0p1, no <= greatest(1, floor(n * 1.0)) AS budget_1 FROM x""")
def nested_budgets(spark, d):
    """Nested label budgets of 1, 10 and 100 percent."""
    return sampling.budgets(table(spark, d, "labels"), "quality", "doc_id", "n", [0.01, 0.1, 1.0]).select("doc_id", "budget_0p01", "budget_0p1", "budget_1")


@query("""
    WITH s AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment), f AS (SELECT *, n::DOUBLE * 1000 / sum(n) OVER () AS share FROM s),
    g AS (SELECT *, row_number() OVER (ORDER BY share - floor(share) DESC, n DESC, c_mktsegment) AS no, 1000 - sum(floor(share)) OVER () AS rest FROM f)
    SELECT c_mktsegment, n, (floor(share) + (no <= rest)::INT)::BIGINT AS quota FROM g""")
def largest_remainder(spark, d):
    """A thousand places dealt in proportion to segments' sizes."""
    return sampling.largest_remainder(table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")), "c_mktsegment", "n", 1000)


@query("SELECT o_orderkey, (ntile(7) OVER (ORDER BY o_orderkey) - 1)::INT AS shard FROM orders")
def contiguous_shards(spark, d):
    return sampling.contiguous_shards(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7).select("o_orderkey", "shard")


@query("""
    WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS no
                         FROM (SELECT * FROM (SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS own FROM lineitem) WHERE own <= 3)),
    r AS (SELECT l_suppkey, no, [l_partkey] AS taken, TRUE AS ok FROM o WHERE no = 1 UNION ALL
          SELECT l_suppkey, no, CASE WHEN able THEN list_append(taken, l_partkey) ELSE taken END, able
          FROM (SELECT o.l_suppkey, o.no, o.l_partkey, taken, len(taken) < 20 AND len(list_filter(taken, lambda x: x = o.l_partkey)) < 3 AS able FROM r JOIN o ON o.l_suppkey = r.l_suppkey AND o.no = r.no + 1))
    SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM o JOIN r USING (l_suppkey, no) WHERE ok""")
def project_run_caps(spark, d):
    """Suppliers' lines in order of price while the supplier and its part have room."""
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return sampling.capped(lines, "l_suppkey", "l_partkey", ["l_extendedprice", "l_orderkey", "l_linenumber"], 20, 3)


@query()
def length_holdout(spark, d):
    """Customers in hash order while some order size is still short."""
    sizes = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("size"))
    return sampling.length_holdout(sizes.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "size"), "o_custkey", "size", 50, "h")


def split_documents(spark, d) -> DataFrame:
    """documents with a split by their id's hash and a digest of their text."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "lang", "source", "n_chars", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), sampling.hash_split(F.col("doc_id"), "split", 0.2, 0.2).alias("split"))


SPLIT_SQL = f"""
    docs AS (SELECT *, CASE WHEN x < 0.2 THEN 'test' WHEN x < 0.2 + 0.2 THEN 'validation' ELSE 'train' END AS split FROM (
        SELECT doc_id, lang, source, n_chars, md5(coalesce(text, '')) AS digest, ('0x' || {SHA.format("'split', doc_id::VARCHAR")}[1:8])::BIGINT / 4294967296.0 AS x FROM documents)),
    ranked AS (SELECT *, CASE split WHEN 'test' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END AS sr FROM docs)"""


@query(f"WITH {SPLIT_SQL}, b AS (SELECT digest, min(sr) AS best FROM ranked GROUP BY digest) SELECT doc_id, split FROM ranked JOIN b USING (digest) WHERE sr = best")
def doc_split_precedence(spark, d):
    """Of equal texts only those of the highest split stay."""
    return dedup.by_precedence(split_documents(spark, d), "digest").select("doc_id", "split")


@query(f"WITH {SPLIT_SQL} SELECT doc_id, digest FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY sr, source, doc_id) AS no FROM ranked) WHERE no = 1")
def doc_winner(spark, d):
    """Of equal texts, the one of the best split, source and id."""
    rows = split_documents(spark, d).withColumn("rank", dedup.split_rank(F.col("split")))
    return dedup.winners(rows, ["digest"], ["rank", "source", "doc_id"]).select("doc_id", "digest")


@query(f"WITH {SPLIT_SQL}, one AS (SELECT digest FROM docs GROUP BY digest HAVING count(DISTINCT source) = 1) SELECT digest, min(doc_id) AS doc_id FROM docs SEMI JOIN one USING (digest) GROUP BY digest")
def doc_conflict_drop(spark, d):
    """Texts that two sources hold lose all rows; others keep their first."""
    return dedup.without_conflicts(split_documents(spark, d), "digest", "source", ["doc_id"]).select("digest", "doc_id")


@query(f"WITH {SPLIT_SQL}, one AS (SELECT digest FROM docs GROUP BY digest HAVING count(DISTINCT split) = 1) SELECT doc_id FROM docs SEMI JOIN one USING (digest)")
def doc_one_split(spark, d):
    return dedup.in_one_split(split_documents(spark, d), "digest").select("doc_id")


@query(f"""
    WITH {SPLIT_SQL}, k AS (SELECT 'digest' AS key, digest AS v, split FROM docs UNION ALL SELECT 'source', source, split FROM docs),
    g AS (SELECT key, v, count(*) AS n, count(DISTINCT split) AS s FROM k GROUP BY ALL)
    SELECT key, sum(n)::BIGINT AS n_rows, count(*) AS n_keys, (sum(n) - count(*))::BIGINT AS n_repeated, count(*) FILTER (s > 1) AS n_shared FROM g GROUP BY key""")
def uniqueness_audit(spark, d):
    return dedup.audit(split_documents(spark, d), ["digest", "source"])


@query(f"""
    WITH {SPLIT_SQL}, k AS (SELECT DISTINCT split, digest FROM docs)
    SELECT a.split AS split_a, b.split AS split_b, count(*) AS n FROM k a JOIN k b ON a.digest = b.digest AND a.split < b.split GROUP BY ALL""")
def leakage_audit(spark, d):
    """Texts that two splits share."""
    return dedup.overlaps(split_documents(spark, d), "digest")


@query(f"""
    WITH {SPLIT_SQL}, x AS (SELECT doc_id, split, source, toxic FROM docs JOIN labels USING (doc_id))
    SELECT doc_id, count(*) FILTER (toxic = 0) OVER w > 0 AND count(*) FILTER (toxic = 1) OVER w > 0 AS matched FROM x WINDOW w AS (PARTITION BY split, source)""")
def matched_controls(spark, d):
    rows = split_documents(spark, d).join(table(spark, d, "labels"), "doc_id")
    return dedup.matched_controls(rows, "split", "source", "toxic").select("doc_id", "matched")


@query("SELECT doc_id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'extra' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def label_coverage(spark, d):
    from peakloom.operators.checks import coverage

    return coverage(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("""
    WITH n AS (SELECT o_custkey, o_orderstatus, count(*) AS n, max(o_orderdate) AS loaded FROM orders GROUP BY ALL),
    l AS (SELECT o_custkey AS entity, 'orders/' || o_orderstatus AS metric, n::DOUBLE AS value, loaded FROM n)
    SELECT entity, metric, value FROM l""")
def ledger_upsert(spark, d):
    """A ledger of counts after one year's rows and then all rows were entered."""
    o = table(spark, d, "orders")

    def ledger(rows):
        return rows.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("loaded")).select(F.col("o_custkey").alias("entity"), F.concat(F.lit("orders/"), text.metric_name(F.col("o_orderstatus"))).alias("metric"), F.col("n").cast("double").alias("value"), "loaded")

    old = ledger(o.filter(F.year("o_orderdate") < 1996)).withColumn("load", F.lit(1))
    return dedup.upsert(old, ledger(o).withColumn("load", F.lit(2)), ["entity", "metric"], "load").select("entity", "metric", "value")


def label_counts(spark, d, label):
    """(label, n): the labels that words of the documents make, a row for each distinct word that makes one, and its count.

    The label hangs on the count, else Spark moves the filter before the count and makes a label of every word of a text.
    """
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))).alias("w"))
    counts = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.when(F.col("n") > 0, label(F.col("w"))).alias("label"), "n").filter("label is not null")


@query("""
    WITH w AS (SELECT upper(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'))) AS w FROM documents),
    ok AS (SELECT w FROM w WHERE regexp_matches(w, '^[ACDEFGHIKLMNPQRSTVWYO]+$')),
    t AS (SELECT w, unnest(string_split(w, '')) AS token FROM ok)
    SELECT token, count(*) AS n FROM t GROUP BY token""")
def token_vocabulary(spark, d):
    """Residue tokens of all words that are valid labels."""
    counted = label_counts(spark, d, text.canonical_label)
    return counted.select(F.explode(text.residue_tokens(F.col("label"))).alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n"))


@query("""
    SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(CASE WHEN lower(trim(coalesce(url, ''))) IN ('nan', 'none', 'null') THEN '' ELSE trim(coalesce(url, '')) END, '([^/]+)/*$', 1)), '\\.gz$', ''), '\\.(mgf|mzml|raw|mzxml)$', ''), '^pxd\\d+_', '') AS run,
           try_cast(nullif(regexp_extract(url, '-?\\d+', 0), '') AS BIGINT) AS first_integer FROM pages""")
def run_names(spark, d):
    return table(spark, d, "pages").select("page_id", text.normal_run(F.col("url")).alias("run"), text.first_integer(F.col("url")).alias("first_integer"))


@query("""
    SELECT conv_id, turn, text || chr(10) || nxt AS joined, md5(text || chr(10) || nxt) AS digest
    FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL""")
def concat_consecutive(spark, d):
    """Each turn with the one that follows."""
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    joined = F.concat(F.col("text"), F.lit("\n"), F.col("nxt"))
    return table(spark, d, "conversations").withColumn("nxt", nxt).filter("nxt is not null").select("conv_id", "turn", joined.alias("joined"), F.md5(joined).alias("digest"))


@query("""
    WITH p AS (SELECT o_orderkey AS l, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders), q AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
    SELECT l AS left_id, r AS right_id FROM p WHERE r IS NOT NULL AND l IN (FROM q) AND r IN (FROM q)""")
def qualified_pairs(spark, d):
    """Neighbouring orders of a customer that are both finished."""
    o = table(spark, d, "orders")
    nxt = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    pairs = o.select(F.col("o_orderkey").alias("left_id"), nxt.alias("right_id")).filter("right_id is not null")
    return joins.both_qualified(pairs, o.filter("o_orderstatus = 'F'"), "o_orderkey").select("left_id", "right_id")


@query()
def sequence_matches(spark, d):
    """Each word against the one that follows, as predicted and true labels, by language."""
    docs = table(spark, d, "documents").select("lang", F.regexp_extract_all(F.upper(F.coalesce("text", F.lit(""))), F.lit("[A-Z]+"), F.lit(0)).alias("w"))
    pairs = docs.select("lang", F.explode(F.zip_with(F.expr("slice(w, 1, greatest(size(w) - 1, 0))"), F.expr("slice(w, 2, greatest(size(w) - 1, 0))"), lambda a, b: F.struct(a.alias("t"), b.alias("p")))).alias("x"))
    distinct = pairs.groupBy("lang", "x.t", "x.p").agg(F.count(F.lit(1)).alias("k")).select("lang", "k", sequences.match(text.residue_tokens(F.col("t")), text.residue_tokens(F.col("p"))).alias("m"))
    scores = sequences.sequence_scores(distinct, ["lang"], "m", F.col("k"))
    return scores.select("lang", "n", r6("aa_precision"), r6("aa_recall"), r6("peptide_precision"))


@query("""
    SELECT o_orderkey AS spectrum_id, round(o_totalprice, 4) AS precursor_mz, (o_orderkey % 3 + 2)::INT AS charge, count(*) AS n_peaks, round(sum(l_extendedprice), 2) AS sum_mz, round(sum(l_quantity), 2) AS sum_intensity
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_totalprice""")
def mgf_round_trip(spark, d):
    """All spectra written as MGF and read back."""
    from peakloom.plans.scratch import new_folder
    from peakloom.sources.spectra import read_mgf, write_mgf

    path = new_folder(spark, "mgf")
    write_mgf(spectra(spark, d).withColumn("title", F.col("spectrum_id").cast("string")), path, title="title", precursor_mz="precursor_mz", charge="charge", peaks="peaks")
    h = F.col("headers")
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 2)
    return read_mgf(spark, path).filter("problem is null").select(
        h["TITLE"].cast("long").alias("spectrum_id"), F.round(h["PEPMASS"].cast("double"), 4).alias("precursor_mz"), F.replace(h["CHARGE"], F.lit("+"), F.lit("")).cast("int").alias("charge"),
        F.size("mz_array").cast("long").alias("n_peaks"), total("mz_array").alias("sum_mz"), total("intensity_array").alias("sum_intensity"),
    )


@query("SELECT o_orderkey AS psm_id, o_orderpriority AS sequence, round(o_totalprice, 2) AS score FROM orders")
def mztab_round_trip(spark, d):
    """Orders written as the PSM section of an mzTab file and read back."""
    from peakloom.plans.scratch import new_folder
    from peakloom.sources.spectra import read_mztab, write_mztab

    path = new_folder(spark, "mztab")
    psms = table(spark, d, "orders").select(F.col("o_orderpriority").alias("sequence"), F.col("o_orderkey").alias("PSM_ID"), F.format_string("%.6f", "o_totalprice").alias("search_engine_score[1]"))
    write_mztab(psms, path, "orders")
    psm = F.col("psm")
    rows = read_mztab(spark, path)
    return rows.select(psm["PSM_ID"].cast("long").alias("psm_id"), psm["sequence"].alias("sequence"), F.round(psm["search_engine_score[1]"].cast("double"), 2).alias("score"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def streamed_windows(spark, d):
    """Hourly counts of the events, read as a stream to its end."""
    from peakloom.plans.scratch import new_folder
    from peakloom.streaming.events import counts_by_window

    like, out = table(spark, d, "events"), new_folder(spark, "stream")
    events = spark.readStream.schema(like.schema).parquet(f"{d}/[e]vents.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = counts_by_window(events, "ts", "event_type", "value", "1 hour", "10 minutes")
    counts.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{out}/rows")).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


HASH8 = "('0x' || sha256(concat_ws(chr(31), {}))[1:8])::BIGINT"


def circle_sql(name: str, group: str, seed: str, looks: str) -> str:
    """CTEs from p (id, y, ...): {name}_found (id, other), the first row of another label from a row's place on its group's circle on."""
    return f"""
    {name}_c AS (SELECT {group} AS g, id, y, row_number() OVER (PARTITION BY {group} ORDER BY {SHA.format(f"'{seed} circle', id::VARCHAR")}, id) - 1 AS pos, count(*) OVER (PARTITION BY {group}) AS n FROM p),
    {name}_d AS (SELECT g, pos, id, y, n FROM {name}_c UNION ALL SELECT g, pos + n, id, y, n FROM {name}_c),
    {name}_e AS (SELECT *, y <> lag(y) OVER (PARTITION BY g ORDER BY pos) AS new FROM {name}_d),
    {name}_f AS (SELECT *, first_value(CASE WHEN new THEN id END IGNORE NULLS) OVER (PARTITION BY g ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM {name}_e),
    {name}_l AS (SELECT id, y, {group} AS g, {HASH8.format(f"'{seed} start', id::VARCHAR")} AS start FROM {looks}),
    {name}_found AS (SELECT * FROM (SELECT l.id, CASE WHEN f.y <> l.y THEN f.id ELSE f.nxt END AS other FROM {name}_l l JOIN {name}_f f ON f.g = l.g AND f.pos < f.n AND f.pos = l.start % f.n) WHERE other IS NOT NULL)"""


@query(f"""
    WITH p AS (SELECT o_orderkey AS id, o_totalprice AS mz, o_orderkey % 3 + 2 AS z, o_custkey AS y FROM orders),
    near AS (SELECT a.id AS a, b.id AS b, CASE WHEN abs(b.mz - a.mz) <= a.mz * 10 / 1e6 THEN 0 ELSE 1 END AS tier FROM p a JOIN p b ON a.y <> b.y AND a.z = b.z AND abs(b.mz - a.mz) <= a.mz * 100 / 1e6),
    best AS (SELECT a, b, tier FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY tier, {SHA.format("'m', 'pair', a::VARCHAR, b::VARCHAR")}, b) AS no FROM near) WHERE no = 1),
    rest AS (SELECT * FROM p WHERE id NOT IN (SELECT a FROM best)),
    {circle_sql("charge", "z", "m 0", "rest")},
    last AS (SELECT * FROM rest WHERE id NOT IN (SELECT id FROM charge_found)),
    {circle_sql("whole", "0", "m 1", "last")}
    SELECT a AS o_orderkey, b AS partner_id, tier FROM best UNION ALL SELECT id, other, 2 FROM charge_found UNION ALL SELECT id, other, 3 FROM whole_found""")
def matched_partners(spark, d):
    """A partner of another label for each spectrum: within 10 ppm, within 100 ppm, of the same charge, or any."""
    from peakloom.operators.partners import matched_partners as find

    rows = precursors(spark, d).withColumnRenamed("spectrum_id", "o_orderkey")
    return find(rows, row_id="o_orderkey", mz="precursor_mz", charge="charge", label="label", tolerances=[10, 100], seed="m")


@query(f"""
    WITH pr AS ({{partners}}), j AS (SELECT tier, a.o_orderkey % 3 = b.o_orderkey % 3 AS same, abs(b.o_totalprice - a.o_totalprice) / a.o_totalprice * 1e6 AS d FROM pr JOIN orders a ON a.o_orderkey = pr.o_orderkey JOIN orders b ON b.o_orderkey = partner_id)
    SELECT tier, count(*) AS n, avg(same::INT) AS same_charge, avg((same AND d <= 10)::INT) AS within, round(median(d), 4) AS median_ppm FROM j GROUP BY tier""".replace("{partners}", SQL["matched_partners"]))
def partner_diagnostics(spark, d):
    """How the partners of each tier lie."""
    from peakloom.operators.partners import diagnostics

    rows = precursors(spark, d).withColumnRenamed("spectrum_id", "o_orderkey")
    return diagnostics(matched_partners(spark, d), rows, "o_orderkey", "precursor_mz", "charge", 10).withColumn("median_ppm", F.round("median_ppm", 4))


@query(f"""
    WITH {UNIT_SQL},
    u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
    m AS (SELECT a.vec_id % 4 AS part, a.e AS a, b.e AS b, list_transform(list_zip(a.e, b.e), lambda p: 0.7 * p[1] + 0.3 * p[2]) AS ma, list_transform(list_zip(a.e, b.e), lambda p: 0.3 * p[1] + 0.7 * p[2]) AS mb FROM u a JOIN u b ON b.vec_id = a.vec_id + 1)
    SELECT part, count(*) AS n, round(avg(greatest(0, 1 - list_cosine_similarity(ma, mb))), 6) AS condition_distance,
           round(avg(((list_cosine_similarity(ma, a) > list_cosine_similarity(ma, b))::INT + (list_cosine_similarity(mb, b) > list_cosine_similarity(mb, a))::INT) / 2), 6) AS accuracy,
           round(avg((list_cosine_similarity(ma, a) > list_cosine_similarity(ma, b))::INT * (list_cosine_similarity(mb, b) > list_cosine_similarity(mb, a))::INT), 6) AS paired_accuracy
    FROM m GROUP BY part""")
def source_selection(spark, d):
    """Mixtures of neighbouring vectors against their sources."""
    from peakloom.operators.counterfactual import source_selection as select

    v = table(spark, d, "embeddings").select("vec_id", vectors.unit(F.col("embedding")).alias("v"))
    pairs = v.select("vec_id", F.col("v").alias("a")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("b")), "vec_id")
    mix = lambda s: F.zip_with("a", "b", lambda x, y: s * x + (1 - s) * y)
    rows = pairs.select((F.col("vec_id") % 4).alias("part"), "a", "b", mix(0.7).alias("ma"), mix(0.3).alias("mb"))
    return select(rows, ["part"], "cosine", "a", "b", "ma", "mb").select("part", "n", r6("condition_distance"), r6("accuracy"), r6("paired_accuracy"))


@query("""
    WITH c AS (SELECT k, (k + 0.5) * 0.0125 AS c FROM range(8) t(k)),
    x AS (SELECT DISTINCT l_discount AS x FROM lineitem), r AS (SELECT x, k, c, exp(-power(c - greatest(0, least(0.1, x)), 2) / (2 * 0.02 * 0.02)) AS w FROM x, c),
    n AS (SELECT x, k, c, w / sum(w) OVER (PARTITION BY x) AS w FROM r),
    e AS (SELECT x, sum(w * c) AS m, sqrt(greatest(0, sum(w * c * c) - power(sum(w * c), 2))) AS s FROM n GROUP BY x)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(m, 6) AS expectation, round(s, 6) AS deviation FROM lineitem JOIN e ON l_discount = x""")
def soft_ordinal(spark, d):
    """Discounts as soft labels over eight bins, and decoded again."""
    from peakloom.functions import ordinal

    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ordinal.soft_labels(F.col("l_discount"), 0.0, 0.1, 8, 0.02).alias("w"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(ordinal.expectation(F.col("w"), 0.0, 0.1, 8), "expectation"), r6(ordinal.deviation(F.col("w"), 0.0, 0.1, 8), "deviation"))


@query()
def isotonic_alignment(spark, d):
    """Prices of each ship month on the scale of the month with most lines, by return flag."""
    from peakloom.operators.alignment import aligned

    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", F.date_trunc("month", F.col("l_shipdate").cast("timestamp")).alias("month"), "l_extendedprice")
    return aligned(rows, "month", "l_partkey", "l_extendedprice", ["l_returnflag"])


@query("""
    WITH s AS (SELECT avg(ln(o_totalprice * (o_orderkey % 3 + 2))) AS m, stddev_pop(ln(o_totalprice * (o_orderkey % 3 + 2))) AS sd, avg(o_orderkey % 3 + 2) AS zm, stddev_pop(o_orderkey % 3 + 2) AS zs FROM orders)
    SELECT o_orderkey AS spectrum_id, round((ln(o_totalprice * (o_orderkey % 3 + 2)) - m) / greatest(sd, 1e-6), 6) AS mass_z, round((o_orderkey % 3 + 2 - zm) / greatest(zs, 1e-6), 6) AS charge_z FROM orders, s""")
def metadata_baseline(spark, d):
    """Precursor mass (logarithm) and charge as z-scores: a baseline without peaks."""
    p = precursors(spark, d).select("spectrum_id", F.log(F.col("precursor_mz") * F.col("charge")).alias("m"), F.col("charge").cast("double").alias("z"))
    s = p.agg(F.avg("m").alias("mm"), F.stddev_pop("m").alias("ms"), F.avg("z").alias("zm"), F.stddev_pop("z").alias("zs"))
    z = lambda x, m, sd: (F.col(x) - F.col(m)) / F.greatest(F.col(sd), F.lit(1e-6))
    return p.join(F.broadcast(s)).select("spectrum_id", r6(z("m", "mm", "ms"), "mass_z"), r6(z("z", "zm", "zs"), "charge_z"))  # s is one row


@query(f"""
    WITH {UNIT_SQL}, j AS (SELECT a.label, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)
    SELECT label, count(*) AS n, round(avg(c), 6) AS mean_cosine, round(min(c), 6) AS least_cosine FROM j GROUP BY label""")
def view_alignment(spark, d):
    """How alike two views are: each vector, and the next one in its place."""
    v = table(spark, d, "embeddings")
    pairs = v.select("vec_id", "label", F.col("embedding").alias("a")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return retrieval.alignment(pairs, ["label"], "a", "b").select("label", "n", r6("mean_cosine"), r6("least_cosine"))


def placed_vectors(spark, d) -> DataFrame:
    """Vectors with a stand-in precursor: m/z from the id, charge 2 or 3."""
    return table(spark, d, "embeddings").select("vec_id", "label", "embedding", (500 + F.col("vec_id") % 50 * 0.002).alias("mz"), (F.col("vec_id") % 2 + 2).cast("int").alias("z"))


NEAR_SQL = f"""
    WITH {UNIT_SQL}, p AS (SELECT *, 500 + vec_id % 50 * 0.002 AS mz, vec_id % 2 + 2 AS z FROM v),
    q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {SHA.format("'0', vec_id::VARCHAR")}, vec_id) AS no, count(*) OVER (PARTITION BY label) AS n FROM p) WHERE no = 1 AND n > 1),
    n1 AS (SELECT q.vec_id AS query_id, q.label AS ql, p.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(greatest(0, 1 - list_cosine_similarity(q.e, p.e)), 9), p.vec_id) AS rank FROM q JOIN p ON q.vec_id <> p.vec_id AND {{0}}),
    ok AS (SELECT query_id FROM n1 GROUP BY query_id HAVING min((label = ql)::INT) < max((label = ql)::INT)),
    h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM n1 SEMI JOIN ok USING (query_id) WHERE label = ql),
    t AS (SELECT query_id, count(*) AS n FROM n1 GROUP BY query_id)
    SELECT query_id, t.n, count(*) AS n_positive, round(avg(k / rank), 6) AS ap, round(1 - (CASE WHEN t.n - count(*) > 0 THEN (t.n - count(*)) / t.n ELSE 0 END), 6) AS random_hit_at_1 FROM h JOIN t USING (query_id) GROUP BY query_id, t.n"""


def near_scores(spark, d, mz: str, same: bool) -> DataFrame:
    rows = placed_vectors(spark, d).withColumn("mass", F.col("mz") * F.col("z"))
    got = retrieval.ranked(retrieval.queries_of(rows, "label", "vec_id", "0"), rows, "vec_id", "label", "embedding", ks=(1,), ppm=100.0 if same else 400_000.0, mz=mz, charge="z", same_charge=same, both=True)
    return got.select("query_id", "n", "n_positive", r6("ap"), r6("random_hit_at_1"))


@query(NEAR_SQL.format("q.z = p.z AND abs(p.mz - q.mz) <= q.mz * 100 / 1e6"))
def mass_controlled_retrieval(spark, d):
    """Retrieval among neighbours of the same charge within 100 ppm, against chance."""
    return near_scores(spark, d, "mz", True)


@query(NEAR_SQL.format("q.z <> p.z AND abs(p.mz * p.z - q.mz * q.z) <= q.mz * q.z * 400000 / 1e6"))
def cross_charge_retrieval(spark, d):
    """Retrieval among rows of another charge and a like product of m/z and charge."""
    return near_scores(spark, d, "mass", False)


@query(f"""
    WITH {UNIT_SQL}, o AS (SELECT vec_id, label, e, list_reverse(e) AS r FROM v),
    q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {SHA.format("'0', vec_id::VARCHAR")}, vec_id) AS no, count(*) OVER (PARTITION BY label) AS n FROM o) WHERE no = 1 AND n > 1),
    w AS (SELECT *, list_transform(list_zip(e, r), lambda p: p[1] + 0.1 * p[2]) AS noisy FROM q),
    n1 AS (SELECT w.vec_id AS query_id, w.label AS ql, v.label, row_number() OVER (PARTITION BY w.vec_id ORDER BY round(greatest(0, 1 - list_cosine_similarity(w.noisy, v.e)), 9), v.vec_id) AS rank FROM w, v WHERE w.vec_id <> v.vec_id)
    SELECT query_id, round(1.0 / min(rank) FILTER (label = ql), 6) AS rr FROM n1 GROUP BY query_id""")
def clean_gallery_robustness(spark, d):
    """Disturbed queries against the clean vectors of all other rows."""
    rows = table(spark, d, "embeddings").withColumn("v", vectors.doubles(F.col("embedding")))
    q = retrieval.queries_of(rows, "label", "vec_id", "0").withColumn("noisy", F.zip_with("v", F.reverse("v"), lambda x, y: x + 0.1 * y))
    return retrieval.ranked(q, rows, "vec_id", "label", "v", ks=(1,), query_vector="noisy").select("query_id", r6("rr"))


@query()
def corpus_build(spark, d):
    """A corpus from the labelled documents: gates, bucket limits, caps, agreement, splits."""
    from peakloom.plans.pipelines import CorpusPlan, build_corpus

    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", F.md5(F.coalesce("text", F.lit(""))).alias("digest")).join(table(spark, d, "labels"), "doc_id")
    rows = docs.withColumn("bucket", text.charge_bucket(F.floor(F.log10(F.greatest("n_chars", F.lit(1)))).cast("int"), "0-2,3,4+"))
    plan = CorpusPlan("doc_id", "digest", "quality", "source", "lang", "bucket", {"toxic": "toxic = 1", "short": "n_chars < 50"}, 2000, 500, 200)
    return build_corpus(rows, plan).select("doc_id", "digest", "source", "lang", "bucket", "split")


@query(f"""
    WITH p AS (SELECT o_orderkey AS id, o_totalprice AS mz, o_orderkey % 3 + 2 AS z, o_custkey AS y, o_orderpriority AS part FROM orders),
    pn AS (SELECT *, row_number() OVER (PARTITION BY part, y ORDER BY {SHA.format("'b', 'row', id::VARCHAR")}, id) - 1 AS no, count(*) OVER (PARTITION BY part, y) AS n FROM p),
    pt AS (SELECT DISTINCT part, y, n * (n - 1) // 2 AS total, ('0x' || left({SHA.format("'b', 'pairs', part, y::VARCHAR")}, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM pn),
    pos AS (SELECT a.part, least(a.id, b.id) AS l, greatest(a.id, b.id) AS r FROM pt, range(4) k(k)
            JOIN pn a ON a.part = pt.part AND a.y = pt.y JOIN pn b ON b.part = pt.part AND b.y = pt.y AND a.no < b.no
            WHERE k < total AND a.no + b.no * (b.no - 1) // 2 = CASE WHEN total <= 4 THEN k ELSE floor((k + u) * total / 4)::BIGINT END),
    {circle_sql("rnd", "part", "b random", "p")},
    {circle_sql("chg", "(part, z)", "b charge", "p")},
    hard AS (SELECT l, r FROM (SELECT a.id AS l, b.id AS r, row_number() OVER (PARTITION BY a.id ORDER BY {SHA.format("'b', 'pair', a.id::VARCHAR, b.id::VARCHAR")}, b.id) AS no FROM p a JOIN p b ON a.part = b.part AND a.z = b.z AND a.y <> b.y AND abs(b.mz - a.mz) <= a.mz * 500 / 1e6) WHERE no = 1),
    neg AS (SELECT 'random' AS pair_set, id AS l, other AS r FROM rnd_found UNION ALL SELECT 'charge', id, other FROM chg_found UNION ALL SELECT 'hard', l, r FROM hard),
    every AS (SELECT part, unnest(['random', 'charge', 'hard']) AS pair_set, l, r, 1 AS label FROM pos UNION ALL SELECT part, pair_set, l, r, 0 FROM neg JOIN p ON p.id = l),
    no AS (SELECT *, row_number() OVER (PARTITION BY part, pair_set, label ORDER BY {SHA.format("'b', concat_ws('|', pair_set, l::VARCHAR, r::VARCHAR)")}, concat_ws('|', pair_set, l::VARCHAR, r::VARCHAR)) AS no FROM every),
    least AS (SELECT part, pair_set, min(n) AS least FROM (SELECT part, pair_set, label, count(*) AS n FROM every GROUP BY ALL) GROUP BY ALL HAVING count(*) = 2)
    SELECT no.part AS "partition", no.pair_set, l AS left_id, r AS right_id, label, round(abs(a.mz - b.mz) / ((a.mz + b.mz) / 2) * 1e6, 4) AS ppm
    FROM no JOIN least ON no.part = least.part AND no.pair_set = least.pair_set JOIN p a ON a.id = l JOIN p b ON b.id = r WHERE no <= least""")
def pair_benchmark(spark, d):
    """Balanced pairs of three protocols from the orders of each priority."""
    from peakloom.plans.pipelines import pair_benchmark as build

    return build(precursors(spark, d), partition="partition", row_id="spectrum_id", label="label", mz="precursor_mz", charge="charge", ppm=500, per_label=4, seed="b").withColumn("ppm", F.round("ppm", 4))


@query(f"""
    WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), c AS (SELECT *, sum(n) OVER (ORDER BY {SHA.format("'c', o_custkey::VARCHAR")}, o_custkey ROWS UNBOUNDED PRECEDING) AS cum FROM s)
    SELECT o_orderkey, CASE WHEN cum - n < 500 THEN 'validation' ELSE 'train' END AS split FROM orders JOIN c USING (o_custkey)""")
def validation_carve_out(spark, d):
    """Whole customers in hash order are validation until 500 orders are reached."""
    from peakloom.plans.pipelines import carve_validation

    return carve_validation(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 500, "c").select("o_orderkey", "split")


@query("""
    WITH r AS (SELECT l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity, k) AS a, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, k) AS b
               FROM (SELECT l_returnflag, l_quantity, l_extendedprice, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem))
    SELECT l_returnflag, count(*) AS n, round(corr(a, b), 6) AS spearman FROM r GROUP BY l_returnflag""")
def spearman(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("k"))
    return metrics.spearman(rows, ["l_returnflag"], "l_quantity", "l_extendedprice", "k").select("l_returnflag", "n", r6("spearman"))


@query(f"""
    WITH {UNIT_SQL}, b AS (SELECT *, vec_id // 32 AS batch FROM v),
    p AS (SELECT l.batch, l.vec_id AS i, list_cosine_similarity(l.e, r.e) / 0.5 AS s, l.label = r.label AS same FROM b l JOIN b r ON l.batch = r.batch AND l.vec_id <> r.vec_id),
    e AS (SELECT batch, i, ln(sum(exp(s))) AS z, avg(s) FILTER (same) AS p FROM p GROUP BY ALL)
    SELECT batch, count(*) AS n, count(p) AS n_valid, round(avg(z - p), 6) AS loss FROM e GROUP BY batch""")
def contrastive_loss(spark, d):
    """Loss of batches of 32 neighbouring vectors."""
    rows = table(spark, d, "embeddings").withColumn("batch", F.floor(F.col("vec_id") / 32).cast("long"))
    return metrics.contrastive_loss(rows, "batch", "vec_id", "label", "embedding", 0.5).select("batch", "n", "n_valid", r6("loss"))


@query(f"""
    WITH {UNIT_SQL}, f AS (SELECT * FROM v ORDER BY {SHA.format("'s', vec_id::VARCHAR")}, vec_id LIMIT 1000),
    m AS (SELECT a.vec_id, a.label AS y, b.label AS w, avg(greatest(0, 1 - list_cosine_similarity(a.e, b.e))) AS d FROM f a JOIN f b ON a.vec_id <> b.vec_id GROUP BY ALL),
    e AS (SELECT vec_id, y, max(d) FILTER (y = w) AS a, min(d) FILTER (y <> w) AS b FROM m GROUP BY ALL)
    SELECT y AS label, count(*) AS n, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END), 6) AS silhouette FROM e GROUP BY y""")
def silhouette(spark, d):
    """Silhouette by label of a thousand vectors chosen by hash: the sample is the measure's own bound."""
    return metrics.silhouette(table(spark, d, "embeddings"), "vec_id", "label", "embedding", 1000, "s").select("label", "n", r6("silhouette"))


@query(f"""
    WITH n AS (SELECT o_orderpriority, count(*) // 512 + 1 AS batches FROM orders GROUP BY o_orderpriority),
    b AS (SELECT o_orderkey, o_totalprice, o_orderpriority, {SHA.format("'p', o_orderkey::VARCHAR")} AS rank, {HASH8.format("'p', o_orderkey::VARCHAR")} % batches AS batch FROM orders JOIN n USING (o_orderpriority))
    SELECT o_orderkey, coalesce(lead(o_totalprice) OVER w, first_value(o_totalprice) OVER w) AS permuted FROM b WINDOW w AS (PARTITION BY o_orderpriority, batch ORDER BY rank, o_orderkey)""")
def permuted_precursors(spark, d):
    """Total prices dealt anew among the orders of a priority."""
    from peakloom.operators.interventions import permuted

    return permuted(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_orderkey", "o_totalprice", "p").select("o_orderkey", "permuted")


@query("""
    WITH s AS (SELECT l_returnflag, avg(l_quantity) AS q, min(l_discount) AS a, max(l_discount) AS z FROM lineitem GROUP BY l_returnflag)
    SELECT l_returnflag, m AS metric, round(v, 6) AS value FROM (SELECT l_returnflag, unnest(['quantity', 'discount/min', 'discount/max']) AS m, unnest([q, a, z]) AS v FROM s)""")
def report_unpivot(spark, d):
    """A nested report as rows of metric and value."""
    wide = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("quantity"), F.struct(F.min("l_discount").alias("min"), F.max("l_discount").alias("max")).alias("discount"))
    return metrics.flattened(wide, ["l_returnflag"]).select("l_returnflag", "metric", r6("value"))


@query("""
    WITH w AS (SELECT upper(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'))) AS w FROM documents), c AS (SELECT w, count(*) AS n FROM w GROUP BY w),
    l AS (SELECT replace(w, 'C', 'C+57.021') AS label, n FROM c WHERE regexp_matches(w, '^[ACDEFGHIKLMNPQRSTVWYO]+$'))
    SELECT len(regexp_replace(label, '[^A-Z]', '', 'g')) AS length, sum(n)::BIGINT AS n, sum(n * len(regexp_extract_all(label, 'C')))::BIGINT AS n_modified FROM l GROUP BY ALL""")
def unimod_labels(spark, d):
    """Words with a UniMod term on every C, written as numeric labels, by length."""
    labels = label_counts(spark, d, lambda w: text.unimod_label(F.replace(F.upper(w), F.lit("C"), F.lit("C(UniMod:4)"))))
    modified = F.size(F.filter(text.residue_tokens(F.col("label")), lambda t: t == "C+57.021"))
    return labels.groupBy(F.length(text.backbone(F.col("label"))).cast("long").alias("length")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * modified).alias("n_modified"))


@query("SELECT o_orderkey AS canonical_index, o_orderpriority AS predicted_sequence, CASE WHEN o_orderkey % 5 > 0 THEN round(o_totalprice, 2) END AS peptide_confidence FROM orders")
def predictions_round_trip(spark, d):
    """Orders as predictions: written, read with checks, and joined to the full index."""
    from peakloom.plans.scratch import new_folder
    from peakloom.sources.predictions import read_predictions, with_denominator, write_predictions

    path = new_folder(spark, "predictions")
    o = table(spark, d, "orders")
    rows = o.filter("o_orderkey % 5 > 0").select(
        F.col("o_orderkey").alias("canonical_index"), *(F.lit(None).cast(k).alias(c) for c, k in (("spectrum_id", "string"), ("peak_file", "string"), ("scan_id", "long"))), F.lit("t").alias("title"),
        *(F.lit(None).cast(k).alias(c) for c, k in (("species", "string"), ("split", "string"), ("source_row_index", "long"), ("precursor_mz", "double"), ("precursor_charge", "double"), ("isolation_low", "double"), ("isolation_high", "double"), ("true_sequence", "string"))),
        F.col("o_orderpriority").alias("predicted_sequence"), F.col("o_totalprice").alias("peptide_confidence"), F.lit(False).alias("no_prediction"),
    )
    write_predictions(rows, path)
    index = o.select(F.col("o_orderkey").alias("canonical_index"), F.col("o_orderpriority").alias("known"))
    got = read_predictions(spark, path).select("canonical_index", "predicted_sequence", "peptide_confidence")
    return with_denominator(index, got, "canonical_index", "peptide_confidence").select("canonical_index", F.coalesce("predicted_sequence", "known").alias("predicted_sequence"), F.round("peptide_confidence", 2).alias("peptide_confidence"))


@query("""
    WITH f AS (SELECT DISTINCT 'title' AS kind, unnest(regexp_extract_all(html, '<title>([^<]*)', 1)) AS value FROM pages
               UNION SELECT DISTINCT 'link', unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) FROM pages
               UNION SELECT DISTINCT 'number', unnest(regexp_extract_all(html, '([0-9]{4,})', 1)) FROM pages)
    SELECT kind, value FROM f""")
def metadata_harvest(spark, d):
    """Titles, links and long numbers of the pages."""
    from peakloom.sources.tables import harvest

    return harvest(table(spark, d, "pages"), "html", {"title": "<title>([^<]*)", "link": 'href="([^"]*)"', "number": "([0-9]{4,})"})


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def partitioned_sink(spark, d):
    """Lines written by flag and status, and counted from what was written."""
    from peakloom.plans.scratch import new_folder
    from peakloom.sources.tables import write_partitioned

    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus")
    return write_partitioned(rows, new_folder(spark, "partitioned"), ["l_returnflag", "l_linestatus"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey, o_orderstatus) NOT IN (SELECT (o_custkey, o_orderstatus) FROM orders WHERE o_totalprice > 300000)")
def predicate_delete(spark, d):
    """Orders without those whose customer and status a large order has."""
    from peakloom.sources.tables import without_rows

    o = table(spark, d, "orders")
    return without_rows(o, o.filter("o_totalprice > 300000"), ["o_custkey", "o_orderstatus"]).select("o_orderkey", "o_custkey")


@query("SELECT spectrum_id, at, mz FROM (SELECT l_orderkey AS spectrum_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1)::INT AS at, l_extendedprice AS mz FROM lineitem) WHERE spectrum_id IN (SELECT o_orderkey FROM orders)".replace(" at", " pos"))
def flat_peaks(spark, d):
    """Ragged arrays as values with their places."""
    from peakloom.sources.spectra import flat_arrays

    values, _ = flat_arrays(spectra(spark, d).select("spectrum_id", F.transform("peaks", lambda p: p["mz"]).alias("mz")), "spectrum_id", "mz")
    return values.select("spectrum_id", F.col("at").alias("pos"), F.col("value").alias("mz"))


WORDS_SQL = "w AS (SELECT DISTINCT upper(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'))) AS w FROM documents), ok AS (SELECT w, length(w) % 7 AS form FROM w WHERE regexp_matches(w, '^[ACDEFGHIKLMNPQRSTVWYO]+$'))"


@query(f"""
    WITH {WORDS_SQL}
    SELECT w, CASE form WHEN 0 THEN replace(w, 'M', 'M+15.995') WHEN 1 THEN replace(w, 'M', 'M+15.995') WHEN 2 THEN replace(w, 'C', 'C+57.021') WHEN 3 THEN replace(replace(w, 'N', 'N+0.984'), 'Q', 'Q+0.984')
                       WHEN 4 THEN '+42.011' || w WHEN 5 THEN CASE WHEN w LIKE '%M' THEN w || '+15.995' END END AS label FROM ok""")
def label_forms(spark, d):
    """Words as labels with modifications in brackets; those that stand at another residue, or unknown ones, are no labels."""
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).select(F.upper("w").alias("w")).distinct()
    w = F.col("w")
    forms = [
        F.replace(F.lower(w), F.lit("m"), F.lit("m(ox)")), F.replace(w, F.lit("M"), F.lit("M[OXIDATION]")), F.replace(w, F.lit("C"), F.lit("C[Carbamidomethyl]")),
        F.regexp_replace(w, "([NQ])", "$1[deamidated]"), F.concat(F.lit(" [Acetyl]-_"), w, F.lit("_ ")), F.concat(w, F.lit("[Oxidation]")), F.concat(F.lit("[Acetyl]"), w),
    ]
    able = words.filter(w.rlike("^[ACDEFGHIKLMNPQRSTVWYO]+$"))
    return able.select("w", text.canonical_label(F.element_at(F.array(*forms), (F.length(w) % 7 + 1).cast("int"))).alias("label"))


@query("""
    SELECT page_id, 'run' || page_id AS run, page_id AS scan, CASE WHEN page_id % 3 < 2 THEN page_id END AS native FROM pages""")
def titles_and_scans(spark, d):
    """Runs and scans from titles, scans from native ids, of each page."""
    k = F.col("page_id").cast("string")
    title = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("run"), k, F.lit(":SCAN:"), k)).otherwise(F.concat(F.lit("run"), k, F.lit("."), k, F.lit("."), k, F.lit(".2")))
    native = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("controllerType=0 scan="), k)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("x: "), k)).otherwise(F.concat(F.lit("scan="), k, F.lit(" foo")))
    t = text.title_parts(title)
    return table(spark, d, "pages").select("page_id", t["run"].alias("run"), t["scan"].alias("scan"), text.scan_number(native).alias("native"))

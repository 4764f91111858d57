"""More queries over the given tables: reports by partition, mixtures, thresholds, splits and file filters, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakloom.functions import digests, peaks, vectors
from peakloom.operators import counterfactual, dedup, metrics, retrieval, sampling
from peakloom.plans.queries import HASH8, PEAKS_SQL, SHA, UNIT_SQL, peak_sums, precursors, query, r6, spectra
from peakloom.session import table

FRACTION = f"({HASH8}::DOUBLE / 4294967296.0)"


def partitioned(spark, d):
    return table(spark, d, "embeddings").withColumn("part", F.col("vec_id") % 3)


@query(f"""
    WITH {UNIT_SQL}, p AS (SELECT *, vec_id % 3 AS part FROM v),
    q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part, label ORDER BY {SHA.format("'r', vec_id::VARCHAR")}, vec_id) AS no, count(*) OVER (PARTITION BY part, label) AS n FROM p) WHERE no = 1 AND n > 1),
    near AS (SELECT q.part, q.vec_id AS query_id, q.label AS ql, p.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(greatest(0, 1 - list_cosine_similarity(q.e, p.e)), 9), p.vec_id) AS rank
             FROM q JOIN p ON q.part = p.part AND q.vec_id <> p.vec_id),
    hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM near WHERE label = ql),
    each AS (SELECT part, query_id, avg(k / rank) AS ap, 1.0 / min(rank) AS rr, (count(*) FILTER (rank <= 5) > 0)::INT::DOUBLE AS hit_at_5, count(*) FILTER (rank <= 10) / count(*) AS recall_at_10 FROM hits GROUP BY ALL),
    means AS (SELECT part, count(*) AS n, avg(ap) AS ap, avg(rr) AS rr, avg(hit_at_5) AS hit_at_5, avg(recall_at_10) AS recall_at_10 FROM each GROUP BY part),
    long AS (SELECT part, n, unnest(['ap', 'rr', 'hit_at_5', 'recall_at_10']) AS metric, unnest([ap, rr, hit_at_5, recall_at_10]) AS value FROM means)
    SELECT part, metric, round(value, 6) AS value, n FROM long UNION ALL SELECT NULL, metric, round(avg(value), 6), count(*) FROM long GROUP BY metric""")
def retrieval_report(spark, d):
    """Retrieval in each of three partitions, and the mean over partitions."""
    got = retrieval.report(partitioned(spark, d), "part", "label", "vec_id", "embedding", "r")
    return got.filter(F.col("metric").isin("ap", "rr", "hit_at_5", "recall_at_10")).select("part", "metric", r6("value"), "n")


@query(f"""
    WITH {UNIT_SQL},
    pr AS (SELECT b.vec_id - a.vec_id AS step, a.vec_id || '-' || b.vec_id AS pair_id, (a.label = b.label)::INT AS label,
                  round((greatest(0, 1 - list_cosine_similarity(a.e, bb.e)) + greatest(0, 1 - list_cosine_similarity(aa.e, b.e))) / 2, 4) AS distance
           FROM v a JOIN v b ON b.vec_id - a.vec_id BETWEEN 1 AND 3 JOIN v aa ON aa.vec_id = a.vec_id + 4 JOIN v bb ON bb.vec_id = b.vec_id + 4),
    ct AS (SELECT step, min(n) AS least FROM (SELECT step, label, count(*) AS n FROM pr GROUP BY ALL) GROUP BY step HAVING count(*) = 2),
    p AS (SELECT * FROM (SELECT pr.*, least, row_number() OVER (PARTITION BY step, label ORDER BY {SHA.format("'two', pair_id")}, pair_id) AS no FROM pr JOIN ct USING (step)) WHERE no <= least),
    s AS (SELECT step, distance, sum(label) AS pos, sum(1 - label) AS neg FROM p GROUP BY ALL),
    c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER t AS np, sum(neg) OVER t AS nn FROM s WINDOW w AS (PARTITION BY step ORDER BY distance ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY step)),
    auc AS (SELECT step, 'auc' AS metric, 1 - sum((cn - neg) * pos + pos * neg / 2.0) / any_value(np * nn) AS value FROM c GROUP BY step),
    ap AS (SELECT step, 'average_precision', sum(pos * cp / (cp + cn)) / sum(pos) FROM c GROUP BY step),
    rates AS (SELECT unnest([0.01, 0.05, 0.1]) AS r, unnest(['0p01', '0p05', '0p1']) AS rn),
    ok AS (SELECT step, r, rn, max(distance) AS t, max(cp) AS cp, any_value(np) AS np FROM c, rates WHERE cn / (cp + cn) <= r GROUP BY ALL),
    op AS (SELECT a.step, rates.rn, 1 - ok.cp / ok.np AS fnr, ok.t FROM (SELECT DISTINCT step FROM c) a CROSS JOIN rates LEFT JOIN ok ON ok.step = a.step AND ok.r = rates.r),
    pu AS (SELECT step, 'purity_at_' || tn AS metric, arg_min(cp / (cp + cn), distance) AS value FROM c, (SELECT unnest([0.1, 0.5]) AS t, unnest(['0p1', '0p5']) AS tn) WHERE (cp + cn) / (np + nn) >= t GROUP BY ALL)
    SELECT step, metric, round(value, 6) AS value FROM (SELECT * FROM auc UNION ALL SELECT * FROM ap UNION ALL SELECT step, 'fnr_at_' || rn, coalesce(fnr, 1) FROM op UNION ALL SELECT step, 'threshold_at_' || rn, t FROM op UNION ALL SELECT * FROM pu)""")
def pair_report(spark, d):
    """All pair metrics, by the mean of both directions' distances between two views (a vector, and the one four ids on)."""
    v = table(spark, d, "embeddings").select("vec_id", "label", vectors.unit(F.col("embedding")).alias("v"))
    v = v.join(v.select((F.col("vec_id") - 4).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    a = v.select(F.col("vec_id").alias("left_id"), F.col("label").alias("la"), F.col("v").alias("va"), F.col("w").alias("wa"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("step"))
    b = v.select(F.col("vec_id").alias("right_id"), F.col("label").alias("lb"), F.col("v").alias("vb"), F.col("w").alias("wb"))
    pairs = a.join(b, F.col("left_id") + F.col("step") == F.col("right_id"))
    distance = F.round(vectors.two_view_distance(F.col("va"), F.col("wa"), F.col("vb"), F.col("wb")), 4)
    rows = pairs.select(F.col("step").cast("long").alias("step"), F.concat_ws("-", "left_id", "right_id").alias("pair_id"), (F.col("la") == F.col("lb")).cast("int").alias("label"), distance.alias("distance"))
    return metrics.pair_report(sampling.balanced(rows, ["step"], "label", "pair_id", "two"), ["step"], "distance", "label").select("step", "metric", r6("value"))


@query(f"""
    WITH {UNIT_SQL}, x AS (SELECT a.vec_id % 4 AS part, 1 - list_cosine_similarity(c.e, a.e) AS s1, 1 - list_cosine_similarity(c.e, b.e) AS n1, 1 - list_cosine_similarity(f.e, a.e) AS s2, 1 - list_cosine_similarity(f.e, b.e) AS n2,
                         1 - list_cosine_similarity(c.e, f.e) AS local, 1 - list_cosine_similarity(a.e, b.e) AS clean
                  FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 JOIN v c ON c.vec_id = a.vec_id + 2 JOIN v f ON f.vec_id = a.vec_id + 3)
    SELECT part, count(*) AS pairs, round(avg((s1 < n1)::INT), 6) AS accuracy_1, round(avg((s1 < n1 AND s2 < n2)::INT), 6) AS paired_accuracy, round(avg((n1 - s1 + n2 - s2) / 2), 6) AS mean_margin,
           round(avg(local), 6) AS local_distance, round(avg(local / greatest(clean, 1e-8)), 6) AS distance_ratio FROM x GROUP BY part""")
def null_local_consistency(spark, d):
    """Two local views against a clean source and a negative (neighbouring vectors stand in for them)."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    rows = v.withColumnRenamed("embedding", "e0")
    for k in (1, 2, 3):
        rows = rows.join(v.select((F.col("vec_id") - k).alias("vec_id"), F.col("embedding").alias(f"e{k}")), "vec_id")
    got = counterfactual.null_local(rows.withColumn("part", F.col("vec_id") % 4), ["part"], "e0", "e1", "e2", "e3")
    return got.select("part", "pairs", r6("accuracy_1"), r6("paired_accuracy"), r6("mean_margin"), r6("local_distance"), r6("distance_ratio"))


@query("""
    WITH s AS (SELECT o_custkey, count(*) * 6 AS size FROM orders GROUP BY o_custkey),
    c AS (SELECT o_custkey, size, k, ((o_custkey % (size - 1)) + k) % (size - 1) + 1 AS step FROM s, range(0, 401) t(k) WHERE size > 1)
    SELECT o_custkey, size, arg_min(step, k)::BIGINT AS stride FROM c WHERE gcd(step, size) = 1 GROUP BY ALL""")
def coprime_strides(spark, d):
    """A step of each customer's own through six times its orders that meets every place once."""
    s = table(spark, d, "orders").groupBy("o_custkey").agg((F.count(F.lit(1)) * 6).alias("size"))
    return s.select("o_custkey", "size", counterfactual.coprime_stride(F.col("size"), F.col("o_custkey")).alias("stride"))


def near_sql(by: str, source: str, then: str, k: str) -> str:
    """Peaks of a spectrum merged where neighbours lie closer than 20,000 ppm of their midpoint: one step of mixing."""
    return f"""o{k} AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY mz, {then}) AS g FROM {source}),
    l{k} AS (SELECT *, CASE WHEN mz - lag(mz) OVER w < 20000 * 1e-6 * (mz + lag(mz) OVER w) / 2 THEN 0 ELSE 1 END AS new FROM o{k} WINDOW w AS (PARTITION BY {by} ORDER BY g)),
    c{k} AS (SELECT * EXCLUDE (new), sum(new) OVER (PARTITION BY {by} ORDER BY g) AS no FROM l{k}),
    x{k} AS (SELECT id, no AS cluster, sum(mz * x) / sum(x) AS mz, sum(x) AS x, CASE WHEN count(DISTINCT origin) > 1 THEN 2 ELSE min(origin) END AS origin FROM c{k} GROUP BY {by}, no)"""


@query(f"""
    WITH p AS (SELECT l_orderkey AS id, l_extendedprice AS mz, l_quantity AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_quantity) AS pos FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
    n AS (SELECT id, count(*) AS n FROM p GROUP BY id), pair AS (SELECT a.id, b.id AS other, least(greatest(floor(a.n * 0.5), 1), b.n) AS k FROM n a JOIN n b ON b.id = a.id + 1),
    s AS (SELECT pair.id, p.mz, 1 AS origin, p.x FROM pair JOIN (SELECT *, row_number() OVER (PARTITION BY id ORDER BY x DESC, pos) AS rank FROM p) p ON p.id = other AND rank <= k UNION ALL SELECT pair.id, mz, 0, x FROM pair JOIN p USING (id)),
    {near_sql("id, origin", "s", "x", "1")}, {near_sql("id", "x1", "origin, x", "2")},
    r AS (SELECT *, coalesce((x - min(x) OVER w) / nullif(max(x) OVER w - min(x) OVER w, 0), 0) AS y FROM x2 WINDOW w AS (PARTITION BY id))
    SELECT id AS spectrum_id, count(*) AS n, count(*) FILTER (origin = 1) AS n_distractor, count(*) FILTER (origin = 2) AS n_mixed, round(sum(mz), 4) AS sum_mz, round(sum(y * cluster), 4) AS placed FROM r GROUP BY id""")
def mixed_spectra(spark, d):
    """Each spectrum with the strongest peaks of the one of the next id mixed in, half as many as it has itself."""
    s = spectra(spark, d).select("spectrum_id", "peaks")
    pairs = s.join(s.select((F.col("spectrum_id") - 1).alias("spectrum_id"), F.col("peaks").alias("other")), "spectrum_id")
    few = peaks.strongest(F.col("other"), peaks.distractor_count(F.col("peaks"), F.col("other"), 0.5))
    m = pairs.select("spectrum_id", peaks.mixed(F.col("peaks"), few, 20_000, "range").alias("m"))
    total = lambda f: F.aggregate(F.transform("m", f), F.lit(0.0), lambda a, x: a + x)
    count = lambda k: F.size(F.filter("m", lambda p: p["origin"] == k)).cast("long")
    return m.select("spectrum_id", F.size("m").cast("long").alias("n"), count(1).alias("n_distractor"), count(2).alias("n_mixed"), F.round(total(lambda p: p["mz"]), 4).alias("sum_mz"), F.round(total(lambda p, i: p["intensity"] * (i + 1)), 4).alias("placed"))


@query("""
    WITH t AS (SELECT unnest([0.02, 0.05, 0.08, 0.2]) AS threshold)
    SELECT l_linestatus, threshold, CASE WHEN count(*) FILTER (l_discount > threshold) > 0 THEN round(count(*) FILTER (l_discount > threshold AND l_returnflag = 'N') / count(*) FILTER (l_discount > threshold), 6) END AS "precision",
           round(count(*) FILTER (l_discount > threshold AND l_returnflag = 'N') / 100000.0, 6) AS recall FROM lineitem, t GROUP BY ALL""")
def residue_thresholds(spark, d):
    """Precision and recall of what scores above thresholds."""
    rows = table(spark, d, "lineitem").select("l_linestatus", "l_discount", (F.col("l_returnflag") == "N").alias("ok"))
    return metrics.thresholds(rows, ["l_linestatus"], "l_discount", "ok", "100000", [0.02, 0.05, 0.08, 0.2]).select("l_linestatus", "threshold", r6("precision"), r6("recall"))


@query(f"""
    WITH s AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 400000)
    SELECT o_orderkey, CASE WHEN s.o_custkey IS NOT NULL THEN 'train' WHEN {FRACTION.format("'f', o.o_custkey::VARCHAR")} < 0.1 THEN 'test' WHEN {FRACTION.format("'f', o.o_custkey::VARCHAR")} < 0.1 + 0.2 THEN 'validation' ELSE 'train' END AS split
    FROM orders o LEFT JOIN s ON o.o_custkey = s.o_custkey""")
def forced_split(spark, d):
    """Customers of large orders train; others are split by hash."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return sampling.forced_split(o, "o_custkey", o.filter("o_totalprice > 400000"), "f", 0.2, 0.1).select("o_orderkey", "split")


@query("""
    WITH k AS (SELECT DISTINCT l_partkey, l_quantity, l_extendedprice FROM lineitem WHERE l_orderkey % 2 = 0)
    SELECT count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem JOIN k USING (l_partkey, l_quantity, l_extendedprice) WHERE l_orderkey % 2 = 1)""")
def known_lines(spark, d):
    """Lines of odd orders that an even order has, too: by part first, then by a fingerprint of quantity and price."""
    rows = table(spark, d, "lineitem").withColumn("key", F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"))
    fingerprint = F.unhex(F.sha2(F.concat_ws("|", "l_quantity", "l_extendedprice"), 256))
    ids = dedup.known_rows(rows.filter("l_orderkey % 2 = 1"), rows.filter("l_orderkey % 2 = 0"), ["l_partkey"], fingerprint, "key")
    return ids.distinct().agg(F.count(F.lit(1)).alias("n"), F.sum("key.l_orderkey").alias("keys"))


@query("SELECT o_orderkey AS spectrum_id, o_orderkey % 3 + 2 AS charge FROM orders WHERE o_orderkey % 3 + 2 BETWEEN 3 AND 4 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def mgf_charge_filter(spark, d):
    """Spectra of charges 3 and 4 out of an MGF file, whose records stay as they are, byte for byte."""
    from peakloom.plans.scratch import new_folder
    from peakloom.sources.spectra import filter_mgf, read_mgf, write_mgf

    source, target = new_folder(spark, "mgf"), new_folder(spark, "mgf-charges")
    write_mgf(spectra(spark, d), source, title="spectrum_id", precursor_mz="precursor_mz", charge="charge", peaks="peaks")
    filter_mgf(spark, source, target, 3, 4)
    h = F.col("headers")
    return read_mgf(spark, target).select(h["TITLE"].cast("long").alias("spectrum_id"), F.replace(h["CHARGE"], F.lit("+"), F.lit("")).cast("int").cast("long").alias("charge"))


@query("""
    SELECT event_type, count(*) AS n, sum((NOT isnan(z) AND z = floor(z) AND z BETWEEN 1 AND 10)::INT)::BIGINT AS n_ok FROM
    (SELECT event_type, CASE event_id % 4 WHEN 0 THEN (event_id % 13)::DOUBLE WHEN 1 THEN 2.5 WHEN 2 THEN 'nan'::DOUBLE ELSE 11 END AS z FROM events) GROUP BY event_type""")
def finite_charges(spark, d):
    """Whole charges from 1 to 10 among numbers that aren't."""
    from peakloom.sources.spectra import finite_charge

    k = F.col("event_id")
    z = F.when(k % 4 == 0, (k % 13).cast("double")).when(k % 4 == 1, 2.5).when(k % 4 == 2, F.lit(float("nan"))).otherwise(11.0)
    return table(spark, d, "events").select("event_type", finite_charge(z, 1, 10).alias("ok")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ok").cast("long")).alias("n_ok"))


@query(f"""
    WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY {SHA.format("'e 3', o_orderkey::VARCHAR")}, o_orderkey) - 1 AS no, count(*) OVER () AS n FROM orders)
    SELECT no AS draw, o_orderkey, 'part' AS kind FROM n WHERE no < 1000
    UNION ALL SELECT k, o_orderkey, 'whole' FROM (SELECT k, {HASH8.format("'e 4 draw', k::VARCHAR")} % (SELECT count(*) FROM orders) AS no FROM range(0, (SELECT count(*) * 2 FROM orders)) t(k)) JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY {SHA.format("'e 4', o_orderkey::VARCHAR")}, o_orderkey) - 1 AS no FROM orders) USING (no)""")
def replay_samples(spark, d):
    """A thousand orders for epoch 3; for epoch 4 twice as many as there are, with replacement."""
    o = table(spark, d, "orders").select("o_orderkey")
    part = sampling.replayed(o, "o_orderkey", 1000, "e", 3).select("draw", "o_orderkey", F.lit("part").alias("kind"))
    return part.union(sampling.replayed(o, "o_orderkey", o.count() * 2, "e", 4).select("draw", "o_orderkey", F.lit("whole")))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS no FROM orders) WHERE no % 7 = 3")
def modulo_shard(spark, d):
    """Every seventh order from the fourth on."""
    return sampling.modulo_shard(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 3, 7)


@query("""
    WITH x AS (SELECT l_returnflag, unnest([l_linenumber, (l_quantity > 25)::INT, (l_discount > 0.05)::INT]) AS x, unnest([0, 1, 2]) AS k FROM lineitem)
    SELECT l_returnflag, max(s) FILTER (k = 0) AS a, max(s) FILTER (k = 1) AS b, max(s) FILTER (k = 2) AS c FROM (SELECT l_returnflag, k, sum(x)::BIGINT AS s FROM x GROUP BY ALL) GROUP BY l_returnflag""")
def elementwise_sums(spark, d):
    """Counts in arrays, added up place by place."""
    rows = table(spark, d, "lineitem").select("l_returnflag", F.array(F.col("l_linenumber").cast("long"), (F.col("l_quantity") > 25).cast("long"), (F.col("l_discount") > 0.05).cast("long")).alias("v"))
    return metrics.array_sums(rows, ["l_returnflag"], "v").select("l_returnflag", *(F.get("sums", F.lit(k)).alias(c) for k, c in enumerate("abc")))


@query(f"""
    WITH g AS (SELECT DISTINCT o_orderpriority, o_custkey FROM orders), b AS (SELECT o_orderpriority, arg_min(o_custkey, {SHA.format("'a', o_custkey::VARCHAR")}) AS c FROM g GROUP BY o_orderpriority)
    SELECT o_orderkey, ('0x' || md5(o.o_orderpriority)[1:8])::BIGINT + 17 AS seed FROM orders o JOIN b ON o.o_orderpriority = b.o_orderpriority AND o.o_custkey = c""")
def acquisition_batches(spark, d):
    """All orders of one customer of each priority, and a seed of the priority's own."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return sampling.first_groups_whole(o, "o_orderpriority", "o_custkey", "a").select("o_orderkey", sampling.derived_seed(F.col("o_orderpriority"), 17).alias("seed"))


@query()
def stable_priorities(spark, d):
    """The ten customers of smallest BLAKE2b priority in each nation, with their other ranks."""
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", digests.priority63("p", F.col("c_custkey")).alias("priority"))
    first = sampling.first_by_group(c, ["c_nationkey"], [F.col("priority"), F.col("c_custkey").desc()], 10)
    return first.select("*", digests.rank128("p", F.col("c_custkey")).alias("rank"), digests.key64("p", F.col("c_custkey")).alias("key"))


@query("""
    WITH a AS (SELECT doc_id, count(*) AS n, sum((toxic = 1)::INT) AS t FROM labels GROUP BY doc_id)
    SELECT source, list(DISTINCT lang ORDER BY lang) AS langs, list(doc_id ORDER BY doc_id) AS ids FROM documents GROUP BY source HAVING count(*) > 1""")
def collected_sets(spark, d):
    """Languages and ordered ids of each source with more than one document."""
    docs = table(spark, d, "documents")
    each = docs.groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("langs"), F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return each.filter(F.size("ids") > 1)


@query(PEAKS_SQL.format(
    steps="k AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY md5(concat_ws('|', 'shuffle|' || spectrum_id, pos - 1)), pos) AS no2 FROM p), s AS (SELECT p.spectrum_id, p.pos, p.mz, k.intensity FROM p JOIN k ON k.spectrum_id = p.spectrum_id AND k.no2 = p.pos)", last="s", order="pos"))
def shuffled_intensities(spark, d):
    """Spectra with their own intensities in another order."""
    from peakloom.operators.interventions import shuffled_intensities as shuffle

    return peak_sums(spectra(spark, d).withColumn("peaks", shuffle(F.col("peaks"), F.concat_ws("|", F.lit("shuffle"), F.col("spectrum_id")))))


@query("""
    SELECT spectrum_id, CASE WHEN part LIKE '1%' OR part LIKE '2%' THEN 0 ELSE precursor_mz END AS precursor_mz, CASE WHEN part LIKE '1%' OR part LIKE '2%' THEN 0 ELSE charge END AS charge FROM
    (SELECT o_orderkey AS spectrum_id, o_totalprice AS precursor_mz, o_orderkey % 3 + 2 AS charge, o_orderpriority AS part FROM orders)""")
def null_conditioning(spark, d):
    """Precursors of two partitions in the null condition."""
    from peakloom.operators.interventions import without_precursor

    p = precursors(spark, d)
    null = F.col("partition").rlike("^[12]")
    got = without_precursor(p.filter(null), "precursor_mz", "charge").unionByName(p.filter(~null))
    return got.select("spectrum_id", "precursor_mz", F.col("charge").cast("long").alias("charge"))

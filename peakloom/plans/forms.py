"""Queries that apply small functions and readers, grouped: label texts, masses, peak scales, tables, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakloom.functions import peaks, text
from peakloom.operators import joins, retrieval, sequences
from peakloom.plans.curation import sequence
from peakloom.plans.queries import peak_sums, peaks_sql, query, r6, spectra
from peakloom.plans.scratch import new_folder
from peakloom.session import table
from peakloom.sources import predictions, tables
from peakloom.sources import spectra as files

SEQUENCE_SQL = "translate(left(md5(o_custkey::VARCHAR), 12), '0123456789abcdef', 'MAPETIDKMSGHVLFY')"
#: Tokens of the queries' labels; T isn't one of them.
VOCABULARY = ["+42.011", "M+15.995", *"ADEFGHIKLMPSVY"]


@query(f"""
    WITH o AS (SELECT o_orderkey AS id, {SEQUENCE_SQL} AS s FROM orders)
    SELECT id, CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'x' || id ELSE '' END AS plain, id % 5 > 2 AS truth,
           CASE WHEN id % 3 < 2 THEN left(s, 1) || '+15.995' || substr(s, 2) END AS numbered, (len(s) - len(replace(s, 'MA', ''))) // 2 AS n_ma,
           array_to_string(string_split(s, ''), '|') AS residues, CASE WHEN id % 2 = 0 THEN 'batch' || id % 7 ELSE 'whole' END AS batch,
           CASE WHEN id % 2 = 0 THEN 'mouse' ELSE 'yeast' END AS species, '0p' || lpad((id % 9 + 1)::VARCHAR, 2, '0') AS rate, NOT contains(s, 'T') AS in_vocabulary
    FROM o""")
def label_texts(spark, d):
    """Texts of each order's making, through the functions for texts, runs and labels."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), sequence(F.col("o_custkey")).alias("s"))
    k = lambda n: F.col("id") % n
    raw = F.when(k(4) == 0, F.lit(" None ")).when(k(4) == 1, F.lit("nan")).when(k(4) == 2, F.concat(F.lit("  x"), "id", F.lit(" ")))
    truth = F.when(k(5) == 0, F.lit(" No")).when(k(5) == 1, F.lit("0")).when(k(5) == 3, F.lit("yes")).when(k(5) == 4, F.lit("1"))
    first, rest = F.substring("s", 1, 1), F.substring("s", 2, 100)
    numbered = F.when(k(3) == 0, F.concat(first, F.lit("[+15.995]"), rest)).when(k(3) == 1, F.concat(first, F.lit("(15.995)"), rest)).otherwise(F.concat(F.lit("[unknown]"), "s"))
    run = F.when(k(2) == 0, F.concat(F.lit("batch"), k(7), F.lit("_"), "id")).otherwise(F.lit("whole"))
    return o.select(
        "id", text.as_text(raw).alias("plain"), text.truthy(truth).alias("truth"), text.numeric_label(numbered).alias("numbered"), text.occurrences(F.col("s"), "MA").cast("long").alias("n_ma"),
        F.array_join(text.split_residues(F.col("s")), "|").alias("residues"), text.acquisition(run).alias("batch"),
        text.species_of(F.when(k(2) == 0, "Mus_1").otherwise("SACC_2"), {"mus": "mouse", "sacc": "yeast"}).alias("species"),
        text.rate_suffix(F.format_string("%.2f", (k(9) + 1) / 100)).alias("rate"), text.in_vocabulary(F.split("s", "(?<=.)(?=.)"), VOCABULARY).alias("in_vocabulary"),
    )


@query(f"""
    WITH o AS (SELECT o_orderkey AS id, replace({SEQUENCE_SQL}, 'T', 'A') AS s FROM orders),
    t AS (SELECT id, s, string_split(replace(s, 'M', '*'), '') AS c FROM o),
    v AS (SELECT id, s, [CASE WHEN x = '*' THEN 'M+15.995' ELSE x END FOR x IN list_reverse(c)] AS r FROM t),
    n AS (SELECT list(t ORDER BY t) AS names FROM (SELECT unnest({VOCABULARY!r}) AS t))
    SELECT id, '+42.011 ' || array_to_string(r, ' ') AS tokens, array_to_string([list_position(names, x) - 1 FOR x IN list_prepend('+42.011', r)], ' ') AS ids,
           '+42.011' || array_to_string(r, '') AS back FROM v, n""")
def vocabulary_round_trip(spark, d):
    """Labels with an alias as tokens of a vocabulary, turned round; their ids, and the text of these with padding and end."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.translate(sequence(F.col("o_custkey")), "T", "A").alias("s"))
    label = F.concat(F.lit("+42.011"), F.replace("s", F.lit("M"), F.lit("M+16")))
    aliases = {a: t for a, t in text.rounded_aliases(VOCABULARY).items() if t == "M+15.995"}
    rows = o.withColumn("t", text.vocabulary_tokens(label, VOCABULARY, aliases, reverse=True)).withColumn("i", text.vocabulary_ids(F.col("t"), VOCABULARY))
    end, pad = len(VOCABULARY), len(VOCABULARY) + 1
    padded = F.concat("i", F.array(F.lit(pad), F.lit(end), F.lit(0), F.lit(pad)))
    return rows.select("id", F.array_join("t", " ").alias("tokens"), F.array_join(F.col("i").cast("array<string>"), " ").alias("ids"), text.from_ids(padded, VOCABULARY, pad, end).alias("back"))


def mass_sql() -> str:
    masses = " ".join(f"WHEN '{k}' THEN {v}" for k, v in text.RESIDUES.items())
    return f"""
    WITH o AS (SELECT o_orderkey AS id, o_orderkey % 3 + 2 AS z, {SEQUENCE_SQL} AS s FROM orders),
    m AS (SELECT id, z, list_sum([CASE x {masses} END FOR x IN string_split(s, '')]) + 18.010565 AS mass FROM o),
    e AS (SELECT *, mass / z + 1.00727646688 AS whole, (id % 3) * 1.00335 / z + (id % 2) * 0.1 AS off FROM m),
    f AS (SELECT *, id % 2 = 0 AND id % 3 < 2 AS fits, (0.9 + (id % 10) / 10.0) / 2 AS mean FROM e)
    SELECT id, round(mass, 6) AS mass, round((off - 1.00335 / z) / whole * 1e6, 3) AS ppm, fits, round(mean - (NOT fits)::INT, 6) AS score,
           round((0.9 + mean - (NOT fits)::INT) / 2, 6) AS first_score, CASE WHEN id % 2 = 0 THEN 15.995 ELSE 15.9 END AS delta FROM f"""


@query(mass_sql())
def peptide_masses(spark, d):
    """Masses of labels, errors against a precursor, scores with the precursor's fit, deltas snapped to known ones."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3 + 2).alias("z"), sequence(F.col("o_custkey")).alias("s"))
    rows = o.withColumn("mass", text.peptide_mass(text.residue_tokens(F.col("s"))))
    mz = F.col("mass") / F.col("z") + text.PROTON + (F.col("id") % 3) * 1.00335 / F.col("z") + (F.col("id") % 2) * 0.1
    rows = rows.withColumn("mz", mz).withColumn("fits", sequences.fits_precursor(F.col("mz"), F.col("mass"), F.col("z"), 10))
    rows = rows.withColumn("p", sequences.peptide_score(F.array(F.lit(0.9), (F.col("id") % 10) / 10.0), F.col("fits")))
    delta = text.snapped_delta(F.when(F.col("id") % 2 == 0, 15.9946).otherwise(15.9))
    return rows.select("id", r6("mass"), F.round(sequences.mass_error_ppm(F.col("mz"), F.col("mass"), F.col("z"), F.lit(1)), 3).alias("ppm"), "fits", F.round("p.score", 6).alias("score"), F.round(F.col("p.token_scores")[0], 6).alias("first_score"), delta.alias("delta"))


@query(peaks_sql(
    "s AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, pos) AS r FROM p QUALIFY count(*) OVER (PARTITION BY spectrum_id) >= 2), "
    "t AS (SELECT *, min(intensity) OVER w AS lo, max(intensity) OVER w AS hi FROM s WHERE r <= 4 WINDOW w AS (PARTITION BY spectrum_id)), "
    "u AS (SELECT spectrum_id, mz, pos, (intensity - lo) / (hi - lo) AS intensity FROM t WHERE hi > lo)", "u"))
def peaks_to_range(spark, d):
    """The four strongest peaks scaled to 0 up to 1, of spectra with two valid peaks or more; none where all are equal."""
    s = spectra(spark, d)
    enough = peaks.valid(F.col("peaks.mz"), F.col("peaks.intensity"), 2)
    scaled = peaks.to_range(peaks.strongest(F.col("peaks"), 4))
    rows = s.withColumn("scaled", F.when(enough, F.filter(scaled, lambda p: ~F.isnan(p["intensity"]))).otherwise(F.slice("peaks", 1, 0)))
    return peak_sums(rows, "scaled")


@query("""
    SELECT o_orderkey AS spectrum_id, o_totalprice AS mz, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_orderkey % 3 = 0 AND o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 2 = 0 UNION SELECT o_orderkey + 3 FROM orders WHERE o_custkey % 2 = 0)""")
def scanned_tables(spark, d):
    """Named columns of two tables, rows by their numbers with a check, those that pairs name, files that aren't there yet."""
    o = tables.scan(spark, f"{d}/orders.parquet", ["o_orderkey", "o_totalprice", "o_custkey", "not_there"], ["o_orderkey"], {"o_orderkey": "spectrum_id", "o_totalprice": "mz"})
    c = tables.scan(spark, f"{d}/customer.parquet", ["c_custkey", "c_mktsegment"], ["c_custkey"])
    even = o.filter("o_custkey % 2 = 0").select(F.col("spectrum_id").alias("left_id"), (F.col("spectrum_id") + 3).alias("right_id"))
    named = joins.referenced(o, even, "spectrum_id")
    met = tables.rows_by_number(c.withColumnRenamed("c_custkey", "o_custkey").withColumn("parity", F.col("o_custkey") % 2), named.withColumn("parity", F.col("o_custkey") % 2).select("o_custkey", "parity").distinct(), "o_custkey", "parity")
    rows = named.join(met, "o_custkey").withColumn("path", F.concat(F.lit("there/file"), "spectrum_id"))
    present = o.filter("spectrum_id % 3 <> 0").select(F.concat(F.lit("elsewhere/file"), "spectrum_id").alias("path"))
    return tables.without_present(rows, present, "path").select("spectrum_id", "mz", F.col("c_mktsegment").alias("segment"))


@query(f"""
    WITH r AS (SELECT 'run' || o_orderkey % 3 AS file, o_orderkey // 4 AS scan, o_orderkey % 10 / 10.0 AS score, {SEQUENCE_SQL} AS peptide, 'o' || o_custkey % 3 AS organism, o_orderkey % 7 = 0 AS chimeric FROM orders),
    g AS (SELECT * FROM r WHERE NOT chimeric),
    b AS (SELECT file, scan, arg_max(peptide, (score, [-ord(x) FOR x IN string_split(peptide, '')])) AS best, max(score) AS score FROM g GROUP BY ALL),
    l AS (SELECT file, scan, arg_min(peptide, (score, peptide)) AS least FROM g GROUP BY ALL),
    s AS (SELECT file, scan, array_to_string(list(DISTINCT peptide ORDER BY peptide), ',') AS peptides, array_to_string(list(DISTINCT organism ORDER BY organism), ',') AS organisms FROM r GROUP BY ALL)
    SELECT file, scan, best, score::DOUBLE AS score, least, peptides, organisms FROM b JOIN l USING (file, scan) JOIN s USING (file, scan)""")
def evidence_tables(spark, d):
    """A tab-separated table of matches: the best and the least row of a scan behind a gate, and all peptides and organisms of it."""
    o = table(spark, d, "orders")
    rows = o.select(F.concat(F.lit("run"), F.col("o_orderkey") % 3).alias("Raw file"), F.concat(F.lit("scan="), F.floor(F.col("o_orderkey") / 4)).alias("Scan"), (F.col("o_orderkey") % 10 / 10.0).alias("PEP"), sequence(F.col("o_custkey")).alias("Sequence"), F.concat(F.lit("o"), F.col("o_custkey") % 3).alias("Organism"), F.when(F.col("o_orderkey") % 7 == 0, "+").alias("Chimeric"))
    path = new_folder(spark, "evidence")
    rows.write.option("sep", "\t").option("header", True).csv(path)
    best = lambda smallest: files.read_best_psms(spark, path, file="Raw file", scan="Scan", score="PEP", peptide="Sequence", smallest=smallest, gates={"chimeric": "Chimeric = '+'"})
    sets = files.read_key_sets(spark, path, keys=["Raw file", "Scan"], sets=["Sequence", "Organism"])
    sets = sets.select(F.col("Raw file").alias("file"), F.substring("Scan", 6, 20).cast("long").alias("scan"), F.array_join("Sequence", ",").alias("peptides"), F.array_join("Organism", ",").alias("organisms"))
    least = best(True).select("file", "scan", F.col("peptide").alias("least"))
    return best(False).withColumnRenamed("peptide", "best").join(least, ["file", "scan"]).join(sets, ["file", "scan"])


@query("SELECT 'name=' || n_name AS file, sha256(n_regionkey || chr(10)) AS sha256, n_nationkey AS canonical, (octet_length(encode(n_regionkey::VARCHAR)) + 1)::BIGINT AS length FROM nation")
def published_files(spark, d):
    """Nations published as files after an audit, their digests, stitched to their canonical numbers."""
    n = table(spark, d, "nation")
    path = new_folder(spark, "published")

    def audit(written):
        if written.count() != n.count():
            raise ValueError("rows are missing")

    predictions.publish(n, f"{path}/nation", audit)
    rows = spark.read.parquet(f"{path}/nation")
    rows.select("n_name", F.col("n_regionkey").cast("string").alias("value")).withColumnRenamed("n_name", "name").repartition("name").write.partitionBy("name").text(f"{path}/texts")
    digests = files.tree_digest(spark, f"{path}/texts").withColumn("file", F.url_decode(F.regexp_extract("path", "/(name=[^/]+)/part-", 1))).filter("file <> ''")
    shards = digests.select("file", "length", "sha256", F.lit(0).alias("shard"), F.col("file").alias("local"))
    index = rows.select(F.lit(0).alias("shard"), F.concat(F.lit("name="), "n_name").alias("local"), F.col("n_nationkey").alias("canonical"))
    return predictions.stitched(shards, index, "shard", "local", "canonical").select("file", "sha256", "canonical", "length")


@query("""
    WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    near AS (SELECT q.vec_id, q.label, t.label AS found, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(greatest(0, 1 - list_cosine_similarity(q.e, t.e)), 9), t.vec_id) AS no FROM v q JOIN v t ON q.vec_id <> t.vec_id WHERE q.vec_id % 100 = 0),
    votes AS (SELECT vec_id, label, found, count(*) AS n FROM near WHERE no <= 10 GROUP BY ALL),
    best AS (SELECT vec_id, label, arg_min(found, (-n, found)) AS predicted FROM votes GROUP BY ALL)
    SELECT count(*) AS n, count(*) FILTER (label = predicted) AS n_right, count(*) FILTER (label = predicted) / count(*) AS accuracy FROM best""")
def knn_share(spark, d):
    """The share of vectors whose label their ten nearest tell."""
    rows = table(spark, d, "embeddings")
    return retrieval.knn_accuracy(rows, rows.filter("vec_id % 100 = 0"), "vec_id", "label", "embedding", 10)

"""Queries that curate rows over the given tables: labels from search results, batches, peaks dealt anew, fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakloom.functions import digests, text
from peakloom.operators import dedup, interventions, partners, retrieval, sequences
from peakloom.plans import pipelines
from peakloom.plans.queries import PAIRS_SQL, PEAKS_SQL, SHA, peak_sums, precursors, query, scored_pairs, spectra
from peakloom.plans.scratch import new_folder
from peakloom.session import table
from peakloom.sources import predictions
from peakloom.sources import spectra as files
from peakloom.streaming import events

#: A label's sequence: the first hex digits of its MD5, by letters.
LETTERS = ("0123456789abcdef", "MAPETIDKMSGHVLFY")
#: Labels whose results one search-result file holds.
LABELS = 2048


def sequence(label):
    return F.translate(F.substring(F.md5(label.cast("string")), 1, 12), *LETTERS)


def search_results(spark, d) -> str:
    """The orders as mzIdentML files, one folder a run: each label's peptide with deltas at every other M, and results.

    A file holds the results of LABELS neighbouring labels and all peptides that they may name, so files grow in number,
    not in size.
    """
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("y")).withColumn("run", F.concat(F.lit("run"), F.col("id") % 3))
    part = lambda y: F.floor(y / LABELS).alias("part")
    attribute = lambda name, value: F.concat(F.lit(f' {name}="'), value.cast("string"), F.lit('"'))
    seq = sequence(F.col("y"))
    letters = F.filter(F.transform(F.split(seq, ""), lambda c, i: F.when((c == "M") & ((F.col("y") + i) % 2 == 0), i + 1)), lambda x: x.isNotNull())
    mods = F.array_join(F.transform(letters, lambda p: F.concat(F.lit("<Modification"), attribute("location", p), attribute("monoisotopicMassDelta", F.lit("15.994915")), F.lit("/>"))), "")
    other = F.lit('<Modification location="1" monoisotopicMassDelta="57.021464"/>')
    peptide = F.concat(F.lit("<Peptide"), attribute("id", F.concat(F.lit("p"), "y")), F.lit("><PeptideSequence>"), seq, F.lit("</PeptideSequence>"), other, mods, F.lit("</Peptide>"))
    item = lambda rank, passes, y: F.concat(F.lit("<SpectrumIdentificationItem"), attribute("rank", F.lit(rank)), attribute("passThreshold", passes), attribute("peptide_ref", F.concat(F.lit("p"), y)), F.lit("/>"))
    items = F.concat(item(2, F.lit("true"), F.col("y") + 1), item(1, F.lit("true"), F.col("y") + 1), item(1, F.when(F.col("id") % 5 == 0, "false").otherwise("true"), F.col("y")))
    result = F.concat(F.lit("<SpectrumIdentificationResult"), attribute("spectrumID", F.concat(F.lit("controller=1 scan="), "id")), F.lit(">"), items, F.lit("</SpectrumIdentificationResult>"))
    at = lambda k, value, p: [F.col("run"), p, F.lit(k).alias("k"), value.alias("value")]
    # A result may name the label after its own, which may be the first of the next file's.
    named = F.explode(F.array_distinct(F.array(part(F.col("y")), part(F.col("y") - 1)))).alias("part")
    peptides = o.select("run", "y").distinct().select(*at(1, peptide, named))
    results = o.select(*at(2, result, part(F.col("y"))))
    ends = [peptides.select("run", "part").distinct().select(*at(k, F.lit(tag), F.col("part"))) for k, tag in ((0, "<MzIdentML>"), (3, "</MzIdentML>"))]
    rows = peptides.unionByName(results).unionByName(ends[0]).unionByName(ends[1])
    path = new_folder(spark, "mzid")
    rows.repartition("run", "part").sortWithinPartitions("run", "part", "k").select("run", "part", "value").write.partitionBy("run", "part").text(path)
    return path


@query("""
    WITH o AS (SELECT o_orderkey AS id, o_custkey AS y, 'run' || o_orderkey % 3 AS run FROM orders),
    p AS (SELECT y, s, array_to_string([s[i] || CASE WHEN s[i] = 'M' AND (y + i - 1) % 2 = 0 THEN '+15.995' ELSE '' END FOR i IN range(1, 13)], '') AS label
          FROM (SELECT DISTINCT y, translate(left(md5(y::VARCHAR), 12), '0123456789abcdef', 'MAPETIDKMSGHVLFY') AS s FROM o)),
    here AS (SELECT DISTINCT run, y FROM o),
    found AS (SELECT id, run, CASE WHEN id % 5 = 0 THEN y + 1 ELSE y END AS y FROM o),
    new AS (SELECT id, label FROM found JOIN here USING (run, y) JOIN p USING (y))
    SELECT o.id AS spectrum_id, coalesce(new.label, own.s) AS label, CASE WHEN new.label IS NULL THEN 'unmatched' WHEN new.label = own.s THEN 'same' ELSE 'updated' END AS relabel
    FROM o JOIN p own USING (y) LEFT JOIN new ON new.id = o.id""")
def relabelled_spectra(spark, d):
    """Spectra with the labels, modifications put in, that search results in XML have for their run and scan."""
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("spectrum_id"), F.concat(F.lit("data/run"), F.col("o_orderkey") % 3, F.lit(".mgf")).alias("peak_file"), sequence(F.col("o_custkey")).alias("label"))
    labels = predictions.mzid_labels(spark, search_results(spark, d), run=F.regexp_extract("path", "run=([^/]+)/", 1))
    return predictions.relabelled(rows, labels, file_col="peak_file", scan_col="spectrum_id", label_col="label").select("spectrum_id", "label", "relabel")


@query("""
    SELECT * FROM (SELECT count(*) AS n, count(*) FILTER (n_chars < 200) AS n_short, count(*) FILTER (text IS NULL OR text = '') AS n_empty, count(DISTINCT lang) AS langs, coalesce(sum(n_chars), 0)::BIGINT AS chars FROM documents)""")
def counted_write(spark, d):
    """Documents written by language, and what was counted while they were written."""
    docs = table(spark, d, "documents")
    one = F.lit(1).cast("long")
    counts = {
        "n": F.count(one), "n_short": F.count(F.when(F.col("n_chars") < 200, one)), "n_empty": F.count(F.when(F.coalesce("text", F.lit("")) == "", one)), "chars": F.coalesce(F.sum("n_chars"), F.lit(0).cast("long")),
    }
    path = new_folder(spark, "counted")
    predictions.publish_counted(docs, path, counts, partition_by=["lang"], source=d)
    told = spark.read.option("multiLine", True).json(f"{path}.manifest.json").select("counts.*")
    langs = spark.read.parquet(path).agg(F.countDistinct("lang").alias("langs"))
    return told.select(*(F.col(c).cast("long").alias(c) for c in counts)).crossJoin(langs)  # one row each


def dealt_sql() -> str:
    """The peaks of a batch numbered by one hash, the places by another."""
    number = lambda kind: f"row_number() OVER (PARTITION BY spectrum_id % 5 ORDER BY {SHA.format(f"'deal', '{kind}', spectrum_id::VARCHAR, (pos - 1)::VARCHAR")}, spectrum_id)"
    steps = f"""a AS (SELECT spectrum_id % 5 AS b, mz, intensity, {number('peak')} AS no FROM p),
    z AS (SELECT spectrum_id % 5 AS b, spectrum_id, {number('place')} AS no FROM p),
    dealt AS (SELECT spectrum_id, mz, intensity FROM z JOIN a USING (b, no))"""
    return PEAKS_SQL.format(steps=steps, last="dealt", order="mz, intensity")


@query(dealt_sql())
def dealt_peaks(spark, d):
    """The peaks of a batch of spectra dealt anew among them."""
    batches = spectra(spark, d).withColumn("batch", F.col("spectrum_id") % 5)
    return peak_sums(interventions.dealt_peaks(batches, ["batch"], "spectrum_id", "peaks", "deal"))


@query("""
    WITH l AS (SELECT l_orderkey AS id, list(l_extendedprice::FLOAT ORDER BY l_linenumber, l_partkey, l_extendedprice, l_quantity) AS mz,
                      list(l_quantity::FLOAT ORDER BY l_linenumber, l_partkey, l_extendedprice, l_quantity) AS x FROM lineitem GROUP BY l_orderkey),
    s AS (SELECT id, o_totalprice::FLOAT AS m, id % 3 + 2 AS z, mz, x FROM l JOIN orders ON o_orderkey = id)
    SELECT DISTINCT s.id AS spectrum_id FROM s JOIN s k ON k.id % 7 = 0 AND s.m = k.m AND s.z = k.z AND s.mz = k.mz AND s.x = k.x""")
def known_spectra(spark, d):
    """Spectra that a probe holds as well, told by the fingerprint of their 32-bit values; the probe's differ beyond these."""
    rows = spectra(spark, d)
    known = rows.filter("spectrum_id % 7 = 0").withColumn("peaks", F.transform("peaks", lambda p: F.struct(p["mz"].cast("float").cast("double").alias("mz"), p["intensity"].alias("intensity"))))
    known = known.withColumn("precursor_mz", F.col("precursor_mz").cast("float").cast("double"))
    cheap = lambda x: x.withColumn("mz32", F.col("precursor_mz").cast("float"))
    print32 = digests.spectrum_fingerprint(F.col("precursor_mz"), F.col("charge"), F.col("peaks.mz"), F.col("peaks.intensity"))
    return dedup.known_rows(cheap(rows), cheap(known), ["mz32", "charge"], print32, "spectrum_id")


def batches_sql(each: int, rows: int) -> str:
    run = lambda no: f"{no} // {each} AS run, {no} % {each} AS place"
    return f"""
    WITH s AS (SELECT o_orderkey AS id, o_custkey AS y, o_orderkey % 3 + 2 AS z, o_totalprice AS m FROM orders WHERE o_totalprice > 0),
    v AS (SELECT y, z, median(m) AS mid FROM s GROUP BY y, z HAVING count(*) >= {rows}),
    n AS (SELECT *, row_number() OVER (PARTITION BY z ORDER BY mid, y) - 1 + ('0x' || left({SHA.format("'batch', '0', 'shift', z::VARCHAR")}, 8))::BIGINT % {each} AS no FROM v),
    p AS (SELECT y, z, mid, {run('no')}, count(*) OVER (PARTITION BY z, no // {each}) AS c FROM n),
    g AS (SELECT *, least(mid - lag(mid) OVER w, lead(mid) OVER w - mid) / mid * 1e6 AS gap FROM p WHERE c = {each} WINDOW w AS (PARTITION BY z, run ORDER BY place)),
    r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY z) - 1 AS turn FROM p WHERE c < {each}),
    q AS (SELECT y, z, turn, row_number() OVER (PARTITION BY turn ORDER BY z, mid, y) - 1 AS no FROM r),
    h AS (SELECT y, z, turn, {run('no')}, count(*) OVER (PARTITION BY turn, no // {each}) AS c FROM q),
    chosen AS (
        SELECT y, z, place, z || '-' || run AS batch, CASE WHEN gap <= 10 THEN 'strict' WHEN gap <= 20000 THEN 'relaxed' ELSE 'same_charge' END AS tier FROM g
        UNION ALL SELECT y, z, place, 'all-' || turn || '-' || run, 'global' FROM h WHERE c = {each}),
    t AS (SELECT *, row_number() OVER (PARTITION BY y, z ORDER BY {SHA.format("'batch', '0', id::VARCHAR")}, id) - 1 AS k FROM s)
    SELECT batch, (place * {rows} + k)::INT AS place, id AS spectrum_id, y AS label, z AS charge, tier FROM t JOIN chosen USING (y, z) WHERE k < {rows}"""


@query(batches_sql(4, 2))
def matched_batches(spark, d):
    """Batches of four labels, two spectra of each, near in mass at one charge."""
    return partners.matched_batches(precursors(spark, d), row_id="spectrum_id", mz="precursor_mz", charge="charge", label="label", labels_each=4, rows_each=2, seed="batch", cut=1000.0).withColumn("charge", F.col("charge").cast("long"))


@query()
def embedding_coherence(spark, d):
    """How far the vectors' singular vectors lean on single rows or components."""
    got = retrieval.coherence(table(spark, d, "embeddings"), "embedding")
    return spark.createDataFrame([(k, float(v)) for k, v in got.items()], "metric string, value double")


def probe_sql(sizes: dict[str, int]) -> str:
    def quota(split: str) -> str:
        return f"""{split}_q AS (SELECT len, base + (row_number() OVER (ORDER BY share - base DESC, n DESC, len) <= {sizes[split]} - sum(base) OVER ())::INT AS quota
            FROM (SELECT *, n * {sizes[split]}::DOUBLE / sum(n) OVER () AS share, floor(share)::BIGINT AS base FROM (SELECT len, count(*) AS n FROM s GROUP BY len)))"""

    def holdout(split: str, but: str) -> str:
        return f"""{quota(split)},
    {split}_c AS (SELECT run, list(coalesce(n, 0) ORDER BY len) AS have, row_number() OVER (ORDER BY {SHA.format(f"'probe', '{split}', 'run', run")}, run) AS i
        FROM (SELECT DISTINCT run FROM one {but}) CROSS JOIN {split}_q LEFT JOIN (SELECT run, len, count(*) AS n FROM one GROUP BY ALL) USING (run, len) GROUP BY run),
    {split}_r(i, rest, take) AS (
        SELECT 0::BIGINT, (SELECT list(quota::BIGINT ORDER BY len) FROM {split}_q), NULL::BIGINT[]
        UNION ALL SELECT c.i, [rest[j] - least(rest[j], have[j]) FOR j IN range(1, len(have) + 1)], [least(rest[j], have[j]) FOR j IN range(1, len(have) + 1)] FROM {split}_r r JOIN {split}_c c ON c.i = r.i + 1),
    {split}_t AS (SELECT run, lens[j] AS len, take[j] AS n FROM {split}_r JOIN {split}_c USING (i), (SELECT list(len ORDER BY len) AS lens FROM {split}_q), range(1, 100) g(j) WHERE j <= len(lens) AND take[j] > 0),
    {split}_rows AS (SELECT id, run, key, len FROM (SELECT *, row_number() OVER (PARTITION BY run, len ORDER BY {SHA.format(f"'probe', '{split}', 'row', id::VARCHAR")}, id) AS no FROM one) JOIN {split}_t USING (run, len) WHERE no <= n)"""

    return f"""
    WITH RECURSIVE s AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m') AS run, o_custkey || '-' || o_orderkey % 5 AS key, 7 + o_orderkey % 4 AS len FROM orders),
    one AS (SELECT * FROM s WHERE key IN (SELECT key FROM s GROUP BY key HAVING count(DISTINCT run) = 1)),
    {holdout("val", "")},
    {holdout("test", "WHERE run NOT IN (SELECT run FROM val_t)")},
    {quota("train")},
    train_rows AS (SELECT id FROM (
        SELECT *, row_number() OVER (PARTITION BY len ORDER BY {SHA.format("'probe', 'train', id::VARCHAR")}, id) AS no FROM s
        WHERE run NOT IN (SELECT run FROM val_t) AND run NOT IN (SELECT run FROM test_t) AND key NOT IN (SELECT key FROM val_rows) AND key NOT IN (SELECT key FROM test_rows)) JOIN train_q USING (len) WHERE no <= quota)
    SELECT id AS spectrum_id, 'val' AS split FROM val_rows UNION ALL SELECT id, 'test' FROM test_rows UNION ALL SELECT id, 'train' FROM train_rows"""


PROBE = {"val": 40, "test": 60, "train": 500}


@query(probe_sql(PROBE))
def probe_split(spark, d):
    """Validation and test from whole months, train from others, lengths in proportion."""
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("spectrum_id"), F.date_format("o_orderdate", "yyyy-MM").alias("run"), F.concat_ws("-", "o_custkey", F.col("o_orderkey") % 5).alias("key"), (7 + F.col("o_orderkey") % 4).alias("length"))
    return pipelines.probe_split(rows, run="run", key="key", length="length", row_id="spectrum_id", sizes=PROBE, seed="probe").select("spectrum_id", "split")


@query(f"""
    WITH {PAIRS_SQL},
    g AS (SELECT step % 2 AS pair_set, unnest(['partition', 'pooled']) AS scope, unnest([step, NULL]) AS step, distance, label FROM pairs),
    s AS (SELECT pair_set, scope, step, distance, sum(label) AS pos, sum(1 - label) AS neg FROM g GROUP BY ALL),
    c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER t AS np, sum(neg) OVER t AS nn FROM s WINDOW w AS (PARTITION BY pair_set, scope, step ORDER BY distance ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY pair_set, scope, step)),
    m AS (SELECT pair_set, scope, step, 'auc' AS metric, 1 - sum((cn - neg) * pos + pos * neg / 2.0) / any_value(np * nn) AS value FROM c GROUP BY ALL
          UNION ALL SELECT pair_set, scope, step, 'average_precision', sum(pos * cp / (cp + cn)) / sum(pos) FROM c GROUP BY ALL)
    SELECT pair_set, scope, step::VARCHAR AS step, metric, round(value, 6) AS value FROM m UNION ALL SELECT pair_set, 'macro', NULL, metric, round(avg(value), 6) FROM m WHERE scope = 'partition' GROUP BY ALL""")
def pooled_pairs(spark, d):
    """Pair metrics by step, their mean over steps, and ranked over all pairs of a set (odd or even steps)."""
    rows = scored_pairs(spark, d).withColumn("pair_set", F.col("step") % 2)
    got = pipelines.pooled_and_macro(rows, "pair_set", "step", "distance", "label").filter("metric in ('auc', 'average_precision')")
    return got.select("pair_set", "scope", F.col("step").cast("string").alias("step"), "metric", F.round("value", 6).alias("value"))


@query("""
    WITH p AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY l_orderkey),
    s AS (SELECT o_orderkey AS id, n, row_number() OVER (ORDER BY o_orderkey) - 1 AS no FROM orders JOIN p ON o_orderkey = id WHERE o_orderkey % 3 < 2 AND o_totalprice < 400000)
    SELECT id AS full_index, no AS supported_index, n AS n_peaks, '' AS problem FROM s
    UNION ALL SELECT o_orderkey, -1, -1, CASE WHEN o_orderkey % 3 = 2 THEN 'unsupported' ELSE 'precursor' END FROM orders JOIN p ON o_orderkey = id WHERE o_orderkey NOT IN (SELECT id FROM s)""")
def mgf_export(spark, d):
    """Spectra of charge 2 or 3 exported, and each record's place among them, read back from the files; rejected rows with the reason."""
    rows = spectra(spark, d).withColumn("sequence", sequence(F.col("label"))).withColumn("precursor_mz", F.when(F.col("precursor_mz") < 400_000, F.col("precursor_mz")))
    path = new_folder(spark, "export")
    files.export_mgf(rows, path, index="spectrum_id", precursor_mz="precursor_mz", charge="charge", peaks="peaks", sequence="sequence", supported=F.col("charge") < 4)
    got = files.read_mgf(spark, f"{path}/mgf").filter("problem is null").select(F.regexp_extract(F.col("headers")["TITLE"], r"index=(\d+)", 1).cast("long").alias("full_index"), F.size("mz_array").cast("long").alias("n_peaks"))
    index = spark.read.parquet(f"{path}/index")
    none = F.lit(-1).cast("long")
    rejected = spark.read.parquet(f"{path}/rejected").select("full_index", none.alias("supported_index"), none.alias("n_peaks"), "problem")
    return index.join(got, "full_index").select("full_index", "supported_index", "n_peaks", F.lit("").alias("problem")).unionByName(rejected)


def beam_sql() -> str:
    masses = " ".join(f"WHEN '{k}' THEN {v}" for k, v in text.RESIDUES.items())
    off = lambda loss, k: f"((m + {loss} + 18.010565) / z + 1.00727646688 - (mz - {k} * 1.00335 / z)) / mz * 1e6"
    return f"""
    WITH o AS (SELECT o_orderkey AS id, o_orderkey % 3 + 2 AS z, reverse(translate(left(md5(o_custkey::VARCHAR), 12), '0123456789abcdef', 'MAPETIDKMSGHVLFY')) AS s FROM orders),
    e AS (SELECT id, z, i, sum(CASE s[i + 1] {masses} END) OVER (PARTITION BY id ORDER BY i) AS m FROM o, range(0, 12) r(i)),
    t AS (SELECT id, z, (m + 18.010565) / z + 1.00727646688 AS whole FROM e WHERE i = 11),
    x AS (SELECT e.*, CASE id % 4 WHEN 0 THEN whole WHEN 1 THEN whole + 1.00335 / e.z WHEN 2 THEN whole / 2 ELSE whole + 5 END AS mz FROM e JOIN t USING (id)),
    d AS (SELECT *, abs({off(0, 0)}) < 50 OR abs({off(0, 1)}) < 50 AS fits, {off(-17.027, 0)} > 50 AND {off(-17.027, 1)} > 50 AS beyond FROM x),
    early AS (SELECT id, min(i) AS step FROM d WHERE beyond AND NOT fits GROUP BY id)
    SELECT d.id AS spectrum_id, coalesce(step, 12)::INT AS step, TRUE AS finished, step IS NULL AND fits AS fits, FALSE AS discarded FROM d LEFT JOIN early USING (id) WHERE d.i = 11"""


@query(beam_sql())
def beam_ends(spark, d):
    """Where each label's peptide, decoded from its end, stops: at its stop token, or where it is too heavy for the precursor."""
    letters = F.filter(F.split(F.reverse(sequence(F.col("label"))), ""), lambda c: c != "")
    rows = precursors(spark, d).withColumn("tokens", letters)
    whole = text.peptide_mass(F.col("tokens")) / F.col("charge") + text.PROTON
    k = F.col("spectrum_id") % 4
    mz = F.when(k == 0, whole).when(k == 1, whole + 1.00335 / F.col("charge")).when(k == 2, whole / 2).otherwise(whole + 5)
    end = sequences.beam_end(F.array_append("tokens", F.lit("$")), F.col("mz"), F.col("charge"), text.RESIDUES | {"-17.027": -17.027}, n_term=("-17.027",), min_length=6, ppm=50.0)
    return rows.withColumn("mz", mz).select("spectrum_id", end.alias("e")).select("spectrum_id", "e.*")


@query("SELECT lang, count(*) AS n, count(*) - count(DISTINCT coalesce(text, '')) AS n_repeats FROM documents GROUP BY lang")
def streamed_repeats(spark, d):
    """Documents read as a stream, and how many of each language repeat a text that its stream has met, told by state."""
    like, out = table(spark, d, "documents"), new_folder(spark, "stream")
    docs = spark.readStream.schema(like.schema).parquet(f"{d}/[d]ocuments.parquet").select("lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    marked = events.marked_repeats(docs, ["lang", "digest"])
    marked.writeStream.outputMode("append").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("append").parquet(f"{out}/rows")).start().awaitTermination()
    return spark.read.schema(marked.schema).parquet(f"{out}/rows").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("repeat").cast("long")).alias("n_repeats"))

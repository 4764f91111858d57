"""Prediction and report files: readers that check what they read, writers that check what they are given."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from peakloom.functions.text import with_deltas
from peakloom.operators.checks import assert_empty, assert_unique

SCHEMA = (
    "canonical_index long, spectrum_id string, peak_file string, scan_id long, title string, species string, split string, source_row_index long, precursor_mz double, precursor_charge double, "
    "isolation_low double, isolation_high double, true_sequence string, predicted_sequence string, peptide_confidence double, no_prediction boolean"
)


def read_predictions(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """Predictions with unique canonical indices, from 0 to n - 1 if n is given; others stop the job."""
    rows = spark.read.schema(SCHEMA).option("header", True).option("mode", "FAILFAST").csv(path)
    assert_unique(rows, "canonical_index")
    if n is not None:
        assert_empty(rows.filter(~F.col("canonical_index").between(0, n - 1)), f"indices must lie in 0 to {n - 1}")
    return rows


def write_predictions(rows: DataFrame, path: str, n: int | None = None) -> DataFrame:
    """Writes one row an index, the first by title of repeated ones, and with n checks that every index is there."""
    from peakloom.operators.dedup import winners

    one = winners(rows, ["canonical_index"], ["title"])
    if n is not None:
        missing = rows.sparkSession.range(n).select(F.col("id").alias("canonical_index")).join(one, "canonical_index", "left_anti")
        assert_empty(missing, "every index must have a prediction")
    one.write.option("header", True).csv(path)
    return one


def with_denominator(index: DataFrame, predictions: DataFrame, key: str, score: str) -> DataFrame:
    """All of the index, with predictions where there are any: rows without one have the score null, which ranks last."""
    return index.join(predictions, key, "left").withColumn("no_prediction", F.col(score).isNull())


def stitched(shards: DataFrame, index: DataFrame, shard: str, local: str, canonical: str) -> DataFrame:
    """Shards' rows under their canonical index. Unknown places and repeated indices stop the job."""
    assert_unique(index, canonical)
    assert_empty(shards.select(shard, local).join(index, [shard, local], "left_anti"), "every row must be in the index")
    out = shards.join(index, [shard, local])
    assert_unique(out, canonical)
    return out


def validate_psms(psms: DataFrame, score: str) -> DataFrame:
    """psms (read_mztab) as columns PSM_ID, sequence, score, spectra_ref; a wrong id order, score or reference stops the job."""
    p = F.col("psm")
    rows = psms.select("file", p["PSM_ID"].try_cast("long").alias("PSM_ID"), F.nullif(p["sequence"], F.lit("null")).alias("sequence"), p[score].alias("text"), p[score].try_cast("double").alias("score"), p["spectra_ref"].alias("spectra_ref"))
    assert_empty(rows.filter("PSM_ID is null"), "ids must be whole numbers")
    assert_unique(rows, "file", "PSM_ID")
    span = rows.groupBy("file").agg(F.min("PSM_ID").alias("a"), F.max("PSM_ID").alias("z"), F.count(F.lit(1)).alias("n"))
    assert_empty(span.filter("z - a + 1 <> n or a not in (0, 1)"), "ids must be consecutive from 0 or 1")
    assert_empty(rows.filter("score is null and lower(text) not in ('null', '')"), "scores must be numbers or null")
    return rows.drop("text")


def read_mzid(spark: SparkSession, path: str) -> DataFrame:
    """(spectrum, peptide_ref, charge, observed_mz): of each result the items of rank 1 that pass the threshold. Plain or gzip."""
    item = "array<struct<_rank:int,_passThreshold:boolean,_peptide_ref:string,_chargeState:int,_experimentalMassToCharge:double>>"
    rows = spark.read.format("xml").schema(f"_spectrumID string, SpectrumIdentificationItem {item}").option("rowTag", "SpectrumIdentificationResult").load(path)
    i = F.explode(F.filter("SpectrumIdentificationItem", lambda x: (x["_rank"] == 1) & x["_passThreshold"])).alias("i")
    return rows.select(F.col("_spectrumID").alias("spectrum"), i).select("spectrum", F.col("i._peptide_ref").alias("peptide_ref"), F.col("i._chargeState").alias("charge"), F.col("i._experimentalMassToCharge").alias("observed_mz"))


def mzid_labels(
    spark: SparkSession, path: str, *, run: Column | None = None, suffix: str = "_msgfplus.mzid.gz", delta: float = 15.99491463, tolerance: float = 1e-4, residue: str = "M", token: str = "+15.995"
) -> DataFrame:
    """(run, scan, label): each scan's peptide, with token after every residue that carries a modification of mass delta.

    Two kinds of rows of the same XML files meet by their references: peptides, and results' items of rank 1 that pass
    the threshold (which they do unless the file says otherwise). Of several, a scan's last one in the file counts, and of
    peptides with one id the last. Modifications of other masses, or without a mass or place, are left out; one at a
    wrong place stops the job. Scans whose peptide is missing or has no sequence are left out. run: from the column
    `path` of a file, its name less suffix unless given. Gzip or plain.
    """
    run = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), f"{re.escape(suffix)}$", "") if run is None else run
    origin = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")]
    at = F.struct("start", F.monotonically_increasing_id().alias("no"))  # rows of one block of a file are in its order
    xml = lambda tag, schema: spark.read.format("xml").schema(schema).option("rowTag", tag).load(path)
    parts = xml("Peptide", "_id string, PeptideSequence string, Modification array<struct<_location:string,_monoisotopicMassDelta:string>>")
    near = lambda m: F.abs(m["_monoisotopicMassDelta"].try_cast("double") - delta) <= tolerance
    places = F.filter(F.transform(F.filter("Modification", near), lambda m: m["_location"].try_cast("int")), lambda x: x.isNotNull())
    made = parts.select("_id", F.nullif("PeptideSequence", F.lit("")).alias("seq"), places.alias("places"), *origin).withColumn("at", at)
    made = made.groupBy("path", F.col("_id").alias("ref")).agg(F.max_by(F.struct("seq", "places"), "at").alias("p"))
    labels = made.select("path", "ref", with_deltas(F.col("p.seq"), F.col("p.places"), residue, token).alias("label"))
    results = xml("SpectrumIdentificationResult", "_spectrumID string, SpectrumIdentificationItem array<struct<_rank:string,_passThreshold:string,_peptide_ref:string>>")
    able = lambda i: (i["_rank"] == "1") & (F.lower(F.coalesce(i["_passThreshold"], F.lit("true"))) == "true") & (F.coalesce(i["_peptide_ref"], F.lit("")) != "")
    scan = F.coalesce(*(F.regexp_extract("_spectrumID", rf"(?:^|\s){w}=(\d+)(?:\s|$)", 1).try_cast("long") for w in ("scan", "scans?")))
    items = results.select(scan.alias("scan"), F.try_element_at(F.filter("SpectrumIdentificationItem", able), F.lit(-1))["_peptide_ref"].alias("ref"), *origin)
    items = items.withColumn("at", at).filter("scan is not null and ref is not null")
    last = items.groupBy("path", "scan").agg(F.max_by("ref", "at").alias("ref"))
    return last.join(labels, ["path", "ref"]).filter("label is not null").select(run.alias("run"), "scan", "label")


def relabelled(rows: DataFrame, labels: DataFrame, *, file_col: str, scan_col: str, label_col: str) -> DataFrame:
    """rows with the label that `labels` (run, scan, label; one row a scan) has for their file and scan, and `relabel`:
    "updated", "same", or "unmatched" where there is none and the row keeps its own. A file's run is its name less the last extension.
    """
    run = F.regexp_replace(F.regexp_extract(file_col, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    new = labels.select(F.col("run").alias("_run"), F.col("scan").alias("_scan"), F.col("label").alias("_label"))
    met = rows.join(new, (run == F.col("_run")) & (F.col(scan_col).cast("long") == F.col("_scan")), "left")
    state = F.when(F.col("_label").isNull(), "unmatched").when(F.col("_label").eqNullSafe(F.col(label_col)), "same").otherwise("updated")
    return met.withColumn("relabel", state).withColumn(label_col, F.coalesce("_label", F.col(label_col))).drop("_run", "_scan", "_label")


def publish_counted(df: DataFrame, path: str, counts: dict[str, Column], check: Callable[[dict], None] | None = None, partition_by: list[str] = (), keep: Column | None = None, **facts) -> dict:
    """Writes df, or its rows for which keep holds, to a path that is free, with a manifest.json of its counts beside it as path.manifest.json; returns them.

    counts: aggregate expressions over all of df's rows, such as counts of reject reasons, taken while the rows are written:
    the table is scanned once. check(counts) raises to stop; then nothing stands at the path. The manifest is moved into place
    whole, after the table.
    """
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    staging, target = hadoop.Path(f"{path}.staging"), hadoop.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    seen = Observation()
    rows = df.observe(seen, *(c.alias(k) for k, c in counts.items()))
    (rows if keep is None else rows.filter(keep)).write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}.staging")
    got = seen.get
    try:
        if check is not None:
            check(got)
    except Exception:
        fs.delete(staging, True)
        raise
    fs.rename(staging, target)
    write_text(spark, f"{path}.manifest.json", json.dumps({**facts, "counts": got}, sort_keys=True, indent=1, default=str) + "\n")
    return got


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written beside the path, then moved there in place of what it held."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    staging, target = hadoop.Path(f"{path}.tmp"), hadoop.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(staging, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(staging, target):
        raise OSError(f"{path} could not be moved into place")


def publish(df: DataFrame, path: str, audit, overwrite: bool = False) -> None:
    """Writes beside the path, audits what was written, then moves it there; what stood there stays as path.backup.

    audit(written) raises to stop; then nothing at the path has changed.
    """
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    staging, target, backup = (hadoop.Path(p) for p in (f"{path}.staging", path, f"{path}.backup"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target) and not overwrite:
        raise FileExistsError(path)
    df.write.mode("overwrite").parquet(f"{path}.staging")
    audit(spark.read.parquet(f"{path}.staging"))
    if fs.exists(target):
        if fs.exists(backup):
            raise FileExistsError(f"{path}.backup")
        fs.rename(target, backup)
    fs.rename(staging, target)


def report(rows: DataFrame, most: int = 100_000, **facts) -> str:
    """JSON with sorted keys of a small report: rows is one row a metric; more than `most` rows stop the job."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report has at most {most} rows")
    return json.dumps({**facts, "rows": [r.asDict(recursive=True) for r in found]}, sort_keys=True, indent=1, default=str)

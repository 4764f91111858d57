"""Spectrum and search-result files: MGF, mzTab, mzML and tab-separated tables.

All reading goes through Spark's own text, XML and CSV readers, so files may lie in any store that Spark reaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    """One row a spectrum: file, ordinal (from 0 in its file), headers map, mz_array, intensity_array, problem.

    Records are split at END IONS, so a large file is read by many tasks. problem tells what is wrong with a record: "nested"
    (two BEGIN IONS), "no begin", "bad peak" or "no peaks"; null if nothing is.
    """
    records = spark.read.option("lineSep", "END IONS").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r", "").alias("value"))
    body = records.filter(F.trim(F.regexp_replace("value", r"\s+", "")) != "")
    begins = F.size(F.regexp_extract_all("value", F.lit(r"(?m)^BEGIN IONS\s*$"), F.lit(0)))
    inner = F.element_at(F.split("value", r"(?m)^BEGIN IONS\s*$"), -1)
    lines = F.filter(F.transform(F.split(inner, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    headers = F.filter(lines, lambda x: x.rlike(r"^[A-Za-z_][A-Za-z0-9_]*="))
    peaks = F.filter(lines, lambda x: ~x.rlike(r"^[A-Za-z_][A-Za-z0-9_]*=|^[#;!/]"))
    part = lambda k: F.transform(peaks, lambda x: F.get(F.split(x, r"\s+"), F.lit(k)).try_cast("double"))
    # Records are numbered in their block of the file; a block starts from the count of those before it.
    body = body.withColumn("part", F.shiftright("at", 33))
    sizes = body.groupBy("file", "block", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("file", "block", "part").orderBy("at"))
    body = body.withColumn("own", own).join(sizes.withColumn("before", before).drop("n"), ["file", "block", "part"]).withColumn("ordinal", F.col("before") + F.col("own") - 1)
    numbered = body.select(
        "file", F.col("ordinal"), begins.alias("begins"), "value",
        F.map_from_entries(F.transform(F.array_distinct(F.transform(headers, lambda h: F.upper(F.substring_index(h, "=", 1)))), lambda k: F.struct(k, F.regexp_replace(F.filter(headers, lambda h: F.upper(F.substring_index(h, "=", 1)) == k)[0], "^[^=]*=", "")))).alias("headers"),
        part(0).alias("mz_array"), part(1).alias("intensity_array"),
    )
    problem = (
        F.when(F.col("begins") > 1, "nested").when(F.col("begins") == 0, "no begin")
        .when(F.exists("mz_array", lambda x: x.isNull()) | F.exists("intensity_array", lambda x: x.isNull()), "bad peak").when(F.size("mz_array") == 0, "no peaks")
    )
    return numbered.select("file", "ordinal", "headers", "mz_array", "intensity_array", problem.alias("problem"))


def mgf_text(title: Column, precursor_mz: Column, charge: Column, peaks: Column, sequence: Column | None = None) -> Column:
    """A record's text."""
    number = lambda x: F.format_string("%.6f", x)
    lines = [F.lit("BEGIN IONS"), F.concat(F.lit("TITLE="), title), F.concat(F.lit("PEPMASS="), number(precursor_mz)), F.concat(F.lit("CHARGE="), charge.cast("string"), F.lit("+"))]
    if sequence is not None:
        lines.append(F.concat(F.lit("SEQ="), sequence))
    return F.concat_ws("\n", *lines, F.array_join(F.transform(peaks, lambda p: F.concat(number(p["mz"]), F.lit(" "), number(p["intensity"]))), "\n"), F.lit("END IONS"))


def write_mgf(df: DataFrame, path: str, *, title: str, precursor_mz: str, charge: str, peaks: str, sequence: str | None = None) -> None:
    df.select(mgf_text(F.col(title), F.col(precursor_mz), F.col(charge), F.col(peaks), F.col(sequence) if sequence else None).alias("value")).write.option("lineSep", "\n\n").text(path)


def export_problem(precursor_mz: Column, charge: Column, sequence: Column, mzs: Column, intensities: Column) -> Column:
    """Why a record can't be exported: the first of "precursor", "charge", "sequence", "peaks", "mz", "intensity", else null."""
    sound = lambda x, low: F.coalesce(x.isNotNull() & ~F.isnan(x) & (x < float("inf")) & low(x), F.lit(False))
    every = lambda xs, low: F.coalesce(F.forall(xs, lambda x: sound(x, low)), F.lit(False))
    return (
        F.when(~sound(precursor_mz, lambda x: x > 0), "precursor")
        .when(~F.coalesce(charge >= 1, F.lit(False)), "charge")
        .when(~F.coalesce((sequence != "") & ~sequence.rlike(r"\s"), F.lit(False)), "sequence")
        .when(~F.coalesce((F.size(mzs) > 0) & (F.size(mzs) == F.size(intensities)), F.lit(False)), "peaks")
        .when(~every(mzs, lambda x: x > 0), "mz")
        .when(~every(intensities, lambda x: x >= 0), "intensity")
    )


def export_mgf(df: DataFrame, path: str, *, index: str, precursor_mz: str, charge: str, peaks: str, sequence: str, supported: Column | None = None, prefix: str = "index=") -> None:
    """Writes path/mgf, path/index (supported_index, full_index) and path/rejected (full_index, problem).

    Records in order of their index, a column of distinct numbers; their titles are prefix and index. Rows that are not
    `supported` are left out and listed as "unsupported", those with an `export_problem` with it. The files of path/mgf,
    in order of their names, hold the records in the order of supported_index, which counts from 0. The checked rows are
    stored once, as path/checked, sorted and dealt by ranges of the index.
    """
    spark = df.sparkSession
    problem = export_problem(F.col(precursor_mz), F.col(charge), F.col(sequence), F.col(f"{peaks}.mz"), F.col(f"{peaks}.intensity"))
    if supported is not None:
        problem = F.when(~F.coalesce(supported, F.lit(False)), "unsupported").otherwise(problem)
    checked = df.withColumn("_problem", problem).select(F.col(index).cast("long").alias("full_index"), "_problem", mgf_text(F.concat(F.lit(prefix), F.col(index).cast("string")), F.col(precursor_mz), F.col(charge), F.col(peaks), F.col(sequence)).alias("value"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    checked.repartitionByRange(parts, "full_index").sortWithinPartitions("full_index").withColumn("at", F.monotonically_increasing_id()).write.parquet(f"{path}/checked")
    rows = spark.read.parquet(f"{path}/checked")
    fine = rows.filter("_problem is null")
    # Each part's records are counted; a window over the parts gives where each starts.
    own = fine.select("full_index", F.shiftright("at", 33).alias("part"), "at")
    sizes = own.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("at")) - 1 + F.col("before")
    own.join(F.broadcast(sizes), "part").select(place.cast("long").alias("supported_index"), "full_index").write.parquet(f"{path}/index")
    rows.filter("_problem is not null").select("full_index", F.col("_problem").alias("problem")).write.parquet(f"{path}/rejected")
    fine.repartitionByRange(parts, "full_index").sortWithinPartitions("full_index").select("value").write.option("lineSep", "\n\n").text(f"{path}/mgf")


# The columns of the PSM section of an mzTab file, in their order.
PSM_COLUMNS = (
    "sequence PSM_ID accession unique database database_version search_engine search_engine_score[1] modifications retention_time charge "
    "exp_mass_to_charge calc_mass_to_charge spectra_ref pre post start end opt_ms_run[1]_aa_scores"
).split()


def read_mztab(spark: SparkSession, path: str, one_header: bool = False) -> DataFrame:
    """One row a PSM: file, and a map of the header's column names to texts.

    Every file has a header of its own, as write_mztab leaves them; PSMs of a file without one stop the job. With
    one_header a single file's header holds for all.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\t", -1).alias("parts"))
    header = rows.filter(F.col("parts")[0] == "PSH").groupBy("file").agg(F.first("parts").alias("names"))  # a row a file
    psms = rows.filter(F.col("parts")[0] == "PSM")
    joined = psms.join(F.broadcast(header.drop("file").limit(1)), how="left") if one_header else psms.join(header, "file", "left")  # one row
    names = F.when(F.col("names").isNull(), F.raise_error(F.concat(F.lit("no header in "), F.col("file"))).cast("array<string>")).otherwise(F.col("names"))
    return joined.withColumn("names", names).select("file", F.map_from_arrays(F.slice("names", 2, F.size("names") - 1), F.slice("parts", 2, F.size("names") - 1)).alias("psm"))


def psm_lines(psms: DataFrame) -> DataFrame:
    """value: PSM lines of the fixed columns, missing ones null."""
    have = set(psms.columns)
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) if c in have else F.lit("null") for c in PSM_COLUMNS]
    return psms.select(F.concat_ws("\t", F.lit("PSM"), *text).alias("value"))


def write_mztab(psms: DataFrame, path: str, title: str) -> None:
    """A folder of text parts, each a whole file: metadata and header come first in every part."""
    head = ["MTD\tmzTab-version\t1.0.0", "MTD\tmzTab-mode\tSummary", f"MTD\tdescription\t{title}", "PSH\t" + "\t".join(PSM_COLUMNS)]

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(head, pa.string())], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    psm_lines(psms).mapInArrow(headed, "value string").write.text(path)


def _param(name: str, params: Column) -> Column:
    return F.filter(params, lambda p: p["_name"] == name)[0]["_value"]


CV = "array<struct<_name:string,_value:string>>"
MZML = (
    f"_id string, _index long, _defaultArrayLength long, cvParam {CV}, "
    f"precursorList struct<precursor: array<struct<selectedIonList: struct<selectedIon: array<struct<cvParam: {CV}>>>>>>, "
    f"binaryDataArrayList struct<binaryDataArray: array<struct<cvParam: {CV}, binary: string>>>"
)


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """One row a spectrum: scan, ms_level, precursor_mz, precursor_charge, n_peaks, and the arrays' encoded texts with their terms."""
    raw = spark.read.format("xml").schema(MZML).option("rowTag", "spectrum").load(path)
    ion = F.col("precursorList.precursor")[0]["selectedIonList"]["selectedIon"][0]["cvParam"]
    return raw.select(
        F.regexp_extract("_id", r"scan=(\d+)", 1).try_cast("long").alias("scan"), _param("ms level", F.col("cvParam")).try_cast("int").alias("ms_level"),
        _param("selected ion m/z", ion).try_cast("double").alias("precursor_mz"), _param("charge state", ion).try_cast("int").alias("precursor_charge"),
        F.col("_defaultArrayLength").alias("n_peaks"), F.col("binaryDataArrayList.binaryDataArray").alias("arrays"),
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _decoded(text, bits, packed):
    import base64
    import zlib

    import numpy as np
    import pandas as pd

    out = []
    for t, n, z in zip(text, bits, packed):
        data = base64.b64decode(t or "")
        data = zlib.decompress(data) if z and data else data
        out.append(np.frombuffer(data, "<f8" if n == 64 else "<f4").astype(float).tolist())
    return pd.Series(out)


def mzml_peaks(spectra: DataFrame) -> DataFrame:
    """spectra of read_mzml with mz_array and intensity_array in place of the encoded texts."""
    def one(kind: str) -> Column:
        a = F.filter("arrays", lambda x: F.exists(x["cvParam"], lambda p: p["_name"] == kind))[0]
        has = lambda name: F.coalesce(F.exists(a["cvParam"], lambda p: p["_name"] == name), F.lit(False))
        return _decoded(F.regexp_replace(a["binary"], r"\s", ""), F.when(has("64-bit float"), 64).otherwise(32), has("zlib compression"))

    return spectra.withColumns({"mz_array": one("m/z array"), "intensity_array": one("intensity array")}).drop("arrays")


def read_best_psms(
    spark: SparkSession, path: str, *, file: str, scan: str, score: str, peptide: str, most_q: float | None = None, q: str | None = None, smallest: bool = False, gates: dict[str, str] | None = None
) -> DataFrame:
    """(file, scan, peptide, score): of a tab-separated table, the row of best score of each scan; ties: the smaller peptide.

    The largest score is best, or, as for error probabilities, the smallest. most_q bounds the column q; a row that meets
    one of the gates (name to SQL condition over the table's text columns) is left out, as are rows without score or scan.
    """
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    for condition in (gates or {}).values():
        rows = rows.filter(~F.coalesce(F.expr(condition), F.lit(False)))
    if most_q is not None:
        rows = rows.filter(F.col(q).try_cast("double") <= most_q)
    rows = rows.select(F.col(file).alias("file"), F.regexp_extract(F.col(scan), r"(\d+)$", 1).try_cast("long").alias("scan"), F.col(peptide).alias("peptide"), F.col(score).try_cast("double").alias("score")).filter("score is not null and scan is not null")
    key = F.col("score") if smallest else -F.col("score")
    best = rows.groupBy("file", "scan").agg(F.min(F.struct(key.alias("s"), "peptide")).alias("b"))
    return best.select("file", "scan", "b.peptide", (F.col("b.s") if smallest else -F.col("b.s")).alias("score"))


def read_key_sets(spark: SparkSession, path: str, *, keys: list[str], sets: list[str], sep: str = "\t") -> DataFrame:
    """(keys, a sorted array for each of `sets`): of a table of texts, the distinct values, not empty, that a key has.

    Values are made distinct before they meet, so a key with many rows, but few values, is no large group.
    """
    rows = spark.read.option("sep", sep).option("header", True).csv(path)
    out = rows.select(*keys).distinct()
    for c in sets:
        own = rows.filter(F.coalesce(F.trim(c), F.lit("")) != "").select(*keys, F.trim(c).alias(c)).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list(c)).alias(c))
        out = out.join(own, keys, "left").withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return out


def tree_digest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of each file below a folder; Spark reads whole files, one a row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def flat_arrays(df: DataFrame, row_id: str, array: str) -> tuple[DataFrame, DataFrame]:
    """(id, at, value) and (id, size) of a ragged column."""
    return df.select(row_id, F.posexplode(array).alias("at", "value")), df.select(row_id, F.size(array).alias("size"))


def filter_mgf(spark: SparkSession, source: str, target: str, low: int, high: int) -> None:
    """The records of MGF files whose charge lies in the range, byte for byte, as a folder of parts."""
    records = spark.read.option("lineSep", "END IONS").text(source).filter(F.col("value").contains("BEGIN IONS"))
    charge = F.regexp_extract("value", r"(?m)^CHARGE=\s*(\d+)", 1)
    records.filter(F.nullif(charge, F.lit("")).cast("int").between(low, high)).write.option("lineSep", "END IONS").text(target)


def finite_charge(z: Column, low: int, high: int) -> Column:
    """Whether a number is a whole charge of the range; not NaN, not 2.5, not null."""
    return F.coalesce(~F.isnan(z) & (z == F.floor(z)) & z.between(low, high), F.lit(False))

"""Tables: scans with column checks, rows by number, partitioned writes that are counted, manifests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.operators.checks import assert_empty


def scan(spark: SparkSession, path: str, columns: list[str], required: list[str] = (), renamed: dict[str, str] | None = None) -> DataFrame:
    """The columns that the table has, of those asked for; a missing required one is an error. renamed: old name to new."""
    df = spark.read.parquet(path)
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"{path} lacks {missing}")
    names = renamed or {}
    return df.select(*(F.col(f"`{c}`").alias(names.get(c, c)) for c in columns if c in df.columns))


def rows_by_number(table: DataFrame, wanted: DataFrame, number: str, check: str) -> DataFrame:
    """The table's rows of wanted numbers, whose `check` column must agree with the table's; others stop the job."""
    got = wanted.select(number, F.col(check).alias("_check")).join(table, number, "left")
    assert_empty(got.filter(~F.col(check).eqNullSafe(F.col("_check"))).select(number), f"{check} must agree")
    return got.drop("_check")


def harvest(texts: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """(kind, value): distinct matches of each pattern's first group."""
    found = F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1)).alias("values")) for k, p in patterns.items()))
    return texts.select(F.explode(found).alias("f")).select("f.kind", F.explode("f.values").alias("value")).distinct()


def without_present(files: DataFrame, present: DataFrame, path: str) -> DataFrame:
    """Files whose names (the last part of their paths) aren't there yet."""
    name = F.regexp_extract(F.col(path), r"[^/]+$", 0)
    return files.withColumn("_name", name).join(present.select(name.alias("_name")).distinct(), "_name", "left_anti").drop("_name")


def write_partitioned(df: DataFrame, path: str, by: list[str], rows_per_file: int = 100_000) -> DataFrame:
    """Writes one folder for each value, at most rows_per_file rows a file, and returns (by, n) as counted from what was written.

    Counts that differ from the input's stop the job.
    """
    counts = lambda x: x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    df.write.partitionBy(*by).option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(path)
    written = counts(df.sparkSession.read.schema(df.schema).parquet(path))
    expected = counts(df)
    assert_empty(expected.exceptAll(written).union(written.exceptAll(expected)), "written counts must agree")
    return written


def without_rows(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The table without rows whose keys are named; null keys are equal to null keys."""
    on = None
    other = gone.select(*(F.col(k).alias(f"_gone_{k}") for k in keys)).distinct()
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_gone_{k}"))
        on = same if on is None else on & same
    return table.join(other, on, "left_anti")


def read_arrays(spark: SparkSession, path: str, vectors: str, ids: str) -> DataFrame:
    """(file, row, id, vector) of NumPy archives that hold a matrix and as many ids; others stop the job. A file is one task's work."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import numpy as np

        for b in batches:
            for file, content in zip(b["path"], b["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    v, i = z[vectors], z[ids]
                if v.ndim != 2 or len(v) != len(i):
                    raise ValueError(f"{file}: {v.shape} vectors and {len(i)} ids")
                for k in range(0, len(v), 10_000):
                    yield pd.DataFrame({"file": file, "row": range(k, min(k + 10_000, len(v))), "id": [str(x) for x in i[k : k + 10_000]], "vector": [x.astype(float).tolist() for x in v[k : k + 10_000]]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(rows, "file string, row long, id string, vector array<double>")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a JSON document, however many lines it has."""
    return spark.read.option("multiLine", True).json(path)

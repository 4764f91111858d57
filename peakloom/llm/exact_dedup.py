"""Exact dedup by a tree merge of sorted digest runs, in DataFrame operations only.

A run is what one partition holds. In each round 2**radix neighbouring runs merge, while the digest prefix that a cell
covers grows by as many bits: cells stay as many and as large as at the start, and no round ends in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.llm.shared import saved


def _best(choice: str, what: str) -> Column:
    return F.max(what) if choice == "largest" else F.min(what)


def dedup_exact(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    choice: str = "smallest",
    radix: int = 4,
) -> DataFrame:
    """One row for each row of docs: id_col, keep_id, group_size long, kept boolean, text_sha256 string.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the smallest (or largest) id
    stays; of repeated rows with that id, one stays; null ids stay only where a group has no other. Merging verifies
    more than the digest: rows join only if SHA-256, an XXH64 and the length all agree. Other columns of docs are
    ignored; empty input gives an empty result.
    """
    if choice not in ("smallest", "largest"):
        raise ValueError("choice is 'smallest' or 'largest'")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # The null flag orders null ids last, row_no tells repeated rows apart.
    null_flag = F.col(id_col).isNotNull() if choice == "largest" else F.col(id_col).isNull()
    entries = saved(
        docs.select(
            F.spark_partition_id().alias("run"),
            F.struct(null_flag.alias("f"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row_no")).alias("who"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            F.xxhash64(text).alias("check"),
            F.octet_length(text).alias("n_bytes"),
        ),
        "digests",
    )
    same = ["digest", "check", "n_bytes"]
    runs = entries.groupBy("run", *same).agg(_best(choice, "who").alias("best"), F.count(F.lit(1)).alias("n"))

    n_runs = (entries.agg(F.max("run")).first()[0] or 0) + 1
    merged, bits = runs, 0
    prefix = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long")
    while n_runs > 1:
        bits += radix
        n_runs = -(-n_runs >> radix)
        # Four bits more than the merged runs, so that cells spread evenly over tasks.
        cell = F.shiftright(prefix, max(0, 32 - bits - 4)).alias("cell")
        merged = (
            merged.select(F.shiftright("run", radix).alias("run"), cell, *same, "best", "n")
            .repartition(F.col("run"), F.col("cell"))
            .sortWithinPartitions("run", "cell", *same)
            .groupBy("run", "cell", *same)
            .agg(_best(choice, "best").alias("best"), F.sum("n").alias("n"))
        )
    groups = merged.filter("n > 1").select(*same, "best", "n")

    # A group's winner goes to each run that holds a copy, then to the rows there: a join key has no more rows than a run.
    by_run = runs.select("run", *same).join(groups, same)
    return (
        entries.join(by_run, ["run", *same], "left")
        .select(
            F.col("who.id").alias(id_col),
            F.when(F.col("n").isNull(), F.col("who.id")).otherwise(F.col("best.id")).alias("keep_id"),
            F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
            (F.col("n").isNull() | (F.col("best.row_no") == F.col("who.row_no"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )

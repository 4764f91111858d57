"""A corpus pipeline of five of the operators in peakloom.llm: STAGES in their order, each over what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peakloom.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from peakloom.llm.queries import toxicity_model
from peakloom.llm.shared import free_name, saved
from peakloom.plans.scratch import new_folder
from peakloom.session import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trained field calls toxic go.

    Null and empty texts have no tokens and are judged by the labels' rate; repeated rows are judged alike; whole texts
    are tagged, however long. All columns go along, whatever their names.
    """
    model = toxicity_model(spark, table(spark, sf_dir, "documents"), sf_dir)
    mark = free_name(docs, "toxicity")
    return toxicity.score_toxicity(docs, model, spans=False, into=mark).filter(F.col(f"{mark}.predicted") == 0).drop(mark)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten or more documents hold go; the documents stay, if with an empty text.

    Null and empty texts stay as they are; rows of one id count as one document, rows without an id as one more; lines
    and texts may be of any length. All columns go along, whatever their names.
    """
    mark = free_name(docs, "lines")
    return line_dedup.dedup_lines(docs, min_docs=10, into=mark).drop(mark)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of five-word shingles one with the smallest doc_id stays.

    Null ids are larger than all others: a row without an id stays if it is linked to no id, one row of each group.
    Null and empty texts have no words and are one group; rows that repeat an id and a text are one document; whole
    texts count, however long. Columns besides doc_id and text may have any names and go along.
    """
    none, digest, no, own, mine, other = (free_name(docs, name) for name in ("none", "digest", "no", "own_id", "own_none", "own_digest"))
    rows = docs.withColumn(none, F.col("doc_id").isNull()).withColumn(digest, F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    named = F.struct(F.col(none).alias("none"), "doc_id", F.col(digest).alias("digest"))
    found = simhash.near_duplicates(rows.select(named.alias("id"), "text"), id_col="id", n=5, percent=80)
    ids = [F.coalesce("id.doc_id", F.lit(0)).alias(own), F.col("id.none").alias(mine), F.col("id.digest").alias(other)]
    kept = found.filter("id = component_id").select(*ids).distinct()
    keys = [F.coalesce("doc_id", F.lit(0)), F.col(none), F.col(digest)]
    here = rows.join(kept, (keys[0] == F.col(own)) & (keys[1] == F.col(mine)) & (keys[2] == F.col(other)), "left_semi")
    # Rows that repeat an id and a text are one document.
    one = F.row_number().over(Window.partitionBy(*keys).orderBy(digest))
    return here.withColumn(no, one).filter(F.col(no) == 1).drop(none, digest, no)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go.

    Null texts and texts without words hold none; repeated rows are judged alike; whole texts are searched. All columns
    go along, whatever their names.
    """
    mark = free_name(docs, "leaks")
    return decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), n=10, remove="documents", into=mark).drop(mark)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids, and the SHA-256 of ids and of the decoded bytes, a row for each row of docs.

    Null and empty texts have no tokens; repeated rows give repeated rows; texts of any length are encoded whole. Columns
    besides doc_id and text are left out.
    """
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    # Stored, so that a task has one Python worker, not one that encodes and one that decodes.
    ids = saved(bpe.encode(docs.select("doc_id", "text"), path=path, pattern=public_tokenizers.PATTERN).select("doc_id", "ids"), "ids")
    return bpe.decode(ids, path=path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"), "ids"
    )


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("SimHash near-dedup", drop_near_copies), ("benchmark decontamination", drop_leaks), ("byte-level BPE", encode)]

#: The first stage trains a model and the last encodes by a vocabulary file: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = new_folder(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

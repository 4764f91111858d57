"""Token counts through a digest cache.

Contents are met in the cache by the digests of the text and of the tokenizer's file; only distinct misses are
encoded, and their counts are appended to the cache.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from peakloom.llm.shared import MOST_BITS, annotate, bit_filter, meet, new_folder, saved, trimmed

MOST_WORDS = 200_000
CACHE = "tokenizer string, digest binary, n_bytes long, n_tokens long"


class Counts(dict):
    """Tokens of a word (bytes without ASCII space), asked of the library once and remembered, at most MOST_WORDS."""

    def __init__(self, count: Callable[[str], int]):
        super().__init__()
        self.count = count

    def __missing__(self, word: bytes) -> int:
        n = self.count(word.decode())
        if len(self) >= MOST_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = n
        return n


@functools.lru_cache(2)  # a Python worker serves many tasks
def by_words(path: str) -> Callable[[bytes], int]:
    """Counts the tokens of a text for a tokenizers file whose pre-tokens and special strings hold no white space.

    No token then spans ASCII white space, so a text's count is the sum over its words.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    of = Counts(lambda word: len(tokenizer.encode(word, add_special_tokens=False)))
    return lambda text: sum(map(of.__getitem__, text.split()))


@functools.lru_cache(2)  # a Python worker serves many tasks
def by_pieces(path: str) -> Callable[[bytes], int]:
    """For a sentencepiece model: whole texts."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: len(model.encode(text.decode(), num_threads=1))


@functools.lru_cache(2)  # a Python worker serves many tasks
def whole_texts(path: str) -> Callable[[bytes], int]:
    """For any other tokenizers file: whole texts."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: len(tokenizer.encode(text.decode(), add_special_tokens=False))


def version_of(path: str, counter: str) -> str:
    with open(path, "rb") as f:
        return f"{counter}:{hashlib.file_digest(f, 'sha256').hexdigest()}"


COUNTERS = {"words": by_words, "pieces": by_pieces, "texts": whole_texts}


def stored_counts(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """(digest, n_bytes, n_tokens) that the cache holds for a tokenizer; equal rows of two concurrent appends are one."""
    try:
        held = spark.read.schema(CACHE).parquet(cache_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        held = spark.createDataFrame([], CACHE)
    return held.filter(F.col("tokenizer") == version).groupBy("digest", "n_bytes").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame,
    *,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    counter: str = "texts",
    limit: int = 2048,
    cache_path: str | None = None,
) -> DataFrame:
    """One row for each row of docs: id_col, n_bytes long, n_tokens long, over_limit boolean.

    Null counts as empty; content is digested as it is, as case and white space may matter to special strings. Equal
    texts are encoded once, repeated rows stay. counter is "words" (see by_words), "pieces" (sentencepiece) or "texts".
    cache_path is a Parquet folder of counts of earlier calls, made if missing; without one, a new folder in the
    shared folder is used. Other columns of docs are ignored; empty input, empty result.

    Digests alone are dealt. Two bit filters of bounded size, of missing contents and of stored or repeated ones, then
    tell at the scan which texts are stored for certain (dropped), which are missing and there once for certain
    (encoded), and which need the exact way: these are joined with the misses, one row a content, and encoded.
    """
    spark = docs.sparkSession
    version = version_of(path, counter)
    cache_path = cache_path or new_folder(spark, "token-cache")
    text = F.coalesce(F.col(text_col), F.lit(""))
    content = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    rows = saved(content.select("id", "digest", "n_bytes", F.spark_partition_id().alias("run")), "contents")
    each = rows.groupBy("digest", "n_bytes").agg(F.count(F.lit(1)).alias("n"))
    known = stored_counts(spark, cache_path, version).select("digest", "n_bytes", F.lit(True).alias("known"))
    each = saved(each.join(known, ["digest", "n_bytes"], "left").withColumn("spot", F.xxhash64("digest")), "distinct-contents")
    misses = each.filter("known is null")
    bits = int(np.clip(np.ceil(np.log2(max(1, each.count()) * 16)), 16, MOST_BITS))
    spot = F.pmod(F.xxhash64("digest"), F.lit(1 << bits)).alias("spot")
    sent = [spark.sparkContext.broadcast(bit_filter(x.select(spot), bits)) for x in (misses, each.filter("known or n > 1"))]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text that may be missing: its count, or the text itself where that isn't certain."""
        count = COUNTERS[counter](path)
        missing, doubtful = (x.value for x in sent)
        for batch in batches:
            at = batch.column(3).to_numpy()
            has = lambda flags: (flags[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)  # noqa: B023, E731
            doubt = has(doubtful)
            again, counts, texts, keep = set(), [], [], []
            digests, all_texts = batch.column(1).to_pylist(), batch.column(0).cast(pa.binary())
            for k in np.flatnonzero(has(missing)).tolist():
                if doubt[k]:
                    if digests[k] in again:
                        continue
                    again.add(digests[k])
                keep.append(k)
                counts.append(None if doubt[k] else count(all_texts[k].as_py()))
                texts.append(all_texts[k].as_py() if doubt[k] else None)
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(counts, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["digest", "n_bytes", "n_tokens", "text"])

    form = "digest binary, n_bytes long, n_tokens long, text string"
    met = saved(content.select("text", "digest", "n_bytes", spot).mapInArrow(trimmed(encode), form), "met-contents")
    rest = met.filter("text is not null").join(misses.select("digest", "n_bytes"), ["digest", "n_bytes"], "left_semi").groupBy("digest", "n_bytes").agg(F.first("text").alias("text"))

    def make():
        count = COUNTERS[counter](path)
        return lambda texts, _: [(count(t or b""),) for t in texts]

    encoded = annotate(rest, "text", "c", "n_tokens long", make).select("digest", "n_bytes", "c.n_tokens")
    new = met.filter("text is null").select("digest", "n_bytes", "n_tokens").union(encoded)
    new.select(F.lit(version).alias("tokenizer"), "digest", "n_bytes", "n_tokens").write.mode("append").parquet(cache_path)

    counts = saved(stored_counts(spark, cache_path, version), "token-counts")
    got = meet(rows, counts, ["digest", "n_bytes"], "run")
    return got.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

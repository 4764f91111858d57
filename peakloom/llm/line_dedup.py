"""Line dedup with once-seen and twice-seen Bloom filters.

Only lines that the twice-seen filter suspects are shuffled, for exact counts and the choice of the first occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm import sketch
from peakloom.llm.shared import annotate, free_name, saved, total_bytes, trimmed, without

SPACE = b" \t\n\x0b\x0c\r"
HASH_ROWS = 2


def line_keys(text: bytes | None) -> list[bytes]:
    """A line's key: ASCII white space stripped at both ends, A-Z lower-cased."""
    return [x.strip(SPACE) for x in (text or b"").lower().split(b"\n")]


def dedup_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    keep: str = "none",
    max_filter_bits: int = 29,
    bytes_per_line: int = 64,
    broadcast_bytes: int = 64 << 20,
    into: str = "line_dedup",
) -> DataFrame:
    """docs with lines removed whose key (not empty) occurs in at least min_docs documents.

    keep="none" removes every such line; keep="first" leaves the first line of the smallest id that holds it.
    Returns all columns of docs, the text replaced, and the struct `into` (n_lines, n_dropped: long). A null or empty
    text is one empty line and stays as it is if nothing is dropped. Rows with the same id count as one document;
    null ids count as one document too, the largest. A column named `into` in docs is replaced. Empty input gives an
    empty result.

    The filter has one bit a cell and at most 2 * 2**max_filter_bits cells. Keys that must go are broadcast as 16-byte
    digests if they take at most broadcast_bytes; else they reach their documents by a salted join.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    spark = docs.sparkSession
    docs = without(docs, into)
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    bits = sketch.bits_for(total_bytes(docs, text_col) / bytes_per_line, 8, max_filter_bits)

    def hashes_of():
        import xxhash

        def of(batch: pa.RecordBatch) -> np.ndarray:
            got: list[int] = []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                got += map(xxhash.xxh64_intdigest, {k for k in line_keys(t) if k})
            return np.array(got, np.uint64)

        return of

    seen = spark.sparkContext.broadcast(sketch.twice_seen(texts, hashes_of, HASH_ROWS, bits))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ids, keys = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                own = [k for k in dict.fromkeys(line_keys(t)) if k]
                yes = sketch.suspected(seen.value, np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own)), HASH_ROWS, bits)
                keys += (own[j] for j in np.flatnonzero(yes))
                ids += [i] * int(yes.sum())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(keys, pa.binary())], names=["id", "key"])

    pairs = texts.mapInArrow(trimmed(suspects), "id string, key binary")
    id_type = docs.schema[id_col].dataType
    counted = (
        pairs.distinct()
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.col("id").cast(id_type)).cast("string").alias("first_id"))
        .filter(F.col("n") >= min_docs)
        .select(F.unhex(F.md5("key")).alias("digest"), "first_id")
    )
    counted = saved(counted, "line-keys")
    held = counted.count() * 48

    if held <= broadcast_bytes:
        frequent = spark.sparkContext.broadcast({bytes(r.digest): r.first_id for r in counted.toLocalIterator()})
        return _cut(docs, id_col, text_col, keep, into, lambda: (lambda part, i: frequent.value))

    salts, drop, no_id, own_id = 16, free_name(docs, "drop"), free_name(docs, "no_id"), free_name(docs, "own_id")
    salt = F.crc32(F.coalesce("id", F.lit("")).cast("binary")) % salts
    lists = (
        pairs.distinct()
        .select("id", F.unhex(F.md5("key")).alias("digest"), salt.cast("int").alias("salt"))
        .join(counted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["digest", "salt"])
        .groupBy(F.coalesce("id", F.lit("")).alias(own_id), F.col("id").isNull().alias(no_id))
        .agg(F.map_from_entries(F.collect_list(F.struct(F.hex("digest"), "first_id"))).alias(drop))
    )
    here = F.col(id_col).cast("string")
    joined = docs.join(lists, (F.coalesce(here, F.lit("")) == F.col(own_id)) & (here.isNull() == F.col(no_id)), "left").drop(own_id, no_id)
    drop_at = len(joined.columns) - 1

    def by_row():
        def of(part: pa.RecordBatch, i: int) -> dict:
            return {bytes.fromhex(k): v for k, v in part.column(drop_at)[i].as_py() or ()}

        return of

    return _cut(joined, id_col, text_col, keep, into, by_row).drop(drop)


def _cut(docs: DataFrame, id_col: str, text_col: str, keep: str, into: str, drops) -> DataFrame:
    id_at = docs.columns.index(id_col)

    def make():
        import hashlib

        drop_of = drops()

        def of(texts: list[bytes | None], part: pa.RecordBatch) -> list[tuple]:
            out = []
            ids = part.column(id_at).to_pylist() if keep == "first" else None
            for i, t in enumerate(texts):
                drop, keys, lines, kept = drop_of(part, i), line_keys(t), (t or b"").split(b"\n"), []
                met: set[bytes] = set()
                for key, line in zip(keys, lines):
                    d = key and hashlib.md5(key, usedforsecurity=False).digest()
                    if d and d in drop:
                        if keep == "none" or d in met or drop[d] != (None if ids[i] is None else str(ids[i])):
                            continue
                        met.add(d)
                    kept.append(line)
                n = len(lines)
                out.append((n, n - len(kept), t if n == len(kept) else b"\n".join(kept)))
            return [(a, b, None if c is None else c.decode()) for a, b, c in out]

        return of

    made = annotate(docs, text_col, into, "n_lines long, n_dropped long, text string", make)
    return made.withColumn(text_col, F.col(f"`{into}`.text")).withColumn(into, F.struct(f"`{into}`.n_lines", f"`{into}`.n_dropped"))

"""Byte-level BPE encoding and decoding.

Long texts are cut into overlapping chunks that are pre-tokenised in parallel. Where the pre-tokens of a chunk and of
the next one begin at the same place they have resynchronised, as a pre-token depends only on the text from its start
on; there the texts are stitched, and the pieces between such places are encoded on their own.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peakloom.llm.shared import annotate, free_name, saved, trimmed, without

#: Characters that a pre-token's end may depend on beyond it.
AHEAD = 8
MOST_WORDS = 40_000


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Encodes pre-tokens by the tiktoken library and remembers them, at most MOST_WORDS."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})
        self.known: dict[str, bytes] = {}

    def ids(self, tokens: list[str]) -> bytes:
        known, out = self.known, []
        for t in tokens:
            got = known.get(t)
            if got is None:
                got = np.array(self.encoding._core_bpe.encode_single_piece(t.encode()), "<u4").tobytes()
                if len(known) >= MOST_WORDS:
                    known.clear()
                if len(t) <= 64:
                    known[t] = got
            out.append(got)
        return b"".join(out)

    def starts(self, text: str) -> list[int]:
        return [m.start() for m in self.pattern.finditer(text)]


@functools.lru_cache(2)  # a Python worker serves many tasks
def encoder_of(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(
    docs: DataFrame,
    *,
    path: str,
    pattern: str,
    text_col: str = "text",
    chunk_chars: int = 1 << 16,
    overlap_chars: int = 1 << 10,
    into: str = "ids",
) -> DataFrame:
    """docs with the binary column `into`: the token ids as little-endian unsigned 32-bit integers.

    Every match of the pattern is encoded on its own by the ranks in the file at path (on every executor), without
    special tokens. Null and empty texts have no ids; repeated rows are encoded alike. A column named `into` is
    replaced. Texts up to chunk_chars are one piece; if a chunk and the next one don't resynchronise in their overlap,
    the text's rest is one piece.
    """
    docs = without(docs, into)
    long = F.length(F.coalesce(text_col, F.lit(""))) > chunk_chars
    short = docs.filter(~long)

    def make():
        encoder = encoder_of(path, pattern)
        return lambda texts, _: [(encoder.ids(encoder.pattern.findall((t or b"").decode())),) for t in texts]

    done = annotate(short, text_col, into, "v binary", make).withColumn(into, F.col(f"`{into}`.v"))
    row = free_name(docs, "row_no")
    rows = saved(docs.filter(long).withColumn(row, F.monotonically_increasing_id()), "long-texts")
    cuts = _cuts(rows.select(F.col(row).alias("row_no"), F.col(text_col).alias("text")), path, pattern, chunk_chars, overlap_chars)
    pieces = rows.select(F.col(row).alias("row_no"), F.col(text_col).alias("text")).join(cuts, "row_no").mapInArrow(trimmed(_pieces), "row_no long, at long, n long, piece string").repartition(F.col("row_no"), F.col("at"))

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, pattern)
        for b in batches:
            ids = []
            for n, piece in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                tokens = []
                for m in encoder.pattern.finditer(piece):
                    if m.start() >= n:
                        break
                    tokens.append(m.group())
                ids.append(encoder.ids(tokens))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())], names=["row_no", "at", "ids"])

    got = pieces.mapInArrow(trimmed(encode_pieces), "row_no long, at long, ids binary").groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts")).mapInArrow(trimmed(_stitched), "row_no long, ids binary")
    stitched = rows.join(got.select(F.col("row_no").alias(row), F.col("ids").alias(into)), row).drop(row)
    return done.unionByName(stitched)


def _cuts(rows: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(row_no, cuts): where each long text is cut, in order: true pre-token starts."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = -(-(len(text) - overlap) // chunk) or 1
                for k in range(n):
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([k], pa.int64()), pa.array([k == n - 1]), pa.array([text[k * chunk : (k + 1) * chunk + overlap]], pa.string())], names=["row_no", "chunk", "last", "piece"])

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        of = regex.compile(pattern)
        for b in batches:
            heads, tails = [], []
            for k, last, piece in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                starts = np.fromiter((m.start() for m in of.finditer(piece)), np.int64)
                heads.append((starts[starts <= overlap - AHEAD] + k * chunk).tolist())
                tails.append([] if last else (starts[(starts >= chunk) & (starts <= chunk + overlap - AHEAD)] + k * chunk).tolist())
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(heads, kind), pa.array(tails, kind)], names=["row_no", "chunk", "head", "tail"])

    found = rows.mapInArrow(trimmed(chunks), "row_no long, chunk long, last boolean, piece string").repartition(F.col("row_no"), F.col("chunk")).mapInArrow(trimmed(bounds), "row_no long, chunk long, head array<long>, tail array<long>")
    order = Window.partitionBy("row_no").orderBy("chunk")
    # A place in both chunks is a true start if all earlier chunks have met as well.
    met = found.withColumn("cut", F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(order)))))
    true = met.withColumn("true", F.bool_and(F.col("cut").isNotNull()).over(order)).filter("true")
    return true.groupBy("row_no").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text's pieces, with a few characters that follow; n is the piece's own length."""
    for b in batches:
        for row, text, cuts in zip(*(b.column(k).to_pylist() for k in range(3))):
            for a, z in zip(cuts, [*cuts[1:], len(text)]):
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([a], pa.int64()), pa.array([z - a], pa.int64()), pa.array([text[a : z + AHEAD]], pa.string())], names=["row_no", "at", "n", "piece"])


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = [b"".join(p["ids"] for p in parts) for parts in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["row_no", "ids"])


def decode(encoded: DataFrame, *, path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """encoded with the binary column `into`: the tokens' bytes, concatenated. Null ids count as none."""

    def make():
        of = {v: k for k, v in ranks(path).items()}
        table = [of.get(k) for k in range(max(of) + 1)]
        return lambda ids, _: [(b"".join(map(table.__getitem__, np.frombuffer(x or b"", "<u4").tolist())),) for x in ids]

    return annotate(encoded, ids_col, into, "v binary", make).withColumn(into, F.col(f"`{into}`.v"))

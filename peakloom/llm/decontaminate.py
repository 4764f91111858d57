"""Benchmark decontamination: a hash set of normalised test n-grams meets every token window of the training texts.

The hash set is broadcast where the benchmark's windows fit a size that is checked; a larger benchmark is joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.llm.shared import annotate, free_name, meet, saved, trimmed

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
#: Odd, so that a power of it never vanishes modulo 2**64.
BASE = 0x9E3779B97F4A7C15


def words(text: str | None) -> list[str]:
    """A-Z lower-cased; runs of 0-9, a-z and everything beyond ASCII."""
    return WORD.findall((text or "").translate(ASCII_LOWER))


def ascii_lower(data: bytes | None) -> str:
    return (data or b"").lower().decode()


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive ids, modulo 2**64."""
    m = len(ids) - n + 1
    out = np.zeros(max(0, m), np.uint64)
    for j in range(n if m > 0 else 0):
        out *= np.uint64(BASE)
        out += ids[j : j + m]
    return out


def windows(items: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """Distinct windows of the test items: item_id string, window array<string>; an item of fewer words, but not none, is one."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words(t)
                own = sorted({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} - {()})
                for k in range(0, len(own), 10_000):
                    part = own[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(part), pa.string()), pa.array(list(map(list, part)), pa.list_(pa.string()))], names=["item_id", "window"])

    return items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text")).mapInArrow(trimmed(of), "item_id string, window array<string>").distinct()


class Hits:
    """The broadcast hash set: windows by length and hash, and each window's items."""

    def __init__(self, rows: list[tuple[str | None, list[str]]]):
        self.word_ids = {w: k for k, w in enumerate(sorted({w for _, ws in rows for w in ws}), 1)}
        rng = np.random.default_rng(20)
        self.codes = np.r_[np.uint64(0), rng.integers(1, 2**63, len(self.word_ids), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)]
        self.items: dict[tuple[str, ...], list[str | None]] = {}
        for item, ws in rows:
            self.items.setdefault(tuple(ws), []).append(item)
        by_n: dict[int, list[tuple[str, ...]]] = {}
        for ws in self.items:
            by_n.setdefault(len(ws), []).append(ws)
        self.hashes = {n: np.unique(np.array([rolling(self.codes[[self.word_ids[w] for w in ws]], n)[0] for ws in group], np.uint64)) for n, group in by_n.items()}

    def find(self, ws: list[str], ids: np.ndarray) -> tuple[np.ndarray, set]:
        """Mask of hit words, and the items that occur. Hash hits are verified word by word."""
        hit, found, codes = np.zeros(len(ws) + 1, np.int64), set(), None
        inside = np.concatenate([[0], np.cumsum(ids > 0)])
        for n, hashes in self.hashes.items():
            if len(ws) < n:
                continue
            full = np.flatnonzero(inside[n:] - inside[:-n] == n)
            if not len(full):
                continue
            if codes is None:
                codes = self.codes[ids]
            at = full[_is_in(rolling(codes, n)[full], hashes)]
            for k in at.tolist():
                if (items := self.items.get(tuple(ws[k : k + n]))) is not None:
                    hit[k] += 1
                    hit[k + n] -= 1
                    found.update(items)
        return np.cumsum(hit[:-1]) > 0, found


def _is_in(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    n: int = 10,
    broadcast_bytes: int = 64 << 20,
    remove: str | None = None,
    into: str = "contamination",
) -> DataFrame:
    """docs with the struct `into`: n_words, n_hit, n_items long, items array<string> (sorted).

    A window is n consecutive words of an item (an item of fewer words, but not none, is one window); a document word
    inside any occurrence of a window is hit. remove="spans" also blanks hit words out of the text (with what stands
    between two hit words), remove="documents" drops documents with hits. Null and wordless texts have no words and no
    hits; repeated rows are judged alike; an empty benchmark hits nothing. A column named `into` is replaced.

    The windows are broadcast if their words take at most broadcast_bytes; else documents' windows are joined to them,
    after a filter of window hashes of bounded size.
    """
    if remove not in (None, "spans", "documents"):
        raise ValueError("remove is None, 'spans' or 'documents'")
    spark = docs.sparkSession
    found = saved(windows(benchmark, item_id_col, item_text_col, n), "test-windows")
    size = found.agg(F.sum(F.expr("aggregate(window, 0L, (a, w) -> a + octet_length(w) + 64)"))).first()[0] or 0
    if size > broadcast_bytes:
        marked = _joined(docs, found, text_col, into, broadcast_bytes)
    else:
        hits = spark.sparkContext.broadcast(Hits([(r.item_id, list(r.window)) for r in found.toLocalIterator()]))

        def make():
            h = hits.value
            id_of = h.word_ids.get

            def of(texts: list[bytes | None], _: pa.RecordBatch) -> list[tuple]:
                out = []
                for t in texts:
                    ws = WORD.findall(ascii_lower(t))
                    ids = np.fromiter((id_of(w, 0) for w in ws), np.int64, len(ws))
                    mask, items = h.find(ws, ids)
                    out.append((len(ws), int(mask.sum()), len(items), sorted(items, key=str), _runs(mask)))
                return out

            return of

        marked = annotate(docs, text_col, into, FIELDS, make)
    if remove == "documents":
        marked = marked.filter(F.col(f"`{into}`.n_hit") == 0)
    if remove == "spans":
        marked = marked.withColumn(text_col, _blanked(F.col(text_col), F.col(f"`{into}`.runs")))
    return marked.withColumn(into, F.struct(*(F.col(f"`{into}`.{k}").alias(k) for k in ("n_words", "n_hit", "n_items", "items"))))


#: Stands for an item without an id where Spark gathers ids.
NO_ID = "\0none"
FIELDS = "n_words long, n_hit long, n_items long, items array<string>, runs array<int>"


def _runs(mask: np.ndarray) -> list[int]:
    """Starts and ends (exclusive) of the hit words' runs, one after the other."""
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).tolist()


@F.pandas_udf(T.StringType())
def _blanked(text, runs):
    import pandas as pd

    out = []
    for t, r in zip(text, runs):
        if t is None or r is None or not len(r):
            out.append(t)
            continue
        spans = [m.span() for m in WORD.finditer(t.translate(ASCII_LOWER))]
        at, parts = 0, []
        for a, b in zip(r[::2], r[1::2]):
            parts.append(t[at : spans[a][0]])
            at = spans[b - 1][1]
        out.append("".join(parts) + t[at:])
    return pd.Series(out, dtype=object)


def _joined(docs: DataFrame, found: DataFrame, text_col: str, into: str, most: int) -> DataFrame:
    """For a large benchmark: documents' windows that pass a bit filter are joined to the test windows by their digest."""
    spark = docs.sparkSession
    bits = int(np.log2(max(1 << 13, most))) + 2
    lengths = sorted(r.n for r in found.select(F.size("window").alias("n")).distinct().collect())

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            at = pa.array([_hash_of(w, xxhash) >> (64 - bits) for w in b.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([at], names=["at"])

    flags = np.zeros(1 << (bits - 3), np.uint8)
    for r in found.select("window").mapInArrow(trimmed(keyed), "at long").groupBy(F.shiftright("at", 15).alias("k")).agg(F.bitmap_construct_agg((F.col("at") % 32768)).alias("bits")).toLocalIterator():
        flags[r.k * 4096 : r.k * 4096 + 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    sent = spark.sparkContext.broadcast(flags)

    row = free_name(docs, "row_no")
    counted = annotate(docs, text_col, into, "n_words long", lambda: lambda texts, _: [(len(WORD.findall(ascii_lower(t))),) for t in texts])
    rows = saved(counted.withColumn(row, F.monotonically_increasing_id()), "rows")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        flags = sent.value
        for b in batches:
            for no, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = words(t)
                codes = np.array([xxhash.xxh64_intdigest(w.encode()) for w in ws], np.uint64)
                for n in lengths:
                    h = rolling(codes, n) >> np.uint64(64 - bits)
                    at = np.flatnonzero(flags[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8) & np.uint8(1))
                    for k in range(0, len(at), 10_000):
                        a = at[k : k + 10_000].tolist()
                        yield pa.RecordBatch.from_arrays([pa.array([no] * len(a), pa.int64()), pa.array(a, pa.int32()), pa.array([ws[i : i + n] for i in a], pa.list_(pa.string()))], names=["row_no", "at", "window"])

    own = saved(rows.select(row, text_col).mapInArrow(trimmed(candidates), "row_no long, at int, window array<string>").withColumn("salt", F.pmod(F.xxhash64("row_no"), F.lit(64))), "own-windows")
    by_window = found.groupBy("window").agg(F.collect_set(F.coalesce("item_id", F.lit(NO_ID))).alias("items"))
    hit = (
        meet(own, by_window, ["window"], "salt")  # very many documents may share a window
        .groupBy("row_no")
        .agg(F.collect_list(F.struct("at", F.size("window").alias("n"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        .select(F.col("row_no").alias(row), F.struct("spans", "items").alias(hits_col := free_name(docs, "hits")))
    )

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def runs(n_words, spans):
        import pandas as pd

        out = []
        for n, own in zip(n_words, spans):
            d = np.zeros(int(n) + 1, np.int64)
            for s in () if own is None else own:
                d[s["at"]] += 1
                d[s["at"] + s["n"]] -= 1
            out.append(_runs(np.cumsum(d[:-1]) > 0))
        return pd.Series(out, dtype=object)

    n_words, items = F.col(f"`{into}`.n_words"), F.coalesce(F.col(f"`{hits_col}`.items"), F.array().cast("array<string>"))
    full = rows.join(hit, row, "left").withColumn(into, F.struct(n_words.alias("n_words"), items.alias("items"), runs(n_words, F.col(f"`{hits_col}`.spans")).alias("runs")))
    r = F.col(f"`{into}`.runs")
    n_hit = F.aggregate(r, F.struct(F.lit(-1).alias("sign"), F.lit(0).cast("long").alias("n")), lambda a, x: F.struct((-a["sign"]).alias("sign"), (a["n"] + a["sign"] * x).alias("n")), lambda a: a["n"])
    whole = F.struct(n_words.alias("n_words"), n_hit.alias("n_hit"), F.size(f"`{into}`.items").cast("long").alias("n_items"), F.transform(f"`{into}`.items", lambda x: F.nullif(x, F.lit(NO_ID))).alias("items"), r.alias("runs"))
    return full.withColumn(into, whole).drop(row, hits_col)


def _hash_of(ws: list[str], xxhash) -> int:
    return int(rolling(np.array([xxhash.xxh64_intdigest(w.encode()) for w in ws], np.uint64), len(ws))[0])

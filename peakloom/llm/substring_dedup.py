"""Substring dedup with a count-min prefilter.

Every partition counts its windows in a sketch; the merged sketch overestimates how many documents hold a window, so
windows that it counts once occur once. Only the others go to an exact count, as packed digests dealt by hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.llm import sketch
from peakloom.llm.shared import free_name, plain, slices, total_bytes, trimmed, without

HASH_ROWS = 2
MOST_WORDS = 100_000
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
LAST = np.iinfo(np.int64).max


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Codes(dict):
    """Numbers of words in two arrays of 64-bit hashes, the halves of XXH3-128; remembered, at most MOST_WORDS between slices."""

    def __init__(self):
        import xxhash

        super().__init__()
        self.digest, self.known = xxhash.xxh3_128_digest, []

    def __missing__(self, word: bytes) -> int:
        self.known.append(self.digest(word))
        self[word] = n = len(self.known) - 1
        return n

    def of(self, words: list[list[bytes]]) -> list[np.ndarray]:
        """Two codes of each of the words."""
        if len(self) > MOST_WORDS:
            self.clear()
            self.known = []
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
        both = np.frombuffer(b"".join(self.known), np.uint64).reshape(-1, 2)
        return [both[at, 0], both[at, 1]] if len(at) else [np.empty(0, np.uint64)] * 2


def window_digests(texts: list[bytes | None], n: int, codes: Codes) -> tuple[list[np.ndarray], np.ndarray, list[list[bytes]]]:
    """Two 64-bit hashes of every window of n words, its text's number in the list, and each text's words.

    Words are bytes without ASCII space. Different hashes of words, not crafted ones, are what windows differ by.
    """
    words = [(t or b"").split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(counts)
    of_word = np.repeat(np.arange(len(counts)), counts)
    m = max(0, len(of_word) - n + 1)
    own = np.arange(m) + n <= ends[of_word[:m]] if m else np.zeros(0, bool)
    out = []
    for code, base in zip(codes.of(words), BASES):
        h = np.zeros(m, np.uint64)
        for j in range(n if m else 0):
            h *= np.uint64(base)
            h += code[j : j + m]
        out.append(mixed(h[own]))
    return out, of_word[:m][own], words


def planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on: alike bytes stand together and compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def numbers(data: bytes, kind: str, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, n).T).reshape(-1).view(kind)


def dedup_substrings(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 13,
    max_sketch_bits: int = 28,
    part_bytes: int = 8 << 20,
    into: str = "substring_dedup",
) -> DataFrame:
    """docs with repeated passages removed: all columns, the kept words joined by one space as the text, and the struct
    `into` (n_words, n_removed: long).

    A word goes if it is inside a window of n consecutive words whose sequence also starts in a document with a smaller
    id, judged on the input. Ids are integers; null ids are larger than all others, and rows with one id don't count as
    smaller than each other. A null text stays null. A column named `into` is replaced. Empty input, empty result.

    The broadcast sketch has one bit a cell and at most 2 * 2**max_sketch_bits cells. Windows are equal if 96 bits of
    digest are. A task holds about part_bytes of text, or of digests, and one document: the number of tasks grows with
    the input, and rows are dealt by id and text, so that rows that share an id are spread.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"{id_col} must be an integer column")
    spark = docs.sparkSession
    docs = without(docs, into)
    size = total_bytes(docs, text_col)
    bits = sketch.bits_for(size / 7, 1.5, max_sketch_bits)
    parts = int(size // part_bytes) + 1
    dealt = F.pmod(F.xxhash64(id_col, text_col), F.lit(parts)).cast("int")
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), dealt.alias("part"))

    def hashes_of():
        codes = Codes()

        def of(batch: pa.RecordBatch) -> np.ndarray:
            got = [np.empty(0, np.uint64)]
            for part in slices(batch, 1, 1 << 20):
                (h, _), doc, _ = window_digests(part.column(1).cast(pa.binary()).to_pylist(), n, codes)
                got.append(distinct(h, doc, h)[0])
            return np.concatenate(got)

        return of

    seen = spark.sparkContext.broadcast(sketch.twice_seen(texts, hashes_of, HASH_ROWS, bits))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed (window, id, part) by bucket. Where a batch holds a window in several documents, the smallest id asks
        for all and the others are told at once: a window has an entry a batch at most, unless rows share an id."""
        codes = Codes()
        for batch in batches:
            ids, own_part = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            held: list[list[np.ndarray]] = [[], [], [], []]
            at = 0
            for part in slices(batch, 1, 1 << 20):
                (h1, h2), doc, _ = window_digests(part.column(1).cast(pa.binary()).to_pylist(), n, codes)
                yes = sketch.suspected(seen.value, h1, HASH_ROWS, bits)
                row = at + doc[yes]
                for k, x in enumerate((h1[yes], (h2[yes] >> np.uint64(32)).astype(np.uint32), ids[row], own_part[row])):
                    held[k].append(x)
                at += part.num_rows
            if not held[0]:
                continue
            entries, later = grouped(*map(np.concatenate, held))
            out = [(0, *x) for x in packed_hits(entries, later)]
            entries = [x[~later] for x in entries]
            out += [(1, k, b"".join(planes(x[own]) for x in entries)) for k, own in by_number((entries[0] % np.uint64(parts)).astype(np.int64))]
            yield rows_of(out)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; a bucket's entries are counted exactly."""
        now, held = None, []
        for b in batches:
            out = []
            for kind, part, data in zip(*(c.to_pylist() for c in b.columns)):
                if kind == 0:
                    out.append((0, part, data))
                    continue
                if part != now:
                    out += settle(held)
                    now, held = part, []
                held.append(data)
            yield rows_of(out)
        yield rows_of(settle(held))

    form = "kind int, part int, data binary"
    hits = (
        texts.mapInArrow(trimmed(suspects), form)
        .repartition(parts, "kind", "part")
        .sortWithinPartitions("kind", "part")
        .mapInArrow(trimmed(confirm), form)
        .select("part", "data")
        .repartition(parts, "part")
    )

    names = docs.columns
    id_at, text_at = names.index(id_col), names.index(text_col)
    struct = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    rows = plain(docs.withColumn(free_name(docs, "part"), dealt)).withColumnRenamed(f"c{len(names)}", "part")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("made", struct)])

    def cut(rows: pa.Table, told: pa.Table) -> pa.Table:
        data = [x.as_py() for x in told.column("data")]
        h = np.concatenate([np.empty(0, np.uint64), *(numbers(x[: len(x) // 2], "<u8", len(x) // 16) for x in data)])
        who = np.concatenate([np.empty(0, np.int64), *(numbers(x[len(x) // 2 :], "<i8", len(x) // 16) for x in data)])
        gone = {int(who[own[0]]): np.unique(h[own]) for _, own in by_number(np.unique(who, return_inverse=True)[1])}
        rows = rows.combine_chunks()
        codes = Codes()
        out, total, removed = [], [], []
        for batch in rows.to_batches():
            for part in slices(batch, text_at, 1 << 20):
                texts = part.column(text_at).cast(pa.binary()).to_pylist()
                (h1, _), doc, split = window_digests(texts, n, codes)
                windows = np.cumsum(np.r_[0, np.bincount(doc, minlength=len(texts))])
                for i, (t, words, who_i) in enumerate(zip(texts, split, part.column(id_at).to_pylist())):
                    own, lost = h1[windows[i] : windows[i + 1]], gone.get(LAST if who_i is None else who_i)
                    total.append(len(words))
                    dropped = 0
                    if lost is not None and len(own):
                        d = np.zeros(len(words) + 1, np.int64)
                        at = np.flatnonzero(lost[np.minimum(np.searchsorted(lost, own), len(lost) - 1)] == own)
                        d[at] += 1
                        d[at + n] -= 1
                        stay = np.cumsum(d[:-1]) == 0
                        dropped = len(words) - int(stay.sum())
                        words = compress(words, stay.tolist())
                    out.append(None if t is None else b" ".join(words).decode())
                    removed.append(dropped)
        made = pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=["n_words", "n_removed"])
        keep = rows.drop_columns(["part"]).set_column(text_at, f"c{text_at}", pa.array(out, pa.string()))
        return keep.append_column("made", made)

    met = rows.repartition(parts, "part").groupBy("part").cogroup(hits.groupBy("part")).applyInArrow(cut, schema)
    return met.toDF(*names, into)


def distinct(key: np.ndarray, doc: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """The columns at the first of each (document, key)."""
    order = np.lexsort((key, doc))
    k, d = key[order], doc[order]
    first = order[np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])]] if len(order) else order
    return [c[first] for c in columns]


def by_number(number: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each number that occurs, with the places where it does."""
    order = np.argsort(number, kind="stable")
    found, first = np.unique(number[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, first[1:]) if len(found) else [])


def grouped(h1: np.ndarray, h2: np.ndarray, who: np.ndarray, part: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct (window, id, part), and a mask of those whose id isn't the window's smallest."""
    order = np.lexsort((part, who, h2, h1))
    h1, h2, who, part = h1[order], h2[order], who[order], part[order]
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    own = new.copy()
    own[1:] |= (who[1:] != who[:-1]) | (part[1:] != part[:-1])
    later = who != who[new][np.cumsum(new) - 1] if len(who) else new
    return [x[own] for x in (h1, h2, who, part)], later[own]


def packed_hits(entries: list[np.ndarray], later: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Windows that go, with the ids they go from, by the part that holds these documents."""
    h, _, who, part = (x[later] for x in entries)
    for k, own in by_number(part):
        yield k, planes(h[own]) + planes(who[own])


def settle(held: list[bytes]) -> list[tuple[int, int, bytes]]:
    """A bucket's entries: those that aren't the smallest id of their window are hits."""
    if not held:
        return []
    cols: list[list[np.ndarray]] = [[], [], [], []]
    for x in held:
        m = len(x) // 24
        for k, (a, b, kind) in enumerate(((0, 8, "<u8"), (8, 12, "<u4"), (12, 20, "<i8"), (20, 24, "<i4"))):
            cols[k].append(numbers(x[a * m : b * m], kind, m))
    return [(0, *x) for x in packed_hits(*grouped(*map(np.concatenate, cols)))]


def rows_of(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["kind", "part", "data"])

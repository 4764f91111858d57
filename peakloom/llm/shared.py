"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.plans.scratch import new_folder, remove
from peakloom.session import bounded_batches

#: Bits of a filter that picks rows at a scan, at most: 32 MB.
MOST_BITS = 28


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later work starts there, also after lost executors.

    What the write shuffled is deleted as soon as it has ended.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes that start meanwhile delete their shuffle files when they end, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    now = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if now is None else spark.conf.set(key, now)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of saved tables that nothing reads any more."""
    for t in tables:
        files = t.inputFiles()
        if files:
            remove(t.sparkSession, files[0].rpartition("/")[0])


def total_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def without(df: DataFrame, name: str) -> DataFrame:
    """df without the column of that name; case doesn't tell names apart, as in Spark."""
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()])


def meet(rows: DataFrame, groups: DataFrame, keys: list[str], salt: str) -> DataFrame:
    """The inner join of rows with groups, which has one row for each key.

    A hot key's rows are dealt by their column `salt`, too: groups meet the few distinct (key, salt), then these meet
    the rows, so that no task gets all rows of a key.
    """
    return rows.join(rows.select(*keys, salt).distinct().join(groups, keys), [*keys, salt])


def plain(df: DataFrame) -> DataFrame:
    """df with columns named c0, c1, ...: Python operators look columns up by names that they take apart at dots."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def annotate(
    docs: DataFrame,
    text_col: str,
    into: str,
    fields: str,
    make: Callable[[], Callable[[list[bytes | None], pa.RecordBatch], list[tuple]]],
    slice_bytes: int = 8 << 20,
) -> DataFrame:
    """docs with the struct column `into`, which a task-local function makes from whole texts.

    make() runs once a task and returns the function, which gets a slice's texts (UTF-8) and the slice.
    A column of docs that is already named `into` is replaced. Other columns may have any names.
    """
    bounded_batches(docs.sparkSession)
    docs = without(docs, into)
    struct = T._parse_datatype_string(fields)
    simple = plain(docs)
    schema = T.StructType([*simple.schema.fields, T.StructField("made", struct)])
    names, text_at = [f.name for f in struct.fields], docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds, of_texts = [to_arrow_type(f.dataType) for f in struct.fields], make()
        for batch in batches:
            for part in slices(batch, text_at, slice_bytes):
                rows = of_texts(part.column(text_at).cast(pa.binary()).to_pylist(), part)
                cols = [pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)]
                made = pa.StructArray.from_arrays(cols, fields=[pa.field(n, k) for n, k in zip(names, kinds)])
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, "made"])

    return simple.mapInArrow(trimmed(run), schema).toDF(*docs.columns, into)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, but when a task has ended its Python worker gives free memory back to the system.

    Workers are used again and again; what one task's arrays took would else add to what the next ones take.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return of


def give_back() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, text_at: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of whole rows of about `most` bytes of text."""
    import pyarrow.compute as pc

    start, held = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(text_at)).to_pylist()):
        held += n or 0
        if held >= most:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def bit_filter(spots: DataFrame, bits: int) -> np.ndarray:
    """The bytes of a filter of 2**bits bits that has the given spots (column spot)."""
    flags = np.zeros(1 << (bits - 3), np.uint8)
    own = spots.groupBy(F.shiftright("spot", 15).alias("k")).agg(F.bitmap_construct_agg(F.col("spot") % 32768).alias("bits"))
    for r in own.toLocalIterator():
        flags[r.k * 4096 : (r.k + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return flags

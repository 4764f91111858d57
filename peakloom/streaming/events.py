"""Unbounded input: the batch operators inside foreachBatch, windows with late data, and dedup within a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, StructField, StructType


def stream(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def counts_by_window(events: DataFrame, time: str, key: str, value: str, window: str, late: str) -> DataFrame:
    """(window_start, key, n, total): tumbling windows; rows later than `late` are let go."""
    w = F.window(time, window)
    return events.withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    w = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


def first_only(events: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """Rows whose keys were not met before, within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def marked_repeats(events: DataFrame, keys: list[str], refuse: bool = False) -> DataFrame:
    """Rows with `repeat`: whether one with their keys was met before, in whatever batch; with refuse such a row stops the query.

    State by key, kept in the query's checkpoint, so that a query that starts again still knows its keys. A batch's rows
    of a key stream past; which of them is the first is not determined. Null keys are one key.
    """

    def mark(_, pdfs, state):
        for pdf in pdfs:
            again = [state.exists or i > 0 for i in range(len(pdf))]
            if refuse and any(again):
                raise ValueError(f"a key is repeated: {pdf[keys].iloc[again.index(True)].to_dict()}")
            if len(pdf):
                state.update((True,))
            yield pdf.assign(repeat=again)

    schema = StructType([*events.schema.fields, StructField("repeat", BooleanType())])
    return events.groupBy(*keys).applyInPandasWithState(mark, schema, "met boolean", "append", "NoTimeout")


def append_new(events: DataFrame, keys: list[str], path: str, checkpoint: str, batch: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Each micro-batch through a batch operator, then appended unless its keys are stored already: repeated batches add nothing."""

    def store(df: DataFrame, _: int) -> None:
        new = batch(df).dropDuplicates(keys)
        try:
            new = new.join(df.sparkSession.read.parquet(path).select(*keys), keys, "left_anti")
        except Exception as e:  # nothing is stored yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("append").parquet(path)

    return events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

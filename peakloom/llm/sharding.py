"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has 2**ring_bits cells. Rows fall into cells by a hash of their key; virtual nodes stand at cell ends. What a
full shard cannot take goes on clockwise to the next virtual node whose shard has room. Which part of which cell goes
where depends only on the cells' row counts: that plan is as large as the ring, whatever the input.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peakloom.llm.shared import saved


def virtual_nodes(shards: int, per_shard: int, cells: int) -> list[tuple[int, int]]:
    """(cell, shard), by cell; each shard's places don't depend on how many other shards there are."""
    taken: dict[int, int] = {}
    for v in range(per_shard):
        for s in range(shards):
            k = int.from_bytes(hashlib.blake2b(f"shard {s} node {v}".encode(), digest_size=8).digest(), "big") % cells
            while k in taken:
                k = (k + 1) % cells
            taken[k] = s
    return sorted(taken.items())


def place(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int], cells: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, low, high, shard, first slot): a cell's rows numbered low to high - 1 go to the shard.

    Rows that their own shard has room for stay there; only the rest moves on, one virtual node after the other.
    """
    room, used, out = list(room), [0] * len(room), []
    waiting: list[list[tuple[int, int, int]]] = [[] for _ in nodes]
    at = 0
    for cell in sorted(counts):
        while at < len(nodes) and nodes[at][0] < cell:
            at += 1
        waiting[at % len(nodes)].append((cell, 0, counts[cell]))
    while any(waiting):
        moved: list[list[tuple[int, int, int]]] = [[] for _ in nodes]
        for k, pieces in enumerate(waiting):
            shard = nodes[k][1]
            for cell, low, high in pieces:
                take = min(high - low, room[shard])
                if take:
                    out.append((cell, low, low + take, shard, used[shard]))
                    room[shard] -= take
                    used[shard] += take
                if low + take < high:
                    moved[k].append((cell, low + take, high))
        waiting = [[] for _ in nodes]
        for k, pieces in enumerate(moved):
            if pieces:
                to = next(j % len(nodes) for j in range(k + 1, k + 1 + len(nodes)) if room[nodes[j % len(nodes)][1]])
                waiting[to] += pieces
    return out


def shard(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 16,
    per_shard: int = 64,
    slack: float = 0.0,
    ring_bits: int = 16,
) -> DataFrame:
    """One row for each row of docs: id_col, size long, text_crc32 long, shard int, slot long.

    size is the text's UTF-8 bytes plus 1 (null: none), text_crc32 the unsigned CRC-32 of those bytes. A shard takes
    at most (1 + slack) times the mean count of rows; with slack 0 counts differ by one at most. Slots are gapless
    from 0 in each shard. Ids may be null; rows with one id are told apart by their texts. The result depends on the
    rows only, not on their order (rows that are alike in all of this are interchangeable). Empty input gives an
    empty result. Other columns of docs are ignored.
    """
    if shards < 1 or per_shard < 1 or slack < 0 or shards * per_shard > 1 << ring_bits:
        raise ValueError("there must be a shard, a virtual node, no negative slack, and a cell for each virtual node")
    spark, cells = docs.sparkSession, 1 << ring_bits
    text = F.coalesce(F.col(text_col), F.lit(""))
    place_on_ring = F.xxhash64(F.col(id_col).cast("string"), F.lit("ring"))
    rows = saved(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "utf-8")).alias("crc"),
            place_on_ring.alias("at"),
            F.col(id_col).isNull().alias("none"),
            F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"),
            F.shiftrightunsigned(place_on_ring, 64 - ring_bits).cast("int").alias("cell"),
            F.spark_partition_id().alias("run"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "ring-rows",
    )
    # Rows that are alike in all of `kind` are interchangeable. Numbers of a cell's rows go by kind, then by run: a
    # window over counts finds where each (kind, run) begins, so that no task orders all rows of a repeated id.
    kind = ["cell", "at", "none", "key", "crc", "size", "run"]
    each = saved(rows.groupBy(*kind).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "ring-counts")
    counts = {r.cell: r.n for r in each.groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator()}  # at most a row a cell
    n = sum(counts.values())
    most = -(-n // shards)
    room = [most - (slack == 0 and n % shards > 0 and s >= n % shards) for s in range(shards)] if slack == 0 else [max(most, int((1 + slack) * n / shards))] * shards
    plan = spark.createDataFrame(place(counts, virtual_nodes(shards, per_shard, cells), room, cells), "cell int, low long, high long, shard int, first long")
    order = Window.partitionBy("cell").orderBy("at", "none", "id", "crc", "size", "run").rowsBetween(Window.unboundedPreceding, 0)
    begun = each.withColumn("begin", F.sum("n").over(order) - F.col("n")).select(*kind, "begin")
    numbered = rows.join(begun, kind).withColumn("no", F.col("begin") + F.row_number().over(Window.partitionBy(*kind).orderBy("row_no")) - 1)
    return numbered.join(F.broadcast(plan), (numbered["cell"] == plan["cell"]) & (F.col("no") >= F.col("low")) & (F.col("no") < F.col("high"))).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("first") + F.col("no") - F.col("low")).alias("slot")
    )

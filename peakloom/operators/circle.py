"""Rows on a circle in hash order, and for each place the first row from there on that has another label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peakloom.functions.vectors import hash_rank
from peakloom.operators.sampling import hash_numbers
from peakloom.plans.scratch import stored

#: Rows of a circle that one window holds.
CUT = 4096


def circle(rows: DataFrame, group: list[str], row_id: str, label: str, seed: str) -> DataFrame:
    """(group, pos, n, id, label, next_id): rows by hash from 0 in each group; next_id is the first row after, round the
    circle, whose label differs from the row's (null if there is none). Labels aren't null.

    A circle is cut into runs of CUT rows, each a window of its own. What a cut's last rows look for lies in the next cut
    or beyond: that is told from one row a cut. The cut rows are stored in the shared folder, so that they are ranked once.
    """
    at = hash_numbers(rows.select(*group, F.col(row_id).alias("id"), F.col(label).alias("label")), group, hash_rank(seed, F.col("id")), "id", total="n")
    at = at.withColumn("pos", F.col("_no") - 1).drop("_no").withColumn("_c", F.floor(F.col("pos") / CUT))
    own = Window.partitionBy(*group, "_c")
    new = F.col("label") != F.lag("label").over(own.orderBy("pos"))
    at = at.withColumn("_new", F.coalesce(new, F.lit(False)))
    # From the cut's end backwards, so that a frame grows by a row at a time.
    after = own.orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    at = stored(at.withColumn("_next", F.last(F.when(F.col("_new"), F.col("id")), ignorenulls=True).over(after)), "circle")

    head = at.groupBy(*group, "_c").agg(F.min(F.struct("pos", "label", "id")).alias("h"), F.min(F.when(F.col("_new"), F.struct("pos", "id"))).alias("s"), F.first("n").alias("n"))
    m = F.ceil(F.col("n") / CUT)
    head = head.select(*group, "_c", m.alias("_m"), F.col("h.label").alias("label"), F.col("h.id").alias("id"), F.col("s.id").alias("second"))
    # Twice round, so that the last cut finds the first ones behind it.
    twice = head.union(head.withColumn("_c", F.col("_c") + F.col("_m")))
    ring = Window.partitionBy(*group).orderBy("_c")
    breaks = F.col("second").isNotNull() | (F.col("label") != F.lag("label").over(ring))
    twice = twice.withColumn("_break", F.when(breaks, F.struct("label", "id", "second")))
    behind = Window.partitionBy(*group).orderBy(F.desc("_c")).rowsBetween(Window.unboundedPreceding, -1)
    found = F.last("_break", ignorenulls=True).over(behind)
    other = twice.withColumn("_f", found).withColumn("_other", F.coalesce("second", F.when(F.col("_f.label") != F.col("label"), F.col("_f.id")).otherwise(F.col("_f.second"))))
    # What the cut before sees: the first row here, or the first of another label.
    seen = other.filter(F.col("_c") < F.col("_m")).select(*group, F.pmod(F.col("_c") - 1, F.col("_m")).alias("_c"), F.col("label").alias("_label"), F.col("id").alias("_id"), "_other")
    next_id = F.coalesce("_next", F.when(F.col("_label") != F.col("label"), F.col("_id")).otherwise(F.col("_other")))
    return at.join(seen, [*group, "_c"]).select(*group, "pos", "n", "id", "label", next_id.alias("next_id"))


def negatives(rows: DataFrame, group: list[str], row_id: str, label: str, seed: str, among: DataFrame | None = None) -> DataFrame:
    """(group, row_id, negative_id): for each row, from a place of its own on the group's circle on, the first of another
    label; rows of groups of one label have none. Each place is looked up about once, whatever the labels. With `among`
    only its rows (group, row_id, label) look."""
    around = circle(rows, group, row_id, label, f"{seed} circle")
    start = F.conv(F.substring(hash_rank(f"{seed} start", F.col(row_id)), 1, 8), 16, 10).cast("long")
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    looks = among if among is not None else rows
    own = looks.select(*group, F.col(row_id).alias("_row"), F.col(label).alias("_own"), start.alias("_start"))
    own = (own.join(sizes, group) if group else own.crossJoin(F.broadcast(sizes))).withColumn("pos", F.pmod("_start", "_n"))  # sizes: one row a group
    met = own.join(around, [*group, "pos"])
    found = F.when(F.col("label") != F.col("_own"), F.col("id")).otherwise(F.col("next_id"))
    return met.select(*group, F.col("_row").alias(row_id), found.alias("negative_id")).filter("negative_id is not null")

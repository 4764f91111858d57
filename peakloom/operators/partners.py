"""Partners for rows: the nearest tier of candidates that has one, decided by hash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peakloom.functions.vectors import hash_rank
from peakloom.operators.circle import negatives
from peakloom.operators.joins import ppm_first
from peakloom.operators.metrics import quantiles
from peakloom.plans.scratch import stored


def matched_partners(df: DataFrame, *, row_id: str, mz: str, charge: str, label: str, tolerances: list[float], seed: str) -> DataFrame:
    """(row_id, partner_id, tier): for each row one of another label.

    Tiers in order: within each tolerance (ppm) at the same charge, then the same charge, then any. Within a tolerance
    the candidate of smallest hash is taken; only rows that a tolerance leaves over meet the next one's candidates, and
    what each gives is stored in the shared folder. Rows left over look along a circle in hash order, of their charge and then
    of all rows: the first of another label is taken, so a row has a partner whenever another label exists. A tier that no
    row is left for isn't worked out.
    """
    rows = df.select(row_id, charge, label)
    left, parts = df.select(row_id, mz, charge, label), []
    for no, ppm in enumerate(tolerances):
        # The first tolerance's rows look among themselves: one table.
        among = {"among": left} if parts else {}
        found = stored(ppm_first(df, row_id=row_id, mz=mz, label=label, on=[charge], ppm=ppm, seed=seed, **among), f"partners-{no}")
        parts.append(found.select(row_id, "partner_id", F.lit(no).alias("tier")))
        left = stored(left.join(found, row_id, "left_anti"), "partners-left")
        if left.isEmpty():
            return reduce(DataFrame.union, parts)
    left = left.select(row_id, charge, label)
    for no, group in enumerate(([charge], [])):
        found = stored(negatives(rows, group, row_id, label, f"{seed} {no}", left).select(row_id, "negative_id"), "partners-circle")
        parts.append(found.select(row_id, F.col("negative_id").alias("partner_id"), F.lit(len(tolerances) + no).alias("tier")))
        left = left.join(found, row_id, "left_anti")
        if group and left.isEmpty():
            break
    return reduce(DataFrame.union, parts)


def diagnostics(pairs: DataFrame, rows: DataFrame, row_id: str, mz: str, charge: str, ppm: float) -> DataFrame:
    """(tier, n, same_charge, within, median_ppm) of partners. What is told of each pair is stored in the shared folder: it is
    read twice."""
    side = lambda s: rows.select(F.col(row_id).alias(f"{s}_id"), F.col(mz).alias(f"{s}_mz"), F.col(charge).alias(f"{s}_z"))
    p = pairs.select(F.col(row_id).alias("a_id"), F.col("partner_id").alias("b_id"), "tier").join(side("a"), "a_id").join(side("b"), "b_id")
    off = F.abs(F.col("b_mz") - F.col("a_mz")) / F.col("a_mz") * 1e6
    p = stored(p.select("tier", (F.col("a_z") == F.col("b_z")).alias("_same"), off.alias("_off")), "partners-off")
    same = F.col("_same")
    means = p.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.avg(same.cast("double")).alias("same_charge"), F.avg((same & (F.col("_off") <= ppm)).cast("double")).alias("within"))
    return means.join(quantiles(p, ["tier"], "_off", {"median_ppm": 0.5}), "tier")


def matched_batches(
    df: DataFrame, *, row_id: str, mz: str, charge: str, label: str, labels_each: int, rows_each: int, seed: str, epoch: int = 0, strict: float = 10.0, relaxed: float = 20_000.0, cut: float = 1.0
) -> DataFrame:
    """(batch, place, row_id, label, charge, tier): an epoch's batches of labels_each different labels, rows_each rows of each.

    A label's rows of one charge are a variant, if they are rows_each or more; the first ones in the epoch's hash order are
    taken. Variants of a charge stand in order of their median m/z, and a batch is a run of labels_each of them: so those
    nearest in mass, which are the hardest to tell apart, stand side by side (tier "strict" or "relaxed" if a neighbour in
    the batch lies within that many ppm, else "same_charge"), and no label is twice in a batch. Where the runs start
    depends on the epoch. What is left at the ends of the charges makes batches across charges (tier "global"), a label's
    first variant apart from its second and so on; incomplete batches are left out. place counts a batch's rows from 0.

    Places in a charge are counted by cuts of m/z (`cut` wide), so no task holds a charge. Rows with a null or empty label,
    or an m/z or charge that is null, not finite or not positive, take no part.
    """
    m, z, y = F.col(mz), F.col(charge), F.col(label)
    able = df.filter(y.isNotNull() & (y.cast("string") != "") & (m > 0) & (m < float("inf")) & (z > 0)).select(row_id, y.alias("_y"), z.alias("_z"), m.cast("double").alias("_m"))
    many = able.groupBy("_y", "_z").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= rows_each)
    variants = quantiles(able.join(many, ["_y", "_z"], "left_semi"), ["_y", "_z"], "_m", {"_at": 0.5}).withColumn("_cut", F.floor(F.col("_at") / cut))
    sizes = variants.groupBy("_z", "_cut").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("_z").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_z", "_cut", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_z", "_cut").orderBy("_at", "_y")) - 1
    shift = F.conv(F.substring(hash_rank(seed, str(epoch), "shift", F.col("_z")), 1, 8), 16, 10).cast("long") % labels_each
    placed = variants.withColumn("_own", own).join(sizes, ["_z", "_cut"]).withColumn("_no", F.col("_before") + F.col("_own") + shift)
    placed = placed.select("_y", "_z", "_at", F.floor(F.col("_no") / labels_each).alias("_run"), (F.col("_no") % labels_each).alias("_place"))
    full = placed.groupBy("_z", "_run").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") == labels_each).drop("_c")
    w = Window.partitionBy("_z", "_run").orderBy("_place")
    gap = F.least(F.col("_at") - F.lag("_at").over(w), F.lead("_at").over(w) - F.col("_at")) / F.col("_at") * 1e6
    tier = F.when(gap <= strict, "strict").when(gap <= relaxed, "relaxed").otherwise("same_charge")
    same = placed.join(full, ["_z", "_run"], "left_semi").withColumn("tier", tier).withColumn("batch", F.concat_ws("-", "_z", "_run"))
    # Of each charge fewer than two batches are left.
    rest = placed.join(full, ["_z", "_run"], "left_anti").withColumn("_turn", F.row_number().over(Window.partitionBy("_y").orderBy("_z")) - 1)
    rest = rest.withColumn("_no", F.row_number().over(Window.partitionBy("_turn").orderBy("_z", "_at", "_y")) - 1).withColumn("_run", F.floor(F.col("_no") / labels_each))
    whole = rest.groupBy("_turn", "_run").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") == labels_each)
    mixed = rest.join(whole, ["_turn", "_run"], "left_semi").withColumn("_place", F.col("_no") % labels_each).withColumn("tier", F.lit("global")).withColumn("batch", F.concat_ws("-", F.lit("all"), "_turn", "_run"))
    chosen = same.select("_y", "_z", "_place", "tier", "batch").unionByName(mixed.select("_y", "_z", "_place", "tier", "batch"))
    taken = Window.partitionBy("_y", "_z").orderBy(hash_rank(seed, str(epoch), F.col(row_id)), row_id)
    rows = able.withColumn("_r", F.row_number().over(taken)).filter(F.col("_r") <= rows_each)
    place = (F.col("_place") * rows_each + F.col("_r") - 1).cast("int").alias("place")
    return rows.join(chosen, ["_y", "_z"]).select("batch", place, row_id, F.col("_y").alias(label), F.col("_z").alias(charge), "tier")

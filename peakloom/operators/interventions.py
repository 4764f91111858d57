"""Disturbed inputs whose statistics stay the same: what a model should or should not notice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peakloom.functions.vectors import hash_rank
from peakloom.operators.sampling import hash_numbers


def shuffled_intensities(peaks: Column, key: Column) -> Column:
    """The spectrum's m/z with its own intensities in another order, which key decides."""
    order = F.array_sort(F.transform(peaks, lambda p, i: F.struct(F.md5(F.concat_ws("|", key, i)).alias("h"), i.alias("at"), p["intensity"].alias("x"))))
    return F.zip_with(peaks, order, lambda p, q: F.struct(p["mz"].alias("mz"), q["x"].alias("intensity")))


def permuted(df: DataFrame, strata: list[str], row_id: str, value: str, seed: str, batch: int = 512) -> DataFrame:
    """df with `permuted`: each row gets the value of another of its stratum; what a stratum holds stays the same.

    A stratum is dealt into batches by hash, and inside a batch every row takes the value of the one that follows it in
    hash order, the last that of the first. A stratum with a single row in a batch keeps its value.
    """
    n = df.groupBy(*strata).agg((F.floor(F.count(F.lit(1)) / batch) + 1).alias("_batches"))
    dealt = df.join(n, strata).withColumn("_rank", hash_rank(seed, F.col(row_id))).withColumn("_batch", F.conv(F.substring("_rank", 1, 8), 16, 10).cast("long") % F.col("_batches"))
    w = Window.partitionBy(*strata, "_batch").orderBy("_rank", row_id)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The value may be null, so places decide, not nulls.
    last = F.row_number().over(w) == F.count(F.lit(1)).over(Window.partitionBy(*strata, "_batch"))
    return dealt.withColumn("permuted", F.when(last, F.first(value).over(whole)).otherwise(F.lead(value).over(w))).drop("_batches", "_rank", "_batch")


def dealt_peaks(df: DataFrame, batch: list[str], row_id: str, peaks: str, seed: str) -> DataFrame:
    """df with a batch's peaks dealt anew among its rows: every row keeps its number of peaks, in order of m/z, and a batch
    its peaks. Which peak goes where is decided by hash.

    Peaks and places are numbered alike in hash order, in cuts, so that a batch may be of any size, then meet by number.
    Rows without peaks keep what they have. Ids are distinct; peaks are structs (mz, intensity).
    """
    each = df.select(*batch, F.col(row_id).alias("_id"), F.posexplode(peaks).alias("_pos", "_peak"))
    pool = hash_numbers(each, batch, hash_rank(seed, "peak", F.col("_id"), F.col("_pos")), "_id").select(*batch, "_no", "_peak")
    places = hash_numbers(each.drop("_peak"), batch, hash_rank(seed, "place", F.col("_id"), F.col("_pos")), "_id").select(*batch, "_no", "_id")
    dealt = places.join(pool, [*batch, "_no"]).groupBy("_id").agg(F.sort_array(F.collect_list("_peak")).alias("_dealt"))
    return df.join(dealt, df[row_id] == dealt["_id"], "left").withColumn(peaks, F.coalesce("_dealt", F.col(peaks))).drop("_id", "_dealt")


def without_precursor(df: DataFrame, mz: str, charge: str) -> DataFrame:
    """The null condition: precursor m/z and charge are 0."""
    return df.withColumn(mz, F.lit(0.0)).withColumn(charge, F.lit(0))

"""Alignment of runs to a common scale by isotonic regression on shared anchors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.operators.metrics import quantiles
from peakloom.operators.sampling import place


def isotonic(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """The non-decreasing least-squares fit to y in the order of x (sorted): neighbours that violate it are pooled."""
    level, weight, held = [], [], []
    for v, w in zip(y, np.ones(len(y)) if weights is None else weights):
        level.append(float(v))
        weight.append(float(w))
        held.append(1)
        while len(level) > 1 and level[-2] > level[-1]:
            n = weight[-2] + weight[-1]
            level[-2:] = [(level[-2] * weight[-2] + level[-1] * weight[-1]) / n]
            weight[-2:] = [n]
            held[-2:] = [held[-2] + held[-1]]
    return np.repeat(level, held)


def aligned(df: DataFrame, run: str, key: str, value: str, species: list[str] = (), least_anchors: int = 50, into: str = "aligned") -> DataFrame:
    """df with `into`: the value on the scale of the species' reference run, the one with most rows (ties: the smallest name).

    A run's anchors are its medians of keys that the reference run holds as well. With at least least_anchors of them
    the value follows the isotonic fit from the run's medians to the reference's (linear between anchors, clipped
    outside); else, and in the reference run, it stays as it is.

    A fit sees one run's anchors. Its curve goes to the rows in pieces of about the root of its length: a row first
    finds its piece, then its place there, both by halving.
    """
    by = list(species)
    own = quantiles(df, [*by, run, key], value, {"_x": 0.5})
    sizes = df.groupBy(*by, run).agg(F.count(F.lit(1)).alias("_n"))
    best = sizes.groupBy(*by).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(run).alias("run"))).alias("_best"))
    best = best.select(*by, F.col("_best.run").alias("_reference"))
    with_reference = lambda x: x.join(best, by) if by else x.crossJoin(F.broadcast(best))  # noqa: E731  one row without species
    medians = with_reference(own)
    scale = medians.filter(F.col(run) == F.col("_reference")).select(*by, key, F.col("_x").alias("_y"))
    anchors = medians.filter(F.col(run) != F.col("_reference")).join(scale, [*by, key]).select(*by, run, "_x", "_y")
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (*by, run))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [*by, run, "_piece", "_starts", "_xs", "_ys"]
        if len(pdf) < least_anchors:
            return pd.DataFrame({k: pd.Series([], dtype=object) for k in names})
        one = pdf.groupby("_x")["_y"].agg(["mean", "size"]).sort_index()
        x, y = one.index.to_numpy(float), isotonic(one.index.to_numpy(float), one["mean"].to_numpy(float), one["size"].to_numpy(float))
        step = int(np.ceil(np.sqrt(len(x))))
        starts = x[::step].tolist()
        # A piece also holds the first anchor of the next one.
        rows = [(*(pdf[c].iloc[0] for c in (*by, run)), k, starts, x[k * step : (k + 1) * step + 1].tolist(), y[k * step : (k + 1) * step + 1].tolist()) for k in range(len(starts))]
        return pd.DataFrame(rows, columns=names)

    curves = anchors.groupBy(*by, run).applyInPandas(fit, f"{kinds}, _piece int, _starts array<double>, _xs array<double>, _ys array<double>")
    heads = curves.filter("_piece = 0").select(*by, run, "_starts")
    v = F.col(value)
    piece = F.greatest(place(F.col("_starts"), v, equal=True) - 1, F.lit(0))
    placed = df.join(heads, [*by, run], "left").withColumn("_piece", F.when(F.col("_starts").isNull(), -1).otherwise(piece)).drop("_starts")
    joined = placed.join(curves.select(*by, run, "_piece", "_xs", "_ys"), [*by, run, "_piece"], "left")
    at = place(F.col("_xs"), v, equal=True)
    x0, x1, y0, y1 = (F.get(F.col(c), at + k) for c, k in (("_xs", -1), ("_xs", 0), ("_ys", -1), ("_ys", 0)))
    between = y0 + (y1 - y0) * F.coalesce(F.try_divide(v - x0, x1 - x0), F.lit(0.0))
    fitted = F.when(F.col("_xs").isNull(), v).when(at == 0, F.element_at("_ys", 1)).when(at == F.size("_xs"), F.element_at("_ys", -1)).otherwise(between)
    return joined.withColumn(into, fitted).select(*df.columns, into)

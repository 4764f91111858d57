"""Matching of predicted to true residue sequences, and what is counted of it."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.functions.text import PROTON, RESIDUES, WATER

EPSILON = 1e-8
ISOTOPE = 1.00335
MATCH = T.StructType([T.StructField("matches", T.ArrayType(T.BooleanType())), T.StructField("n_true", T.IntegerType()), T.StructField("n_predicted", T.IntegerType()), T.StructField("peptide", T.BooleanType())])


def token_mass(token: str) -> float:
    """Residue mass plus deltas; an unknown residue has mass 0."""
    import re

    return RESIDUES.get(token[:1], 0.0) + sum(map(float, re.findall(r"[+-]\d+(?:\.\d+)?", token)))


def runs_of_matches(a: np.ndarray, at: np.ndarray, n: np.ndarray, b: np.ndarray, bt: np.ndarray, m: np.ndarray, step: int, cumulative: float, single: float) -> tuple[np.ndarray, np.ndarray]:
    """Which masses of a and of b match where lists agree from their start: totals within `cumulative`, masses within `single`.

    List k is n[k] masses of a from the place at[k] on, against m[k] of b from bt[k] on, read by `step` (1, or -1: backwards).
    Where totals differ the list that lags behind advances. All lists go on side by side, each with its running totals.
    """
    fits_a, fits_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    go = np.flatnonzero((n > 0) & (m > 0))
    i, j, n, m = at[go], bt[go], n[go], m[go]
    s, t = a[i], b[j]
    while len(i):
        both = np.abs(s - t) < cumulative
        hit = both & (np.abs(a[i] - b[j]) < single)
        fits_a[i[hit]] = fits_b[j[hit]] = True
        ahead = s < t
        on_a, on_b = both | ahead, both | ~ahead
        i, j, n, m = i + step * on_a, j + step * on_b, n - on_a, m - on_b
        go = np.flatnonzero((n > 0) & (m > 0))
        i, j, n, m, on_a, on_b = i[go], j[go], n[go], m[go], on_a[go], on_b[go]
        s, t = s[go], t[go]
        s, t = np.where(on_a, s + a[i], s), np.where(on_b, t + b[j], t)
    return fits_a, fits_b


def misses(fits: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of each list's places stand before its first one that doesn't fit."""
    gaps = np.r_[np.flatnonzero(~fits), len(fits)]
    return np.minimum(gaps[np.searchsorted(gaps, starts)] - starts, n)


def matched_lists(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, mode: str, cumulative: float = 0.5, single: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Whether each mass of b matches, and whether lists match whole. Lists lie in a and b one after another, n and m long."""
    at, bt = np.cumsum(n) - n, np.cumsum(m) - m
    back = lambda k, l: runs_of_matches(a, at + n - 1, k, b, bt + m - 1, l, -1, cumulative, single)[1]  # noqa: E731, E741
    if mode == "backward":
        fits = back(n, m)
    else:
        fits_a, fits = runs_of_matches(a, at, n, b, bt, m, 1, cumulative, single)
        if mode == "best":
            first_a, first_b = misses(fits_a, at, n), misses(fits, bt, m)
            fits &= np.arange(len(b)) - np.repeat(bt, m) < np.repeat(first_b, m)
            fits |= back(n - first_a, m - first_b)
    return fits, (n == m) & (misses(fits, bt, m) == m)


def matched(true: list[str], predicted: list[str], mode: str, cumulative: float = 0.5, single: float = 0.1) -> tuple[list[bool], bool]:
    """Whether each predicted residue matches. forward, backward, or best: forward up to the first miss, the rest backward."""
    masses, sizes = lambda x: np.array([token_mass(t) for t in x], float), lambda x: np.array([len(x)])
    fits, whole = matched_lists(masses(true), sizes(true), masses(predicted), sizes(predicted), mode, cumulative, single)
    return fits.tolist(), bool(whole[0])


def match(true: Column, predicted: Column, mode: str = "best") -> Column:
    """struct(matches, n_true, n_predicted, peptide) of two token arrays; null counts as none, and two empty ones match."""

    @F.arrow_udf(MATCH)
    def of(true: pa.Array, predicted: pa.Array) -> pa.Array:
        def lists(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            tokens = x.flatten().dictionary_encode()
            known = np.array([0.0 if t is None else token_mass(t) for t in tokens.dictionary.to_pylist()] + [0.0])
            places = tokens.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False)
            return known[places], pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)

        (a, n), (b, m) = lists(true), lists(predicted)
        fits, whole = matched_lists(a, n, b, m, mode)
        matches = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(m)], pa.int32()), pa.array(fits))
        return pa.StructArray.from_arrays([matches, pa.array(n, pa.int32()), pa.array(m, pa.int32()), pa.array(whole)], names=[f.name for f in MATCH.fields])

    return of(true, predicted)


def sequence_scores(df: DataFrame, group: list[str], matched_col: str, times: Column | None = None) -> DataFrame:
    """(group, n, aa_precision, aa_recall, peptide_precision) from match()'s structs; a row counts `times` times."""
    m, k = F.col(matched_col), F.lit(1) if times is None else times
    hits = F.size(F.filter(m["matches"], lambda x: x))
    c = df.groupBy(*group).agg(F.sum(k).alias("n"), F.sum(k * hits).alias("_h"), F.sum(k * m["n_true"]).alias("_t"), F.sum(k * m["n_predicted"]).alias("_p"), F.sum(k * m["peptide"].cast("int")).alias("_w"))
    return c.select(*group, "n", (F.col("_h") / (F.col("_p") + EPSILON)).alias("aa_precision"), (F.col("_h") / (F.col("_t") + EPSILON)).alias("aa_recall"), (F.col("_w") / (F.col("n") + EPSILON)).alias("peptide_precision"))


def mass_error_ppm(observed_mz: Column, mass: Column, charge: Column, isotope: Column) -> Column:
    """Of the observed m/z against a neutral mass, after taking off isotope steps of 1.00335 over the charge."""
    expected = mass / charge + 1.00727646688
    return (observed_mz - isotope * 1.00335 / charge - expected) / expected * 1e6


def fits_precursor(observed_mz: Column, mass: Column, charge: Column, ppm: float, low: int = 0, high: int = 1) -> Column:
    return F.exists(F.sequence(F.lit(low), F.lit(high)), lambda k: F.abs(mass_error_ppm(observed_mz, mass, charge, k)) < ppm)


def peptide_score(token_scores: Column, fits: Column) -> Column:
    """struct(score, token_scores): the mean, less one without a precursor fit; tokens are averaged with it."""
    mean = F.try_divide(F.aggregate(token_scores, F.lit(0.0), lambda a, x: a + x), F.size(token_scores).cast("double"))
    score = F.when(fits, mean).otherwise(mean - 1)
    return F.struct(score.alias("score"), F.transform(token_scores, lambda x: (x + score) / 2).alias("token_scores"))


def beam_end(
    tokens: Column, mz: Column, charge: Column, masses: dict[str, float], *, n_term: tuple[str, ...] = (), stop: str = "$", pad: str = "", min_length: int = 6, ppm: float = 50.0, isotopes: tuple[int, int] = (0, 1)
) -> Column:
    """struct(step, finished, fits, discarded): where a beam that is decoded token by token ends, and how.

    tokens: an array, in the order of decoding (from the C-terminus, so that an N-terminal token comes last). The first step
    (from 0) counts at which one of these holds; a beam that none ends has step null and is neither finished nor discarded.
    - A padding token: discarded.
    - From the third token on, an N-terminal token that is not the last residue: discarded.
    - A stop without residues, or with fewer than min_length: discarded.
    - Any other stop: finished, and fits if the mass agrees with the precursor within ppm at one of the isotope offsets.
    - No stop, the mass doesn't agree, and with some token of negative mass after it, it would still be too large at every
      offset: finished, and doesn't fit.
    A residue without a mass agrees with no precursor and exceeds none. A null token counts as such a residue; null tokens, m/z or
    charge give a beam without end or fit. One pass with a running mass; tokens after the end aren't looked at.
    """
    known = F.create_map(*(F.lit(x) for k, v in masses.items() for x in (k, float(v)))) if masses else F.create_map().cast("map<string,double>")
    losses = [float(v) for v in masses.values() if v < 0]

    def off(mass: Column) -> list[Column]:
        """ppm by which the peptide's m/z lies above the precursor's, at each isotope offset."""
        calculated = (mass + WATER) / charge + PROTON
        return [(calculated - (mz - k * ISOTOPE / charge)) / mz * 1e6 for k in range(isotopes[0], isotopes[1] + 1)]

    yes = lambda c: F.coalesce(c, F.lit(False))
    agrees = lambda mass: yes(reduce(Column.__or__, [F.abs(d) < ppm for d in off(mass)]))
    too_large = lambda mass: yes(reduce(Column.__and__, [d > ppm for d in off(mass)]))
    terminal = lambda t: yes(t.isin(*n_term)) if n_term else F.lit(False)

    def state(i, n, mass, before, last, step, finished, fits, discarded) -> Column:
        """before: an N-terminal token stands before the last token; last: the last one is such a token."""
        return F.struct(
            i.cast("int").alias("i"), n.cast("int").alias("n"), mass.cast("double").alias("mass"), before.alias("before"), last.alias("last"),
            step.cast("int").alias("step"), finished.alias("finished"), fits.alias("fits"), discarded.alias("discarded"),
        )

    def take(a: Column, t: Column) -> Column:
        stops, pads = yes(t == stop), yes(t == pad)
        mass = F.when(stops | pads, a["mass"]).otherwise(a["mass"] + F.try_element_at(known, t))
        n = a["n"] + F.when(stops | pads, 0).otherwise(1)
        inside = (a["i"] > 1) & (a["before"] | (a["last"] & ~stops))
        discarded = pads | inside | (stops & ((n == 0) | (n < min_length)))
        fits = ~discarded & stops & agrees(mass)
        beyond = reduce(Column.__or__, [too_large(mass + x) for x in losses], F.lit(False))
        finished = ~discarded & (stops | (~agrees(mass) & beyond))
        step = F.when(finished | discarded, a["i"])
        return F.when(a["step"].isNotNull(), a).otherwise(state(a["i"] + 1, n, mass, a["before"] | a["last"], terminal(t), step, finished, fits, discarded))

    no = F.lit(False)
    start = state(F.lit(0), F.lit(0), F.lit(0.0), no, no, F.lit(None), no, no, no)
    return F.aggregate(tokens, start, take, lambda a: F.struct(a["step"].alias("step"), a["finished"].alias("finished"), a["fits"].alias("fits"), a["discarded"].alias("discarded")))

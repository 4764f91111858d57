"""Ranks by BLAKE2b, which Spark lacks: Arrow batches of texts."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.functions.text import as_text


@F.pandas_udf(T.LongType())
def _u63(x: pd.Series) -> pd.Series:
    return x.map(lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") & ((1 << 63) - 1))


@F.pandas_udf(T.StringType())
def _hex128(x: pd.Series) -> pd.Series:
    return x.map(lambda t: hashlib.blake2b(t.encode(), digest_size=16).hexdigest())


@F.pandas_udf(T.DecimalType(20, 0))
def _little64(x: pd.Series) -> pd.Series:
    from decimal import Decimal

    return x.map(lambda t: Decimal(int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little")))


def joined(sep: str, parts: tuple[Column | str, ...]) -> Column:
    return F.concat_ws(sep, *(F.lit(p) if isinstance(p, str) else as_text(p.cast("string")) for p in parts))


def priority63(*parts: Column | str) -> Column:
    """63 bits of the parts' texts, joined by the unit separator; missing parts are empty."""
    return _u63(joined("\x1f", parts))


def rank128(seed: str, *identity: Column) -> Column:
    """128 bits in hex: the seed, the record separator, and the identity's parts joined by the unit separator."""
    return _hex128(F.concat_ws("\x1e", F.lit(seed), F.concat_ws("\x1f", *(p.cast("string") for p in identity))))


def key64(*parts: Column | str) -> Column:
    """64 bits, least significant byte first, of the parts joined by colons."""
    return _little64(F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)))


@F.pandas_udf(T.StringType())
def _packed128(mz: pd.Series, charge: pd.Series, mzs: pd.Series, intensities: pd.Series) -> pd.Series:
    import numpy as np

    out = []
    for m, z, x, y in zip(mz, charge, mzs, intensities):
        if any(v is None for v in (x, y)) or pd.isna(m) or pd.isna(z):
            out.append(None)
            continue
        h = hashlib.blake2b(digest_size=16)
        for part, kind in (([m], "<f4"), ([z], "<i4"), ([len(x)], "<i4"), (x, "<f4"), (y, "<f4")):
            h.update(np.asarray(part, dtype=kind).tobytes())
        out.append(h.hexdigest())
    return pd.Series(out, dtype=object)


def spectrum_fingerprint(mz: Column, charge: Column, mz_array: Column, intensity_array: Column) -> Column:
    """128 bits in hex of a spectrum as stored: precursor m/z, charge, number of peaks, m/z values, intensities.

    Floats are 32-bit, whole numbers too, all with the least significant byte first and nothing between them, so values
    that differ only beyond 32 bits have one fingerprint. Null if any of the four is null.
    """
    return _packed128(mz.cast("double"), charge.cast("int"), mz_array.cast("array<double>"), intensity_array.cast("array<double>"))

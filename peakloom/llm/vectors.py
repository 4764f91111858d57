"""Vectors as whole numbers, for operators that must be exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components that are larger stop the job: sums of 64 squares of differences must fit 64 bits.
MOST = 1 << 27


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int, dim: int | None = None) -> DataFrame:
    """(id, v): v holds floor(scale * x) of every component x, as array<int>.

    Rows whose vector is null, has a null or non-finite component or, where dim is given, another length are left
    out. A component beyond +-2**27 stops the job with an error.
    """
    x = F.col(f"`{vec_col}`")
    sound = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    if dim is not None:
        sound = (F.size(x) == dim) & sound
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * scale))
    far = F.exists(x, lambda e: F.abs(e.cast("double") * scale) > MOST)
    checked = F.when(far, F.raise_error(F.lit("a component is too large for exact sums"))).otherwise(whole)
    return vectors.filter(sound).select(F.col(f"`{id_col}`").alias("id"), checked.cast("array<int>").alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A column of integer lists of one length, as rows of an int64 matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact a @ b.T of integers: by float64 where no sum can leave its 53 bits, else in 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.einsum("id,jd->ij", a, b)

"""Vectors as whole numbers, so that distances, sums and ties are exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Components beyond are set to this bound: squares and their sums stay in 64 bits.
BOUND = 1 << 24


def is_whole(vector: Column) -> Column:
    """Not null, and without null, infinite or NaN components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as integers within the bound."""
    bound = float(BOUND)
    near = lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(scale * x.cast("double"), F.lit(bound)), F.lit(-bound))), F.lit(BOUND)), F.lit(-BOUND))
    return F.transform(vector, lambda x: near(x).cast("int"))


def integers(rows: DataFrame, vector: str, scale: int, *columns: Column) -> DataFrame:
    """The columns and `values`, of the rows whose vector is whole."""
    kept = rows.where(is_whole(F.col(f"`{vector}`")))
    return kept.select(*columns, whole_numbers(F.col(f"`{vector}`"), scale).alias("values"))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """A batch of vectors of one width, a row each."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def floor_mean(sums: np.ndarray, n: np.ndarray, old: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / n); rows without members keep the old ones."""
    return np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], old)

"""Rows of a vector table that can be computed with, as numpy blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vec: Column) -> Column:
    """Whether a vector is there, has entries, and all of them are finite numbers."""
    inf = float("inf")
    return F.coalesce(
        (F.size(vec) > 0) & F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(inf)), F.lit(False))), F.lit(False)
    )


def usual_length(rows: DataFrame, vec_col: str) -> int:
    """The length that most vectors have, the larger of several; 0 without rows."""
    lengths = rows.groupBy(F.size(vec_col).alias("d")).agg(F.count(F.lit(1)).alias("c"))
    most = lengths.agg(F.max(F.struct("c", "d")).alias("m")).first().m
    return most.d if most else 0


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column without nulls, all of length ``dims``, as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)

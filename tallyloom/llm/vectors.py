"""What the two vector searches share: which vectors count, and blocks of them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: Column, zero: bool = False) -> Column:
    """Not null, not empty, all components finite; with ``zero`` False also not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vector.isNotNull() & (F.size(vector) > 0) & finite
    return good if zero else good & F.exists(vector, lambda x: x != 0)


def vectors(table: DataFrame, key: str, vector: str, zero: bool = False) -> DataFrame:
    """(_id, _dim, _vec) of usable vectors with a key."""
    return table.filter(F.col(key).isNotNull() & F.coalesce(usable(F.col(vector), zero), F.lit(False))).select(
        F.col(key).cast("long").alias("_id"), F.size(vector).alias("_dim"),
        F.col(vector).cast("array<double>").alias("_vec"))


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of one length as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(np.float64)

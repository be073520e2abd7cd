"""Vector columns: which rows take part, and how they cross to numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Not null, not all zero, and without a null or non-finite component."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def taking_part(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows with an id and a usable vector; components as doubles."""
    v = F.col(vector_col)
    return vectors.where(usable(v) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def matrix(column) -> np.ndarray:
    """Rows of equal length of an Arrow list column, as doubles."""
    chunk = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = np.asarray(chunk.flatten(), dtype=np.float64)
    return flat.reshape(len(chunk), -1) if len(chunk) else flat.reshape(0, 0)

"""What the vector operators share: which vectors take part, and rows as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and without null or non-finite components."""
    size = F.abs(F.get(vector, F.lit(0))).isNotNull()
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.coalesce(F.isnan(x), F.lit(True)))
    return F.coalesce(size & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def one_per_id(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the usable vectors: an id that comes more than once counts as its smallest vector.

    Null ids and unusable vectors are left out.  The minimum is a partial aggregate.
    """
    taken = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    return taken.where(F.col("id").isNotNull() & usable(F.col("vector"))).groupBy("id").agg(F.min("vector").alias("vector"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equally long lists as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)

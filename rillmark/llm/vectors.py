"""Whole-number vectors for the operators on embeddings.

A vector takes part if it isn't null and empty and has finite components only. Those of another length
than the one of the least id (among lengths that suit the operator) take no part either, as they can't be compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole numbers are below this, so that sums of their products over many dimensions are exact in 64 bits.
LIMIT = 1 << 26


def finite(vector: Column) -> Column:
    """No null, no NaN, no infinity in it."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & good


def comparable(rows: DataFrame, id_col: str, vector_col: str, multiple: int = 1, keep: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """Columns id, v and ``keep`` of the rows that take part, and the length of their vectors (0 without rows)."""
    kept = [F.col(c) for c in keep if c not in ("id", "v")]
    known = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), *kept)
    known = known.where(finite(F.col("v")) & (F.size("v") % multiple == 0))
    least = known.select("id", F.size("v").alias("n")).orderBy(F.col("id").asc_nulls_last(), "n").limit(1).collect()
    length = least[0].n if least else 0
    return known.where(F.size("v") == length), length


def matrix(vectors: pa.Array, length: int, scale: int) -> np.ndarray:
    """A row of floor(scale * x) for each vector of a column without nulls."""
    out = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if out.size and np.abs(out).max() >= LIMIT:
        raise ValueError(f"components from {LIMIT // scale} on have no exact sums in 64 bits")
    return out.astype(np.int64).reshape(-1, length)

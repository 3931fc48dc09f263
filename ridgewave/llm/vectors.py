"""Vectors as whole numbers, shared by the operators on embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components become floor(SCALE x); those of LARGEST or more in magnitude would overflow sums of squares.
SCALE, LARGEST = 256, float(1 << 19)


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, *keep: str) -> tuple[DataFrame, int]:
    """(__rw_id, __rw_v array<int>, kept columns as __rw_<name>) and the number of components.

    Rows whose vector is null or empty, or holds a null or non-finite component or one of 2**19 or more in
    magnitude, are left out, and so are those of another length than the vector of the smallest id.
    """
    whole = F.col(f"`{vector_col}`")
    fits = whole.isNotNull() & (F.size(whole) > 0) & F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    ints = F.transform(whole, lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("int"))
    rows = df.where(fits).select(F.col(f"`{id_col}`").alias("__rw_id"), ints.alias("__rw_v"), *(F.col(f"`{c}`").alias(f"__rw_{c}") for c in keep))
    first = rows.orderBy(F.col("__rw_id").asc_nulls_last(), "__rw_v").limit(1).select(F.size("__rw_v").alias("n")).collect()
    width = first[0]["n"] if first else 0
    return rows.where(F.size("__rw_v") == width), width

"""What the two vector operators share: valid rows and their blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """True for a vector without null or non-finite components; null and empty ones are not usable."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(embedding) > 0) & F.forall(embedding, lambda x: F.coalesce(finite(x), F.lit(False))), F.lit(False))


def blocked(rows: DataFrame, keys: list[str], size: int, name: str) -> DataFrame:
    """rows with `name`, the number of blocks of about `size` rows that its group by keys needs, and `salt`, its own block."""
    per = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    out = rows.join(per, keys)
    return out.withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit(31)), F.col(name)).cast("int"))


def matrix(column, dtype: str = "<f8") -> np.ndarray:
    """Rows of a binary column of equal length."""
    return np.stack([np.frombuffer(x.as_buffer(), dtype) for x in column])

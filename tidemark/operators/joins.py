"""Joins that choose by a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

#: Most rows of a side that is broadcast, and most bytes of its texts and collections.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64_000_000


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether `df` has at most `limit` rows and its columns of no fixed width hold at most `most_bytes`, as text."""
    wide = [f.name for f in df.schema.fields if isinstance(f.dataType, (StringType, BinaryType, ArrayType, MapType, StructType))]
    few = df.limit(limit + 1)
    if not wide:
        return few.count() <= limit
    n, size = few.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*wide)))), F.lit(0))).first()
    return n <= limit and size <= most_bytes


def join_checked(large: DataFrame, small: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """`large` joined to `small`, whose size is checked first (`is_small`): a small one is broadcast and `large` isn't
    shuffled; else it is a shuffled join, whose skewed keys adaptive execution splits."""
    return large.join(F.broadcast(small) if is_small(small, limit) else small, on, how)

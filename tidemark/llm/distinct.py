"""Distinct counts over huge identifier sets, exact, by ranges of the identifiers' hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges that the identifiers' hash is cut into. Each identifier lies in one, so counts of ranges add up.
BUCKETS = 4096


def partial_sets(df: DataFrame, dims: Sequence[str], ident: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, dims..., ident): the distinct identifiers of each combination, by hash range: the partial result.

    Tables of different days or partitions are combined by `union`; repeats between them don't matter. Null identifiers identify nothing and are left
    out; null dimensions are values. Repeats are removed before the shuffle, so an identifier with a third of all rows moves once a task.
    """
    return df.where(F.col(ident).isNotNull()).select(F.pmod(F.xxhash64(ident), F.lit(buckets)).cast("int").alias("bucket"), *dims, ident).distinct()


def count_distinct(sets: DataFrame, dims: Sequence[str], combinations: Sequence[Sequence[str]], ident: str) -> DataFrame:
    """(dims..., level, n): distinct identifiers of every combination of values of each set of dimensions in `combinations`; exact, error 0.

    `level` names the dimensions that are counted by, joined by "+" ("all" for none); the others are null. Once the sets lie by hash range, every
    combination is deduplicated and counted within its range without moving an identifier again; only counts are added up over the ranges.
    Empty input gives no rows.
    """
    dims = list(dims)
    kinds = dict(sets.dtypes)
    local = sets.repartition("bucket")
    level = F.explode(F.array(*(F.struct(F.lit("+".join(c) or "all").alias("level"), *((F.col(d) if d in c else F.lit(None).cast(kinds[d])).alias(f"_{d}") for d in dims)) for c in combinations)))
    each = local.select("bucket", ident, level.alias("_x")).select("bucket", "_x.*", ident)
    keys = ["level", *(f"_{d}" for d in dims)]
    once = each.groupBy("bucket", *keys, ident).agg(F.lit(1).alias("_one"))
    counted = once.groupBy("bucket", *keys).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.sum("n").alias("n")).select(*(F.col(f"_{d}").alias(d) for d in dims), "level", "n")

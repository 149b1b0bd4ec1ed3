"""Aggregates over everything before a row, without one task for a whole entity."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.readings import DAY_MS

Fold = tuple[Callable[[Column], Column], Column]


def before(df: DataFrame, entity: str, time: str, order: Sequence[str], folds: Mapping[str, Fold], *, chunk: int = DAY_MS, backward: bool = False) -> DataFrame:
    """`df` with one more column for each of `folds` (name: (max, min or sum; what of)): the aggregate over all rows of the same entity that stand before the row.

    Rows stand in the order of `time` (a BIGINT), then `order`, or `backward`; rows that tie in all of these stand in any order. Null where nothing stands before, a null entity is an entity.
    Each entity is cut into chunks of time: a chunk's own rows are ordered in one task, and what its predecessors
    hold comes from one row a chunk.
    """
    k = F.floor(F.col(time) / chunk).cast("long")
    rows = df.withColumn("_k", -k if backward else k).withColumns({f"_in_{n}": x for n, (_, x) in folds.items()})
    per = rows.groupBy(F.col(entity).alias("_e2"), F.col("_k").alias("_k2")).agg(*(f(F.col(f"_in_{n}")).alias(f"_ch_{n}") for n, (f, _) in folds.items()))
    so_far = W.partitionBy("_e2").orderBy("_k2").rowsBetween(W.unboundedPreceding, -1)
    per = per.select("_e2", "_k2", *(f(F.col(f"_ch_{n}")).over(so_far).alias(f"_far_{n}") for n, (f, _) in folds.items()))
    keys = [F.col(c).desc() if backward else F.col(c) for c in (time, *order)]
    here = W.partitionBy(entity, "_k").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(per, F.col(entity).eqNullSafe(F.col("_e2")) & (F.col("_k") == F.col("_k2")))
    out = {}
    for n, (f, _) in folds.items():
        far, near = F.col(f"_far_{n}"), f(F.col(f"_in_{n}")).over(here)
        out[n] = F.when(far.isNull(), near).when(near.isNull(), far).otherwise(far + near if f is F.sum else (F.greatest if f is F.max else F.least)(far, near))
    return rows.withColumns(out).select(*df.columns, *folds)

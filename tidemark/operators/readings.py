"""From arrived inserts to readings: one value for each (entity, time)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def latest(df: DataFrame, entity: str = "series_id", time_ms: str = "ts_ms", value: str = "value", seq: str = "seq") -> DataFrame:
    """Last write wins: columns (entity, time_ms, value), one row for each (entity, time_ms).

    Rows with a null entity, time or value are no readings and are dropped first. Of the rest the highest
    `seq` gives the value (a null `seq` is older than any other); rows that tie on `seq` are settled by the greater value, NaN being the
    greatest. NaN and infinities are values. Rows repeated unchanged count once. Extra columns are ignored.

    The only shuffle is on (entity, time), so an entity with very many rows is spread over all tasks.
    """
    clean = df.select(F.col(entity).alias("_e"), F.col(time_ms).alias("_t"), F.col(value).cast("double").alias("_v"), F.coalesce(F.col(seq).cast("long"), F.lit(-(2**63))).alias("_s")).where("_e is not null and _t is not null and _v is not null")
    once = clean.repartition("_e", "_t").groupBy("_e", "_t", "_s").agg(F.max("_v").alias("_v"))
    out = once.groupBy("_e", "_t").agg(F.max_by("_v", "_s").alias("_v"))
    return out.select(F.col("_e").alias(entity), F.col("_t").alias(time_ms), F.col("_v").alias(value))


def floor_to(t: Column, width: Column | int) -> Column:
    """The start of the slot of `width` that `t` lies in; rounds down for negative times too, in whole numbers."""
    w = width if isinstance(width, Column) else F.lit(width).cast("long")
    return t - F.pmod(t, w)


def one_metric(series: DataFrame, entity: str = "series_id", metric: str = "metric") -> DataFrame:
    """(entity, metric), one row for each registered entity; a series registered again counts once.

    If an id was registered under several metrics the first in byte order counts; ids or metrics that are null are dropped.
    """
    return series.dropna(subset=[entity, metric]).groupBy(entity).agg(F.min(metric).alias(metric))

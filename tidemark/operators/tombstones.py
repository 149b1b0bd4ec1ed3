"""Deletion of time ranges: closed intervals [min_t, max_t] of a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.matchers import Matcher
from tidemark.operators.prefix import before
from tidemark.operators.select import Store
from tidemark.session import written

#: Deleted ranges, and ranges of one series, up to which they travel to the samples as one broadcast array a series.
INTERVALS, OF_SERIES = 200_000, 32


def union(tombstones: DataFrame) -> DataFrame:
    """The deleted ranges of each series as few, disjoint intervals; those that overlap, nest or are adjacent (10-20, 21-30) become one.

    Rows with a null, or with min_t > max_t, delete nothing and are dropped.
    """
    rows = tombstones.where("series_id is not null and min_t <= max_t").groupBy("series_id", "min_t").agg(F.max("max_t").alias("max_t"))
    rows = before(rows, "series_id", "min_t", [], {"_seen": (F.max, F.col("max_t"))})
    # min_t - 1 can't overflow where it is compared: nothing precedes the least possible time.
    marked = rows.withColumn("_new", F.when(F.col("_seen").isNull() | (F.expr("try_subtract(min_t, 1)") > F.col("_seen")), 1).otherwise(0))
    islands = before(marked, "series_id", "min_t", [], {"_i": (F.sum, F.col("_new"))}).withColumn("_i", F.coalesce("_i", F.lit(0)) + F.col("_new"))
    return islands.groupBy("series_id", "_i").agg(F.min("min_t").alias("min_t"), F.max("max_t").alias("max_t")).select("series_id", "min_t", "max_t")


def apply(samples: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Samples outside all deleted ranges of their series; both ends of a range are deleted. Rows with a null series or time stay.

    A few ranges, at most INTERVALS, and OF_SERIES of a series, are broadcast as one array a series. More are told from the order of time: of the disjoint ranges of a series only the
    last one that starts at or before a sample can hold it, and its end is the greatest end so far (`before`, by chunks of time); samples and ranges meet by (series, chunk), whatever their number.
    """
    holes = written(union(tombstones), "holes")
    sizes = holes.groupBy("series_id").agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    if sizes[0] <= INTERVALS and sizes[1] <= OF_SERIES:
        few = holes.groupBy("series_id").agg(F.collect_list(F.struct("min_t", "max_t")).alias("_holes"))
        both = samples.join(F.broadcast(few), "series_id", "left")
        hit = F.exists("_holes", lambda h: (F.col("ts_ms") >= h["min_t"]) & (F.col("ts_ms") <= h["max_t"]))
        return both.where(~F.coalesce(hit, F.lit(False))).select(*samples.columns)
    there = F.col("series_id").isNotNull() & F.col("ts_ms").isNotNull()
    row = F.struct(*(F.col(c) for c in samples.columns))
    rows = samples.where(there).select(F.col("series_id").alias("_e"), F.col("ts_ms").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_end"), row.alias("_row"))
    ranges = holes.select(F.col("series_id").alias("_e"), F.col("min_t").alias("_t"), F.lit(0).alias("_kind"), F.col("max_t").alias("_end"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    told = before(rows.unionByName(ranges), "_e", "_t", ["_kind"], {"_upto": (F.max, F.col("_end"))})
    kept = told.where((F.col("_kind") == 1) & (F.col("_upto").isNull() | (F.col("_upto") < F.col("_t")))).select("_row.*")
    return kept.unionByName(samples.where(~there))


def delete(store: Store, matchers: Sequence[Matcher], mint: int, maxt: int) -> DataFrame:
    """Tombstones (series_id, min_t, max_t) that delete [mint, maxt] from the matching series, clipped to each series' own samples; series without any there get none."""
    own = store.select(matchers).groupBy("series_id").agg(F.min("ts_ms").alias("_a"), F.max("ts_ms").alias("_b"))
    return own.select("series_id", F.greatest(F.lit(mint).cast("long"), "_a").alias("min_t"), F.least(F.lit(maxt).cast("long"), "_b").alias("max_t")).where("min_t <= max_t")


def clean(samples: DataFrame, tombstones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples rewritten without what is deleted, and the tombstones that remain: none."""
    return apply(samples, tombstones), tombstones.where(F.lit(False))


def count(tombstones: DataFrame) -> DataFrame:
    """Number of intervals of each series after union."""
    return union(tombstones).groupBy("series_id").agg(F.count("*").alias("n"))


def surviving(tombstones: DataFrame, mint: int) -> DataFrame:
    """Tombstones that still matter after everything before `mint` is gone."""
    return tombstones.where(F.col("max_t") >= mint)

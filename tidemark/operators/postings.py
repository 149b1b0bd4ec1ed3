"""Set algebra on lists of series ids (one column, `series_id`)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def union(lists: Sequence[DataFrame]) -> DataFrame:
    """Ids in any of the lists, once each."""
    return reduce(lambda a, b: a.union(b), lists).distinct()


def intersect(lists: Sequence[DataFrame]) -> DataFrame:
    """Ids in all of the lists, once each; of no list nothing can be told, so that is an error."""
    if not lists:
        raise ValueError("no list")
    return reduce(lambda a, b: a.intersect(b), [x.select("series_id") for x in lists]).distinct()


def subtract(full: DataFrame, drop: DataFrame) -> DataFrame:
    """Ids of `full` that aren't in `drop`, once each. Null ids never equal each other and are dropped."""
    return full.where("series_id is not null").distinct().join(drop, "series_id", "left_anti")


def seek(ids: DataFrame, least: int) -> DataFrame:
    """The smallest id at or above `least`; no row if there is none."""
    return ids.where(F.col("series_id") >= least).agg(F.min("series_id").alias("series_id")).where("series_id is not null")


def consecutive(spark: SparkSession, start: int, end: int) -> DataFrame:
    """The ids start .. end - 1."""
    return spark.range(start, end).withColumnRenamed("id", "series_id")


def add(index: DataFrame, entries: DataFrame) -> DataFrame:
    """An index (name, value, series_id) with more entries; repeats change nothing."""
    return index.unionByName(entries).distinct()


def delete(index: DataFrame, entries: DataFrame) -> DataFrame:
    """An index without the entries (name, value, series_id); absent ones change nothing."""
    return index.join(entries, ["name", "value", "series_id"], "left_anti")

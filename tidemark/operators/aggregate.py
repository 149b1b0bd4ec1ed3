"""Aggregates of samples over time and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import exact_sum
from tidemark.operators.joins import join_checked
from tidemark.operators.labels import key_by, key_string, key_without, label
from tidemark.operators.readings import floor_to

MINUTE_MS, HOUR_MS = 60_000, 3_600_000


def labelled(samples: DataFrame, series: DataFrame, names: Sequence[str]) -> DataFrame:
    """Samples with some labels as columns (a name's own, `__name__` as `metric`); missing labels are ''."""
    cols = [label(F.col("labels"), n).alias("metric" if n == "__name__" else n) for n in names]
    return join_checked(samples, series.select("series_id", *cols), ["series_id"])


def bucketed(samples: DataFrame, width: int, keys: Sequence[str], agg: Column, name: str) -> DataFrame:
    """One aggregate for each combination of `keys` and time bucket of `width` ms (`bucket_ms`, its start; negative times round down)."""
    return samples.groupBy(*keys, floor_to(F.col("ts_ms"), width).alias("bucket_ms")).agg(agg.alias(name))


def max_by_bucket(samples: DataFrame, width: int, keys: Sequence[str]) -> DataFrame:
    """Greatest value of each bucket; NaN counts as greater than any number."""
    return bucketed(samples, width, keys, F.max("value"), "max_value")


def mean_by_bucket(samples: DataFrame, width: int, keys: Sequence[str]) -> DataFrame:
    """Mean of the finite values of each bucket, from exact sums; null where there is none."""
    v = F.col("value")
    return bucketed(samples, width, keys, F.try_divide(exact_sum(v), F.count(F.when(~F.isnan(v) & ~v.isin(float("inf"), float("-inf")), v))), "mean_value")


def last_point(samples: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """The latest sample of each group: (keys..., ts_ms, value). Of several at that time the greatest value."""
    top = samples.groupBy(*keys, "ts_ms").agg(F.max("value").alias("value"))
    return top.groupBy(*keys).agg(F.max("ts_ms").alias("ts_ms"), F.max_by("value", "ts_ms").alias("value"))


def above(samples: DataFrame, limit: float) -> DataFrame:
    """Samples with a finite value above `limit`."""
    return samples.where((F.col("value") > limit) & ~F.isnan("value") & (F.col("value") != float("inf")))


def by_labels(samples: DataFrame, series: DataFrame, names: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Aggregates of samples grouped by some labels: (key as `{a=1}`, ...)."""
    rows = join_checked(samples, series.select("series_id", key_string(key_by(F.col("labels"), names)).alias("key")), ["series_id"])
    return rows.groupBy("key").agg(*aggs)


def without_labels(samples: DataFrame, series: DataFrame, names: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Aggregates of samples grouped by all labels but some and the metric's name."""
    rows = join_checked(samples, series.select("series_id", key_string(key_without(F.col("labels"), names)).alias("key")), ["series_id"])
    return rows.groupBy("key").agg(*aggs)


def pivot_metrics(buckets: DataFrame, metrics: Sequence[str], keys: Sequence[str], value: str) -> DataFrame:
    """Buckets of several metrics side by side: one column a metric."""
    return buckets.groupBy(*keys).agg(*(F.max(F.when(F.col("metric") == m, F.col(value))).alias(m) for m in metrics))


def coldest(samples: DataFrame, share: float = 0.1) -> DataFrame:
    """(series_id, last_ms): the series that were written to least recently, `share` of all, rounded down; ties by id. Series without a time come first."""
    last = samples.where("series_id is not null").groupBy("series_id").agg(F.max("ts_ms").alias("last_ms"))
    return last.orderBy("last_ms", "series_id").limit(int(last.count() * share))

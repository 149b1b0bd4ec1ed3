"""Totals over trailing periods by binary doubling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.numbers import LIMBS, limbs, summed
from tidemark.operators.readings import DAY_MS, latest

_SUM = (*LIMBS, "big")
_PARTS = (*_SUM, "n", "x")  # parts of the finite sum, finite count, count of NaN and infinities


def daily_totals(readings: DataFrame, entity: str, time_ms: str, value: str) -> DataFrame:
    """(entity, day, hi, lo, mid, low, big, n, x): partial results for each entity and UTC day, the sums in exact parts (`limbs`); they add up, so they can be kept and combined."""
    v = F.col(value)
    bad = F.isnan(v) | v.isin(float("inf"), float("-inf"))
    return readings.groupBy(F.col(entity), F.floor(F.col(time_ms) / DAY_MS).cast("long").alias("day")).agg(
        *(F.sum(p).alias(k) for k, p in limbs(v).items()), F.count(F.when(~bad, 1)).alias("n"), F.count(F.when(bad, 1)).alias("x")
    )


def trailing(daily: DataFrame, entity: str, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Totals over the trailing `windows` (days, each at least 1), for every day from an entity's first to its last.

    Block sums of 1, 2, 4, ... days are made by adding a block to the block before it; a window of any length
    is put together from the blocks of its binary digits. Sums are exact until the last step and only ever added, never subtracted, so they don't depend on the order of the rows, and a
    huge value leaves no rounding error once it is out of the window. Days without activity are made from each active day up to the next one. All steps use one partitioning and sort.

    Columns: entity, day (days since 1970-01-01), and for each window N `sum_N`, `mean_N` (null without a finite
    reading), `count_N`, `nonfinite_N`. Empty input gives no rows.
    """
    if not windows or min(windows) < 1:
        raise ValueError("windows must be days of at least 1")
    w = W.partitionBy(entity).orderBy("day")
    made = daily.withColumn("_upto", F.coalesce(F.lead("day").over(w) - 1, F.col("day"))).withColumn("_d", F.explode(F.sequence("day", "_upto")))
    grid = made.select(entity, F.col("_d").alias("day"), *(F.when(F.col("_d") == F.col("day"), F.col(p)).otherwise(0).alias(p) for p in _PARTS))

    def shifted(name: str, k: int) -> Column:
        return F.coalesce(F.lag(name, k).over(w), F.lit(0)) if k else F.col(name)

    top = max(windows).bit_length() - 1
    for p in _PARTS:
        grid = grid.withColumnRenamed(p, f"{p}0")
    for k in range(1, top + 1):
        grid = grid.withColumns({f"{p}{k}": F.col(f"{p}{k - 1}") + shifted(f"{p}{k - 1}", 1 << (k - 1)) for p in _PARTS})
    out: dict[str, Column] = {}
    for n in windows:
        terms, at = [], 0
        for k in range(n.bit_length() - 1, -1, -1):
            if n >> k & 1:
                terms.append((k, at))
                at += 1 << k
        for p in _PARTS:
            total = shifted(f"{p}{terms[0][0]}", 0)
            for k, at in terms[1:]:
                total = total + shifted(f"{p}{k}", at)
            out[f"_{p}_{n}"] = total
    grid = grid.withColumns(out)
    cols = [F.col(entity), F.col("day")]
    for n in windows:
        total = summed({k: F.col(f"_{k}_{n}") for k in _SUM})
        cols += [total.alias(f"sum_{n}"), F.try_divide(total, F.col(f"_n_{n}")).alias(f"mean_{n}"), F.col(f"_n_{n}").alias(f"count_{n}"), F.col(f"_x_{n}").alias(f"nonfinite_{n}")]
    return grid.select(*cols)


def rolling_totals(df: DataFrame, entity: str = "series_id", time_ms: str = "ts_ms", value: str = "value", seq: str = "seq", windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Trailing sums and means of the readings in arrived inserts `df` (see `latest` for nulls, repeats and corrections).

    NaN and infinities can't be summed usefully; they are left out of sums and means and counted in `nonfinite_N`.
    """
    return trailing(daily_totals(latest(df, entity, time_ms, value, seq), entity, time_ms, value), entity, windows)

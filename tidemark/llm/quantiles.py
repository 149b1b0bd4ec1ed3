"""Exact percentiles of very large numeric columns, from mergeable partial counts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.joins import join_checked
from tidemark.session import ship, written


def partial_counts(df: DataFrame, group: Sequence[str], value: str, *keep: str) -> DataFrame:
    """(group..., keep..., value, n): how often each value stands in each group, for each `keep` (such as a day).

    Such tables of days or partitions are combined with `union` and need nothing else; counts of equal values add up.
    Null and NaN have no rank and are left out; -0.0 counts as 0.0; infinities are the least and greatest values. Null groups are groups.
    """
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).select(*group, *keep, (v + F.lit(0.0)).alias(value)).groupBy(*group, *keep, value).agg(F.count("*").alias("n"))


def _running(width: int):  # noqa: ANN202
    """Adds `upto`, the running total of n within equal group columns (the first `width`), to batches in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list | None = None
        total = 0
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            new = np.zeros(len(n), bool)
            for c in b.columns[:width]:
                x, y = c[1:], c[:-1]
                new[1:] |= pc.or_(pc.fill_null(pc.not_equal(x, y), False), pc.xor(pc.is_null(x), pc.is_null(y))).to_numpy(zero_copy_only=False)
            first = [c[0].as_py() for c in b.columns[:width]]
            if first != last:
                total = 0
            cum = np.cumsum(n) + total
            starts = np.flatnonzero(new)
            base = np.zeros(len(n), np.int64)
            if len(starts):
                which = np.cumsum(new)
                base = np.concatenate(([0], cum[starts - 1]))[which]
            upto = cum - base
            total, last = int(upto[-1]), [c[-1].as_py() for c in b.columns[:width]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto)], [*b.schema.names, "upto"])

    return run


def percentiles(counts: DataFrame, group: Sequence[str], value: str, probs: Sequence[float], n: str = "n") -> DataFrame:
    """(group..., p, value, count): for each group and p of `probs` (0 to 1) the exact percentile, without error.

    `counts` are partial counts, of one or many days. The percentile p of k values is at rank p (k - 1) of their order; between two
    ranks it is interpolated: a + (b - a) x fraction (equal neighbours, infinities too, give themselves; between an infinity and another value: the infinity). Groups without values have no row; empty input gives none.

    The values are sorted over the cluster by (group, value), so that a group of any size is spread over as many partitions as its share of the rows;
    each partition counts its groups, the counts before it are a group's offset, and only the rows at the wanted ranks are kept.
    """
    if not probs or min(probs) < 0 or max(probs) > 1:
        raise ValueError("probs must lie in 0..1")
    spark = counts.sparkSession
    ship(spark)
    group = list(group)
    names = [f"_g{i}" for i in range(len(group))]
    base = counts.select(*(F.col(g).alias(k) for g, k in zip(group, names, strict=True)), F.col(value).cast("double").alias("_v"), F.col(n).cast("long").alias("_n")).where("_n > 0 and _v is not null")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A range partitioning by (group, value) also serves the grouping by both: equal values meet without another shuffle.
    ranged = base.repartitionByRange(parts, *names, "_v").groupBy(*names, "_v").agg(F.sum("_n").alias("_n"))
    ordered = ranged.sortWithinPartitions(*names, "_v")
    kinds = ", ".join(f"{k} {t}" for k, t in ordered.dtypes)
    table = written(ordered.mapInArrow(_running(len(group)), f"{kinds}, upto long").withColumn("_part", F.spark_partition_id()), "sorted")
    per = table.groupBy(*names, "_part").agg(F.max("upto").alias("_k"))
    by = W.partitionBy(*names)
    per = per.select(*(F.col(k).alias(f"{k}x") for k in names), F.col("_part").alias("_px"), F.coalesce(F.sum("_k").over(by.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"), F.sum("_k").over(by).alias("_all"))
    # Null groups meet as equals: a hash join needs plain keys, so nulls get a key of their own.
    keys = [*(c for k in names for c in (f"{k}_a", f"{k}_b")), "_part"]

    def keyed(df: DataFrame, suffix: str, part: str) -> DataFrame:
        plain = {"string": "", "double": 0.0}
        cols = {}
        for k in names:
            kind = dict(df.dtypes)[f"{k}{suffix}"]
            cols[f"{k}_a"] = F.col(f"{k}{suffix}").isNull()
            cols[f"{k}_b"] = F.coalesce(F.col(f"{k}{suffix}"), F.lit(plain.get(kind, 0)).cast(kind))
        return df.withColumns(cols).withColumn("_part", F.col(part))

    both = join_checked(keyed(table, "", "_part"), keyed(per, "x", "_px").drop("_px", *(f"{k}x" for k in names)), keys)
    ranks = [(p, F.floor(F.lit(p) * (F.col("_all") - 1)).cast("long"), F.ceil(F.lit(p) * (F.col("_all") - 1)).cast("long")) for p in probs]
    start, end = F.col("_off") + F.col("upto") - F.col("_n"), F.col("_off") + F.col("upto")

    def inside(r):  # noqa: ANN001, ANN202
        return (start <= r) & (r < end)

    wanted = F.lit(False)
    for _, lo, hi in ranks:
        wanted = wanted | inside(lo) | inside(hi)
    hits = both.where(wanted)
    aggs = [F.max("_all").alias("_all")]
    for i, (_, lo, hi) in enumerate(ranks):
        aggs += [F.max(F.when(inside(lo), F.col("_v"))).alias(f"_lo{i}"), F.max(F.when(inside(hi), F.col("_v"))).alias(f"_hi{i}")]
    found = hits.groupBy(*names).agg(*aggs)
    rows = []
    for i, p in enumerate(probs):
        a, b = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        h = F.lit(p) * (F.col("_all") - 1)
        endless = F.when(a == float("-inf"), a).when(b == float("inf"), b)
        rows.append(F.struct(F.lit(float(p)).alias("p"), F.when(a == b, a).otherwise(F.coalesce(endless, a + (b - a) * (h - F.floor(h)))).alias(value)))
    return found.select(*(F.col(k).alias(g) for g, k in zip(group, names, strict=True)), F.inline(F.array(*rows)), F.col("_all").alias("count")).select(*group, "p", value, "count")

"""Continuous periods and gaps of half-open time ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.readings import DAY_MS
from tidemark.session import written

#: The longest duration that goes into one session; a longer range is cut into pieces that touch.
_LONG = 900_000_000_000_000_000


def _sessions(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, _a, _b, _prev): one row for each run of ranges [_a, _b) of the same `keys` that overlap, nest or touch, with the greatest _b and _prev of the run."""
    cuts = F.expr(f"""CASE WHEN coalesce(try_subtract(_b, _a) <= {_LONG}, false) THEN array(named_struct('a', _a, 'b', _b))
        ELSE transform(sequence(0L, cast(floor((cast(_b AS decimal(20, 0)) - _a - 1) / {_LONG}) AS bigint)), i -> named_struct('a', cast(cast(_a AS decimal(21, 0)) + i * cast({_LONG} AS decimal(21, 0)) AS bigint),
          'b', cast(least(cast(_b AS decimal(21, 0)), cast(_a AS decimal(21, 0)) + (i + 1) * cast({_LONG} AS decimal(21, 0))) AS bigint))) END""")
    df = df.select(*keys, "_prev", F.inline(cuts).alias("_a", "_b"))
    # Milliseconds stand for microseconds here, so that every BIGINT is a valid time.
    window = F.session_window(F.timestamp_micros("_a"), F.expr("make_interval(0, 0, 0, 0, 0, 0, cast((_b - _a) / 1000000BD AS decimal(18, 6)))"))
    runs = df.groupBy(*keys, window).agg(F.max("_b").alias("_end"), F.max("_prev").alias("_prev"))
    return runs.select(*keys, F.unix_micros("session_window.start").alias("_a"), F.col("_end").alias("_b"), "_prev")


def merge_ranges(df: DataFrame, entity: str = "store_dir", lo: str = "min_t", hi: str = "max_t", chunk: int = DAY_MS) -> DataFrame:
    """(entity, kind, from_t, to_t): continuous periods ("period") of the ranges [lo, hi), and the gaps between neighbouring periods ("gap").

    Ranges that overlap, nest or touch belong to one period. Rows with a null bound or without positive length
    are ignored; a null entity is an entity like any other. Repeated rows change nothing. Empty input gives no rows. Bounds may be any BIGINT.

    `session_window` with each row's own duration merges the ranges that start in the same `chunk` of time of an entity, so a
    very large entity is spread over its chunks. The latest end of all earlier chunks comes in as the end of a chunk's first range. A run that neither
    continues an earlier chunk nor is the last of its own is a period; the others, at most two a chunk, are merged by sessions of the entity.
    """
    rows = df.select(F.col(entity).alias("_e"), F.col(lo).cast("long").alias("_a"), F.col(hi).cast("long").alias("_b")).where("_a < _b")
    rows = rows.groupBy("_e", "_a").agg(F.max("_b").alias("_b"))
    rows = written(rows.withColumn("_k", F.floor(F.col("_a") / chunk).cast("long")), "ranges")
    per = rows.groupBy("_e", "_k").agg(F.min("_a").alias("_a"), F.min_by("_b", "_a").alias("_b"), F.max("_b").alias("_top"))
    so_far = W.partitionBy("_e").orderBy("_k").rowsBetween(W.unboundedPreceding, -1)
    carried = per.withColumn("_prev", F.max("_top").over(so_far)).where("_prev is not null").select("_e", "_k", "_a", F.greatest("_b", "_prev").alias("_b"), "_prev")
    runs = _sessions(rows.select("_e", "_k", "_a", "_b", F.lit(None).cast("long").alias("_prev")).unionByName(carried), "_e", "_k")
    # _prev: where the run before ends, or the latest end of all earlier chunks.
    here = W.partitionBy("_e", "_k").orderBy("_a")
    runs = written(runs.select("_e", "_a", "_b", F.coalesce(F.lag("_b").over(here), "_prev").alias("_prev"), F.lead("_a").over(here).isNull().alias("_last")), "runs")
    # A null _prev, which `<` and `>=` leave out, stands at an entity's first run.
    edges = _sessions(runs.where("_last or _prev >= _a"), "_e").select("_e", "_a", "_b")
    periods = runs.where("not _last and (_prev is null or _prev < _a)").select("_e", "_a", "_b").unionByName(edges)
    gaps = runs.where("_prev < _a").select("_e", "_prev", "_a")
    out = [d.toDF(entity, "from_t", "to_t").select(entity, F.lit(kind).alias("kind"), "from_t", "to_t") for d, kind in ((periods, "period"), (gaps, "gap"))]
    return out[0].unionByName(out[1])

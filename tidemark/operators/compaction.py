"""Block metadata: overlaps, compaction plans, merged metadata, merged data, retention and checkpoints.

Ranges of blocks are half-open, [min_t, max_t). Rows without a positive length (also the unset bounds of a new block) or with a null bound are no blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import join_checked
from tidemark.operators.prefix import before
from tidemark.operators.readings import floor_to
from tidemark.operators.select import merge_stores
from tidemark.operators.tombstones import apply, surviving
from tidemark.session import written

_KEY = ("min_t", "max_t", "ulid")


def valid(blocks: DataFrame) -> DataFrame:
    """Blocks with a range, each listed once: of rows with the same store, id and range the first in the order of their other columns."""
    keys = ["store_dir", "ulid", "min_t", "max_t"]
    rest = [c for c in blocks.columns if c not in keys]
    rows = blocks.where("min_t < max_t")
    if not rest:
        return rows.distinct()
    return rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_rest")).select(*keys, "_rest.*").select(*blocks.columns)


def sorted_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks in order of time."""
    return blocks.orderBy("store_dir", *_KEY)


def overlap_groups(blocks: DataFrame) -> DataFrame:
    """Blocks that overlap another, with the number of their group (`island`, from 0 for each store, in order of time).

    A store is cut into days of starts (`before`), so that a very large one is no single task. Groups chain: a block belongs to the group if it starts before the latest end so far. Blocks that touch don't overlap.
    """
    rows = before(valid(blocks), "store_dir", "min_t", ["max_t", "ulid"], {"_seen": (F.max, F.col("max_t"))})
    new = F.when(F.col("_seen").isNull() | (F.col("min_t") >= F.col("_seen")), 1).otherwise(0)
    rows = before(written(rows.withColumn("_new", new), "marked"), "store_dir", "min_t", ["max_t", "ulid"], {"_i": (F.sum, F.col("_new"))})
    rows = written(rows.withColumn("_i", F.coalesce("_i", F.lit(0)) + F.col("_new")), "islands")
    groups = rows.groupBy("store_dir", "_i").agg(F.count("*").alias("_n"), F.min("min_t").alias("_a")).where("_n > 1")
    numbered = before(groups, "store_dir", "_a", ["_i"], {"island": (F.sum, F.lit(1))})
    numbered = numbered.select(F.col("store_dir").alias("_s2"), F.col("_i").alias("_i2"), F.coalesce("island", F.lit(0)).alias("island"))
    return rows.join(numbered, F.col("store_dir").eqNullSafe(F.col("_s2")) & (F.col("_i") == F.col("_i2"))).select(*blocks.columns, "island")


def first_overlap(blocks: DataFrame) -> DataFrame:
    """Of each store the blocks of its first overlapping group: what is compacted first."""
    return overlap_groups(blocks).where("island = 0")


def split_by_range(blocks: DataFrame, width: int) -> DataFrame:
    """Blocks with the start of the aligned range of `width` ms that holds them whole (`range_start`); blocks that cross a boundary belong to none."""
    rows = valid(blocks).withColumn("range_start", floor_to(F.col("min_t"), width))
    return rows.where(F.col("max_t") <= F.col("range_start") + width)


def plan(blocks: DataFrame, ranges: list[int], deleted_share: float = 0.05) -> DataFrame:
    """(store_dir, ulid, reason): the blocks of each store that its next compaction takes, by the first reason that applies.

    "overlap": its first group of overlapping blocks. Else the newest block is left alone, as it may still be added to, and of the rest: "range": for the
    smallest of `ranges` but the least (new blocks have that), the earliest aligned range with more than one block, none of which failed, that they span
    from end to end or that ends no later than the newest of the rest begins. "tombstones": going back from the newest of the rest as long as blocks are at least as long as the middle
    one of `ranges`, the first block with more deletions than `deleted_share` of its series. A store without reason has no row; nor have blocks without a store.
    """
    widths = sorted(ranges)
    rows = written(valid(blocks).where("store_dir is not null"), "valid")
    overlap = first_overlap(rows).select("store_dir", "ulid", F.lit(0).alias("_r"), F.lit("overlap").alias("reason"))
    # The newest start of each store, and the newest of the rest: two numbers a store, from partial aggregates.
    top = rows.groupBy("store_dir").agg(F.max("min_t").alias("_newest"))
    old = join_checked(rows, top, ["store_dir"]).where("min_t < _newest")
    old = written(join_checked(old, old.groupBy("store_dir").agg(F.max("min_t").alias("_high")), ["store_dir"]), "old")
    found = overlap
    for i, width in enumerate(widths[1:], 1):
        held = old.withColumn("_start", floor_to(F.col("min_t"), width)).where(F.col("max_t") <= F.col("_start") + width)
        group = held.groupBy("store_dir", "_start").agg(F.count("*").alias("_n"), F.max(F.coalesce(F.col("failed"), F.lit(False)).cast("int")).alias("_f"), F.min("min_t").alias("_a"), F.max("max_t").alias("_b"), F.min("_high").alias("_high"))
        fit = group.where("_n > 1 and _f = 0").where((F.col("_b") - F.col("_a") == width) | (F.col("_b") <= F.col("_high")))
        one = fit.groupBy("store_dir").agg(F.min("_start").alias("_start"))
        found = found.unionByName(held.join(one, ["store_dir", "_start"]).select("store_dir", "ulid", F.lit(i).alias("_r"), F.lit("range").alias("reason")))
    length = F.col("max_t") - F.col("min_t")
    cut = before(old, "store_dir", "min_t", ["max_t", "ulid"], {"_s": (F.min, length)}, backward=True).withColumn("_s", F.least("_s", length))
    cut = cut.where((F.col("_s") >= widths[len(widths) // 2]) & (F.col("num_tombstones") > F.lit(deleted_share) * F.col("num_series")))
    cut = cut.groupBy("store_dir").agg(F.max(F.struct("min_t", "max_t", "ulid")).alias("_b")).select("store_dir", F.col("_b.ulid").alias("ulid"), F.lit(len(widths)).alias("_r"), F.lit("tombstones").alias("reason"))
    found = written(found.unionByName(cut), "found")
    best = join_checked(found, found.groupBy("store_dir").agg(F.min("_r").alias("_r")), ["store_dir", "_r"], "left_semi")
    return best.select("store_dir", "ulid", "reason").distinct()


def merged_meta(blocks: DataFrame, keys: tuple[str, ...] = ("store_dir",)) -> DataFrame:
    """(keys..., min_t, max_t, level, sources, parents, num_series, num_tombstones): the metadata of what each group of blocks compacts to.

    The level is one above the highest; sources are the distinct ids of all, in order; parents are the blocks themselves, in order of time.
    `num_series` and `num_tombstones` are sums over the parents: upper bounds until the block is written.
    """
    rows = valid(blocks)
    parent = F.struct("min_t", "max_t", "ulid")
    ids = rows.select(*keys, F.explode_outer("sources").alias("_s")).groupBy(*keys).agg(F.array_sort(F.collect_set("_s")).alias("sources"))
    out = rows.groupBy(*keys).agg(F.min("min_t").alias("min_t"), F.max("max_t").alias("max_t"), (F.max("level") + 1).alias("level"), F.array_sort(F.collect_list(parent)).alias("parents"), F.sum("num_series").alias("num_series"), F.sum("num_tombstones").alias("num_tombstones"))
    return out.join(ids, list(keys)).select(*keys, "min_t", "max_t", "level", "sources", "parents", "num_series", "num_tombstones")


def overlapping(blocks: DataFrame, mint: int, maxt: int) -> DataFrame:
    """Blocks that share a time with the closed range [mint, maxt]."""
    return valid(blocks).where((F.col("min_t") <= maxt) & (F.col("max_t") > mint))


def populate(sources: list[DataFrame], tombstones: DataFrame | None = None) -> DataFrame:
    """Samples of the blocks to compact, oldest first, as one: at equal times the last block wins, deleted ranges are dropped; sorted for writing by series and time within tasks."""
    rows = merge_stores(sources)
    rows = apply(rows, tombstones) if tombstones is not None else rows
    return rows.repartition("series_id", floor_to(F.col("ts_ms"), 86_400_000)).sortWithinPartitions("series_id", "ts_ms")


def stats(samples: DataFrame, width: int, chunk: int = 120) -> DataFrame:
    """(part, num_samples, num_series, num_chunks, min_t, max_t) of the readings of each time partition of `width` ms."""
    per = samples.groupBy(floor_to(F.col("ts_ms"), width).alias("part"), "series_id").agg(F.count("*").alias("n"), F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b"))
    return per.groupBy("part").agg(F.sum("n").alias("num_samples"), F.count("*").alias("num_series"), F.sum(F.ceil(F.col("n") / chunk)).cast("long").alias("num_chunks"), F.min("a").alias("min_t"), F.max("b").alias("max_t"))


def retained(samples: DataFrame, keep_ms: int, now: Column | int) -> DataFrame:
    """Samples not older than `keep_ms` before `now`."""
    n = F.lit(now) if isinstance(now, int) else now
    return samples.where(F.col("ts_ms") >= n - keep_ms)


def checkpoint(series: DataFrame, samples: DataFrame, tombstones: DataFrame, keep: DataFrame, mint: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a log keeps: series in `keep`, their samples from `mint` on, and tombstones that reach `mint`."""
    return series.join(keep, "series_id", "left_semi"), samples.where(F.col("ts_ms") >= mint).join(keep, "series_id", "left_semi"), surviving(tombstones, mint)


def unflushed(samples: DataFrame, marks: DataFrame) -> DataFrame:
    """What a log still has to keep: samples with a `seq` above their series' mark (series_id, flushed_seq), the highest number whose samples lie in blocks.

    Series without a mark keep everything; a null `seq` is older than any mark. Replaying these after a restart brings nothing twice.
    """
    top = marks.where("series_id is not null").groupBy("series_id").agg(F.max("flushed_seq").alias("_mark"))
    rows = join_checked(samples.where("series_id is not null"), top, ["series_id"], "left")
    return rows.where(F.col("_mark").isNull() | (F.col("seq") > F.col("_mark"))).drop("_mark")

"""Filling containers of fixed capacity: a configuration linear program over the length histogram."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.joins import join_checked
from tidemark.session import ship

#: Most rounds of multiplicative weights, each of which prices one configuration; their step; and the relative gap between containers and lower bound at which they end.
ROUNDS, STEP, GAP = 256, 0.4, 0.001
#: Parts of the containers that the program's configurations may fill; the rest is filled up from what they leave.
PARTS = (1.0, 0.9, 0.7, 0.5, 0.3)
#: Steps of the grid on which configurations are priced: at most so many different sizes, and units of a capacity. Items are placed by their exact sizes.
GRID = 512


def price(profit: np.ndarray, size: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """How many of each size fill one container for the greatest profit, and that profit: a knapsack by dynamic programming over the capacity.

    Memory is two numbers for each unit of the capacity, time at most units x sizes."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(size)
    size, profit = size[order], profit[order]
    fits = np.searchsorted(size, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room], took[room] = best[room - 1], -1
        if n := fits[room]:
            gain = best[room - size[:n]] + profit[:n]
            i = int(gain.argmax())
            if gain[i] > best[room]:
                best[room], took[room] = gain[i], i
    chosen, room = np.zeros(len(size), np.int64), capacity
    while room > 0:
        if took[room] >= 0:
            chosen[took[room]] += 1
            room -= int(size[took[room]])
        else:
            room -= 1
    out = np.empty_like(chosen)
    out[order] = chosen
    return out, float(best[capacity])


def on_grid(size: np.ndarray, count: np.ndarray, capacity: int, grid: int = GRID) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sizes in units of a grid and classes of neighbouring sizes: (class of each size, least and greatest size of each class in units, units of a capacity).

    At most `grid` classes, and 8 x `grid` units of a capacity; up to these every size is a class of its own and every token a unit. Sizes ascend. The least size of a class is rounded down, for
    bounds, the greatest up, for configurations that fit."""
    unit = max(1, -(-capacity // (8 * grid)))
    width = -(-capacity // grid) if len(size) > grid else 1
    _, group = np.unique((size - 1) // width, return_inverse=True)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    last = np.append(first[1:], len(size)) - 1
    return group, np.maximum(size[first] // unit, 1), -(-size[last] // unit), capacity // unit


def program(size: np.ndarray, count: np.ndarray, capacity: int, rounds: int = ROUNDS) -> Iterator[tuple[list[np.ndarray], float]]:
    """The configuration linear program by multiplicative weights: after 8, 16, 32, ... `rounds` rounds (configurations, each used equally often, as numbers of each class of
    sizes; lower bound on the containers).

    Each round prices the classes by their weights and takes the configuration of the greatest value (`price`). Weights of classes that the configurations so far
    cover too little grow by a factor, those of classes covered too much shrink. Weights divided by the value of the best configuration are a feasible dual solution, so
    the sum of the items' weights so divided bounds the containers from below; so do the total size, and the items of more than half a container.
    """
    group, least, most, units = on_grid(size, count, capacity)
    unit = max(1, -(-capacity // (8 * GRID)))
    demand = np.bincount(group, weights=count)
    bound = max(float(size @ count) / capacity, float(count[2 * size > capacity].sum()), 1.0)
    exact = unit == 1 and np.array_equal(least, most)
    weight, covered, out = most / units, np.zeros(len(demand)), []
    for t in range(1, rounds + 1):
        taken, value = price(weight, most, units)
        # Sizes rounded up fit less: the bound is taken with sizes rounded down, in a capacity rounded up.
        dual = value if exact else price(weight, least, capacity // unit + 1)[1] if t & (t - 1) == 0 else np.inf
        bound = max(bound, float(weight @ demand) / dual)
        out.append(np.minimum(taken, demand.astype(np.int64)))
        covered += out[-1]
        if t >= 8 and t & (t - 1) == 0 or t == rounds:
            yield out, bound
        share = demand / bound
        weight = (most / units) * np.exp(STEP * np.clip((t * share - covered) / np.maximum(share, 1.0), -6, 6))


def plan(size: np.ndarray, count: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[np.ndarray, np.ndarray, int]], float]:
    """Whole containers for all items: ((sizes, how many of each, containers filled so)..., lower bound on the containers), rounded from the linear program.

    Each configuration is used for its share of the containers, or of some part of them (PARTS, the best counts), the largest remaining size of a class first. What is left of a container's room is filled up
    with the largest remaining size that fits; so are the containers beyond the shares. It ends when the containers are within GAP of the bound, or are the next
    whole number, or after `rounds` rounds. The result has at most some entries for each size and round, whatever the number of items.
    """
    if not len(size):
        return [], 0.0
    order = np.argsort(size)
    size, count = size[order].astype(np.int64), count[order].astype(np.int64)
    group = on_grid(size, count, capacity)[0]
    best, fewest = [], 1 << 62
    for chosen, bound in program(size, count, capacity, rounds):
        least = int(np.ceil(bound - 1e-9))
        for part in PARTS:
            whole, n = int(np.ceil(part * least)), len(chosen)
            filled = _fill([(c, (t + 1) * whole // n - t * whole // n) for t, c in enumerate(chosen)], group, size, count, capacity)
            used = sum(k for _, _, k in filled)
            if used < fewest:
                best, fewest = filled, used
            if fewest <= max(least, bound * (1 + GAP)):
                return best, bound
    return best, bound


def _fill(shares: list[tuple[np.ndarray, int]], group: np.ndarray, size: np.ndarray, count: np.ndarray, capacity: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """The containers of each configuration, filled up, then those of what is left; sizes ascend."""
    left = count.copy()
    out: list[tuple[np.ndarray, np.ndarray, int]] = []
    ends = np.searchsorted(group, np.arange(group[-1] + 1), side="right")
    for start, copies in [*shares, (None, 1 << 62)]:
        while copies > 0 and left.any():
            take, room = np.zeros_like(left), capacity
            for g in np.flatnonzero(start) if start is not None else ():
                want, i = int(start[g]), ends[g] - 1
                while want and i >= 0 and group[i] == g:
                    c = min(want, int(left[i]), room // int(size[i]))
                    take[i] += c
                    room, want, i = room - c * int(size[i]), want - c, i - 1
            i = len(size)
            while room > 0:
                i = int(np.searchsorted(size[:i], room, side="right"))
                fits = np.flatnonzero(left[:i] > take[:i])
                if not len(fits):
                    break
                i = int(fits[-1])
                c = min(room // int(size[i]), int(left[i] - take[i]))
                take[i] += c
                room -= c * int(size[i])
            used = np.flatnonzero(take)[::-1]
            n = int(min(copies, (left[used] // take[used]).min()))
            left -= take * n
            copies -= n
            out.append((size[used], take[used], n))
    return out


def _histogram(rows: DataFrame, size: str) -> tuple[np.ndarray, np.ndarray]:
    """Sizes below the capacity and how many items have them: at most capacity - 1 numbers."""
    hist = rows.where(F.col(size) > 0).groupBy(size).count().collect()
    return np.array([r[0] for r in hist], np.int64), np.array([r[1] for r in hist], np.int64)


def bound(df: DataFrame, capacity: int, tokens: str = "tokens", rounds: int = ROUNDS) -> DataFrame:
    """One row (capacity, items, tokens, lower_bound, containers, unused_share): how many containers `pack` fills, and the least number that any packing of
    the same pieces needs, by a dual solution of the linear program. Null and negative sizes count as 0. Empty input needs no containers."""
    t = F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0))
    rows = df.select(t.alias("_t")).withColumns({"_full": F.floor(F.col("_t") / capacity).cast("long"), "_rest": F.pmod("_t", F.lit(capacity))})
    total = rows.agg(F.count("*"), F.coalesce(F.sum("_t"), F.lit(0)), F.coalesce(F.sum("_full"), F.lit(0))).first()
    chosen, least = plan(*_histogram(rows, "_rest"), capacity, rounds)
    n = sum(k for _, _, k in chosen) + total[2]
    unused = 1 - total[1] / (n * capacity) if n else None
    return df.sparkSession.createDataFrame([(capacity, total[0], total[1], float(least + total[2]), n, unused)], "capacity long, items long, tokens long, lower_bound double, containers long, unused_share double")


def pack(df: DataFrame, capacity: int, ident: str = "doc_id", tokens: str = "tokens", rounds: int = ROUNDS) -> DataFrame:
    """(ident, piece, pieces, start, tokens, container): every item in containers of `capacity` tokens with little unused space.

    An item larger than the capacity, and no other, is split: into full pieces, each a container of its own, and a rest that shares one. `start` is the
    first token of the piece. Containers are numbered from 0 without gaps. Null sizes count as 0; items of size 0 take no space and lie in
    container 0 with one piece. Rows with equal or null ids are items of their own. Empty input gives no rows.

    Only the histogram of the piece sizes, at most `capacity` - 1 numbers, goes to the driver, where `plan` decides how many containers hold what. Pieces are
    ranked within their size in hash buckets with offsets (so a size that a third of all items has is spread too), and a rank tells the container.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = df.sparkSession
    ship(spark)
    t = F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0))
    rows = df.select(F.col(ident).alias("_i"), t.alias("_t"))
    full = F.floor(F.col("_t") / capacity).cast("long")
    rest = F.pmod(F.col("_t"), F.lit(capacity))
    rows = rows.withColumns({"_full": full, "_rest": rest}).withColumn("pieces", F.greatest(F.col("_full") + (F.col("_rest") > 0).cast("long"), F.lit(1)))
    chosen = plan(*_histogram(rows, "_rest"), capacity, rounds)[0]
    # Slots: from which rank of a size on, in containers from which number on, so many in each.
    keys, first, each, at = [], [], [], 0
    rank: dict[int, int] = {}
    for sizes, takes, n in chosen:
        for s, c in zip(sizes.tolist(), takes.tolist(), strict=True):
            keys.append((s << 44) + rank.get(s, 0))
            first.append(at)
            each.append(c)
            rank[s] = rank.get(s, 0) + c * n
        at += n
    order = np.argsort(np.array(keys, np.int64))
    slots = spark.sparkContext.broadcast(tuple(np.array(x, np.int64)[order] for x in (keys, first, each)))  # some numbers a size and round

    bucket = F.pmod(F.xxhash64("_i", "_t"), F.lit(512))
    small = rows.where("_rest > 0").withColumn("_b", bucket)
    sums = small.groupBy("_rest", "_b").agg(F.count("*").alias("_n"))
    sums = sums.select("_rest", "_b", F.coalesce(F.sum("_n").over(W.partitionBy("_rest").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    ranked = small.withColumn("_r", F.row_number().over(W.partitionBy("_rest", "_b").orderBy("_i", "_t")) - 1)
    ranked = join_checked(ranked, sums, ["_rest", "_b"]).withColumn("_k", F.shiftleft(F.col("_rest"), 44) + F.col("_off") + F.col("_r"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, each = slots.value
        for b in batches:
            k = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            i = np.searchsorted(keys, k, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(first[i] + (k - keys[i]) // each[i], pa.int64())], [*b.schema.names[:-1], "container"])

    picked = ranked.select("_i", F.col("_full").alias("piece"), "pieces", (F.col("_full") * capacity).alias("start"), F.col("_rest").alias("tokens"), "_k")
    out = picked.mapInArrow(place, picked.drop("_k").schema.add("container", "long"))
    empty = rows.where("_t = 0").select("_i", F.lit(0).cast("long").alias("piece"), "pieces", F.lit(0).cast("long").alias("start"), "_t", F.lit(0).cast("long").alias("container"))
    # Full pieces: containers after those of the plan, numbered by item over hash buckets.
    large = rows.where("_full > 0").withColumn("_b", bucket)
    sums = large.groupBy("_b").agg(F.sum("_full").alias("_n"))
    sums = sums.select("_b", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"))  # at most 512 rows
    within = F.sum("_full").over(W.partitionBy("_b").orderBy("_i", "_t").rowsBetween(W.unboundedPreceding, 0)) - F.col("_full")
    large = large.withColumn("_at", within).join(F.broadcast(sums), "_b")
    large = large.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_full") - 1)))
    large = large.select("_i", "piece", "pieces", (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("long").alias("tokens"), (F.lit(at) + F.col("_off") + F.col("_at") + F.col("piece")).alias("container"))
    every = out.union(large).union(empty)
    return every.select(F.col("_i").alias(ident), "piece", "pieces", "start", "tokens", "container")

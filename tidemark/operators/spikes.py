"""Implausible readings: impossible values, stuck sensors and spikes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.joins import join_checked
from tidemark.operators.readings import DAY_MS
from tidemark.session import ship, written

#: Readings that one chunk of a series holds, but for what its last bucket of time (1 / CUTS of its span) adds; and the days it spans at most.
CHUNK_READINGS, CHUNK_DAYS = 1 << 17, 64
#: Readings in the packed chunks that a task holds before it passes them on.
FLUSH = 1 << 19
#: Readings that a chunk sees of its neighbours; more than the longest context any test needs.
HALO = 16
#: Zero changes that a run of 10 or more equal readings counts as: a spike in a constant source has up to four changes, so that spikes alone don't make it one that varies.
RUN_COUNTS = 4
#: Readings a daily profile is moved by, to either side, for the matrix; and the sparse part, in usual changes, from which a reading is odd.
REACH, LIMIT = 4, 6.0
#: Time buckets of a chunk that is cut because it holds too many readings.
CUTS = 1024
#: Bins of the mergeable histogram of changes grow by this factor; a median from it is off by at most half of that.
GROWTH = 1.01

_PACKED = "_e long, _k long, n long, ts binary, v binary, head binary, tail binary, usual double, moved long, still long, held long, bins array<int>, counts array<long>"


def _change_stats(v: np.ndarray, lo: float, hi: float) -> tuple[float, int, int, int, np.ndarray, np.ndarray]:
    """Of one chunk: median of the nonzero absolute changes, number of nonzero and of zero changes (those of long constant
    runs left out), the zero changes of long runs but for RUN_COUNTS of each, and the histogram of the nonzero ones."""
    ok = v[np.isfinite(v) & (v >= lo) & (v <= hi)]
    d = np.abs(np.diff(ok))
    same = d == 0
    if same.any():
        edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
        length = edge[1::2] - edge[::2]
        still = int(length[length < 9].sum())
        held = int((length[length >= 9] - RUN_COUNTS).sum())
        d = d[~same]
    else:
        still = held = 0
    d = d[d > 0]
    if not len(d):
        return 0.0, 0, still, held, np.empty(0, np.int32), np.empty(0, np.int64)
    bins, counts = np.unique(np.floor(np.log(d) / np.log(GROWTH)).astype(np.int32), return_counts=True)
    return float(np.median(d)), len(d), still, held, bins, counts.astype(np.int64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (entity, chunk, time, seq, value) to one row for each chunk; of a time, the last row counts."""
    pieces: list[tuple[np.ndarray, ...]] = []
    out: list[tuple] = []
    held = 0

    def close(upto: int | None) -> Iterator[pa.RecordBatch]:
        nonlocal pieces, held
        e, k, t, v, lo, hi = (np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*pieces, strict=True))
        if upto is not None:
            at = len(e) - upto
            pieces = [(e[at:], k[at:], t[at:], v[at:], lo[at:], hi[at:])]
            if not at:
                return
            e, k, t, v, lo, hi = e[:at], k[:at], t[:at], v[:at], lo[:at], hi[:at]
        else:
            pieces = []
        new = (e[1:] != e[:-1]) | (k[1:] != k[:-1])
        keep = np.append(new | (t[1:] != t[:-1]), True)
        e, k, t, v, lo, hi = e[keep], k[keep], t[keep], v[keep], lo[keep], hi[keep]
        starts = np.concatenate(([0], np.flatnonzero((e[1:] != e[:-1]) | (k[1:] != k[:-1])) + 1, [len(e)]))
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            tt, vv = t[a:b], v[a:b]
            usual, moved, still, stuck, bins, counts = _change_stats(vv, lo[a], hi[a])
            out.append((int(e[a]), int(k[a]), int(b - a), tt.tobytes(), vv.tobytes(), tt[:HALO].tobytes() + vv[:HALO].tobytes(), tt[-HALO:].tobytes() + vv[-HALO:].tobytes(), usual, moved, still, stuck, bins.tolist(), counts.tolist()))
            held += int(b - a)
            if len(out) >= 1024 or held >= FLUSH:
                held = 0
                yield flush()

    def flush() -> pa.RecordBatch:
        rows = list(zip(*out, strict=True))
        out.clear()
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        names = ["_e", "_k", "n", "ts", "v", "head", "tail", "usual", "moved", "still", "held", "bins", "counts"]
        return pa.record_batch([pa.array(x, t) for x, t in zip(rows, types, strict=True)], names)

    for b in batches:
        if not b.num_rows:
            continue
        cols = tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        if pieces and not (cols[0][-1] == pieces[0][0][0] and cols[1][-1] == pieces[0][1][0]) or not pieces:
            pieces.append(cols)
            e, k = cols[0], cols[1]
            last = int(((e == e[-1]) & (k == k[-1])).sum())
            yield from close(last)
        else:
            pieces.append(cols)
    if pieces:
        yield from close(None)
    if out:
        yield flush()


def sparse_part(m: np.ndarray, seen: np.ndarray, rounds: int = 80, close: float = 0.5) -> np.ndarray:
    """Robust principal components: the sparse part of `m`, what remains when a low-rank part is taken off it.

    Principal component pursuit: of all sums of two matrices that give `m`, the one with the least sum of singular values of the first and of absolute entries of the
    second, these weighted by 1 / sqrt(the longer side), and in a row of which only a part is seen by more: 1 / sqrt(that part of the longer side); solved with an augmented Lagrangian until no entry is off by more than `close`.
    Cells that aren't `seen` are free.
    """
    rows, cols = m.shape
    wide, weight = rows <= cols, 1 / np.sqrt(max(rows, cols) * np.maximum(seen.sum(1, keepdims=True), 1) / max(seen.sum(1).max(), 1))

    def powers(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, v = np.linalg.eigh(x @ x.T if wide else x.T @ x)
        return np.sqrt(np.maximum(p, 0)), v

    top = powers(m)[0][-1]
    if not top > 0:
        return np.zeros_like(m)
    price, step = m / max(top, (np.abs(m) / weight).max()), 1.25 / top
    sparse = low = np.zeros_like(m)
    for _ in range(rounds):
        x = m - sparse + price / step
        size, v = powers(x)
        keep = size > 1 / step
        v, shrunk = v[:, keep], 1 - 1 / (step * size[keep])
        low = (v * shrunk) @ (v.T @ x) if wide else (x @ v) @ (v * shrunk).T
        x = m - low + price / step
        sparse = np.where(seen, np.sign(x) * np.maximum(np.abs(x) - weight / step, 0), x)
        off = m - low - sparse
        if np.abs(off).max() < close:
            break
        price = np.where(seen, price + step * off, 0.0)
        step *= 1.6
    return m - low


def off_course(t: np.ndarray, x: np.ndarray, step: int, reach: int = REACH) -> np.ndarray:
    """How far each reading lies from the normal behaviour of its source, by robust principal components on its daily profiles.

    The matrix has a row for each day and a column for each time of day, and each day stands in it 2 `reach` + 1 times, moved by -`reach` .. `reach` readings:
    so a level that drifts or changes for good is part of the profile, even that of a single day, while up to `reach` odd readings are in the minority in every column.
    A time of day with several readings gives way to the next ones; a source denser than its step has as many columns as its fullest day has readings.
    """
    day = t // DAY_MS - t[0] // DAY_MS
    width = int(max(1, DAY_MS // step, np.unique(day, return_counts=True)[1].max()))
    # Times in whole columns: the product may not overflow.
    column = (t % DAY_MS) * width // DAY_MS if width < 1 << 36 else np.arange(len(t)) % width
    _, day = np.unique(day, return_inverse=True)
    at, n = day * width + column, np.arange(len(t))
    at = np.maximum.accumulate(at - n) + n
    used, at = np.unique(at % width, return_inverse=True)[1], at // width
    rows, cols = int(at.max()) + 1, int(used.max()) + 1
    m, seen = np.zeros((2 * reach + 1, rows, cols)), np.zeros((rows, cols), bool)
    seen[at, used] = True
    x = x - np.median(x)
    for k in range(2 * reach + 1):
        m[k, at, used] = x[np.clip(n + k - reach, 0, len(x) - 1)]
    shape = (2 * reach + 1) * rows, cols
    return sparse_part(m.reshape(shape), np.tile(seen, (2 * reach + 1, 1))).reshape(m.shape)[reach, at, used]


def flag_chunk(t: np.ndarray, v: np.ndarray, counter: bool, lo: float, hi: float, step: int, usual: float, varies: bool, far: float = 10.0, run: int = 10) -> np.ndarray:
    """The kinds of the readings of a chunk and its neighbours' nearest: 0 none, 1 impossible, 2 stuck, 3 spike."""
    kind = np.zeros(len(v), np.int8)
    ok = np.isfinite(v) & (v >= lo) & (v <= hi)
    kind[~ok] = 1
    at = np.flatnonzero(ok)
    if len(at) < 3:
        return kind
    x, xt = v[at], t[at]
    same = np.diff(x) == 0
    if varies and same.any():
        edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if b - a + 1 >= run:
                kind[at[a : b + 1]] = 2
    # A counter's readings less the growth to be expected.
    if counter:
        x = x - usual * ((xt - xt[0]) / step)
    moves = np.abs(np.diff(x))
    moves = moves[moves > 0]
    if not len(moves):
        return kind
    # Levels in units of the usual change. A source that stands still most of the time has none: its least move is large.
    unit = usual if usual > 0 else moves.min() / (2 * far)
    with np.errstate(over="ignore"):
        level = np.clip(x / unit, -1e15, 1e15)
    rest = np.abs(off_course(xt, level, step))
    # Large odd readings bend the profile a little for their neighbours: once more without them, and they against the course of the others.
    near = np.max([np.pad(rest, (REACH + k, REACH - k))[REACH:-REACH] for k in range(-REACH, REACH + 1)], axis=0)
    first_odd = (rest > LIMIT) & (rest > near / 4)
    others = np.flatnonzero(~first_odd)
    if len(others) < len(x) and len(others) > 1:
        course = level[others] - off_course(xt[others], level[others], step)
        rest = np.abs(level - np.interp(np.arange(len(x)), others, course))
    odd = rest > LIMIT
    # Few odd readings between others that are as usual are a spike; more are a change of level or a silence.
    edge = np.flatnonzero(np.diff(np.concatenate(([0], odd.view(np.int8), [0]))))
    last = len(x) - 1
    for first, end in zip(edge[::2], edge[1::2], strict=True):
        if end - first > 3 or first < 1 or end > last:
            continue
        # The exact check: away from both sides, which lie together.
        for i, j in ((i, j) for i in range(first, end) for j in range(i + 1, end + 1)):
            a, b, inside = x[i - 1], x[j], x[i:j]
            away = min(np.abs(inside - a).min(), np.abs(inside - b).min())
            if away > far * usual and abs(b - a) <= (far * usual if usual > 0 else away / far):
                where = at[i:j]
                kind[where[kind[where] == 0]] = 3
    return kind


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("impossible", "stuck", "spike")
    for batch in batches:
        es, ts, vs, ks = [], [], [], []
        for i in range(batch.num_rows):  # one chunk at a time: a chunk may be large
            r = {k: c[i].as_py() for k, c in zip(batch.schema.names, batch.columns, strict=True)}
            t, v = np.frombuffer(r["ts"], np.int64), np.frombuffer(r["v"])

            def near(parts: list[bytes] | None, last: bool) -> tuple[np.ndarray, np.ndarray]:
                if not parts:
                    return np.empty(0, np.int64), np.empty(0)
                tt = np.concatenate([np.frombuffer(p[: len(p) // 2], np.int64) for p in parts])
                vv = np.concatenate([np.frombuffer(p[len(p) // 2 :]) for p in parts])
                return (tt[-HALO:], vv[-HALO:]) if last else (tt[:HALO], vv[:HALO])

            (bt, bv), (at, av) = near(r["before"], True), near(r["after"], False)
            t, v = np.concatenate((bt, t, at)), np.concatenate((bv, v, av))
            own = np.zeros(len(t), bool)
            own[len(bt) : len(t) - len(at)] = True
            kind = flag_chunk(t, v, r["counter"], r["lo"], r["hi"], r["step"], r["u"], r["varies"])
            hit = own & (kind > 0)
            if hit.any():
                es.append(np.full(int(hit.sum()), r["_e"]))
                ts.append(t[hit])
                vs.append(v[hit])
                ks.append(kind[hit])
        if es:
            code = np.concatenate(ks)
            yield pa.record_batch([pa.array(np.concatenate(es), pa.int64()), pa.array(np.concatenate(ts), pa.int64()), pa.array(np.concatenate(vs), pa.float64()), pa.array(np.array(names, object)[code - 1], pa.string())], ["_e", "_t", "_v", "reason"])


def _cut(rows: DataFrame) -> DataFrame:
    """Chunks (_e, _k) of more than CHUNK_READINGS rows are cut: a bucket of time (_w / CUTS) goes to the next part, with a `_k` between this and the next chunk's, when those before it make up so many."""
    full = written(rows.groupBy("_e", "_k").agg(F.count("*").alias("_n")).where(F.col("_n") > CHUNK_READINGS).select("_e", "_k"), "full")
    if not full.limit(1).count():
        return rows
    rows = rows.withColumn("_b", F.floor(F.pmod("_t", F.col("_w")) * F.lit(CUTS) / F.col("_w")).cast("long"))
    sums = join_checked(rows, full, ["_e", "_k"], "left_semi").groupBy("_e", "_k", "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_e", "_k").orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    parts = sums.select("_e", "_k", "_b", F.floor(before / CHUNK_READINGS).cast("long").alias("_p"))
    return join_checked(rows, written(parts, "parts"), ["_e", "_k", "_b"], "left").withColumn("_k", F.col("_k") + F.least(F.coalesce("_p", F.lit(0)), F.lit(CUTS - 1))).drop("_b", "_p")


def implausible(df: DataFrame, sources: DataFrame, *, entity: str = "series_id", time_ms: str = "ts_ms", value: str = "value", seq: str = "seq", lo: str = "lo", hi: str = "hi", step: str = "scrape_ms", counter: str = "counter") -> DataFrame:
    """Readings that can't be right: (entity, time_ms, value, reason), reason "impossible", "stuck" or "spike", the first that holds.

    `sources` has one row for each entity (a BIGINT): its possible range (null: unbounded), `step` ms between readings, and whether it is
    a `counter`. Other entities, rows with a null entity, time or value, and sources without a positive step are left out.
    Last write wins as in `latest`.

    impossible: NaN, infinite, outside lo..hi. stuck: all of a run of 10 or more equal plausible readings, in a source of which
    more than half of all changes (a long run counting as RUN_COUNTS) aren't zero, and of those outside such runs more than four fifths. spike: one to three readings further than ten usual changes from the reading before and
    the one after, which themselves lie no further apart (a counter: from its course). A source of which at least half of the changes are zero has no
    usual change: any move away that returns to within a tenth of itself is a spike, and no run is stuck.
    Sources may be of any length and density: a chunk spans at most CHUNK_DAYS and about CHUNK_READINGS; a chunk knows the HALO readings on either side, however
    far away, and its source's usual change, the median nonzero change, from all its chunks (exact for one chunk, else from a histogram, to 1 %).

    Spikes are found by robust principal components on the daily profiles of each chunk (`off_course`), in units of the usual change: one to three readings
    with a sparse part beyond LIMIT, between readings without, are candidates; the definition above is then checked for these. Where the sparse part is small, or large over more readings, no reading is a spike.
    """
    ship(df.sparkSession)
    src = sources.select(F.col(entity).cast("long").alias("_e"), F.coalesce(F.col(lo).cast("double"), F.lit(float("-inf"))).alias("lo"), F.coalesce(F.col(hi).cast("double"), F.lit(float("inf"))).alias("hi"), F.col(step).cast("long").alias("step"), F.coalesce(F.col(counter).cast("boolean"), F.lit(False)).alias("counter")).where("_e is not null and step > 0")
    src = src.groupBy("_e").agg(F.min("lo").alias("lo"), F.min("hi").alias("hi"), F.min("step").alias("step"), F.max("counter").alias("counter"))
    # A null bound may be read as NaN by some writers.
    src = src.withColumns({"lo": F.when(F.isnan("lo"), F.lit(float("-inf"))).otherwise(F.col("lo")), "hi": F.when(F.isnan("hi"), F.lit(float("inf"))).otherwise(F.col("hi"))})
    rows = df.select(F.col(entity).cast("long").alias("_e"), F.col(time_ms).cast("long").alias("_t"), F.col(value).cast("double").alias("_v"), F.coalesce(F.col(seq).cast("long"), F.lit(-(2**63))).alias("_q")).where("_e is not null and _t is not null and _v is not null")
    rows = join_checked(rows, src.drop("counter"), ["_e"])
    span = F.least(F.lit(CHUNK_DAYS * DAY_MS).cast("long"), F.col("step") * CHUNK_READINGS)
    rows = rows.withColumns({"_w": span, "_k": F.floor(F.col("_t") / span).cast("long") * CUTS})
    rows = _cut(rows).repartition("_e", "_k").sortWithinPartitions("_e", "_k", "_t", "_q", "_v")
    chunks = written(rows.select("_e", "_k", "_t", "_v", "lo", "hi").mapInArrow(_pack, _PACKED), "chunks")

    # Chunks of sources that have several: what lies before and after, and the usual change of the whole source.
    order = W.partitionBy("_e").orderBy("_k")
    edges = chunks.select("_e", "_k", "head", "tail", F.count("*").over(W.partitionBy("_e")).alias("_c")).where("_c > 1")
    edges = edges.select("_e", "_k", F.collect_list("tail").over(order.rowsBetween(-HALO, -1)).alias("before"), F.collect_list("head").over(order.rowsBetween(1, HALO)).alias("after"))
    totals = chunks.groupBy("_e").agg(F.sum("n").alias("_n"), F.sum("moved").alias("moved"), F.sum("still").alias("still"), F.sum("held").alias("held"), F.count("*").alias("_c"), F.max("usual").alias("usual"))
    several = totals.where("_c > 1").select("_e")
    bins = chunks.join(several, "_e", "left_semi").select("_e", F.inline(F.arrays_zip("bins", "counts"))).groupBy("_e", "bins").agg(F.sum("counts").alias("n"))
    cum = bins.withColumns({"upto": F.sum("n").over(W.partitionBy("_e").orderBy("bins")), "all": F.sum("n").over(W.partitionBy("_e"))})
    median = cum.where("2 * upto >= all").groupBy("_e").agg(F.pow(F.lit(GROWTH), F.min("bins") + 0.5).alias("_m"))
    per = totals.join(median, "_e", "left").join(src, "_e").select("_e", "lo", "hi", "step", "counter", F.when(F.col("moved") * 2 > F.col("_n") - F.col("held"), F.coalesce("_m", "usual")).otherwise(0.0).alias("u"), ((F.col("still") * 4 < F.col("moved")) & (F.col("moved") * 2 > F.col("_n") - F.col("held"))).alias("varies"))
    whole = join_checked(chunks.select("_e", "_k", "ts", "v"), per, ["_e"])
    whole = join_checked(whole, edges, ["_e", "_k"], "left", BROADCAST_EDGES)
    found = whole.drop("_k").mapInArrow(_flag, "_e long, _t long, _v double, reason string")
    return found.select(F.col("_e").alias(entity), F.col("_t").alias(time_ms), F.col("_v").alias(value), "reason")


#: An edge row holds up to 2 x HALO x HALO readings, some 8 kB.
BROADCAST_EDGES = 4_000

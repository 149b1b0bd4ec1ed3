"""Compact chunks of samples: numbers of variable length and XORed values."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import ship

CHUNK_SAMPLES = 120


def zigzag(x: np.ndarray) -> np.ndarray:
    """Signed to unsigned, small magnitudes first."""
    x = x.astype(np.int64)
    return ((x << 1) ^ (x >> 63)).view(np.uint64)


def unzigzag(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(1)).view(np.int64)) ^ -((x & np.uint64(1)).view(np.int64))


def to_varints(x: np.ndarray) -> bytes:
    """Unsigned numbers, seven bits a byte, low bits first; the top bit says that more follow."""
    x = x.astype(np.uint64)
    parts = np.stack([(x >> np.uint64(7 * i)) & np.uint64(0x7F) for i in range(10)], axis=1).astype(np.uint8)
    size = np.maximum(1, 10 - np.argmax(parts[:, ::-1] != 0, axis=1))
    size[~(parts != 0).any(axis=1)] = 1
    at = np.arange(10)[None, :]
    parts |= np.where(at < size[:, None] - 1, 0x80, 0).astype(np.uint8)
    return parts[at < size[:, None]].tobytes()


def from_varints(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 0x80)
    starts = np.concatenate(([0], ends[:-1] + 1))
    out = np.zeros(len(ends), np.uint64)
    for i in range(10):
        at = starts + i
        live = at <= ends
        out[live] |= (b[at[live]] & np.uint8(0x7F)).astype(np.uint64) << np.uint64(7 * i)
    return out


def encode(t: np.ndarray, v: np.ndarray) -> bytes:
    """A chunk: the count, then times as differences of differences, then each value's bits XORed with the last value's, byte planes compressed."""
    t = np.asarray(t, np.int64)
    with np.errstate(over="ignore"):
        d = np.diff(t, prepend=np.int64(0))
        dd = np.concatenate((d[:2], np.diff(d)[1:])) if len(d) > 1 else d
    times = to_varints(zigzag(dd)) if len(t) else b""
    bits = np.ascontiguousarray(v, np.float64).view(np.uint64)
    x = bits ^ np.concatenate((np.zeros(1, np.uint64), bits[:-1])) if len(bits) else bits
    planes = zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), 6)
    return to_varints(np.array([len(t), len(times)], np.uint64)) + times + planes


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The times and values of a chunk, bit for bit."""
    head = 0
    for _ in range(2):
        while data[head] >= 0x80:
            head += 1
        head += 1
    n, size = (int(x) for x in from_varints(data[:head]))
    if not n:
        return np.empty(0, np.int64), np.empty(0)
    dd = unzigzag(from_varints(data[head : head + size]))
    with np.errstate(over="ignore"):
        d = np.concatenate((dd[:1], np.cumsum(dd[1:])))
        t = np.cumsum(d)
    x = np.frombuffer(zlib.decompress(data[head + size :]), np.uint8).reshape(8, n).T
    return t, np.bitwise_xor.accumulate(np.ascontiguousarray(x).view(np.uint64).ravel()).view(np.float64)


def to_chunks(samples: DataFrame, size: int = CHUNK_SAMPLES, width: int = 1_800_000) -> DataFrame:
    """(series_id, min_t, max_t, n, payload): chunks of at most `size` samples of a series and time partition of `width` ms.

    Samples must be readings (one a time, no nulls). Partitions of a series are encoded apart, so no task holds a series.
    """
    ship(samples.sparkSession)
    part = F.col("ts_ms") - F.pmod(F.col("ts_ms"), F.lit(width).cast("long"))
    rows = samples.select("series_id", "ts_ms", "value", part.alias("_p"))
    rows = rows.withColumn("_c", F.floor((F.row_number().over(W.partitionBy("series_id", "_p").orderBy("ts_ms")) - 1) / size))
    packed = rows.groupBy("series_id", "_p", "_c").agg(F.array_sort(F.collect_list(F.struct("ts_ms", "value"))).alias("s")).select("series_id", F.col("s.ts_ms").alias("t"), F.col("s.value").alias("v"))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"series_id": f["series_id"], "min_t": [x[0] for x in f["t"]], "max_t": [x[-1] for x in f["t"]], "n": [len(x) for x in f["t"]], "payload": [encode(np.asarray(t), np.asarray(v)) for t, v in zip(f["t"], f["v"], strict=True)]})

    return packed.mapInPandas(pack, "series_id long, min_t long, max_t long, n long, payload binary")


def from_chunks(chunks: DataFrame, mint: int | None = None, maxt: int | None = None) -> DataFrame:
    """(series_id, ts_ms, value) of chunks; chunks outside [mint, maxt] aren't decoded."""
    ship(chunks.sparkSession)
    if mint is not None:
        chunks = chunks.where(F.col("max_t") >= mint)
    if maxt is not None:
        chunks = chunks.where(F.col("min_t") <= maxt)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [decode(p) for p in batch.column(1).to_pylist()]
            if parts:
                ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(t) for t, _ in parts])
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(np.concatenate([t for t, _ in parts]), pa.int64()), pa.array(np.concatenate([v for _, v in parts]), pa.float64())], ["series_id", "ts_ms", "value"])

    out = chunks.select("series_id", "payload").mapInArrow(unpack, "series_id long, ts_ms long, value double")
    if mint is not None:
        out = out.where(F.col("ts_ms") >= mint)
    return out if maxt is None else out.where(F.col("ts_ms") <= maxt)

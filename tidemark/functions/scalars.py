"""Scalar helpers for times, ids and checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Time partition of the write path: half an hour.
PARTITION_MS = 1_800_000
#: Default block ranges: two hours, times five, three steps; and how long data is kept.
BLOCK_MIN_MS, BLOCK_FACTOR, BLOCK_STEPS, RETENTION_MS = 7_200_000, 5, 3, 15 * 86_400_000


def floor_div(t: Column, width: int) -> Column:
    """Whole quotient rounded down, for negative numbers too."""
    return (t - F.pmod(t, F.lit(width).cast("long"))) / F.lit(width)


def partition_of(t: Column, width: int = PARTITION_MS) -> Column:
    """Start of the partition a time lies in."""
    return t - F.pmod(t, F.lit(width).cast("long"))


def range_end(t: Column, width: int) -> Column:
    """End of the aligned range a time lies in (its start plus the width)."""
    return partition_of(t, width) + F.lit(width)


def clamp(a: Column, b: Column, mint: int, maxt: int) -> Column:
    """The interval [a, b] clipped to [mint, maxt], as a struct (a, b); null if nothing remains."""
    lo, hi = F.greatest(a, F.lit(mint).cast("long")), F.least(b, F.lit(maxt).cast("long"))
    return F.when(lo <= hi, F.struct(lo.alias("a"), hi.alias("b")))


def overlaps_closed(min_t: Column, max_t: Column, mint: Column | int, maxt: Column | int) -> Column:
    """Whether [min_t, max_t] and [mint, maxt] share a time."""
    return (min_t <= maxt) & (max_t >= mint)


def block_ranges(least: int = BLOCK_MIN_MS, steps: int = BLOCK_STEPS, factor: int = BLOCK_FACTOR) -> list[int]:
    """Block ranges that grow by a factor."""
    return [least * factor**i for i in range(steps)]


def backoff(d: Column, least: int, most: int) -> Column:
    """The next waiting time: doubled, within bounds."""
    return F.least(F.greatest(d * 2, F.lit(least)), F.lit(most))


def pack_chunk_id(series: Column, chunk: Column) -> Column:
    """Series (upper 40 bits) and chunk number (lower 24 bits) in one BIGINT."""
    return F.shiftleft(series.cast("long"), 24).bitwiseOR(chunk.cast("long").bitwiseAND(F.lit((1 << 24) - 1)))


def unpack_chunk_id(packed: Column) -> Column:
    """Struct (series, chunk) of a packed id."""
    return F.struct(F.shiftrightunsigned(packed, 24).alias("series"), packed.bitwiseAND(F.lit((1 << 24) - 1)).alias("chunk"))


def chunk_end_estimate(start: Column, now: Column, end: Column, filled: float = 0.25) -> Column:
    """When a chunk that took from `start` to `now` for a part `filled` of its room should be closed, so that chunks divide the time to `end` evenly."""
    n = F.floor((end - start) / ((now - start + 1) / F.lit(filled)))
    return F.when(n <= 1, end).otherwise(start + F.floor((end - start) / n))


def checksum(data: Column) -> Column:
    """CRC-32."""
    return F.crc32(data)


def runes(text: Column) -> Column:
    """Length in code points and in bytes of UTF-8."""
    return F.struct(F.char_length(text).alias("runes"), F.octet_length(text).alias("bytes"))

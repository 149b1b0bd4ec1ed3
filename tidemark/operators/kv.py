"""An ordered map of byte strings with sequence numbers, deletions and snapshots: rows (key, seq, type, value).

Type 1 sets a value, 0 deletes the key. Of a key the entry with the highest sequence number counts; entries with a null key or sequence number don't.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DELETE, PUT = 0, 1
SCHEMA = "key binary, seq bigint, type tinyint, value binary"


class Batch:
    """Puts and deletes that are written together, in order."""

    def __init__(self) -> None:
        self.ops: list[tuple[int, bytes, bytes | None]] = []

    def put(self, key: bytes, value: bytes) -> Batch:
        self.ops.append((PUT, key, value))
        return self

    def delete(self, key: bytes) -> Batch:
        self.ops.append((DELETE, key, None))
        return self

    def append(self, other: Batch) -> Batch:
        self.ops.extend(other.ops)
        return self

    def replay(self) -> Iterable[tuple[int, bytes, bytes | None]]:
        return iter(self.ops)

    def rows(self, spark: SparkSession, after: int) -> DataFrame:
        """The batch as entries with the sequence numbers that follow `after`."""
        return spark.createDataFrame([(bytearray(k), after + 1 + i, t, None if v is None else bytearray(v)) for i, (t, k, v) in enumerate(self.ops)], SCHEMA)


def snapshot(entries: DataFrame, seq: int | None = None) -> DataFrame:
    """(key, value): what a reader sees that began after entry `seq` (null: now). At the same sequence number a put wins over a deletion, then the greater value."""
    rows = entries.where("key is not null and seq is not null")
    if seq is not None:
        rows = rows.where(F.col("seq") <= seq)
    last = rows.groupBy("key").agg(F.max(F.struct("seq", "type", "value")).alias("_e"))
    return last.where(F.col("_e.type") == PUT).select("key", F.col("_e.value").alias("value"))


def get(entries: DataFrame, key: Column | bytes, seq: int | None = None) -> DataFrame:
    """(key, value) of one key; no row if it is absent or deleted."""
    return snapshot(entries.where(F.col("key") == (F.lit(bytearray(key)) if isinstance(key, bytes) else key)), seq)


def scan(entries: DataFrame, start: Column | None = None, end: Column | None = None, seq: int | None = None, reverse: bool = False) -> DataFrame:
    """Pairs with start <= key < end in the order of the keys' bytes, or backward."""
    rows = entries
    if start is not None:
        rows = rows.where(F.col("key") >= start)
    if end is not None:
        rows = rows.where(F.col("key") < end)
    return snapshot(rows, seq).orderBy(F.col("key").desc() if reverse else F.col("key"))


def seek(entries: DataFrame, key: Column, seq: int | None = None) -> DataFrame:
    """The first pair at or after a key."""
    return scan(entries, key, seq=seq).limit(1)


def compact(entries: DataFrame, oldest_snapshot: int | None = None) -> DataFrame:
    """Entries without those that no reader can see: of each key what the oldest open snapshot sees, and everything newer; without snapshots only the last puts."""
    rows = entries.where("key is not null and seq is not null")
    if oldest_snapshot is None:
        last = rows.groupBy("key").agg(F.max(F.struct("seq", "type", "value")).alias("_e"))
        return last.where(F.col("_e.type") == PUT).select("key", "_e.seq", "_e.type", "_e.value")
    old, new = rows.where(F.col("seq") <= oldest_snapshot), rows.where(F.col("seq") > oldest_snapshot)
    last = old.groupBy("key").agg(F.max(F.struct("seq", "type", "value")).alias("_e")).where(F.col("_e.type") == PUT)
    return last.select("key", "_e.seq", "_e.type", "_e.value").unionByName(new.select("key", "seq", "type", "value"))


def approximate_size(entries: DataFrame, start: Column, end: Column) -> DataFrame:
    """Bytes of keys and values with start <= key < end, all versions."""
    rows = entries.where((F.col("key") >= start) & (F.col("key") < end))
    return rows.agg(F.coalesce(F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))), F.lit(0)).alias("bytes"))


def repair(entries: DataFrame) -> DataFrame:
    """What can be saved of damaged entries: those with a key, a sequence number and a known type, a put with its value; once each."""
    good = entries.where("key is not null and seq is not null and type in (0, 1) and (type = 0 or value is not null)")
    return good.select("key", "seq", "type", F.when(F.col("type") == PUT, F.col("value")).alias("value")).distinct()

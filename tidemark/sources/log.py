"""A log of records in numbered segments: what was written since the last block, to be read back after a restart.

A record is (pos, kind, body, crc): its place in the segment, what it is ("series", "sample", "deletion" or "flush"), its text as JSON, and the checksum of both. Segments are folders `segment=N`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.layout import _filesystem

SCHEMA = "pos bigint, kind string, body string, crc bigint, segment bigint"


def _crc() -> Column:
    return F.crc32(F.encode(F.concat_ws(" ", F.col("pos").cast("string"), "kind", "body"), "UTF-8"))


def records(df: DataFrame, kind: str, pos: str, columns: list[str]) -> DataFrame:
    """Rows of a table as records of a kind, in the order of a column."""
    body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return df.select(F.col(pos).cast("long").alias("pos"), F.lit(kind).alias("kind"), body.alias("body")).withColumn("crc", _crc())


def write_segment(rows: DataFrame, path: str, number: int) -> None:
    """Writes a segment; one of that number is replaced, so that a writer that failed may write it again."""
    rows.repartitionByRange("pos").sortWithinPartitions("pos").write.mode("overwrite").parquet(f"{path}/segment={number}")


def read(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(segment, pos, kind, body) of the sound records of segments first..last (null: from the start, to the end): of each segment those before its first record whose checksum is wrong or whose text is missing."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        rows = rows.where(F.col("segment") >= first)
    if last is not None:
        rows = rows.where(F.col("segment") <= last)
    torn = rows.where(~F.coalesce(F.col("crc") == _crc(), F.lit(False))).groupBy("segment").agg(F.min("pos").alias("_end"))
    # One row a segment.
    return rows.join(F.broadcast(torn), "segment", "left").where(F.col("_end").isNull() | (F.col("pos") < F.col("_end"))).select("segment", "pos", "kind", "body")


def repair(spark: SparkSession, path: str, to: str) -> None:
    """Writes the log's sound part to another place: segments up to the first torn one, of which only the part before the damage is kept."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    torn = rows.where(~F.coalesce(F.col("crc") == _crc(), F.lit(False))).agg(F.min("segment")).first()[0]
    good = read(spark, path, last=torn).withColumn("crc", _crc())
    good.repartition("segment").sortWithinPartitions("segment", "pos").write.mode("overwrite").partitionBy("segment").parquet(to)


def truncate(spark: SparkSession, path: str, before: int) -> list[int]:
    """Removes the segments below a number, once their records lie in blocks; returns the numbers."""
    fs, p = _filesystem(spark, path)
    old = [(int(f.getPath().getName().removeprefix("segment=")), f.getPath()) for f in fs.listStatus(p) if f.getPath().getName().startswith("segment=")]
    gone = sorted((n, q) for n, q in old if n < before)
    for _, q in gone:
        fs.delete(q, True)
    return [n for n, _ in gone]


def decoded(rows: DataFrame, kind: str, schema: str) -> DataFrame:
    """The rows that the records of a kind were made of."""
    return rows.where(F.col("kind") == kind).select(F.from_json("body", schema, {"allowNonNumericNumbers": "true"}).alias("_r")).select("_r.*")

"""Blocks: the data of a range of time with its metadata, written whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.compaction import populate
from tidemark.sources.layout import _filesystem, write_samples
from tidemark.sources.tables import table

SAMPLES = "series_id bigint, ts_ms bigint, value double, seq bigint"
META = "ulid string, min_t bigint, max_t bigint, level int, sources array<string>, parents array<string>, num_samples bigint, num_series bigint, num_chunks bigint, num_tombstones bigint"


def write(samples: DataFrame, series: DataFrame, folder: str, ulid: str, *, level: int = 1, sources: list[str] | None = None, parents: list[str] | None = None, tombstones: DataFrame | None = None, chunk: int = 120) -> DataFrame:
    """Writes the block `folder`/`ulid`: samples by day, the series that have any, open deletions and the metadata (META), which it returns.

    Samples are readings: one row a (series, time). The range is half-open: from the first sample to one after the last; a block without samples has a null range. Everything is written
    beside and renamed at the end, so a block is there whole or not at all; one of that name is replaced. `num_chunks` counts chunks of `chunk` samples.
    """
    spark = samples.sparkSession
    beside = f"{folder}/{ulid}.tmp"
    fs, tmp = _filesystem(spark, beside)
    fs.delete(tmp, True)
    rows = samples.withColumn("seq", F.col("seq") if "seq" in samples.columns else F.lit(0).cast("long")).select("series_id", "ts_ms", "value", "seq")
    write_samples(rows, f"{beside}/samples.parquet", "overwrite")
    stored = spark.read.schema(SAMPLES).parquet(f"{beside}/samples.parquet")
    per = stored.groupBy("series_id").agg(F.count("*").alias("n"), F.min("ts_ms").alias("a"), F.max("ts_ms").alias("z"))
    series.join(per.select("series_id"), "series_id", "left_semi").write.mode("overwrite").parquet(f"{beside}/series.parquet")
    holes = tombstones if tombstones is not None else spark.createDataFrame([], "series_id bigint, min_t bigint, max_t bigint")
    holes.write.mode("overwrite").parquet(f"{beside}/tombstones.parquet")
    n = per.agg(F.sum("n"), F.count("*"), F.sum(F.ceil(F.col("n") / chunk)), F.min("a"), F.max("z")).first()
    meta = spark.createDataFrame([(ulid, n[3], None if n[4] is None else n[4] + 1, level, sorted(set(sources or [ulid])), parents or [], int(n[0] or 0), int(n[1]), int(n[2] or 0), holes.count())], META)
    meta.coalesce(1).write.mode("overwrite").json(f"{beside}/meta.json")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{ulid}")
    fs.delete(place, True)
    fs.rename(tmp, place)
    return read_meta(spark, folder, ulid)


def read_meta(spark: SparkSession, folder: str, ulid: str) -> DataFrame:
    """The metadata of a block, as written."""
    return spark.read.schema(META).json(f"{folder}/{ulid}/meta.json")


def read(spark: SparkSession, folder: str, ulid: str, name: str = "samples") -> DataFrame:
    """The samples, series or tombstones of a block."""
    if name == "samples":
        return spark.read.schema(f"{SAMPLES}, day bigint").parquet(f"{folder}/{ulid}/samples.parquet").drop("day")
    return table(spark, f"{folder}/{ulid}", name)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compact(spark: SparkSession, folder: str, parents: list[str], ulid: str) -> DataFrame:
    """Makes one block of several, given oldest first, and returns its metadata: at equal times the last parent's value counts, deleted ranges are dropped, and series are counted anew.

    The parents go once the new block is there; if the job fails before, they are as they were.
    """
    metas = [read_meta(spark, folder, p).first() for p in parents]
    holes, series = (_union([read(spark, folder, p, name) for p in parents]) for name in ("tombstones", "series"))
    series = series.groupBy("series_id").agg(F.max(F.array_sort(F.map_entries("labels"))).alias("_a")).select("series_id", F.map_from_entries("_a").alias("labels"))
    rows = populate([read(spark, folder, p) for p in parents], holes)
    meta = write(rows, series, folder, ulid, level=max(m["level"] for m in metas) + 1, sources=[s for m in metas for s in m["sources"]], parents=parents)
    for p in parents:
        fs, path = _filesystem(spark, f"{folder}/{p}")
        fs.delete(path, True)
    return meta

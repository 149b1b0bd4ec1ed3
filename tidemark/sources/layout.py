"""Stored layout: Parquet partitioned by day, sorted by series and time; what it holds, its upkeep and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.readings import DAY_MS
from tidemark.operators.select import Store


def write_samples(samples: DataFrame, path: str, mode: str = "append", rows_per_file: int = 5_000_000, split: int = 16) -> None:
    """Samples by day (`day`, days since 1970), within a file sorted by series and time, so that day, series and time ranges skip files and row groups.

    A day's rows are spread over `split` tasks by series and hour, so that neither a large day nor a large series is one task's work.
    """
    rows = samples.where("ts_ms is not null and series_id is not null").withColumn("day", F.floor(F.col("ts_ms") / DAY_MS).cast("long"))
    rows = rows.withColumn("_s", F.pmod(F.xxhash64("series_id", F.floor(F.col("ts_ms") / 3_600_000)), F.lit(split)))
    rows.repartition("day", "_s").sortWithinPartitions("day", "series_id", "ts_ms").drop("_s").write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy("day").parquet(path)


def read_samples(spark: SparkSession, path: str, mint: int | None = None, maxt: int | None = None) -> DataFrame:
    """Samples with mint <= ts_ms <= maxt: the days are pruned, and the time filter reaches the row groups."""
    rows = spark.read.parquet(path)
    if mint is not None:
        rows = rows.where((F.col("day") >= mint // DAY_MS) & (F.col("ts_ms") >= mint))
    if maxt is not None:
        rows = rows.where((F.col("day") <= maxt // DAY_MS) & (F.col("ts_ms") <= maxt))
    return rows.drop("day")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, rows): the properties of the stored files."""
    return spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).groupBy("file", "bytes").agg(F.count("*").alias("rows"))


def partitions(spark: SparkSession, path: str) -> DataFrame:
    """(day, files, bytes, rows, min_t, max_t): the properties of the stored days."""
    rows = spark.read.parquet(path).select("day", "ts_ms", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b"))
    per = rows.groupBy("day", "f", "b").agg(F.count("*").alias("n"), F.min("ts_ms").alias("a"), F.max("ts_ms").alias("z"))
    return per.groupBy("day").agg(F.count("*").alias("files"), F.sum("b").alias("bytes"), F.sum("n").alias("rows"), F.min("a").alias("min_t"), F.max("z").alias("max_t"))


def approximate_size(spark: SparkSession, path: str, mint: int, maxt: int) -> DataFrame:
    """(bytes): size of the files of the days that [mint, maxt] touches."""
    return partitions(spark, path).where((F.col("day") >= mint // DAY_MS) & (F.col("day") <= maxt // DAY_MS)).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def touched(spark: SparkSession, path: str, mint: int, maxt: int) -> DataFrame:
    """The stored days, with their properties, that hold samples of [mint, maxt]."""
    return partitions(spark, path).where((F.col("min_t") <= maxt) & (F.col("max_t") >= mint))


def _filesystem(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _days(spark: SparkSession, path: str) -> list[tuple[int, int, str]]:
    """(day, bytes, folder) of the stored days, oldest first: one entry a day, from the file system alone."""
    fs, p = _filesystem(spark, path)
    found = [(f.getPath().getName(), f.getPath()) for f in fs.listStatus(p) if f.isDirectory()]
    return sorted((int(n.removeprefix("day=")), int(fs.getContentSummary(q).getLength()), q.toString()) for n, q in found if n.startswith("day="))


def drop_before(spark: SparkSession, path: str, time_ms: int) -> list[int]:
    """Retention by time: removes the days that lie wholly before `time_ms`, without reading them; returns them."""
    return _drop(spark, [(d, f) for d, _, f in _days(spark, path) if (d + 1) * DAY_MS <= time_ms])


def drop_beyond(spark: SparkSession, path: str, most_bytes: int) -> list[int]:
    """Retention by size: removes the oldest days until the others hold at most `most_bytes`; the newest day stays. Returns the removed days."""
    days, gone = _days(spark, path), []
    held = sum(b for _, b, _ in days)
    for d, b, f in days[:-1]:
        if held <= most_bytes:
            break
        held -= b
        gone.append((d, f))
    return _drop(spark, gone)


def _drop(spark: SparkSession, days: list[tuple[int, str]]) -> list[int]:
    for _, folder in days:
        fs, p = _filesystem(spark, folder)
        fs.delete(p, True)
    return [d for d, _ in days]


def swap(spark: SparkSession, new: str, path: str) -> None:
    """Puts a rewritten folder in the place of the old one, by renaming: readers see the old data or the new, except for the moment between the two steps."""
    fs, old = _filesystem(spark, path)
    aside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.old")
    fs.rename(old, aside)
    if not fs.rename(_filesystem(spark, new)[1], old):
        fs.rename(aside, old)
        raise OSError(f"{new} couldn't be put in the place of {path}")
    fs.delete(aside, True)


def dump(samples: DataFrame) -> DataFrame:
    """(line): rows as lines of text, `id @ time # seq`, for reading by people; a null is "-"."""
    return samples.select(F.concat_ws(" ", F.coalesce(F.col("series_id").cast("string"), F.lit("-")), F.lit("@"), F.coalesce(F.col("ts_ms").cast("string"), F.lit("-")), F.lit("#"), F.coalesce(F.col("seq").cast("string"), F.lit("-"))).alias("line"))


def rewrite(spark: SparkSession, path: str, to: str, keep_after: int | None = None, tombstones: DataFrame | None = None) -> None:
    """Small files into few, one row a (series, time), without deleted ranges and without days before `keep_after`; written beside, to be swapped in by its reader."""
    rows = read_samples(spark, path, keep_after)
    store = Store(spark.createDataFrame([], "series_id bigint, labels map<string,string>"), rows)
    from tidemark.operators.readings import latest
    from tidemark.operators.tombstones import apply

    out = latest(store.samples)
    if tombstones is not None:
        out = apply(out, tombstones)
    write_samples(out.withColumn("seq", F.lit(0).cast("long")), to, "overwrite")


def save_snapshot(store: Store, path: str) -> None:
    """The series and the inverted index of a store, as tables."""
    store.series.write.mode("overwrite").parquet(f"{path}/series.parquet")
    store.label_index().repartition("name").sortWithinPartitions("name", "value", "series_id").write.mode("overwrite").parquet(f"{path}/label_index.parquet")


def load_snapshot(spark: SparkSession, path: str, samples: DataFrame) -> Store:
    """A store from a snapshot and samples."""
    return Store(spark.read.parquet(f"{path}/series.parquet"), samples)

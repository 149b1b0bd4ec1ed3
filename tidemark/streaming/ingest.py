"""Continuous ingest and windows over streams."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.session import run_folder
from tidemark.sources.ingest import Appender
from tidemark.sources.layout import write_samples

INSERTS = "series_id bigint, ts_ms bigint, value double, seq bigint"


def inserts(spark: SparkSession, path: str, schema: str = INSERTS, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of arriving Parquet files. `files_per_trigger` bounds a batch: the pressure on what comes after."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def ingest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch of samples by day. A batch that is run again after a failure writes its own folder anew, so every row counts once.

    Ends when the source is drained (availableNow); `ingested` reads what is there.
    """

    def write(batch: DataFrame, number: int) -> None:
        write_samples(batch, f"{path}/batch={number}", "overwrite")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, path: str) -> DataFrame:
    """The samples that `ingest` wrote, of all batches."""
    return spark.read.parquet(path).drop("batch", "day")


def register(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """A stream of (labels, ts_ms, value) through an `Appender`: series get ids once, whatever batch they come in, and samples are committed batch by batch.

    A batch that is delivered again, even after a failure halfway, writes its samples in place of those of the attempt before: every row counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        app = Appender(batch.sparkSession, folder, number)
        app.add(batch)
        app.commit()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: A watermark starts at 1970, and what is older would count as late from the start; so event times are moved ahead by whole days, some four thousand years.
AHEAD_MS = 1_461_000 * 86_400_000


def deduplicated(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """The stream without rows that arrive again unchanged within the watermark. A row without a time is dropped."""
    return stream.where("ts_ms is not null").withColumn("ts", F.timestamp_millis(F.col("ts_ms") + AHEAD_MS)).withWatermark("ts", late).dropDuplicatesWithinWatermark(["series_id", "ts_ms", "value", "seq"]).drop("ts")


def tumbling(stream: DataFrame, width: str = "5 minutes", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """(series_id, bucket_ms, n, max_value) of tumbling windows, or with `slide` of windows that begin that often; rows later than the watermark are dropped, and the state of windows before it, NaN is greater than any number."""
    rows = stream.where("ts_ms is not null and value is not null and series_id is not null").withColumn("ts", F.timestamp_millis(F.col("ts_ms") + AHEAD_MS))
    out = rows.withWatermark("ts", late).groupBy("series_id", F.window("ts", width, slide)).agg(F.count("*").alias("n"), F.max("value").alias("max_value"))
    return out.select("series_id", (F.unix_millis("window.start") - AHEAD_MS).alias("bucket_ms"), "n", "max_value")


def sessions(stream: DataFrame, gap: str = "1 hour", late: str = "2 days") -> DataFrame:
    """(series_id, from_ms, to_ms, n): bursts of samples without a pause longer than `gap`; `to_ms` is the last sample's time plus the gap."""
    rows = stream.where("ts_ms is not null and series_id is not null").withColumn("ts", F.timestamp_millis("ts_ms"))
    out = rows.withWatermark("ts", late).groupBy("series_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return out.select("series_id", F.unix_millis("session_window.start").alias("from_ms"), F.unix_millis("session_window.end").alias("to_ms"), "n")


def to_table(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs an aggregated stream over what its source holds, and returns the last state of each group (`keys`): a table in this driver's shared folder.

    Only groups that a batch changed are written, each batch to its own place, which it writes anew if it is run again; state beyond the watermark is dropped.
    """
    spark = stream.sparkSession
    place = f"{run_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/table/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/table")
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], stream.schema)
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(f"{', '.join(f'`{c}` {t}' for c, t in stream.dtypes)}, batch bigint").parquet(f"{place}/table")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return last.select(*keys, "_last.*").select(*stream.columns)

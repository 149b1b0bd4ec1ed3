"""Other tables as series and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import table


def events(spark: SparkSession, folder: str) -> DataFrame:
    """(metric, user, ts_ms, value, seq, props) of the `events` table; milliseconds are rounded down, and the session's time zone plays no part."""
    rows = table(spark, folder, "events").withColumn("_ts", F.col("ts").cast("timestamp_ntz"))
    return rows.select(F.col("event_type").alias("metric"), F.col("user_id").cast("string").alias("user"), F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', _ts)").alias("ts_ms"), "value", F.col("event_id").alias("seq"), "props")

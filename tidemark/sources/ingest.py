"""The write path: series get ids, samples are buffered and committed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.labels import canonical

SERIES = "series_id bigint, labels map<string,string>"
SAMPLES = "series_id bigint, ts_ms bigint, value double, seq bigint"


def assign_ids(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """(series_id, labels): series for label sets (`labels`) that aren't known yet; ids go on from the highest known one, without gaps, in a fixed order.

    Sets are compared whole, never by hash. A null set is the empty set. Ids come from ranks in ranges of the sorted sets and the counts of the ranges before:
    no task orders all new series.
    """
    new = wanted.select(canonical(F.col("labels")).alias("_a")).distinct().join(known.select(canonical(F.col("labels")).alias("_a")).distinct(), "_a", "left_anti")
    top = known.agg(F.coalesce(F.max("series_id"), F.lit(-1))).first()[0]
    bucket = F.substring(F.sha2(F.to_json("_a"), 256), 1, 3)
    ranked = new.withColumn("_b", bucket).withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy("_a")))
    sums = ranked.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # at most 4096 rows
    numbered = ranked.join(F.broadcast(sums.select("_b", "_off")), "_b")
    return numbered.select((F.lit(top) + F.col("_off") + F.col("_r")).cast("long").alias("series_id"), F.map_from_entries(F.transform("_a", lambda e: F.struct(e["name"], e["value"]))).alias("labels"))


def resolve(series: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with `labels` or `series_id` to samples by id, with a `status`: "ok", or "unknown" for an id or set that isn't registered."""
    keyed = rows.withColumn("_a", F.when(F.col("labels").isNotNull(), canonical(F.col("labels"))))
    by_set = series.select(canonical(F.col("labels")).alias("_a"), F.col("series_id").alias("_s"))
    ids = series.select(F.col("series_id").alias("_k")).distinct()
    out = keyed.join(by_set, "_a", "left")
    out = out.withColumn("_id", F.coalesce("_s", F.when(F.col("_a").isNull(), F.col("series_id")))).join(ids, F.col("_id") == F.col("_k"), "left")
    return out.select(F.col("_id").alias("series_id"), "ts_ms", "value", F.when(F.col("_k").isNotNull(), "ok").otherwise("unknown").alias("status"))


@dataclass
class Appender:
    """Collects inserts and commits them together to a folder with Parquet tables `series` and `samples`.

    Series become known when they are added, samples when `commit` writes them; `rollback` drops the samples and keeps the series.
    With a number of a `batch` the samples are those of that batch alone, whatever an earlier attempt at it has written: a batch that is committed again counts once.
    """

    spark: SparkSession
    folder: str
    batch: int | None = None
    pending: list[DataFrame] = field(default_factory=list)

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.parquet")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}.parquet") if there else self.spark.createDataFrame([], schema)

    def series(self) -> DataFrame:
        return self._read("series", SERIES)

    def samples(self) -> DataFrame:
        """All committed samples, but for those of this appender's own batch."""
        rows = self._read("batches", f"{SAMPLES}, batch bigint")
        others = rows if self.batch is None else rows.where(F.col("batch") != self.batch)
        return self._read("samples", SAMPLES).unionByName(others.drop("batch"))

    def add(self, rows: DataFrame) -> DataFrame:
        """Registers the label sets of rows (labels, ts_ms, value) and buffers the samples; returns (series_id, labels) of the new series. The same set added again keeps its id."""
        new = assign_ids(self.series(), rows.select("labels"))
        new.write.mode("append").parquet(f"{self.folder}/series.parquet")
        self.pending.append(rows.select("labels", F.lit(None).cast("long").alias("series_id"), "ts_ms", "value"))
        return new

    def add_fast(self, rows: DataFrame) -> None:
        """Buffers samples (series_id, ts_ms, value) of known series."""
        self.pending.append(rows.select(F.lit(None).cast("map<string,string>").alias("labels"), "series_id", "ts_ms", "value"))

    def commit(self) -> DataFrame:
        """Writes what is buffered, later additions with higher `seq`; returns (status, n): rows of unknown series are reported and not written."""
        if not self.pending:
            return self.spark.createDataFrame([], "status string, n bigint")
        top = self.samples().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        rows = None
        for i, p in enumerate(self.pending):
            part = resolve(self.series(), p).withColumn("seq", F.lit(top + 1 + i).cast("long"))
            rows = part if rows is None else rows.unionByName(part)
        good = rows.where("status = 'ok' and ts_ms is not null and value is not null").select("series_id", "ts_ms", "value", "seq")
        report = self.spark.createDataFrame([tuple(r) for r in rows.groupBy("status").count().collect()], "status string, n bigint")
        if self.batch is None:
            good.write.mode("append").parquet(f"{self.folder}/samples.parquet")
        else:
            good.write.mode("overwrite").parquet(f"{self.folder}/batches.parquet/batch={self.batch}")
        self.pending.clear()
        return report

    def rollback(self) -> None:
        self.pending.clear()

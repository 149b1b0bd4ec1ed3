"""Readers of series and samples in text forms, and of insert requests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.labels import METRIC

# The measurements of the public time-series benchmark for servers, and their fields.
DEVOPS_FIELDS: Mapping[str, str] = {
    "cpu": "usage_user usage_system usage_idle usage_nice usage_iowait usage_irq usage_softirq usage_steal usage_guest usage_guest_nice",
    "diskio": "reads writes read_bytes write_bytes read_time write_time io_time",
    "disk": "total free used used_percent inodes_total inodes_free inodes_used",
    "kernel": "boot_time interrupts context_switches processes_forked disk_pages_in disk_pages_out",
    "mem": "total available used free cached buffered used_percent available_percent buffered_percent",
    "net": "bytes_sent bytes_recv packets_sent packets_recv err_in err_out drop_in drop_out",
    "nginx": "accepts active handled reading requests waiting writing",
    "postgres": "numbackends xact_commit xact_rollback blks_read blks_hit tup_returned tup_fetched tup_inserted tup_updated tup_deleted conflicts temp_files temp_bytes deadlocks blk_read_time blk_write_time",
    "redis": "uptime_in_seconds total_connections_received expired_keys evicted_keys keyspace_hits keyspace_misses instantaneous_ops_per_sec instantaneous_input_kbps instantaneous_output_kbps connected_clients used_memory used_memory_rss used_memory_peak used_memory_lua rdb_changes_since_last_save sync_full sync_partial_ok sync_partial_err pubsub_channels pubsub_patterns latest_fork_usec connected_slaves master_repl_offset repl_backlog_active repl_backlog_size repl_backlog_histlen mem_fragmentation_ratio used_cpu_sys used_cpu_user used_cpu_sys_children used_cpu_user_children",
}


def devops_metrics(measurements: Sequence[str] | None = None) -> list[str]:
    """Metric names such as cpu_usage_user; of all measurements, or of some."""
    return [f"{m}_{f}" for m in (measurements or DEVOPS_FIELDS) for f in DEVOPS_FIELDS[m].split()]


def devops_series(lines: DataFrame, metrics: Sequence[str], column: str = "value") -> DataFrame:
    """(labels): one series for each line `measurement,k=v,k=v,...` and metric. Lines without a pair give series with the metric's name only; null lines none."""
    tail = F.when(F.instr(column, ",") > 0, F.regexp_replace(column, r"^[^,]*,", ""))
    pairs = F.filter(F.split(tail, ","), lambda p: F.instr(p, "=") > 0)
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(p, r"^[^=]*=", "").alias("v")))
    base = lines.where(F.col(column).isNotNull()).select(F.coalesce(F.map_from_entries(entries), F.create_map().cast("map<string,string>")).alias("l"))
    return base.select("l", F.explode(F.array(*map(F.lit, metrics))).alias("m")).select(F.map_concat(F.map_filter("l", lambda k, _: k != METRIC), F.create_map(F.lit(METRIC), F.col("m"))).alias("labels"))


def read_devops(spark: SparkSession, path: str, metrics: Sequence[str] | None = None) -> DataFrame:
    """Series of a file of such lines."""
    return devops_series(spark.read.text(path), metrics or devops_metrics())


def json_series(lines: DataFrame, column: str = "value", instance: str | None = None) -> DataFrame:
    """(labels): one series for each JSON object of strings in `column`; lines that aren't such objects give none. `instance` replaces that label, if the set has it."""
    out = lines.select(F.from_json(column, "map<string,string>", {"mode": "PERMISSIVE"}).alias("labels")).where("labels is not null")
    if instance is None:
        return out
    return out.select(F.transform_values("labels", lambda k, v: F.when(k == "instance", F.lit(instance)).otherwise(v)).alias("labels"))


def requests(df: DataFrame) -> DataFrame:
    """(labels, series_id, ts_ms, value) of insert requests (lset ARRAY<STRUCT<name, value>>, id, t, v): a request without labels refers to a known id."""
    return df.select(F.when(F.size("lset") > 0, F.map_from_entries("lset")).alias("labels"), F.col("id").alias("series_id"), F.col("t").alias("ts_ms"), F.col("v").alias("value"))


def groups(df: DataFrame) -> DataFrame:
    """(group_id, slot, ts_ms, value): rows of groups (group_id, ts_ms, slots, values), one time with many values, as narrow samples."""
    return df.select("group_id", "ts_ms", F.inline(F.arrays_zip(F.col("slots").alias("slot"), F.col("values").alias("value"))))


def unpivot(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide rows to narrow ones: (ids..., metric, value), a null value is no sample."""
    return df.unpivot(list(ids), list(metrics), "metric", "value").where("value is not null")

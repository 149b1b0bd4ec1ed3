"""Queries for the store's own operators, over whole tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.functions.codecs import from_chunks, to_chunks
from tidemark.operators import aggregate as agg
from tidemark.operators import compaction, kv, postings, tombstones
from tidemark.operators.labels import as_string, canonical, with_label, without_label
from tidemark.operators.matchers import AnyOf, Equal, Not, Prefix, Regex, everything
from tidemark.operators.readings import latest
from tidemark.operators.select import Store, align_by_labels, chain_stores, merge_stores
from tidemark.plans.training import double_sql, exact_sql
from tidemark.session import written
from tidemark.sources import datasets, loaders
from tidemark.sources.tables import table
from tidemark.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: The end of the benchmark's range, a day in the middle of the readings, and its five metrics, the first of which the queries of one metric use.
END = 1_390_608_000_000
FIVE = ("chassis_temp_c", "core_load_pct", "core_wait_pct", "fan_speed_rpm", "volume_used_pct")
GAUGES = ("cache_hit_ratio", *FIVE, "flush_delay_ms", "intake_humidity_pct", "queue_depth_items", "supply_volts")
HOUR, DAY = 3_600_000, 86_400_000

# Building blocks of the SQL: series once each, readings (last write wins), label values with '' for missing ones.
_S = "s AS (SELECT series_id, arg_min(labels, added_ms) AS labels FROM series WHERE series_id IS NOT NULL GROUP BY series_id)"
_R = "r AS (SELECT series_id, ts_ms, max_by(value, seq) AS value FROM samples WHERE series_id IS NOT NULL AND ts_ms IS NOT NULL AND value IS NOT NULL GROUP BY series_id, ts_ms)"
_L = "l AS (SELECT series_id, unnest(map_keys(labels)) AS name, unnest(map_values(labels)) AS value FROM s)"
_BASE = f"WITH {_S}, {_R}"


def _lab(name: str) -> str:
    return f"coalesce(s.labels['{name}'], '')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if there is one."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def _picked(cond: str, more: str = "") -> str:
    return f"{_BASE} SELECT r.series_id, r.ts_ms, r.value FROM r JOIN s ON s.series_id = r.series_id WHERE {cond}{more}"


# Retrieval


@query(_picked(f"{_lab('__name__')} = 'core_load_pct'"))
def select_equal(spark: SparkSession, folder: str) -> DataFrame:
    return Store.of(spark, folder).select([Equal("__name__", "core_load_pct")])


@query(_picked(f"{_lab('__name__')} = 'supply_volts' AND {_lab('dc')} = 'dc-a'"))
def select_two_matchers(spark: SparkSession, folder: str) -> DataFrame:
    return Store.of(spark, folder).select([Equal("__name__", "supply_volts"), Equal("dc", "dc-a")])


@query(_picked(f"regexp_full_match({_lab('host')}, '(heron|larch)-0000.*')"))
def select_regex(spark: SparkSession, folder: str) -> DataFrame:
    return Store.of(spark, folder).select([Regex("host", "(heron|larch)-0000.*")])


@query(_picked(f"{_lab('__name__')} = 'volume_used_pct' AND {_lab('dc')} <> 'dc-a'"))
def select_not_equal(spark: SparkSession, folder: str) -> DataFrame:
    return Store.of(spark, folder).select([Equal("__name__", "volume_used_pct"), Not(Equal("dc", "dc-a"))])


@query(_picked(f"NOT regexp_full_match({_lab('__name__')}, '.*_(pct|sum|ratio)') AND {_lab('__name__')} <> 'gateway_rtt_ms'"))
def select_not_regex(spark: SparkSession, folder: str) -> DataFrame:
    return Store.of(spark, folder).select([Not(Regex("__name__", ".*_(pct|sum|ratio)")), Not(Equal("__name__", "gateway_rtt_ms"))])


@query(_picked(f"{_lab('rack')} = '' AND {_lab('__name__')} = 'fan_speed_rpm'"))
def select_empty_label(spark: SparkSession, folder: str) -> DataFrame:
    return Store.of(spark, folder).select([Equal("rack", ""), Equal("__name__", "fan_speed_rpm")])


@query(_picked(f"regexp_full_match({_lab('rack')}, '(r1.*)?') AND {_lab('__name__')} = 'fan_speed_rpm'"))
def select_regex_with_empty(spark: SparkSession, folder: str) -> DataFrame:
    return Store.of(spark, folder).select([Regex("rack", "(r1.*)?"), Equal("__name__", "fan_speed_rpm")])


@query(_picked("false"))
def select_no_match(spark: SparkSession, folder: str) -> DataFrame:
    return Store.of(spark, folder).select([Equal("host", "nobody")])


@query(_picked("false"))
def select_without_matchers(spark: SparkSession, folder: str) -> DataFrame:
    return Store.of(spark, folder).select([])


@query(_picked("false"))
def select_invalid_pattern(spark: SparkSession, folder: str) -> DataFrame:
    return Store.of(spark, folder).select([Equal("__name__", "core_load_pct"), Regex("host", "*")])


@query(_picked(f"{_lab('rack')} <> '' AND {_lab('__name__')} = 'fan_speed_rpm'"))
def select_regex_newline(spark: SparkSession, folder: str) -> DataFrame:
    """Hosts without a rack get a line break at their end here: `.*` doesn't cover it, and the end of the value is its very end."""
    store = Store.of(spark, folder)
    host = F.concat(F.coalesce(F.try_element_at("labels", F.lit("host")), F.lit("")), F.when(F.coalesce(F.try_element_at("labels", F.lit("rack")), F.lit("")) == "", F.lit("\n")).otherwise(F.lit("")))
    series = store.series.withColumn("labels", F.map_concat(F.map_filter("labels", lambda k, _: k != "host"), F.create_map(F.lit("host"), host)))
    return Store(series, store.samples).select([Regex("host", ".*"), Equal("__name__", "fan_speed_rpm")])


@query(_picked(f"regexp_full_match({_lab('host')}, '[a-z]+-0000.*') AND {_lab('__name__')} = 'volume_used_pct'"))
def select_regex_own_dialect(spark: SparkSession, folder: str) -> DataFrame:
    r"""A pattern of the engine's dialect alone: `\p{Lower}` and a possessive quantifier."""
    return Store.of(spark, folder).select([Regex("host", r"\p{Lower}++-0000.*"), Equal("__name__", "volume_used_pct")])


@query(_picked("false"))
def select_regex_other_dialect(spark: SparkSession, folder: str) -> DataFrame:
    """A named group as other dialects write it isn't valid here, so it matches nothing."""
    return Store.of(spark, folder).select([Regex("host", "(?P<n>.*)")])


@query(_picked("false"))
def select_parity_unknown_label(spark: SparkSession, folder: str) -> DataFrame:
    """A label name without values selects nothing in this mode, even for a matcher that accepts ''."""
    return Store.of(spark, folder).select([Equal("no_such_label", "")], parity=True)


@query(_picked("r.ts_ms >= 0 AND r.ts_ms <= 1389000000000"))
def select_parity_from_zero(spark: SparkSession, folder: str) -> DataFrame:
    return Store.of(spark, folder).select([everything()], -1_000_000, 1_389_000_000_000, parity=True)


@query(_picked("true"))
def select_all(spark: SparkSession, folder: str) -> DataFrame:
    """All samples of registered series."""
    store = Store.of(spark, folder)
    return store.select([everything()])


@query(_picked(f"r.ts_ms BETWEEN {END - DAY} AND {END}"))
def select_range_closed(spark: SparkSession, folder: str) -> DataFrame:
    return Store.of(spark, folder).select([everything()], END - DAY, END)


@query(f"{_BASE} SELECT r.series_id, {_lab('host')} AS host, r.ts_ms, r.value FROM r JOIN s ON s.series_id = r.series_id WHERE {_lab('__name__')} = 'heap_live_bytes'")
def select_with_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = Store.of(spark, folder).select([Equal("__name__", "heap_live_bytes")], with_labels=True)
    return rows.select("series_id", F.coalesce(F.try_element_at("labels", F.lit("host")), F.lit("")).alias("host"), "ts_ms", "value")


@query(f"WITH {_S} SELECT x.series_id, x.ts_ms, x.value, x.seq FROM samples x JOIN s ON s.series_id = x.series_id WHERE starts_with({_lab('host')}, 'opal') AND x.ts_ms IS NOT NULL AND x.value IS NOT NULL")
def chain_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Every arrived row, repeated times too."""
    return Store.of(spark, folder).chain([Prefix("host", "opal")])


@query(f"{_BASE} SELECT r.series_id, min(r.ts_ms) AS ts_ms, min_by(r.value, r.ts_ms) AS value FROM r JOIN s ON s.series_id = r.series_id WHERE r.ts_ms >= {END} GROUP BY r.series_id")
def seek_first_ge(spark: SparkSession, folder: str) -> DataFrame:
    return Store.of(spark, folder).seek([everything()], END)


@query(f"{_BASE} SELECT r.series_id AS id, r.ts_ms AS t, r.value AS v, {_lab('host')} AS host FROM r JOIN s ON s.series_id = r.series_id WHERE {_lab('__name__')} = 'volume_used_pct' AND r.ts_ms BETWEEN {END - DAY} AND {END}")
def request_response(spark: SparkSession, folder: str) -> DataFrame:
    """The nested response, flattened again."""
    out = Store.of(spark, folder).respond([Equal("__name__", "volume_used_pct")], END - DAY, END)
    host = F.coalesce(F.try_element_at(F.map_from_entries(F.transform("metric", lambda e: F.struct(e["name"], e["value"]))), F.lit("host")), F.lit(""))
    return out.select("id", host.alias("host"), F.inline("values"))


# Labels and postings


@query(f"WITH {_S}, {_L} SELECT DISTINCT name FROM l UNION SELECT 'ALL_POSTINGS'")
def label_names(spark: SparkSession, folder: str) -> DataFrame:
    return Store.of(spark, folder).label_names()


@query(f"WITH {_S}, {_L} SELECT DISTINCT value FROM l WHERE name = 'host'")
def label_values(spark: SparkSession, folder: str) -> DataFrame:
    return Store.of(spark, folder).label_values("host")


@query(f"WITH {_S}, {_L} SELECT name AS symbol FROM l UNION SELECT value FROM l")
def symbols(spark: SparkSession, folder: str) -> DataFrame:
    return Store.of(spark, folder).symbols()


@query(f"WITH {_S}, {_L} SELECT name, value, count(DISTINCT series_id) AS n FROM l GROUP BY name, value UNION ALL SELECT 'ALL_POSTINGS', 'ALL_POSTINGS', count(*) FROM s")
def postings_per_value(spark: SparkSession, folder: str) -> DataFrame:
    return Store.of(spark, folder).postings_sizes()


@query(f"WITH {_S}, {_L} SELECT DISTINCT series_id FROM l WHERE name = 'job' AND value = 'node-probe'")
def postings_get(spark: SparkSession, folder: str) -> DataFrame:
    return Store.of(spark, folder).postings("job", "node-probe")


def _lists(spark: SparkSession, folder: str) -> list[DataFrame]:
    store = Store.of(spark, folder)
    return [store.postings("job", "node-probe"), store.postings("dc", "dc-a")]


_A, _B = ("SELECT series_id FROM l WHERE name = 'job' AND value = 'node-probe'", "SELECT series_id FROM l WHERE name = 'dc' AND value = 'dc-a'")


@query(f"WITH {_S}, {_L} {_A} INTERSECT {_B}")
def postings_intersect(spark: SparkSession, folder: str) -> DataFrame:
    return postings.intersect(_lists(spark, folder))


@query(f"WITH {_S}, {_L} {_A} UNION {_B}")
def postings_union(spark: SparkSession, folder: str) -> DataFrame:
    return postings.union(_lists(spark, folder))


@query(f"WITH {_S}, {_L} {_A} EXCEPT {_B}")
def postings_except(spark: SparkSession, folder: str) -> DataFrame:
    return postings.subtract(*_lists(spark, folder))


@query(f"WITH {_S}, {_L} SELECT min(series_id) AS series_id FROM l WHERE name = 'dc' AND value = 'dc-a' AND series_id >= 1100 HAVING min(series_id) IS NOT NULL")
def postings_seek(spark: SparkSession, folder: str) -> DataFrame:
    return postings.seek(_lists(spark, folder)[1], 1100)


@query(f"WITH {_S}, {_L} SELECT name, count(*) AS n FROM (SELECT DISTINCT name, value, series_id FROM l EXCEPT ({_B.replace('series_id', 'name, value, series_id')})) GROUP BY name UNION ALL SELECT 'ALL_POSTINGS', count(*) FROM s")
def postings_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Entries left for each name when those of one label are deleted."""
    index = Store.of(spark, folder).label_index()
    return postings.delete(index, index.where("name = 'dc' and value = 'dc-a'")).groupBy("name").agg(F.count("*").alias("n"))


_PAIR = "array_to_string(list_transform(list_sort(map_keys({0})), lambda k: k || '=' || {0}[k]), ',')"


@query(f"WITH {_S} SELECT series_id, '{{' || {_PAIR.format('labels')} || '}}' AS labels FROM s")
def labels_string(spark: SparkSession, folder: str) -> DataFrame:
    return Store.of(spark, folder).series.select("series_id", as_string(F.col("labels")).alias("labels"))


@query(f"WITH {_S}, e AS (SELECT series_id, list_sort(list_filter(list_distinct(list_concat(map_keys(labels), ['rack'])), lambda k: k <> 'slot')) AS ks, labels FROM s) SELECT series_id, '{{' || array_to_string(list_transform(ks, lambda k: k || '=' || coalesce(labels[k], 'none')), ',') || '}}' AS labels FROM e")
def labels_add_delete(spark: SparkSession, folder: str) -> DataFrame:
    """A rack for those without one; no slot for anyone."""
    changed = without_label(with_label(F.col("labels"), "rack", "none"), "slot")
    return Store.of(spark, folder).series.select("series_id", as_string(changed).alias("labels"))


@query(f"WITH {_S}, o AS (SELECT series_id, list_transform(list_sort(map_keys(labels)), lambda k: {{'name': k, 'value': labels[k]}}) AS a FROM s) SELECT series_id, row_number() OVER (ORDER BY a, series_id) AS place FROM o")
def series_sorted(spark: SparkSession, folder: str) -> DataFrame:
    """The place of each series in the order of label sets."""
    rows = Store.of(spark, folder).series.withColumn("label_arr", canonical(F.col("labels")))
    # Ranks over range partitions: local row numbers plus the rows of the partitions before; no task holds all series.
    parts = written(rows.select("label_arr", "series_id").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "label_arr", "series_id").withColumn("_p", F.spark_partition_id()), "ranked")
    sums = parts.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    local = parts.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy("label_arr", "series_id")))
    return local.join(F.broadcast(sums.select("_p", "_off")), "_p").select("series_id", (F.col("_off") + F.col("_r")).alias("place"))


def _finite_mean(x: str) -> str:
    return f"{double_sql(f'coalesce(sum({exact_sql(x)}) FILTER (WHERE isfinite({x})), 0)')} / nullif(count(*) FILTER (WHERE isfinite({x})), 0)"


@query(f"{_BASE}, k AS (SELECT series_id, '{{' || array_to_string(list_transform(list_sort(list_filter(map_keys(labels), lambda k: k = 'dc' OR k = 'job')), lambda k: k || '=' || labels[k]), ',') || '}}' AS key FROM s) SELECT k.key, count(*) AS n, max(r.ts_ms) AS last_ms FROM r JOIN k ON k.series_id = r.series_id GROUP BY k.key")
def labels_by(spark: SparkSession, folder: str) -> DataFrame:
    store = Store.of(spark, folder)
    return agg.by_labels(latest(store.samples), store.series, ["dc", "job"], [F.count("*").alias("n"), F.max("ts_ms").alias("last_ms")])


@query(f"{_BASE}, k AS (SELECT series_id, '{{' || array_to_string(list_transform(list_sort(list_filter(map_keys(labels), lambda k: k NOT IN ('slot', 'host', '__name__'))), lambda k: k || '=' || labels[k]), ',') || '}}' AS key FROM s) SELECT k.key, count(*) AS n, max(r.ts_ms) AS last_ms FROM r JOIN k ON k.series_id = r.series_id GROUP BY k.key")
def labels_without(spark: SparkSession, folder: str) -> DataFrame:
    store = Store.of(spark, folder)
    return agg.without_labels(latest(store.samples), store.series, ["slot", "host"], [F.count("*").alias("n"), F.max("ts_ms").alias("last_ms")])


# The benchmark's aggregates


def _hosts(store: Store, n: int, metrics: tuple[str, ...], span: tuple[int, int]) -> tuple[str, ...]:
    """The first hosts, in order of name, that have readings of the metrics in the range: the benchmark's choice of hosts."""
    rows = agg.labelled(store.chain([AnyOf("__name__", metrics), Not(Equal("host", ""))], *span), store.series, ["host"])
    return tuple(r[0] for r in rows.select("host").distinct().orderBy("host").limit(n).collect())


def _tsbs(metrics: tuple[str, ...], hosts: int | None, hours: int | None, width: int, mean: bool = False) -> tuple[Query, str]:
    names = ", ".join(f"'{m}'" for m in metrics)
    when = f"AND r.ts_ms BETWEEN {END - hours * HOUR} AND {END}" if hours else ""
    chosen = f"AND {_lab('host')} IN (SELECT host FROM h)" if hosts else ""
    what = f"{_finite_mean('r.value')} AS mean_value" if mean else "max(r.value) AS max_value"
    sql = f"""{_BASE}, h AS (SELECT DISTINCT {_lab('host')} AS host FROM r JOIN s ON s.series_id = r.series_id WHERE {_lab('__name__')} IN ({names}) AND {_lab('host')} <> '' {when} ORDER BY host LIMIT {hosts or 1})
SELECT {_lab('host')} AS host, {_lab('__name__')} AS metric, r.ts_ms - ((r.ts_ms % {width}) + {width}) % {width} AS bucket_ms, {what} FROM r JOIN s ON s.series_id = r.series_id WHERE {_lab('__name__')} IN ({names}) {when} {chosen} GROUP BY 1, 2, 3"""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        store = Store.of(spark, folder)
        matchers = [AnyOf("__name__", metrics)]
        span = (END - hours * HOUR, END) if hours else (-(2**63), 2**63 - 1)
        if hosts:
            matchers.append(AnyOf("host", _hosts(store, hosts, metrics, span)))
        rows = agg.labelled(store.select(matchers, *span), store.series, ["host", "__name__"])
        if mean:
            return agg.mean_by_bucket(rows, width, ["host", "metric"])
        return agg.max_by_bucket(rows, width, ["host", "metric"])

    return run, sql


for _name, _args in {
    "tsbs_1_1_1": (FIVE[:1], 1, 1, 300_000), "tsbs_1_1_12": (FIVE[:1], 1, 12, 300_000), "tsbs_1_1_24": (FIVE[:1], 1, 24, 300_000), "tsbs_1_1_all": (FIVE[:1], 1, None, 300_000),
    "tsbs_1_8_1": (FIVE[:1], 8, 1, 300_000), "tsbs_5_1_1": (FIVE, 1, 1, 300_000), "tsbs_5_1_12": (FIVE, 1, 12, 300_000), "tsbs_5_1_24": (FIVE, 1, 24, 300_000), "tsbs_5_1_all": (FIVE, 1, None, 300_000),
    "tsbs_5_8_1": (FIVE, 8, 1, 300_000), "cpu_max_all_8": (GAUGES, 8, 1, HOUR), "double_groupby_5": (FIVE, None, None, HOUR, True), "double_groupby_all": (GAUGES, None, None, HOUR, True),
}.items():
    _QUERIES[_name], _SQL[_name] = _tsbs(*_args)


@query(f"{_BASE}, t AS (SELECT {_lab('host')} AS host, {_lab('__name__')} AS metric, r.ts_ms, max(r.value) AS value FROM r JOIN s ON s.series_id = r.series_id GROUP BY 1, 2, 3) SELECT host, metric, max(ts_ms) AS ts_ms, max_by(value, ts_ms) AS value FROM t GROUP BY host, metric")
def lastpoint(spark: SparkSession, folder: str) -> DataFrame:
    store = Store.of(spark, folder)
    return agg.last_point(agg.labelled(store.select([everything()]), store.series, ["host", "__name__"]), ["host", "metric"])


@query(f"{_BASE} SELECT {_lab('host')} AS host, r.ts_ms, r.value FROM r JOIN s ON s.series_id = r.series_id WHERE {_lab('__name__')} = 'core_load_pct' AND r.value > 90 AND isfinite(r.value)")
def high_cpu_all(spark: SparkSession, folder: str) -> DataFrame:
    """Readings above 90 %, the threshold of the public benchmark's definition."""
    store = Store.of(spark, folder)
    return agg.above(agg.labelled(store.select([Equal("__name__", "core_load_pct")]), store.series, ["host"]), 90.0).select("host", "ts_ms", "value")


@query(f"{_BASE}, a AS (SELECT {_lab('host')} AS host, r.ts_ms, r.value FROM r JOIN s ON s.series_id = r.series_id WHERE {_lab('__name__')} = 'core_load_pct' AND r.value > 90 AND isfinite(r.value)) SELECT * FROM a WHERE host = (SELECT min(host) FROM a)")
def high_cpu_1(spark: SparkSession, folder: str) -> DataFrame:
    """The same of one host, the first that has any."""
    rows = high_cpu_all(spark, folder)
    host = rows.agg(F.min("host")).first()[0]
    return rows.where(F.col("host") == F.lit(host))


@query(f"{_BASE} SELECT r.series_id, count(*) AS n, min(r.ts_ms) AS min_t, max(r.ts_ms) AS max_t FROM r GROUP BY r.series_id")
def sample_count(spark: SparkSession, folder: str) -> DataFrame:
    return latest(table(spark, folder, "samples")).groupBy("series_id").agg(F.count("*").alias("n"), F.min("ts_ms").alias("min_t"), F.max("ts_ms").alias("max_t"))


@query(f"""{_BASE}, b AS (SELECT {_lab('host')} AS host, {_lab('__name__')} AS metric, r.ts_ms - ((r.ts_ms % {HOUR}) + {HOUR}) % {HOUR} AS bucket_ms, max(r.value) AS v FROM r JOIN s ON s.series_id = r.series_id WHERE {_lab('__name__')} IN ('chassis_temp_c', 'fan_speed_rpm') GROUP BY 1, 2, 3)
SELECT host, bucket_ms, max(CASE WHEN metric = 'chassis_temp_c' THEN v END) AS chassis_temp_c, max(CASE WHEN metric = 'fan_speed_rpm' THEN v END) AS fan_speed_rpm FROM b GROUP BY host, bucket_ms""")
def pivot_two_metrics(spark: SparkSession, folder: str) -> DataFrame:
    store, two = Store.of(spark, folder), ("chassis_temp_c", "fan_speed_rpm")
    rows = agg.labelled(store.select([AnyOf("__name__", two)]), store.series, ["host", "__name__"])
    return agg.pivot_metrics(agg.max_by_bucket(rows, HOUR, ["host", "metric"]), two, ["host", "bucket_ms"], "max_value")


@query(f"SELECT event_type AS metric, CAST(user_id AS VARCHAR) AS \"user\", (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % {HOUR} AS bucket_ms, max(value) AS max_value FROM events GROUP BY 1, 2, 3")
def events_hourly_max(spark: SparkSession, folder: str) -> DataFrame:
    return agg.max_by_bucket(datasets.events(spark, folder), HOUR, ["metric", "user"])


@query("SELECT l_suppkey, metric, max(value) AS max_value, count(*) AS n FROM (SELECT l_suppkey, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS metric, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem) WHERE value IS NOT NULL GROUP BY 1, 2")
def unpivot_max(spark: SparkSession, folder: str) -> DataFrame:
    rows = loaders.unpivot(table(spark, folder, "lineitem"), ["l_suppkey"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rows.groupBy("l_suppkey", "metric").agg(F.max("value").alias("max_value"), F.count("*").alias("n"))


@query("SELECT l_orderkey * 8 + l_linenumber AS group_id, unnest(['quantity', 'price']) AS slot, unnest([l_quantity, l_extendedprice]) AS value FROM lineitem")
def group_explode(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("group_id"), F.lit(0).alias("ts_ms"), F.array(F.lit("quantity"), F.lit("price")).alias("slots"), F.array("l_quantity", "l_extendedprice").alias("values"))
    return loaders.groups(rows).select("group_id", "slot", "value")


@query("SELECT CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, count(*) AS n FROM events WHERE props IS NOT NULL GROUP BY 1")
def json_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Label sets from JSON objects, counted by one label."""
    return loaders.json_series(table(spark, folder, "events"), "props").groupBy(F.try_element_at("labels", F.lit("k")).alias("k")).agg(F.count("*").alias("n"))


# Sources merged


def _newer(rows: DataFrame) -> DataFrame:
    """A newer block over two days: the same times with other values."""
    return rows.where(F.col("ts_ms").between(END - DAY, END + DAY) & F.col("value").isNotNull()).withColumn("value", F.lit(0.5))


_N = f"n AS (SELECT series_id, ts_ms, 0.5 AS value FROM r WHERE ts_ms BETWEEN {END - DAY} AND {END + DAY})"


@query(f"WITH {_R} SELECT series_id, ts_ms, CASE WHEN ts_ms BETWEEN {END - DAY} AND {END + DAY} THEN 0.5 ELSE value END AS value FROM r")
def merge_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "samples")
    return merge_stores([rows, _newer(rows)])


@query(f"WITH {_R}, {_N} SELECT series_id, ts_ms, value FROM r UNION ALL SELECT series_id, ts_ms, value FROM n")
def chain_concat(spark: SparkSession, folder: str) -> DataFrame:
    rows = latest(table(spark, folder, "samples"))
    return chain_stores([rows, _newer(rows)])


@query(f"WITH {_R} SELECT series_id, ts_ms, CASE WHEN ts_ms >= {END - DAY} THEN 1.5 ELSE value END AS value FROM r")
def vertical_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Two overlapping chunks: at equal times the second wins."""
    rows = latest(table(spark, folder, "samples"))
    return merge_stores([rows.where(F.col("ts_ms") <= END), rows.where(F.col("ts_ms") >= END - DAY).withColumn("value", F.lit(1.5))])


@query(f"{_BASE} SELECT '{{' || {_PAIR.format('s.labels')} || '}}' AS labels, count(*) AS n, max(r.ts_ms) AS last_ms FROM r JOIN s ON s.series_id = r.series_id GROUP BY 1")
def align_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Two stores that number the same series differently, matched by labels."""
    a = Store.of(spark, folder)
    b = Store(a.series.withColumn("series_id", F.col("series_id") + 1_000_000), a.samples.withColumn("series_id", F.col("series_id") + 1_000_000).where(F.col("ts_ms") >= END))
    rows = align_by_labels([a, b])
    key = F.concat(F.lit("{"), F.array_join(F.transform("label_arr", lambda e: F.concat(e["name"], F.lit("="), e["value"])), ","), F.lit("}"))
    return rows.groupBy(key.alias("labels")).agg(F.count("*").alias("n"), F.max("ts_ms").alias("last_ms"))


@query(f"WITH {_R} SELECT series_id, ts_ms, value FROM r")
def codec_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """All readings through compressed chunks and back."""
    return from_chunks(to_chunks(latest(table(spark, folder, "samples")), width=DAY))


# Deletion

_T = """d AS (SELECT DISTINCT series_id, min_t, max_t FROM tombstones WHERE series_id IS NOT NULL AND min_t <= max_t),
dp AS (SELECT *, max(max_t) OVER (PARTITION BY series_id ORDER BY min_t, max_t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM d),
dg AS (SELECT *, sum(CASE WHEN seen IS NULL OR min_t > seen + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY min_t, max_t ROWS UNBOUNDED PRECEDING) AS k FROM dp),
u AS (SELECT series_id, min(min_t) AS min_t, max(max_t) AS max_t FROM dg GROUP BY series_id, k)"""


@query(f"WITH {_T} SELECT series_id, min_t, max_t FROM u")
def tombstone_union(spark: SparkSession, folder: str) -> DataFrame:
    return tombstones.union(table(spark, folder, "tombstones"))


@query(f"WITH {_T} SELECT series_id, count(*) AS n FROM u GROUP BY series_id")
def tombstone_count(spark: SparkSession, folder: str) -> DataFrame:
    return tombstones.count(table(spark, folder, "tombstones"))


@query(f"{_BASE} SELECT r.series_id, r.ts_ms, r.value FROM r JOIN s ON s.series_id = r.series_id WHERE NOT EXISTS (SELECT 1 FROM tombstones t WHERE t.series_id = r.series_id AND r.ts_ms BETWEEN t.min_t AND t.max_t)")
def tombstone_apply(spark: SparkSession, folder: str) -> DataFrame:
    return Store.of(spark, folder).deleting(table(spark, folder, "tombstones")).select([everything()])


@query(f"{_BASE}, b AS (SELECT r.series_id, min(r.ts_ms) AS a, max(r.ts_ms) AS z FROM r JOIN s ON s.series_id = r.series_id WHERE {_lab('job')} = 'node-probe' GROUP BY r.series_id) SELECT series_id, greatest(a, {END - DAY}) AS min_t, least(z, {END}) AS max_t FROM b WHERE greatest(a, {END - DAY}) <= least(z, {END})")
def delete_clamped(spark: SparkSession, folder: str) -> DataFrame:
    return tombstones.delete(Store.of(spark, folder), [Equal("job", "node-probe")], END - DAY, END)


# Blocks

_V = "v AS (SELECT store_dir, ulid, min_t, max_t, min(level) AS level, arg_min(sources, level) AS sources, bool_or(coalesce(failed, false)) AS failed, max(num_series) AS num_series, max(num_tombstones) AS num_tombstones FROM blocks WHERE min_t < max_t GROUP BY store_dir, ulid, min_t, max_t)"
_O = """op AS (SELECT *, max(max_t) OVER (PARTITION BY store_dir ORDER BY min_t, max_t, ulid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM v),
og AS (SELECT *, sum(CASE WHEN seen IS NULL OR min_t >= seen THEN 1 ELSE 0 END) OVER (PARTITION BY store_dir ORDER BY min_t, max_t, ulid ROWS UNBOUNDED PRECEDING) AS k FROM op),
oc AS (SELECT *, count(*) OVER (PARTITION BY store_dir, k) AS n FROM og), ov AS (SELECT *, dense_rank() OVER (PARTITION BY store_dir ORDER BY k) - 1 AS island FROM oc WHERE n > 1)"""


@query(f"WITH {_V}, {_O} SELECT store_dir, ulid, min_t, max_t, island FROM ov")
def block_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    return compaction.overlap_groups(table(spark, folder, "blocks")).select("store_dir", "ulid", "min_t", "max_t", F.col("island").cast("long").alias("island"))


@query(f"WITH {_V}, {_O} SELECT store_dir, ulid FROM ov WHERE island = 0")
def block_first_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return compaction.first_overlap(table(spark, folder, "blocks")).select("store_dir", "ulid")


@query(f"WITH {_V} SELECT store_dir, ulid, min_t - ((min_t % 36000000) + 36000000) % 36000000 AS range_start FROM v WHERE max_t <= min_t - ((min_t % 36000000) + 36000000) % 36000000 + 36000000")
def compaction_split(spark: SparkSession, folder: str) -> DataFrame:
    return compaction.split_by_range(table(spark, folder, "blocks"), 36_000_000).select("store_dir", "ulid", "range_start")


def _plan_sql() -> str:
    ranges, parts = scalars.block_ranges(), []
    for i, w in enumerate(ranges[1:], 1):
        parts.append(f"""h{i} AS (SELECT *, min_t - ((min_t % {w}) + {w}) % {w} AS st FROM old), i{i} AS (SELECT * FROM h{i} WHERE max_t <= st + {w}),
g{i} AS (SELECT store_dir, min(st) AS st FROM (SELECT store_dir, st FROM i{i} GROUP BY store_dir, st HAVING count(*) > 1 AND NOT bool_or(failed) AND (max(max_t) - min(min_t) = {w} OR max(max_t) <= min(high))) GROUP BY store_dir),
p{i} AS (SELECT i.store_dir, i.ulid, {i} AS r, 'range' AS reason FROM i{i} i JOIN g{i} g ON g.store_dir = i.store_dir AND g.st = i.st)""")
    mid, n = ranges[len(ranges) // 2], len(ranges)
    return f"""WITH {_V}, {_O}, nw AS (SELECT *, max(min_t) OVER (PARTITION BY store_dir) AS newest FROM v), old AS (SELECT *, max(min_t) OVER (PARTITION BY store_dir) AS high FROM nw WHERE min_t < newest),
{", ".join(parts)}, bk AS (SELECT *, min(max_t - min_t) OVER (PARTITION BY store_dir ORDER BY min_t DESC, max_t DESC, ulid DESC ROWS UNBOUNDED PRECEDING) AS sh FROM old),
ts AS (SELECT store_dir, ulid, {n} AS r, 'tombstones' AS reason FROM (SELECT *, row_number() OVER (PARTITION BY store_dir ORDER BY min_t DESC, max_t DESC, ulid DESC) AS k FROM bk WHERE sh >= {mid} AND num_tombstones > 0.05 * num_series) WHERE k = 1),
al AS (SELECT store_dir, ulid, 0 AS r, 'overlap' AS reason FROM ov WHERE island = 0 {" ".join(f"UNION ALL SELECT store_dir, ulid, r, reason FROM p{i}" for i in range(1, n))} UNION ALL SELECT store_dir, ulid, r, reason FROM ts),
be AS (SELECT *, min(r) OVER (PARTITION BY store_dir) AS best FROM al) SELECT DISTINCT store_dir, ulid, reason FROM be WHERE r = best"""


@query(_plan_sql())
def compaction_plan(spark: SparkSession, folder: str) -> DataFrame:
    return compaction.plan(table(spark, folder, "blocks"), scalars.block_ranges())


@query(f"""WITH {_V}, m AS (SELECT store_dir, min(min_t) AS min_t, max(max_t) AS max_t, max(level) + 1 AS level, CAST(sum(num_series) AS BIGINT) AS num_series, CAST(sum(num_tombstones) AS BIGINT) AS num_tombstones, count(*) AS parents FROM v GROUP BY store_dir),
x AS (SELECT store_dir, array_to_string(list_sort(list_distinct(list(src))), ',') AS sources FROM (SELECT store_dir, unnest(sources) AS src FROM v) WHERE src IS NOT NULL GROUP BY store_dir)
SELECT m.*, coalesce(x.sources, '') AS sources FROM m LEFT JOIN x ON x.store_dir = m.store_dir""")
def compaction_meta(spark: SparkSession, folder: str) -> DataFrame:
    out = compaction.merged_meta(table(spark, folder, "blocks"))
    return out.select("store_dir", "min_t", "max_t", "level", "num_series", "num_tombstones", F.size("parents").cast("long").alias("parents"), F.array_join("sources", ",").alias("sources"))


@query(f"WITH {_V} SELECT store_dir, ulid FROM v WHERE min_t <= {END} AND max_t > {END - DAY}")
def blocks_overlapping(spark: SparkSession, folder: str) -> DataFrame:
    return compaction.overlapping(table(spark, folder, "blocks"), END - DAY, END).select("store_dir", "ulid")


@query(f"WITH {_R}, {_N}, m AS (SELECT r.series_id, r.ts_ms, coalesce(n.value, r.value) AS value FROM r LEFT JOIN n ON n.series_id = r.series_id AND n.ts_ms = r.ts_ms) SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM tombstones t WHERE t.series_id = m.series_id AND m.ts_ms BETWEEN t.min_t AND t.max_t)")
def compaction_populate(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "samples")
    return compaction.populate([rows, _newer(rows)], table(spark, folder, "tombstones"))


@query(f"WITH {_R}, p AS (SELECT series_id, ts_ms - ((ts_ms % {DAY}) + {DAY}) % {DAY} AS part, count(*) AS n, min(ts_ms) AS a, max(ts_ms) AS b FROM r GROUP BY 1, 2) SELECT part, CAST(sum(n) AS BIGINT) AS num_samples, count(*) AS num_series, CAST(sum(ceil(n / 120.0)) AS BIGINT) AS num_chunks, min(a) AS min_t, max(b) AS max_t FROM p GROUP BY part")
def block_stats(spark: SparkSession, folder: str) -> DataFrame:
    return compaction.stats(latest(table(spark, folder, "samples")), DAY)


@query("SELECT ts_ms - ((ts_ms % 1800000) + 1800000) % 1800000 AS part, ts_ms - ((ts_ms % 1800000) + 1800000) % 1800000 + 1800000 AS part_end, count(*) AS n FROM samples WHERE ts_ms IS NOT NULL GROUP BY 1, 2")
def partition_counts(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("ts_ms")
    return table(spark, folder, "samples").where("ts_ms is not null").groupBy(scalars.partition_of(t).alias("part"), scalars.range_end(t, scalars.PARTITION_MS).alias("part_end")).agg(F.count("*").alias("n"))


@query(f"WITH {_R}, m AS (SELECT max(ts_ms) AS t FROM r) SELECT series_id, ts_ms, value FROM r WHERE ts_ms >= (SELECT t FROM m) - {scalars.RETENTION_MS}")
def retention_drop(spark: SparkSession, folder: str) -> DataFrame:
    rows = latest(table(spark, folder, "samples"))
    newest = table(spark, folder, "samples").where("series_id is not null and value is not null").agg(F.max("ts_ms")).first()[0]
    return compaction.retained(rows, scalars.RETENTION_MS, newest or 0)


@query(f"WITH {_S}, k AS (SELECT series_id FROM s WHERE {_lab('job')} <> ''), c AS (SELECT 'series' AS kind, count(*) AS n FROM k UNION ALL SELECT 'samples', count(*) FROM samples x JOIN k ON k.series_id = x.series_id WHERE x.ts_ms >= {END} UNION ALL SELECT 'tombstones', count(*) FROM tombstones WHERE max_t >= {END}) SELECT kind, n FROM c")
def checkpoint_filter(spark: SparkSession, folder: str) -> DataFrame:
    store = Store.of(spark, folder)
    keep = store.matching([Not(Equal("job", ""))]).select("series_id")
    parts = compaction.checkpoint(store.series, store.samples, table(spark, folder, "tombstones"), keep, END)
    counts = [p.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, p in zip(("series", "samples", "tombstones"), parts, strict=True)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(f"WITH m AS (SELECT series_id, max(seq) AS mark FROM samples WHERE series_id IS NOT NULL AND ts_ms < {END} GROUP BY series_id) SELECT x.series_id, x.ts_ms, x.value, x.seq FROM samples x LEFT JOIN m ON m.series_id = x.series_id WHERE x.series_id IS NOT NULL AND (m.mark IS NULL OR x.seq > m.mark)")
def log_clean(spark: SparkSession, folder: str) -> DataFrame:
    """What a log keeps once all inserts up to each series' last one before a time are flushed."""
    rows = table(spark, folder, "samples")
    marks = rows.where(F.col("ts_ms") < END).groupBy("series_id").agg(F.max("seq").alias("flushed_seq"))
    return compaction.unflushed(rows, marks).select("series_id", "ts_ms", "value", "seq")


@query(f"SELECT min(t) AS t, min(a) AS a, min(b) AS b FROM (SELECT series_id AS t, greatest(min_t, {END - 7 * DAY}) AS a, least(max_t, {END + 7 * DAY}) AS b FROM tombstones WHERE greatest(min_t, {END - 7 * DAY}) <= least(max_t, {END + 7 * DAY})) GROUP BY t, a, b")
def clamp_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Deleted ranges clipped to two weeks."""
    rows = table(spark, folder, "tombstones").select(F.col("series_id").alias("t"), scalars.clamp(F.col("min_t"), F.col("max_t"), END - 7 * DAY, END + 7 * DAY).alias("c")).where("c is not null")
    return rows.select("t", "c.a", "c.b").distinct()


# Ordered map

_KV = "e AS (SELECT encode(value) AS k, value AS key, seq, CASE WHEN series_id = 17 THEN 0 ELSE 1 END AS type, CAST(series_id AS VARCHAR) AS val FROM tags WHERE name = 'path' AND value IS NOT NULL AND seq IS NOT NULL)"


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    """The tag `path` as keys: each insert sets the key to its series, series 17 deletes it."""
    rows = table(spark, folder, "tags").where("name = 'path'")
    return rows.select(F.encode("value", "UTF-8").alias("key"), "seq", F.when(F.col("series_id") == 17, 0).otherwise(1).cast("tinyint").alias("type"), F.encode(F.col("series_id").cast("string"), "UTF-8").alias("value"))


def _text(rows: DataFrame) -> DataFrame:
    return rows.select(F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"))


def _last(more: str = "") -> str:
    return f"x AS (SELECT key, max_by(type, seq * 2 + type) AS type, max_by(val, seq * 2 + type) AS value FROM e {more} GROUP BY key)"


@query(f"WITH {_KV}, {_last()} SELECT key, value FROM x WHERE type = 1 AND key = '/v2/cellar/probe'")
def kv_get(spark: SparkSession, folder: str) -> DataFrame:
    return _text(kv.get(_entries(spark, folder), b"/v2/cellar/probe"))


@query(f"WITH {_KV}, {_last()} SELECT key, value FROM x WHERE type = 1 AND key >= '/v1/' AND key < '/v2/'")
def kv_scan(spark: SparkSession, folder: str) -> DataFrame:
    return _text(kv.scan(_entries(spark, folder), F.lit(bytearray(b"/v1/")), F.lit(bytearray(b"/v2/"))))


@query(f"WITH {_KV}, {_last()} SELECT key, value FROM x WHERE type = 1 ORDER BY key DESC LIMIT 100")
def kv_reverse_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The last hundred keys, from the end."""
    return _text(kv.scan(_entries(spark, folder), reverse=True).limit(100))


@query(f"WITH {_KV}, {_last()} SELECT key, value FROM x WHERE type = 1 ORDER BY key DESC")
def kv_reverse_scan_all(spark: SparkSession, folder: str) -> DataFrame:
    """All keys, from the end."""
    return _text(kv.scan(_entries(spark, folder), reverse=True))


@query(f"WITH {_KV}, q AS (SELECT max(seq) // 2 AS pos FROM tags), {_last('WHERE seq <= (SELECT pos FROM q)')} SELECT key, value FROM x WHERE type = 1")
def kv_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """What a reader sees that began halfway."""
    at = table(spark, folder, "tags").agg(F.max("seq")).first()[0] or 0
    return _text(kv.snapshot(_entries(spark, folder), at // 2))


@query(f"WITH {_KV}, x AS (SELECT key, max(seq) AS seq, max_by(type, seq * 2 + type) AS type, max_by(val, seq * 2 + type) AS value FROM e GROUP BY key) SELECT key, seq, value FROM x WHERE type = 1")
def kv_compact(spark: SparkSession, folder: str) -> DataFrame:
    """The entries that remain where no snapshot is open."""
    return kv.compact(_entries(spark, folder)).select(F.decode("key", "UTF-8").alias("key"), "seq", F.decode("value", "UTF-8").alias("value"))


@query(f"WITH {_KV} SELECT CAST(sum(octet_length(k) + octet_length(encode(val))) AS BIGINT) AS bytes FROM e WHERE key >= '/v1/' AND key < '/v2/' AND val IS NOT NULL")
def kv_approximate_size(spark: SparkSession, folder: str) -> DataFrame:
    return kv.approximate_size(_entries(spark, folder).where("value is not null"), F.lit(bytearray(b"/v1/")), F.lit(bytearray(b"/v2/")))


# Streams


@query(f"SELECT series_id, ts_ms - ((ts_ms % {HOUR}) + {HOUR}) % {HOUR} AS bucket_ms, count(*) AS n, max(value) AS max_value FROM samples WHERE series_id IS NOT NULL AND ts_ms IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly maxima of the table read as a stream; the last state of the windows, kept in the shared folder."""
    rows = ingest.inserts(spark, f"{folder}/samples.parque[t]")
    return ingest.to_table(ingest.tumbling(rows, "1 hour"), ["series_id", "bucket_ms"])


@query(f"""SELECT series_id, o - ((o % {HOUR}) + {HOUR}) % {HOUR} - k * {HOUR} AS bucket_ms, count(*) AS n, max(value) AS max_value
FROM (SELECT series_id, ts_ms AS o, value FROM samples WHERE series_id IS NOT NULL AND ts_ms IS NOT NULL AND value IS NOT NULL), (VALUES (0), (1), (2)) AS t(k) GROUP BY 1, 2""")
def stream_sliding(spark: SparkSession, folder: str) -> DataFrame:
    """Maxima over three hours, every hour."""
    rows = ingest.inserts(spark, f"{folder}/samples.parque[t]")
    return ingest.to_table(ingest.tumbling(rows, "3 hours", slide="1 hour"), ["series_id", "bucket_ms"])


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

"""Queries of what is written and read back: layout, blocks, logs, the write path and streams, over whole tables, and their results in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.functions.codecs import to_chunks
from tidemark.operators import aggregate as agg
from tidemark.operators import compaction, kv, postings, tombstones
from tidemark.operators.labels import as_string, label
from tidemark.operators.matchers import Equal, Range, everything
from tidemark.operators.readings import latest
from tidemark.operators.select import Store
from tidemark.plans.reference import _BASE, _KV, _R, _S, DAY, END, HOUR, _entries, _lab, _last, _picked, _text
from tidemark.session import run_folder, written
from tidemark.sources import blocks, datasets, layout, loaders, log
from tidemark.sources.ingest import Appender
from tidemark.sources.tables import table
from tidemark.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return register


def _place(spark: SparkSession) -> str:
    """A new place in this driver's shared folder."""
    return f"{run_folder(spark)}/db-{uuid.uuid4().hex}"


# The partitioned layout

_KEPT = "samples WHERE series_id IS NOT NULL AND ts_ms IS NOT NULL"
_DAYS = f"CAST(floor(ts_ms / {DAY}.0) AS BIGINT)"


def _stored(spark: SparkSession, folder: str) -> str:
    to = _place(spark)
    layout.write_samples(table(spark, folder, "samples"), to)
    return to


@query(f"SELECT series_id, ts_ms, value, seq FROM {_KEPT} AND ts_ms BETWEEN {END - DAY} AND {END}")
def layout_range(spark: SparkSession, folder: str) -> DataFrame:
    """A range of time from the layout by days: other days aren't read."""
    return layout.read_samples(spark, _stored(spark, folder), END - DAY, END)


@query(f"SELECT {_DAYS} AS day, count(*) AS rows, min(ts_ms) AS min_t, max(ts_ms) AS max_t FROM {_KEPT} GROUP BY 1")
def layout_properties(spark: SparkSession, folder: str) -> DataFrame:
    return layout.partitions(spark, _stored(spark, folder)).select(F.col("day").cast("long").alias("day"), "rows", "min_t", "max_t")


@query(f"SELECT {_DAYS} AS day, count(*) AS rows FROM {_KEPT} GROUP BY 1 HAVING min(ts_ms) <= {END + HOUR} AND max(ts_ms) >= {END - HOUR}")
def layout_touched(spark: SparkSession, folder: str) -> DataFrame:
    return layout.touched(spark, _stored(spark, folder), END - HOUR, END + HOUR).select(F.col("day").cast("long").alias("day"), "rows")


@query(f"WITH {_R} SELECT series_id, ts_ms, value FROM r WHERE NOT EXISTS (SELECT 1 FROM tombstones t WHERE t.series_id = r.series_id AND r.ts_ms BETWEEN t.min_t AND t.max_t)")
def layout_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    """Two writes compacted, deleted ranges dropped, and the result put in the place of the files."""
    rows, path = table(spark, folder, "samples"), _place(spark)
    layout.write_samples(rows.where(F.col("ts_ms") < END), path)
    layout.write_samples(rows.where(F.col("ts_ms") >= END), path)
    layout.rewrite(spark, path, f"{path}.new", tombstones=table(spark, folder, "tombstones"))
    layout.swap(spark, f"{path}.new", path)
    return layout.read_samples(spark, path).select("series_id", "ts_ms", "value")


@query(f"SELECT {_DAYS} AS day, count(*) AS rows FROM {_KEPT} GROUP BY 1 HAVING ({_DAYS} + 1) * {DAY} > (SELECT max(ts_ms) FROM {_KEPT}) - {scalars.RETENTION_MS}")
def retention_by_time(spark: SparkSession, folder: str) -> DataFrame:
    """Days that lie wholly before the time that is kept are removed as files."""
    path = _stored(spark, folder)
    newest = layout.partitions(spark, path).agg(F.max("max_t")).first()[0] or 0
    layout.drop_before(spark, path, newest - scalars.RETENTION_MS)
    return layout.partitions(spark, path).select(F.col("day").cast("long").alias("day"), "rows")


@query(f"SELECT {_DAYS} AS day, count(*) AS rows FROM {_KEPT} GROUP BY 1 ORDER BY day DESC LIMIT 1")
def retention_by_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """With room for one byte only the newest day stays."""
    path = _stored(spark, folder)
    layout.drop_beyond(spark, path, 1)
    return layout.partitions(spark, path).select(F.col("day").cast("long").alias("day"), "rows")


@query("SELECT coalesce(CAST(series_id AS VARCHAR), '-') || ' @ ' || coalesce(CAST(ts_ms AS VARCHAR), '-') || ' # ' || CAST(seq AS VARCHAR) AS line FROM samples")
def layout_dump(spark: SparkSession, folder: str) -> DataFrame:
    return layout.dump(table(spark, folder, "samples"))


@query(f"WITH {_S} SELECT name, value, count(DISTINCT series_id) AS n FROM (SELECT series_id, unnest(map_keys(labels)) AS name, unnest(map_values(labels)) AS value FROM s UNION ALL SELECT series_id, 'ALL_POSTINGS', 'ALL_POSTINGS' FROM s) GROUP BY 1, 2")
def index_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The index from a snapshot that was written and read again."""
    to, store = _place(spark), Store.of(spark, folder)
    layout.save_snapshot(store, to)
    return layout.load_snapshot(spark, to, store.samples).postings_sizes()


# Blocks

_TWO = f"r WHERE ts_ms >= {END - 2 * DAY}"


def _two_blocks(spark: SparkSession, folder: str) -> str:
    """An older and a newer block that share a day, in which the newer has other values; deletions lie in the first."""
    to, store, rows = _place(spark), Store.of(spark, folder), latest(table(spark, folder, "samples"))
    blocks.write(rows.where(F.col("ts_ms").between(END - 2 * DAY, END)), store.series, to, "01", tombstones=table(spark, folder, "tombstones"))
    blocks.write(rows.where(F.col("ts_ms") >= END - DAY).withColumn("value", F.lit(1.5)), store.series, to, "02")
    return to


_MERGED = f"m AS (SELECT series_id, ts_ms, CASE WHEN ts_ms >= {END - DAY} THEN 1.5 ELSE value END AS value FROM {_TWO} AND NOT EXISTS (SELECT 1 FROM tombstones t WHERE t.series_id = r.series_id AND r.ts_ms BETWEEN t.min_t AND t.max_t))"


@query(f"WITH {_R}, x AS (SELECT '01' AS ulid, * FROM {_TWO} AND ts_ms <= {END} UNION ALL SELECT '02', * FROM r WHERE ts_ms >= {END - DAY}), p AS (SELECT ulid, series_id, count(*) AS n, min(ts_ms) AS a, max(ts_ms) AS z FROM x GROUP BY 1, 2) SELECT ulid, min(a) AS min_t, max(z) + 1 AS max_t, 1 AS level, CAST(sum(n) AS BIGINT) AS num_samples, count(*) AS num_series, CAST(sum(ceil(n / 120.0)) AS BIGINT) AS num_chunks, CASE WHEN ulid = '01' THEN (SELECT count(*) FROM tombstones) ELSE 0 END AS num_tombstones FROM p GROUP BY ulid")
def block_meta(spark: SparkSession, folder: str) -> DataFrame:
    to = _two_blocks(spark, folder)
    return blocks.read_meta(spark, to, "01").unionByName(blocks.read_meta(spark, to, "02")).drop("sources", "parents")


@query(f"WITH {_R}, {_MERGED} SELECT * FROM m")
def block_compacted(spark: SparkSession, folder: str) -> DataFrame:
    to = _two_blocks(spark, folder)
    blocks.compact(spark, to, ["01", "02"], "03")
    return blocks.read(spark, to, "03").select("series_id", "ts_ms", "value")


@query(f"WITH {_R}, {_MERGED}, p AS (SELECT series_id, count(*) AS n, min(ts_ms) AS a, max(ts_ms) AS z FROM m GROUP BY 1) SELECT '03' AS ulid, min(a) AS min_t, max(z) + 1 AS max_t, 2 AS level, '01,02' AS sources, '01,02' AS parents, CAST(sum(n) AS BIGINT) AS num_samples, count(*) AS num_series, CAST(sum(ceil(n / 120.0)) AS BIGINT) AS num_chunks, 0 AS num_tombstones FROM p")
def block_compacted_meta(spark: SparkSession, folder: str) -> DataFrame:
    """Series are counted in the new block, not summed over its parents."""
    meta = blocks.compact(spark, _two_blocks(spark, folder), ["01", "02"], "03")
    return meta.withColumns({"sources": F.array_join("sources", ","), "parents": F.array_join("parents", ",")})


@query("SELECT series_id, min_t, max_t FROM tombstones")
def block_tombstones(spark: SparkSession, folder: str) -> DataFrame:
    return blocks.read(spark, _two_blocks(spark, folder), "01", "tombstones")


@query(f"WITH {_R} SELECT series_id, ts_ms, value FROM r WHERE NOT EXISTS (SELECT 1 FROM tombstones t WHERE t.series_id = r.series_id AND r.ts_ms BETWEEN t.min_t AND t.max_t)")
def tombstone_clean(spark: SparkSession, folder: str) -> DataFrame:
    rows, left = tombstones.clean(latest(table(spark, folder, "samples")), table(spark, folder, "tombstones"))
    return rows.join(left.select("series_id"), "series_id", "left_anti")


@query("SELECT store_dir, ulid, row_number() OVER (PARTITION BY store_dir ORDER BY min_t, max_t, ulid) AS place FROM (SELECT DISTINCT store_dir, ulid, min_t, max_t FROM blocks WHERE min_t < max_t)")
def blocks_sorted(spark: SparkSession, folder: str) -> DataFrame:
    """The place of each block among those of its store, in order of time."""
    from tidemark.operators.prefix import before

    rows = before(compaction.valid(table(spark, folder, "blocks")), "store_dir", "min_t", ["max_t", "ulid"], {"_n": (F.sum, F.lit(1))})
    return rows.select("store_dir", "ulid", (F.coalesce("_n", F.lit(0)) + 1).alias("place"))


@query(f"WITH {_R}, x AS (SELECT *, (row_number() OVER (PARTITION BY series_id, ts_ms - ((ts_ms % {DAY}) + {DAY}) % {DAY} ORDER BY ts_ms) - 1) // 32 AS c FROM r) SELECT series_id, min(ts_ms) AS min_t, max(ts_ms) AS max_t, count(*) AS n FROM x GROUP BY series_id, ts_ms - ((ts_ms % {DAY}) + {DAY}) % {DAY}, c")
def chunks_by_time(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of at most 32 samples, in order of series and least time."""
    return to_chunks(latest(table(spark, folder, "samples")), 32, DAY).drop("payload").orderBy("series_id", "min_t")


# The log

_BODY = "series_id bigint, ts_ms bigint, value double"


def _logged(spark: SparkSession, folder: str) -> str:
    """All inserts as records in four segments, by their numbers."""
    to, rows = _place(spark), table(spark, folder, "samples").where("seq is not null")
    step = (rows.agg(F.max("seq")).first()[0] or 0) // 4 + 1
    for k in range(4):
        log.write_segment(log.records(rows.where((F.col("seq") >= k * step) & (F.col("seq") < (k + 1) * step)), "sample", "seq", ["series_id", "ts_ms", "value"]), to, k)
    return to


_STEP = "(SELECT max(seq) // 4 + 1 FROM samples)"


@query(f"SELECT seq // {_STEP} AS segment, count(*) AS n, count(series_id) AS ids, CAST(sum(ts_ms) AS HUGEINT) % 1000003 AS times FROM samples GROUP BY 1")
def log_read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all segments, read back and decoded."""
    rows = log.read(spark, _logged(spark, folder))
    body = F.from_json("body", _BODY, {"allowNonNumericNumbers": "true"})
    return rows.groupBy("segment").agg(F.count("*").alias("n"), F.count(body["series_id"]).alias("ids"), (F.sum(body["ts_ms"].cast("decimal(38,0)")) % 1_000_003).alias("times"))


@query(f"SELECT series_id, ts_ms, value FROM samples WHERE seq < 3 * {_STEP} AND seq <= 2 * {_STEP} + 99")
def log_repair(spark: SparkSession, folder: str) -> DataFrame:
    """A segment that was torn at its hundredth record: what is before is kept, what comes after isn't."""
    path = _logged(spark, folder)
    raw = spark.read.schema(log.SCHEMA).parquet(path)
    first = raw.where("segment = 2").agg(F.min("pos")).first()[0] or 0
    step = (raw.agg(F.max("pos")).first()[0] or 0) // 4 + 1
    torn = written(raw.where("segment = 2").withColumn("body", F.when(F.col("pos") == max(first, 2 * step + 100), F.lit("{")).otherwise(F.col("body"))).drop("segment"), "torn")
    log.write_segment(torn, path, 2)
    log.repair(spark, path, f"{path}.sound")
    return log.decoded(log.read(spark, f"{path}.sound"), "sample", _BODY)


@query(f"SELECT series_id, ts_ms, value FROM samples WHERE seq >= 2 * {_STEP}")
def log_truncate(spark: SparkSession, folder: str) -> DataFrame:
    path = _logged(spark, folder)
    log.truncate(spark, path, 2)
    return log.decoded(log.read(spark, path), "sample", _BODY)


# The write path

_EVENTS = "SELECT event_type AS metric, CAST(user_id AS VARCHAR) AS \"user\", epoch_us(ts) // 1000 AS ts_ms, value FROM events"


def _inserts(spark: SparkSession, folder: str) -> DataFrame:
    rows = datasets.events(spark, folder)
    return rows.select(F.create_map(F.lit("__name__"), F.col("metric"), F.lit("user"), F.col("user")).alias("labels"), "ts_ms", "value")


def _named(app: Appender, rows: DataFrame) -> DataFrame:
    named = app.series().select("series_id", label(F.col("labels"), "__name__").alias("metric"), label(F.col("labels"), "user").alias("user"))
    return rows.join(named, "series_id").select("metric", "user", "ts_ms", "value")


@query(_EVENTS)
def append_commit(spark: SparkSession, folder: str) -> DataFrame:
    """Inserts by label set, committed; adding the sets again changes no id."""
    app, rows = Appender(spark, _place(spark)), _inserts(spark, folder)
    app.add(rows)
    app.commit()
    app.add(rows)
    app.rollback()
    return _named(app, app.samples())


@query(f"WITH e AS ({_EVENTS}) SELECT unnest(range((SELECT count(*) FROM (SELECT DISTINCT metric, \"user\" FROM e)))) AS series_id, 1 AS n")
def append_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids are given without gaps from 0, once each, though all sets come twice; a rollback keeps the series."""
    app, rows = Appender(spark, _place(spark)), _inserts(spark, folder)
    app.add(rows.where(F.col("ts_ms") % 2 == 0))
    app.rollback()
    app.add(rows)
    app.rollback()
    return app.series().groupBy("series_id").agg(F.count("*").cast("int").alias("n"))


@query(f"{_EVENTS} UNION ALL SELECT event_type, CAST(user_id AS VARCHAR), epoch_us(ts) // 1000 + 1, -1.0 FROM events")
def append_fast(spark: SparkSession, folder: str) -> DataFrame:
    """Samples by known ids, after the first by label set; one of an unknown id is refused."""
    app, rows = Appender(spark, _place(spark)), _inserts(spark, folder)
    app.add(rows)
    app.commit()
    app.add_fast(app.samples().select("series_id", F.col("ts_ms") + 1, F.lit(-1.0).alias("value")).toDF("series_id", "ts_ms", "value"))
    app.add_fast(spark.createDataFrame([(-7, 1, 1.0)], "series_id bigint, ts_ms bigint, value double"))
    app.commit()
    return _named(app, app.samples())


@query(_EVENTS)
def insert_requests(spark: SparkSession, folder: str) -> DataFrame:
    """The same from requests with lists of labels."""
    rows = datasets.events(spark, folder)
    lset = F.array(F.struct(F.lit("__name__").alias("name"), F.col("metric").alias("value")), F.struct(F.lit("user").alias("name"), F.col("user").alias("value")))
    app = Appender(spark, _place(spark))
    app.add(loaders.requests(rows.select(lset.alias("lset"), F.lit(None).cast("long").alias("id"), F.col("ts_ms").alias("t"), F.col("value").alias("v"))))
    app.commit()
    return _named(app, app.samples())


_FIELDS = loaders.DEVOPS_FIELDS["cpu"].split()


@query(f"SELECT '{{__name__=cpu_' || m || ',hostname=' || c_name || ',nation=' || c_nationkey || '}}' AS labels FROM customer, (SELECT unnest([{', '.join(repr(f) for f in _FIELDS)}]) AS m)")
def devops_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Series from lines of measurements: one for each line and metric."""
    lines = table(spark, folder, "customer").select(F.concat(F.lit("cpu,hostname="), "c_name", F.lit(",nation="), F.col("c_nationkey").cast("string")).alias("value"))
    return loaders.devops_series(lines, loaders.devops_metrics(["cpu"])).select(as_string(F.col("labels")).alias("labels"))


@query(f"WITH {_KV}, f AS (SELECT key, seq, type, val FROM e UNION ALL SELECT * FROM (VALUES ('/a', 1000000000001, 1, 'one'), ('/a', 1000000000002, 0, NULL), ('/b', 1000000000003, 1, 'two'), ('/v2/cellar/probe', 1000000000004, 0, NULL), ('/b', 1000000000005, 1, 'three')) AS t(key, seq, type, val)), {_last().replace('FROM e', 'FROM f')} SELECT key, value FROM x WHERE type = 1")
def kv_batch(spark: SparkSession, folder: str) -> DataFrame:
    """A batch of puts and deletes on top of what is there; repeated keys count in order."""
    batch = kv.Batch().put(b"/a", b"one").delete(b"/a").append(kv.Batch().put(b"/b", b"two").delete(b"/v2/cellar/probe")).put(b"/b", b"three")
    return _text(kv.scan(_entries(spark, folder).unionByName(batch.rows(spark, 1_000_000_000_000))))


@query(f"WITH {_KV}, {_last('WHERE type = 0 OR val IS NOT NULL')} SELECT key, value FROM x WHERE type = 1")
def kv_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Entries that lack something or are of an unknown type are dropped."""
    rows = _entries(spark, folder)
    bad = rows.withColumn("type", F.lit(9).cast("tinyint")).unionByName(rows.withColumn("key", F.lit(None).cast("binary")))
    return _text(kv.snapshot(kv.repair(rows.unionByName(bad).unionByName(rows))))


# Index and helpers


@query(_picked(f"{_lab('host')} >= 'heron' AND {_lab('host')} < 'larch-00001' AND {_lab('__name__')} = 'volume_used_pct'"))
def select_label_range(spark: SparkSession, folder: str) -> DataFrame:
    return Store.of(spark, folder).select([Range("host", "heron", "larch-00001"), Equal("__name__", "volume_used_pct")])


@query(f"WITH {_S}, l AS (SELECT series_id, unnest(map_keys(labels)) AS name, unnest(map_values(labels)) AS value FROM s) SELECT name, count(*) AS n FROM (SELECT DISTINCT name, value, series_id FROM l UNION SELECT 'room', 'one', series_id FROM s) GROUP BY name UNION ALL SELECT 'ALL_POSTINGS', count(*) FROM s")
def postings_add(spark: SparkSession, folder: str) -> DataFrame:
    """Entries for each name once those of another label are added, twice."""
    store = Store.of(spark, folder)
    new = store.series.select(F.lit("room").alias("name"), F.lit("one").alias("value"), "series_id")
    return postings.add(postings.add(store.label_index(), new), new).groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT unnest(range(CAST(min(series_id) AS BIGINT), CAST(max(series_id) AS BIGINT))) AS series_id FROM series")
def postings_consecutive(spark: SparkSession, folder: str) -> DataFrame:
    a, b = table(spark, folder, "series").agg(F.min("series_id"), F.max("series_id")).first()
    return postings.consecutive(spark, a or 0, b or 0)


@query("WITH l AS (SELECT series_id, max(ts_ms) AS last_ms FROM samples WHERE series_id IS NOT NULL GROUP BY series_id) SELECT series_id, last_ms FROM l ORDER BY last_ms NULLS FIRST, series_id LIMIT (SELECT count(*) // 10 FROM l)")
def coldest_series(spark: SparkSession, folder: str) -> DataFrame:
    return agg.coldest(table(spark, folder, "samples"))


@query(f"SELECT series_id, min_t, max_t FROM tombstones WHERE min_t <= {END + 7 * DAY} AND max_t >= {END - 7 * DAY}")
def overlaps_closed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "tombstones").where(scalars.overlaps_closed(F.col("min_t"), F.col("max_t"), END - 7 * DAY, END + 7 * DAY))


@query("""SELECT p_partkey, least(greatest(p_size * 2, 20), 60) AS wait, p_partkey * 16777216 + p_size AS packed, p_partkey AS series, CAST(p_size AS BIGINT) AS chunk, length(p_name) AS runes, octet_length(encode(p_name)) AS bytes,
CASE WHEN floor(100000 / ((p_size * 100 + 1) / 0.25)) <= 1 THEN 100000 ELSE CAST(floor(100000 / floor(100000 / ((p_size * 100 + 1) / 0.25))) AS BIGINT) END AS ends FROM part""")
def scalar_helpers(spark: SparkSession, folder: str) -> DataFrame:
    """Waiting times, chunk ids packed and unpacked, lengths of texts, and when chunks should end, of made-up numbers from parts."""
    size, key = F.col("p_size"), F.col("p_partkey")
    packed = scalars.pack_chunk_id(key, size)
    un, text = scalars.unpack_chunk_id(packed), scalars.runes(F.col("p_name"))
    ends = scalars.chunk_end_estimate(F.lit(0).cast("long"), (size * 100).cast("long"), F.lit(100_000).cast("long"))
    return table(spark, folder, "part").select("p_partkey", scalars.backoff(size, 20, 60).alias("wait"), packed.alias("packed"), un["series"].alias("series"), un["chunk"].alias("chunk"), text["runes"].cast("long").alias("runes"), text["bytes"].cast("long").alias("bytes"), ends.cast("long").alias("ends"))


# Streams


@query(f"SELECT series_id, ts_ms, value, seq FROM {_KEPT}")
def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """The table as a stream into the layout by days."""
    to = _place(spark)
    ingest.ingest(ingest.inserts(spark, f"{folder}/samples.parque[t]"), f"{to}/data", f"{to}/checkpoint").awaitTermination()
    return ingest.ingested(spark, f"{to}/data")


@query("SELECT DISTINCT series_id, ts_ms, value, seq FROM samples WHERE ts_ms IS NOT NULL AND series_id IS NOT NULL")
def stream_deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    """Every row delivered twice; rows that come again within the watermark are dropped."""
    rows, to = ingest.inserts(spark, f"{folder}/samples.parque[t]"), _place(spark)
    ingest.ingest(ingest.deduplicated(rows.unionByName(rows)), f"{to}/data", f"{to}/checkpoint").awaitTermination()
    return ingest.ingested(spark, f"{to}/data")


@query(_EVENTS)
def stream_register(spark: SparkSession, folder: str) -> DataFrame:
    """Inserts by label set as a stream: series get their ids, samples are committed batch by batch."""
    to = _place(spark)
    _inserts(spark, folder).write.parquet(f"{to}/in")
    ingest.register(ingest.inserts(spark, f"{to}/in", "labels map<string,string>, ts_ms bigint, value double"), f"{to}/db", f"{to}/checkpoint").awaitTermination()
    app = Appender(spark, f"{to}/db")
    return _named(app, app.samples())


@query(f"{_BASE} SELECT r.series_id, count(*) AS n FROM r JOIN s ON s.series_id = r.series_id GROUP BY r.series_id")
def snapshot_select(spark: SparkSession, folder: str) -> DataFrame:
    """Everything selected from a store that was loaded from a snapshot of its series and a layout by days."""
    to = _place(spark)
    layout.save_snapshot(Store.of(spark, folder), to)
    store = layout.load_snapshot(spark, to, layout.read_samples(spark, _stored(spark, folder)))
    return store.select([everything()]).groupBy("series_id").agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)



"""Loaders, the write path, stored layout and streams."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.matchers import Equal, everything
from tidemark.operators.select import Store
from tidemark.sources import blocks, log, layout, loaders
from tidemark.sources.ingest import Appender, assign_ids
from tidemark.streaming import ingest

SAMPLES = "series_id long, ts_ms long, value double, seq long"
INSERTS = "labels map<string,string>, ts_ms long, value double"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_devops_lines(spark, tmp_path):
    lines = spark.createDataFrame([("cpu,hostname=host_0,region=eu=1",), ("cpu",), (None,), ("cpu,,novalue",)], "value string")
    got = [r[0] for r in rows(loaders.devops_series(lines, ["cpu_a", "cpu_b"]))]
    assert {"hostname": "host_0", "region": "eu=1", "__name__": "cpu_b"} in got and got.count({"__name__": "cpu_a"}) == 2 and len(got) == 6
    assert len(loaders.devops_metrics()) == 101 and loaders.devops_metrics(["cpu"])[0] == "cpu_usage_user"
    (tmp_path / "x.txt").write_text("mem,hostname=h\n")
    assert loaders.read_devops(spark, str(tmp_path / "x.txt"), ["mem_used"]).count() == 1


def test_json_groups_requests(spark):
    lines = spark.createDataFrame([('{"instance":"a","job":"j"}',), ("nonsense",), (None,)], "value string")
    assert {"instance": "pc1", "job": "j"} in [r[0] for r in rows(loaders.json_series(lines, instance="pc1"))]
    g = spark.createDataFrame([(1, 5, [1, 2], [0.5, 1.5]), (2, 6, [], [])], "group_id long, ts_ms long, slots array<int>, values array<double>")
    assert sorted(rows(loaders.groups(g))) == [(1, 5, 1, 0.5), (1, 5, 2, 1.5)]
    r = spark.createDataFrame([([("a", "1")], None, 5, 1.0), ([], 7, 6, 2.0)], "lset array<struct<name string, value string>>, id long, t long, v double")
    assert rows(loaders.requests(r)) == [({"a": "1"}, None, 5, 1.0), (None, 7, 6, 2.0)]


def test_assign_ids_is_dense_and_stable(spark):
    none = spark.createDataFrame([], "series_id long, labels map<string,string>")
    sets = spark.createDataFrame([({"k": str(i % 50), "z": "1"},) for i in range(100)] + [(None,), ({},)], "labels map<string,string>")
    first = assign_ids(none, sets)
    assert sorted(r[0] for r in rows(first)) == list(range(51))
    assert sorted(rows(first.selectExpr("series_id", "to_json(labels)"))) == sorted(rows(assign_ids(none, sets).selectExpr("series_id", "to_json(labels)")))
    more = assign_ids(first, sets.unionByName(spark.createDataFrame([({"k": "new"},)], "labels map<string,string>")))
    assert [(r[0], r[1]) for r in rows(more)] == [(51, {"k": "new"})]


def test_appender(spark, tmp_path):
    app = Appender(spark, str(tmp_path))
    batch = spark.createDataFrame([({"h": "a"}, 1, 1.0), ({"h": "b"}, 1, 2.0), ({"h": "a"}, 2, 3.0)], INSERTS)
    assert app.add(batch).count() == 2 and app.samples().count() == 0
    app.rollback()
    assert app.series().count() == 2 and rows(app.commit()) == []
    assert app.add(batch).count() == 0
    ids = {r["labels"]["h"]: r["series_id"] for r in app.series().collect()}
    app.add_fast(spark.createDataFrame([(ids["a"], 2, 9.0), (77, 1, 1.0)], "series_id long, ts_ms long, value double"))
    assert dict(rows(app.commit())) == {"ok": 4, "unknown": 1}
    got = Store(app.series(), app.samples()).select([Equal("h", "a")])
    assert sorted(rows(got)) == [(ids["a"], 1, 1.0), (ids["a"], 2, 9.0)]


def test_layout(spark, tmp_path):
    day = 86_400_000
    data = [(s, d * day + s, float(d), 0) for d in (-1, 0, 1, 5) for s in range(4)]
    path = str(tmp_path / "s")
    layout.write_samples(spark.createDataFrame(data, SAMPLES), path)
    got = layout.read_samples(spark, path, 0, day + 2)
    assert sorted(rows(got.select("series_id", "ts_ms", "value", "seq"))) == sorted(r for r in data if 0 <= r[1] <= day + 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters: [IsNotNull(ts_ms)" in plan
    assert {r["day"]: r["rows"] for r in layout.partitions(spark, path).collect()} == {-1: 4, 0: 4, 1: 4, 5: 4}
    assert layout.approximate_size(spark, path, 0, day).first()[0] > 0 and layout.files(spark, path).agg(F.sum("rows")).first()[0] == 16
    layout.write_samples(spark.createDataFrame([(0, 0, 7.0, 1)], SAMPLES), path)
    to = str(tmp_path / "t")
    layout.rewrite(spark, path, to, keep_after=0, tombstones=spark.createDataFrame([(1, 0, 2**60)], "series_id long, min_t long, max_t long"))
    out = sorted(rows(layout.read_samples(spark, to).select("series_id", "ts_ms", "value")))
    assert len(out) == 9 and out[0] == (0, 0, 7.0)
    store = Store(spark.createDataFrame([(0, {"a": "b"})], "series_id long, labels map<string,string>"), layout.read_samples(spark, to))
    layout.save_snapshot(store, str(tmp_path / "snap"))
    assert layout.load_snapshot(spark, str(tmp_path / "snap"), store.samples).select([everything()]).count() == 3


def test_stream_ingest_restarts_without_doubles(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    spark.createDataFrame([(1, 5, 1.0, 1), (1, 6, 2.0, 2)], SAMPLES).coalesce(1).write.parquet(src)
    for _ in range(2):
        ingest.ingest(ingest.inserts(spark, src), out, check).awaitTermination()
    assert ingest.ingested(spark, out).count() == 2
    spark.createDataFrame([(1, 7, 3.0, 3)], SAMPLES).coalesce(1).write.mode("append").parquet(src)
    ingest.ingest(ingest.inserts(spark, src), out, check).awaitTermination()
    assert ingest.ingested(spark, out).count() == 3


def test_stream_register(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([({"h": "a"}, 1, 1.0), ({"h": "b"}, 1, 2.0)], INSERTS).coalesce(1).write.parquet(src)
    spark.createDataFrame([({"h": "a"}, 2, 3.0)], INSERTS).coalesce(1).write.mode("append").parquet(src)
    folder = str(tmp_path / "db")
    for check in ("c1", "c2"):  # the second run delivers the same batches again
        ingest.register(ingest.inserts(spark, src, INSERTS, files_per_trigger=1), folder, str(tmp_path / check)).awaitTermination()
    app = Appender(spark, folder)
    assert app.series().count() == 2 and app.samples().count() == 3


def test_stream_register_after_a_failure_halfway(spark, tmp_path, monkeypatch):
    src, folder, check = (str(tmp_path / x) for x in ("src", "db", "c"))
    spark.createDataFrame([({"h": "a"}, 1, 1.0), ({"h": "b"}, 1, 2.0)], INSERTS).coalesce(1).write.parquet(src)
    commit, calls = Appender.commit, []

    def failing(self):
        commit(self)
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("after the samples are written")

    monkeypatch.setattr(Appender, "commit", failing)
    for _ in range(2):
        try:
            ingest.register(ingest.inserts(spark, src, INSERTS), folder, check).awaitTermination()
        except Exception:  # noqa: BLE001
            assert len(calls) == 1
    app = Appender(spark, folder)
    assert len(calls) == 2 and app.series().count() == 2 and sorted(r["value"] for r in app.samples().collect()) == [1.0, 2.0] and {r["seq"] for r in app.samples().collect()} == {1}


@pytest.mark.parametrize("kind", ["tumbling", "sessions", "deduplicated"])
def test_stream_windows(spark, tmp_path, kind):
    src = str(tmp_path / "src")
    data = [(1, 0, 1.0, 1), (1, 0, 1.0, 1), (1, 299_999, 5.0, 2), (1, 300_000, 2.0, 3), (2, -1, 1.0, 4), (None, 1, 1.0, 5), (1, None, 1.0, 6)]
    spark.createDataFrame(data, SAMPLES).coalesce(1).write.parquet(src)
    stream = ingest.inserts(spark, src)
    if kind == "tumbling":
        assert sorted(rows(ingest.to_table(ingest.tumbling(stream), ["series_id", "bucket_ms"]))) == [(1, 0, 3, 5.0), (1, 300_000, 1, 2.0), (2, -300_000, 1, 1.0)]
    elif kind == "sessions":
        assert ingest.sessions(stream).isStreaming
        batch = ingest.sessions(spark.read.parquet(src))
        assert sorted(rows(batch)) == [(1, 0, 3_900_000, 4), (2, -1, 3_599_999, 1)]
    else:
        ingest.ingest(ingest.deduplicated(stream), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
        assert ingest.ingested(spark, f"{tmp_path}/o").count() == 4


LABELLED = "series_id long, labels map<string,string>"


def test_blocks_are_written_whole(spark, tmp_path):
    folder = str(tmp_path)
    series = spark.createDataFrame([(1, {"a": "b"}), (2, {"a": "c"}), (3, {})], LABELLED)
    old = spark.createDataFrame([(1, -5, 1.0), (1, 10, 2.0), (2, 86_400_000, float("nan"))], "series_id long, ts_ms long, value double").selectExpr("*", "7 as day_", "8 as _s")
    new = spark.createDataFrame([(1, 10, 9.0), (3, 11, 1.0)], "series_id long, ts_ms long, value double")
    holes = spark.createDataFrame([(2, 0, 2**62)], "series_id long, min_t long, max_t long")
    a = blocks.write(old, series, folder, "a", tombstones=holes).first()
    assert (a["min_t"], a["max_t"], a["num_samples"], a["num_series"], a["num_tombstones"], a["sources"]) == (-5, 86_400_001, 3, 2, 1, ["a"])
    assert {r["series_id"] for r in blocks.read(spark, folder, "a", "series").collect()} == {1, 2}
    blocks.write(new, series, folder, "b")
    c = blocks.compact(spark, folder, ["a", "b"], "c").first()
    assert (c["level"], c["num_series"], c["num_samples"], c["sources"], c["parents"]) == (2, 2, 3, ["a", "b"], ["a", "b"])
    assert sorted(tuple(r)[:3] for r in blocks.read(spark, folder, "c").collect()) == [(1, -5, 1.0), (1, 10, 9.0), (3, 11, 1.0)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["c"]
    empty = blocks.write(new.limit(0), series, folder, "e").first()
    assert (empty["min_t"], empty["max_t"], empty["num_samples"], empty["num_series"]) == (None, None, 0, 0) and blocks.read(spark, folder, "e").count() == 0


def test_log_survives_damage(spark, tmp_path):
    path = str(tmp_path / "log")
    rows_ = [(i, i % 3, None if i == 4 else float("nan") if i == 5 else float(i)) for i in range(30)]
    df = spark.createDataFrame(rows_, "pos long, series_id long, value double")
    for k in range(3):
        log.write_segment(log.records(df.where(f"pos div 10 = {k}"), "sample", "pos", ["series_id", "value"]), path, k)
        log.write_segment(log.records(df.where(f"pos div 10 = {k}"), "sample", "pos", ["series_id", "value"]), path, k)  # written again
    assert log.read(spark, path).count() == 30 and log.read(spark, path, 1, 1).count() == 10
    got = log.decoded(log.read(spark, path, last=0), "sample", "series_id long, value double").collect()
    assert len(got) == 10 and sum(r["value"] is None for r in got) == 1 and sum(r["value"] != r["value"] for r in got if r["value"] is not None) == 1
    torn = spark.createDataFrame([(r["pos"], r["kind"], None if r["pos"] == 13 else r["body"], r["crc"]) for r in spark.read.schema(log.SCHEMA).parquet(path).where("segment = 1").collect()], "pos long, kind string, body string, crc long")
    log.write_segment(torn, path, 1)
    assert sorted(r["pos"] for r in log.read(spark, path).collect()) == [*range(13), *range(20, 30)]
    log.repair(spark, path, f"{path}2")
    assert sorted(r["pos"] for r in log.read(spark, f"{path}2").collect()) == [*range(13)]
    assert log.truncate(spark, path, 2) == [0, 1] and {r["segment"] for r in log.read(spark, path).collect()} == {2}


def test_retention_removes_days(spark, tmp_path):
    day, path = 86_400_000, str(tmp_path / "s")
    layout.write_samples(spark.createDataFrame([(s, d * day + s, float(d), 0) for d in (-2, 0, 1, 5) for s in range(40)], SAMPLES), path)
    assert layout.drop_before(spark, path, 1) == [-2] and layout.drop_before(spark, path, day) == [0]
    assert {r["day"] for r in layout.touched(spark, path, 0, 3 * day).collect()} == {1}
    assert layout.drop_beyond(spark, path, 10**9) == [] and layout.drop_beyond(spark, path, 1) == [1] and layout.drop_beyond(spark, path, 1) == []
    assert layout.read_samples(spark, path).count() == 40
    assert [r[0] for r in layout.dump(spark.createDataFrame([(1, None, 2.0, 3)], SAMPLES)).collect()] == ["1 @ - # 3"]

"""Matchers, retrieval, labels, deletion, blocks and the ordered map."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import codecs, scalars
from tidemark.operators import aggregate as agg
from tidemark.operators import compaction, kv, labels, postings, tombstones
from tidemark.operators.matchers import AnyOf, Custom, Equal, Not, Prefix, Regex, everything
from tidemark.operators.readings import latest
from tidemark.operators.select import Store, align_by_labels, chain_stores, merge_stores

SERIES = "series_id long, labels map<string,string>"
SAMPLES = "series_id long, ts_ms long, value double, seq long"
BLOCKS = "store_dir string, ulid string, min_t long, max_t long, level int, sources array<string>, failed boolean, num_series long, num_tombstones long"


def rows(df):
    return [tuple(r) for r in df.collect()]


def ids(df):
    return sorted(r[0] for r in df.select("series_id").distinct().collect())


@pytest.fixture(scope="module")
def store(spark):
    sets = {0: {"__name__": "cpu", "host": "a", "x": "a"}, 1: {"__name__": "cpu", "host": "b", "x": ""}, 2: {"__name__": "mem", "host": "a"}, 3: {"__name__": "mem", "host": "b", "x": "ab"}, 4: {}, 5: None}
    series = spark.createDataFrame([*sets.items(), (0, sets[0]), (None, {"host": "z"})], SERIES)
    data = [(s, t, float(10 * s + t), t) for s in range(6) for t in (-5, 0, 5, 10)] + [(0, 5, 99.0, 100), (99, 5, 1.0, 1), (0, None, 1.0, 1), (0, 7, None, 1)]
    from tidemark.operators.select import distinct_series

    return Store(distinct_series(series), spark.createDataFrame(data, SAMPLES)), {k: v or {} for k, v in sets.items()}


CASES = [
    [Equal("host", "a")], [Equal("host", "a"), Equal("__name__", "mem")], [Equal("x", "")], [Not(Equal("x", "a"))], [Regex("x", ".*")], [Regex("x", "a")], [Regex("x", "a|ab")],
    [Not(Regex("x", "a.*"))], [Equal("nope", "")], [Equal("nope", "1")], [Regex("host", "*")], [Not(Regex("host", "*"))], [AnyOf("host", ("a", "q"))], [AnyOf("host", ())], [Prefix("x", "a")], [Not(Not(Equal("host", "b")))], [everything()], [everything(), Equal("host", "b")],
]


@pytest.mark.parametrize("matchers", CASES, ids=str)
def test_select_against_model(store, matchers):
    st, sets = store
    want = [k for k, v in sets.items() if all(m == everything() or m.accepts(v.get(m.name, "")) for m in matchers)]
    got = st.select(matchers)
    assert ids(got) == want
    assert got.count() == 4 * len(want)


def test_select_range_labels_and_last_write(store):
    st, _ = store
    got = rows(st.select([Equal("host", "a")], 0, 5, with_labels=True).orderBy("series_id", "ts_ms"))
    assert [(r[0], r[2], r[3]) for r in got] == [(0, 0, 0.0), (0, 5, 99.0), (2, 0, 20.0), (2, 5, 25.0)] and got[0][1]["host"] == "a"
    assert st.select([]).count() == 0
    assert st.chain([Equal("__name__", "cpu"), Equal("host", "a")]).count() == 5


def test_parity_and_custom(store):
    st, _ = store
    assert st.select([Equal("nope", "")], parity=True).count() == 0 and st.select([Equal("x", "")], parity=True).count() > 0
    assert rows(st.select([everything()], -100, 100, parity=True).agg(F.min("ts_ms"))) == [(0,)]
    assert ids(st.select([Custom("x", lambda v: F.length(v) == 2)])) == [3]


def test_seek_and_response(store):
    st, _ = store
    assert sorted(rows(st.seek([Equal("__name__", "cpu")], 1))) == [(0, 5, 99.0), (1, 5, 15.0)]
    assert rows(st.seek([Equal("__name__", "cpu")], 11)) == []
    out = {r["id"]: r for r in st.respond([Equal("host", "a")], 0, 5).collect()}
    assert [(p["t"], p["v"]) for p in out[0]["values"]] == [(0, 0.0), (5, 99.0)] and out[0]["metric"][0]["name"] == "__name__"
    assert st.respond([Equal("host", "a")], 0, 5, return_metric=False).columns == ["id", "values"]


def test_label_index(store):
    st, _ = store
    assert [r[0] for r in st.label_names().collect()] == ["ALL_POSTINGS", "__name__", "host", "x"]
    assert [r[0] for r in st.label_values("x").collect()] == ["", "a", "ab"] and rows(st.label_values("nope")) == []
    assert {r[0] for r in st.symbols().collect()} == {"__name__", "host", "x", "cpu", "mem", "a", "b", "", "ab"}
    assert {(r[0], r[1]): r[2] for r in st.postings_sizes().collect()}[("ALL_POSTINGS", "ALL_POSTINGS")] == 6
    assert [r[0] for r in st.postings("host", "b").collect()] == [1, 3]
    assert st.sorted_series().collect()[0]["series_id"] in (4, 5)


def test_label_functions(spark):
    df = spark.createDataFrame([({"b": "2", "a": "1", "__name__": "m"},), ({},), (None,), ({"a": None},)], "l map<string,string>")
    assert [r[0] for r in rows(df.select(labels.as_string(F.col("l"))))] == ["{__name__=m,a=1,b=2}", "{}", "{}", "{}"]
    one = df.limit(1)
    assert rows(one.select(labels.as_string(labels.with_label(F.col("l"), "a", "9")), labels.as_string(labels.with_label(F.col("l"), "c", "9")), labels.as_string(labels.without_label(F.col("l"), "b"))))[0] == ("{__name__=m,a=1,b=2}", "{__name__=m,a=1,b=2,c=9}", "{__name__=m,a=1}")
    assert rows(one.select(labels.key_string(labels.key_by(F.col("l"), ["b", "q"])), labels.key_string(labels.key_without(F.col("l"), ["b"]))))[0] == ("{b=2}", "{a=1}")
    pairs = spark.createDataFrame([([("a", "1"), ("a", "2")],)], "p array<struct<name string, value string>>")
    with pytest.raises(Exception, match="(?i)duplicate"):
        pairs.select(labels.from_pairs(F.col("p"))).collect()


def test_postings(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "series_id long") for xs in ([10, 65545, 8, 65543, 6, 8, None], [8, 6, 2, None]))
    assert ids(postings.intersect([a, b]).where("series_id is not null")) == [6, 8]
    assert ids(postings.subtract(a, b)) == [10, 65543, 65545]
    assert {r[0] for r in postings.union([a, b]).collect()} == {None, 2, 6, 8, 10, 65543, 65545}
    assert rows(postings.seek(a, 7)) == [(8,)] and rows(postings.seek(a, 65546)) == [] and ids(postings.consecutive(spark, 3, 6)) == [3, 4, 5]


def test_merge_chain_align(spark):
    a = spark.createDataFrame([(1, 1, 1.0, 5), (1, 2, 2.0, 5), (1, 2, 3.0, 6)], SAMPLES)
    b = spark.createDataFrame([(1, 2, 9.0, 0), (1, 3, 9.0, 0), (1, None, 1.0, 1)], SAMPLES)
    assert sorted(rows(merge_stores([a, b]))) == [(1, 1, 1.0), (1, 2, 9.0), (1, 3, 9.0)] and sorted(rows(merge_stores([b, a])))[1] == (1, 2, 3.0)
    assert chain_stores([a, b]).count() == 6
    sa = Store(spark.createDataFrame([(1, {"h": "x"})], SERIES), a)
    sb = Store(spark.createDataFrame([(7, {"h": "x"})], SERIES), b.withColumn("series_id", F.lit(7).cast("long")))
    assert sorted((r[1], r[2]) for r in rows(align_by_labels([sa, sb]))) == [(1, 1.0), (2, 9.0), (3, 9.0)]


def test_tombstones(spark):
    t = spark.createDataFrame([(1, 10, 20), (1, 21, 30), (1, 40, 50), (1, 42, 43), (1, 35, 60), (2, 5, 4), (2, None, 4), (None, 1, 2), (1, 10, 20), (3, -(2**63), 2**63 - 1), (3, 0, 1)], "series_id long, min_t long, max_t long")
    assert sorted(rows(tombstones.union(t))) == [(1, 10, 30), (1, 35, 60), (3, -(2**63), 2**63 - 1)]
    s = spark.createDataFrame([(1, x, float(x)) for x in (9, 10, 25, 30, 31, 34, 35, 60, 61)] + [(2, 5, 1.0), (3, 7, 1.0)], "series_id long, ts_ms long, value double")
    assert sorted((r[0], r[1]) for r in rows(tombstones.apply(s, t))) == [(1, 9), (1, 31), (1, 34), (1, 61), (2, 5)]
    assert tombstones.clean(s, t)[1].count() == 0 and rows(tombstones.count(t).where("series_id = 1")) == [(1, 2)]
    assert sorted(r[2] for r in rows(tombstones.surviving(t.where("series_id = 1"), 45))) == [50, 60]


def test_delete_is_clipped_and_random_model(spark, store):
    st, _ = store
    assert sorted(rows(tombstones.delete(st, [Equal("host", "a")], 3, 1000))) == [(0, 3, 10), (2, 3, 10)]
    rng = random.Random(11)
    model, data, holes = {}, [], []
    for seq in range(600):
        s, t = rng.randrange(4), rng.randrange(80)
        if rng.random() < 0.06:
            holes.append((s, t, t + rng.randrange(6)))
        data.append((s, t, float(seq), seq))
        model[(s, t)] = float(seq)
    want = {(s, t, v) for (s, t), v in model.items() if not any(h[0] == s and h[1] <= t <= h[2] for h in holes) and 10 <= t <= 60}
    series = spark.createDataFrame([(i, {"n": str(i)}) for i in range(4)], SERIES)
    whole = Store(series, spark.createDataFrame(data, SAMPLES)).deleting(spark.createDataFrame(holes, "series_id long, min_t long, max_t long"))
    assert set(rows(whole.select([everything()], 10, 60))) == want
    split = whole.select([everything()], 10, 30).unionByName(whole.select([everything()], 31, 60))
    assert set(rows(split)) == want
    packed = compaction.populate([whole.samples], whole.tombstones).where("ts_ms between 10 and 60")
    assert set(rows(packed)) == want


def block(u, a, b, store="s", failed=False, tomb=0, level=1, sources=None):
    return (store, u, a, b, level, sources or [u], failed, 100, tomb)


def test_block_overlaps_and_split(spark):
    df = spark.createDataFrame([block("a", 0, 10), block("b", 10, 20), block("c", 15, 18), block("d", 17, 30), block("e", 40, 50), block("f", 45, 46), block("f", 45, 46), block("x", 5, 5), block("y", 9, None), block("z", 2**63 - 1, -(2**63))], BLOCKS)
    got = {(r["ulid"], r["island"]) for r in compaction.overlap_groups(df).collect()}
    assert got == {("b", 0), ("c", 0), ("d", 0), ("e", 1), ("f", 1)}
    assert {r["ulid"] for r in compaction.first_overlap(df).collect()} == {"b", "c", "d"}
    ex = spark.createDataFrame([block("a", 0, 10), block("b", 10, 20), block("c", 50, 60), block("d", 90, 100), block("e", -10, -5), block("w", 25, 35)], BLOCKS)
    assert {(r["ulid"], r["range_start"]) for r in compaction.split_by_range(ex, 30).collect()} == {("a", 0), ("b", 0), ("c", 30), ("d", 90), ("e", -30)}
    assert {r["ulid"] for r in compaction.overlapping(ex, 20, 50).collect()} == {"c", "w"}


def test_plan(spark):
    r = [10, 30, 90]
    rows_ = [
        block("a1", 0, 10, "full"), block("a2", 10, 20, "full"), block("a3", 20, 30, "full"), block("a4", 30, 40, "full"),
        block("b1", 0, 10, "fresh"), block("b2", 10, 20, "fresh"), block("b3", 20, 30, "fresh"),
        block("c1", 0, 10, "bad", failed=True), block("c2", 10, 20, "bad"), block("c3", 40, 50, "bad"), block("c4", 50, 60, "bad"), block("c6", 60, 70, "bad"), block("c5", 90, 100, "bad"),
        block("d1", 0, 30, "dead", tomb=6), block("d2", 30, 60, "dead", tomb=5), block("d3", 60, 70, "dead"),
        block("e1", 0, 10, "over"), block("e2", 5, 20, "over"), block("g1", 0, 10, "one"),
    ]
    got = sorted(rows(compaction.plan(spark.createDataFrame(rows_, BLOCKS), r)))
    assert got == sorted([("full", "a1", "range"), ("full", "a2", "range"), ("full", "a3", "range"), ("bad", "c3", "range"), ("bad", "c4", "range"), ("dead", "d1", "tombstones"), ("over", "e1", "overlap"), ("over", "e2", "overlap")])


def test_meta_and_stats(spark):
    df = spark.createDataFrame([block("a", 0, 10, level=2, sources=["q", "p"]), block("b", 10, 20, sources=["p"]), block("n", 1, 1)], BLOCKS)
    m = compaction.merged_meta(df).collect()[0]
    assert (m["min_t"], m["max_t"], m["level"], m["sources"], [p["ulid"] for p in m["parents"]]) == (0, 20, 3, ["p", "q"], ["a", "b"])
    s = spark.createDataFrame([(1, t, 0.0) for t in range(250)] + [(2, 3, 0.0)], "series_id long, ts_ms long, value double")
    assert rows(compaction.stats(s, 1000)) == [(0, 251, 2, 4, 0, 249)]
    assert compaction.retained(s, 100, 249).count() == 101
    keep = spark.createDataFrame([(1,)], "series_id long")
    parts = compaction.checkpoint(s.select("series_id").distinct(), s, spark.createDataFrame([(1, 0, 5), (1, 0, 200)], "series_id long, min_t long, max_t long"), keep, 100)
    assert [p.count() for p in parts] == [1, 150, 1]


def test_unflushed(spark):
    s = spark.createDataFrame([(1, 1, 0.0, 1), (1, 2, 0.0, 5), (1, 3, 0.0, 6), (2, 1, 0.0, 1), (1, 4, 0.0, None), (None, 1, 0.0, 9)], SAMPLES)
    marks = spark.createDataFrame([(1, 5), (1, 3), (None, 9), (3, 1)], "series_id long, flushed_seq long")
    assert sorted(r[:2] for r in rows(compaction.unflushed(s, marks))) == [(1, 3), (2, 1)]


def test_kv_against_model(spark):
    rng = random.Random(1)
    data, states, model = [], {}, {}
    for seq in range(1, 401):
        k = bytes([rng.choice((0, 97, 98, 255)), rng.randrange(6)])
        if rng.random() < 0.45:
            data.append((bytearray(k), seq, kv.DELETE, None))
            model.pop(k, None)
        else:
            v = str(seq).encode()
            data.append((bytearray(k), seq, kv.PUT, bytearray(v)))
            model[k] = v
        states[seq] = dict(model)
    df = spark.createDataFrame([*data, (None, 1, 1, None), (bytearray(b"q"), None, 1, None)], kv.SCHEMA)

    def pairs(x):
        return [(bytes(r[0]), bytes(r[1])) for r in x.collect()]

    assert pairs(kv.scan(df)) == sorted(model.items()) and pairs(kv.scan(df, reverse=True)) == sorted(model.items(), reverse=True)
    assert pairs(kv.scan(df, seq=200)) == sorted(states[200].items())
    assert pairs(kv.scan(df, F.lit(bytearray(b"a")), F.lit(bytearray(b"b")))) == sorted((k, v) for k, v in model.items() if b"a" <= k < b"b")
    some = sorted(model)[0]
    assert pairs(kv.get(df, some)) == [(some, model[some])] and pairs(kv.get(df, b"none")) == []
    assert pairs(kv.seek(df, F.lit(bytearray(b"b")))) == [min((k, v) for k, v in model.items() if k >= b"b")]
    kept = kv.compact(df, 200)
    assert pairs(kv.scan(kept, seq=200)) == sorted(states[200].items()) and pairs(kv.scan(kept)) == sorted(model.items()) and pairs(kv.scan(kv.compact(df))) == sorted(model.items())
    batch = kv.Batch().put(b"k", b"1").delete(b"k").append(kv.Batch().put(b"k", b"2"))
    assert [o[0] for o in batch.replay()] == [1, 0, 1] and pairs(kv.scan(batch.rows(spark, 7))) == [(b"k", b"2")]
    assert rows(kv.approximate_size(df.limit(0), F.lit(bytearray(b"a")), F.lit(bytearray(b"b")))) == [(0,)]


def test_aggregates(spark, store):
    st, _ = store
    got = agg.labelled(st.select([Regex("host", ".+")]), st.series, ["host", "__name__"])
    assert ("a", "cpu", 0, 99.0) in {tuple(r) for r in agg.max_by_bucket(got, 10, ["host", "metric"]).collect()}
    assert ("b", -10, 15.0) in {tuple(r) for r in agg.mean_by_bucket(got, 10, ["host"]).select("host", "bucket_ms", "mean_value").collect()}
    assert {(r[0], r[1]) for r in rows(agg.last_point(got, ["host"]))} == {("a", 10), ("b", 10)}
    assert {r[0] for r in rows(agg.by_labels(latest(st.samples), st.series, ["x"], [F.count("*").alias("n")]))} == {"{x=a}", "{x=}", "{x=ab}", "{}"}


def test_scalars(spark):
    df = spark.createDataFrame([(-1,), (0,), (1_800_000,), (3_599_999,)], "t long")
    assert [r[0] for r in rows(df.select(scalars.range_end(F.col("t"), 1_800_000)))] == [0, 1_800_000, 3_600_000, 3_600_000]
    assert scalars.block_ranges() == [7_200_000, 36_000_000, 180_000_000]
    one = df.limit(1)
    packed = scalars.pack_chunk_id(F.lit(2**40 - 1), F.lit(5))
    assert rows(one.select(scalars.unpack_chunk_id(packed).alias("u")).select("u.series", "u.chunk")) == [(2**40 - 1, 5)]
    assert rows(one.select(scalars.clamp(F.lit(1), F.lit(9), 3, 5).alias("c")).select("c.a", "c.b")) == [(3, 5)] and rows(one.select(scalars.clamp(F.lit(1), F.lit(2), 3, 5).isNull())) == [(True,)]
    assert rows(one.select(scalars.backoff(F.lit(3), 10, 100), scalars.backoff(F.lit(90), 10, 100), scalars.chunk_end_estimate(F.lit(0), F.lit(9), F.lit(400)), scalars.checksum(F.lit(b"abc"))))[0] == (10, 100, 40, 891568578)


def test_codecs(spark):
    rng = np.random.default_rng(3)
    for t, v in ((np.array([], np.int64), np.array([])), (np.array([-5]), np.array([np.nan])), (np.array([-(2**62), 0, 2**62]), np.array([np.inf, -0.0, 1e-310])), (np.cumsum(rng.integers(1, 9999, 500)), rng.normal(size=500))):
        a, b = codecs.decode(codecs.encode(t, v))
        assert a.tolist() == t.tolist() and np.array_equal(b.view(np.uint64), np.asarray(v, float).view(np.uint64))
    x = np.array([0, 1, 127, 128, 2**64 - 1], np.uint64)
    assert codecs.from_varints(codecs.to_varints(x)).tolist() == x.tolist() and codecs.to_varints(x[:4]) == b"\x00\x01\x7f\x80\x01"
    y = np.array([0, -1, 1, -(2**63), 2**63 - 1], np.int64)
    assert codecs.unzigzag(codecs.zigzag(y)).tolist() == y.tolist()
    s = spark.createDataFrame([(i % 3, int(t), float(t)) for i, t in enumerate(rng.integers(-5_000_000, 5_000_000, 700))], "series_id long, ts_ms long, value double").dropDuplicates(["series_id", "ts_ms"])
    chunks = codecs.to_chunks(s, size=50).cache()
    assert sorted(rows(codecs.from_chunks(chunks))) == sorted(rows(s)) and chunks.agg(F.max("n")).first()[0] <= 50
    assert sorted(rows(codecs.from_chunks(chunks, 0, 1000000))) == sorted(r for r in rows(s) if 0 <= r[1] <= 1000000)
    assert rows(codecs.from_chunks(chunks.limit(0))) == []


def test_regex_matches_whole_values_in_the_engines_dialect(spark):
    cases = {"a.*": ["a", "ab"], "a": ["a"], "(?s)a.*": ["a", "a\n", "ab"], "(?P<n>a)": [], "*": [], "a)|(b": [], r"\p{Lower}": ["a", "b"], "a{0,1}": ["", "a"], "a++": ["a"], "(?x) a # b)": ["a"], "": [""], "a|b": ["a", "b"]}
    values = ["", "a", "a\n", "ab", "b", "A"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for p, want in cases.items():
        m = Regex("v", p)
        assert [r[0] for r in df.where(m.test(F.col("v"))).collect()] == want, p
        assert [v for v in values if m.accepts(v)] == want, p


@pytest.mark.parametrize("backward", [False, True])
def test_before_against_brute_force(spark, backward):
    from tidemark.operators.prefix import before

    rng = random.Random(4)
    data = [(rng.choice(["a", "a", "b", None]), rng.randrange(-500, 500), i, rng.choice([None, 1, 5, -3, 7])) for i in range(300)]
    df = spark.createDataFrame(data, "e string, t long, u long, v long")
    got = {r["u"]: (r["hi"], r["lo"], r["all"]) for r in before(df, "e", "t", ["u"], {"hi": (F.max, F.col("v")), "lo": (F.min, F.col("v")), "all": (F.sum, F.col("v"))}, chunk=100, backward=backward).collect()}
    for e, t, u, _ in data:
        seen = [v for e2, t2, u2, v in data if e2 == e and v is not None and ((t2, u2) > (t, u) if backward else (t2, u2) < (t, u))]
        assert got[u] == ((max(seen), min(seen), sum(seen)) if seen else (None, None, None))
    assert before(df.limit(0), "e", "t", [], {"x": (F.max, F.col("v"))}).count() == 0


def test_deletion_with_very_many_ranges(spark, monkeypatch):
    rng = random.Random(6)
    holes = [(rng.choice([1, 2, None]), a, a + rng.choice([-1, 0, 3, 40])) for a in (rng.randrange(-1000, 1000) for _ in range(150))] + [(3, -(2**63), -5)]
    data = [(rng.choice([1, 1, 2, 3, 4, None]), rng.choice([rng.randrange(-1100, 1100), None]), float(i), i) for i in range(600)]
    s, t = spark.createDataFrame(data, "series_id long, ts_ms long, value double, seq long"), spark.createDataFrame(holes, "series_id long, min_t long, max_t long")
    want = sorted((r for r in data if r[0] is None or r[1] is None or not any(h[0] == r[0] and h[1] <= r[1] <= h[2] for h in holes)), key=repr)
    for limit in (1000, 0):
        monkeypatch.setattr(tombstones, "OF_SERIES", limit)
        assert sorted(rows(tombstones.apply(s, t)), key=repr) == want


def test_sides_are_broadcast_by_rows_and_bytes(spark):
    from tidemark.operators.joins import is_small, join_checked

    a = spark.createDataFrame([(i, "x" * 100) for i in range(50)], "k long, t string")
    assert is_small(a, 50) and not is_small(a, 49) and not is_small(a, 50, 3000) and is_small(a.select("k"), 50, 0) and is_small(a.limit(0), 0, 0)
    odd = spark.createDataFrame([(1, None, None, None, None)], "k long, t string, m map<string,string>, l array<long>, b binary")
    assert is_small(odd) and join_checked(a, odd.drop("t"), ["k"]).count() == 1 and join_checked(a, odd.drop("t"), ["k"], limit=0).count() == 1

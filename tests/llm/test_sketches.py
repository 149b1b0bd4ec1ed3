"""Percentiles, distinct counts and frequent values against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm.distinct import count_distinct, partial_sets
from tidemark.llm.frequent import bounds, heavy_hitters, merge, sketch
from tidemark.llm.quantiles import partial_counts, percentiles
from tidemark.llm.queries import p2_zone

NAN, INF = float("nan"), float("inf")
PROBS = (0.0, 0.1, 0.5, 0.99, 1.0)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_percentiles_against_numpy(spark):
    rng = random.Random(2)
    data = [(rng.choice(["a", "b", None]), rng.choice([1, 2]), d, rng.choice([rng.gauss(0, 10), 5.0, -0.0])) for d in (0, 1, 2) for _ in range(500)]
    data += [("hot", 1, 0, float(i % 97)) for i in range(3000)] + [("one", 1, 0, 7.0), ("nan", 1, 0, NAN), ("null", 1, 0, None)]
    df = spark.createDataFrame(data, "g string, h int, day int, v double").selectExpr("*", "1 as _v", "2 as upto")
    whole = partial_counts(df, ["g", "h"], "v", "day")
    by_day = partial_counts(df.where("day = 0"), ["g", "h"], "v", "day")
    for d in (1, 2):
        by_day = by_day.unionByName(partial_counts(df.where(f"day = {d}"), ["g", "h"], "v", "day"))
    want = defaultdict(list)
    for g, h, _, v in data:
        if v is not None and v == v:
            want[(g, h)].append(v)
    for counts in (whole, by_day):
        got = {(g, h, p): (v, n) for g, h, p, v, n in rows(percentiles(counts, ["g", "h"], "v", PROBS))}
        assert len(got) == len(want) * len(PROBS)
        for (g, h), vs in want.items():
            for p in PROBS:
                assert got[(g, h, p)] == (pytest.approx(np.quantile(vs, p), abs=1e-9), len(vs))


def test_percentiles_of_infinities_and_nothing(spark):
    df = spark.createDataFrame([(1, x) for x in (-INF, 1.0, 2.0, INF)] + [(2, INF), (2, INF)], "g int, v double")
    got = {(g, p): v for g, p, v, _ in rows(percentiles(partial_counts(df, ["g"], "v"), ["g"], "v", (0.1, 0.5, 0.9)))}
    assert got == {(1, 0.1): -INF, (1, 0.5): 1.5, (1, 0.9): INF, (2, 0.1): INF, (2, 0.5): INF, (2, 0.9): INF}
    assert rows(percentiles(partial_counts(df.limit(0), ["g"], "v"), ["g"], "v", (0.5,))) == []
    with pytest.raises(ValueError):
        percentiles(partial_counts(df, ["g"], "v"), ["g"], "v", (1.5,))


def test_distinct_against_sets(spark):
    rng = random.Random(4)
    data = [(rng.choice([0, 1, None]), rng.choice(["x", "y", None]), "hot" if rng.random() < 0.4 else f"i{rng.randrange(300)}") for _ in range(4000)] + [(0, "x", None)]
    df = spark.createDataFrame(data, "day int, zone string, id string").selectExpr("*", "1 as bucket2", "'q' as level")
    combos = [["day"], ["day", "zone"], []]
    a, b = partial_sets(df.where("day = 0 or day is null"), ["day", "zone"], "id"), partial_sets(df, ["day", "zone"], "id")
    got = {(d, z, lv): n for d, z, lv, n in rows(count_distinct(a.unionByName(b), ["day", "zone"], combos, "id"))}
    want = defaultdict(set)
    for d, z, i in data:
        if i is not None:
            want[(d, None, "day")].add(i)
            want[(d, z, "day+zone")].add(i)
            want[(None, None, "all")].add(i)
    assert got == {k: len(v) for k, v in want.items()}
    assert rows(count_distinct(b.limit(0), ["day", "zone"], combos, "id")) == []


def stream(seed, n=6000):
    rng = random.Random(seed)
    data = []
    for _ in range(n):
        r = rng.random()
        data.append((rng.choice(["p", "q"]), "big" if r < 0.3 else "Big" if r < 0.34 else rng.choice(["m1", "m2", "m3"]) if r < 0.4 else f"r{rng.randrange(100000)}"))
    return data + [("p", None), ("p", ""), (None, "n"), (None, "n"), ("p", "käfer")] * 20


@pytest.mark.parametrize("cells", [2048, 32])
def test_sketch_bounds_hold(spark, cells):
    data = stream(1)
    df = spark.createDataFrame(data, "name string, value string").repartition(5)
    parts = sketch(df, cells=cells)
    true = Counter(x for x in data if x[1])
    totals = Counter(x[0] for x in data if x[1])
    merged = merge(parts)
    for r in merged.collect():
        assert 0 <= r["votes"] <= r["total"]
        f = true[(r["name"], r["candidate"])]
        assert r["votes"] <= f <= (r["total"] + r["votes"]) / 2
    assert {(r["name"], r["row"]): 0 for r in merged.collect()}.keys() == {(n, i) for n in totals for i in range(4)}
    assert all(sum(r["total"] for r in merged.where("row = 0").collect() if r["name"] == n) == k for n, k in totals.items())
    for name, value, lower, upper, k in rows(bounds(merged, 0.01, width=cells)):
        assert lower <= true[(name, value)] <= upper and k == totals[name]
    again = merge(parts.unionByName(sketch(df.limit(0), cells=cells)))
    assert sorted(rows(again), key=repr) == sorted(rows(merged), key=repr)


def test_sketch_adds_batch_by_batch_and_passes_names_on(monkeypatch):
    import pyarrow as pa

    import tidemark.llm.frequent as f

    monkeypatch.setattr(f, "BLOCK", 10)
    monkeypatch.setattr(f, "NAMES", 2)
    rng = random.Random(5)
    data = [(f"1n{rng.randrange(5)}", rng.choice(["a", "a", "a", f"v{rng.randrange(50)}"])) for _ in range(400)]
    cells = {v: hash(v) % 4 for _, v in data}
    batches = [pa.record_batch([pa.array([x[0] for x in data[i : i + 7]]), pa.array([x[1] for x in data[i : i + 7]]), pa.array([cells[x[1]] for x in data[i : i + 7]], pa.int32())], ["n", "v", "c0"]) for i in range(0, 400, 7)]
    out = [r for b in f._partials(1, 4)(iter(batches)) for r in b.to_pylist()]
    total = Counter()
    for r in out:
        total[r["name"]] += r["total"]
    assert total == Counter(x[0] for x in data) and len({(r["name"], r["cell"]) for r in out}) < len(out)


@pytest.mark.parametrize("cells", [2048, 16, 2])
def test_heavy_hitters_exact_at_any_width(spark, cells):
    data = stream(2)
    df = spark.createDataFrame(data, "name string, value string").repartition(3).selectExpr("*", "1 as row", "2 as cell")
    true, totals = Counter(x for x in data if x[1]), Counter(x[0] for x in data if x[1])
    for share in (0.01, 0.3):
        want = {(n, v, c, totals[n]) for (n, v), c in true.items() if c / totals[n] >= share}
        assert set(rows(heavy_hitters(df, share, cells=cells))) == want
    assert rows(heavy_hitters(df.limit(0))) == []


def test_share_at_the_border(spark):
    data = [("a", "x")] * 7 + [("a", f"v{i}") for i in range(693)]
    assert rows(heavy_hitters(spark.createDataFrame(data, "name string, value string"), 0.01)) == [("a", "x", 7, 700)]


def test_numbers_with_a_unit_are_read(spark, tmp_path):
    values = ["1", "2,5 u", " 3e0u ", "+4 u", "n/a", "-", "NaN", "", "u", "5 s", "6 u u", None]
    data = [(i, 0, i, "took_ms", v) for i, v in enumerate(values)] + [(i, 0, i, "zone", "a") for i in range(len(values))]
    spark.createDataFrame(data, "series_id long, ts_ms long, seq long, name string, value string").write.parquet(f"{tmp_path}/tags.parquet")
    got = {(r["name"], r["zone"], r["p"]): (r["value"], r["count"]) for r in p2_zone(spark, str(tmp_path)).collect()}
    assert got[("took_ms", "a", 0.5)] == (2.75, 4)


def test_a_block_of_very_many_names():
    import pyarrow as pa

    from tidemark.llm import frequent

    n = 100_000
    names = [f"1n{i}" for i in range(n)] + ["1n5"] * 10
    values = ["a"] * n + ["b"] * 10
    cells = [[(7 * i + r) % frequent.CELLS for i in range(n)] + [(35 + r) % frequent.CELLS] * 10 for r in range(frequent.ROWS)]
    block = pa.record_batch([names, values, *(pa.array(c, pa.int32()) for c in cells)], ["n", "v", *(f"c{r}" for r in range(frequent.ROWS))])
    before = pa.total_allocated_bytes()
    out = list(frequent._partials(frequent.ROWS, frequent.CELLS)(iter([block, block])))
    rows = [r for b in out for r in b.to_pylist() if r["row"] == 0]
    # Two blocks make one here; the names held have a row each, the others too, and nothing is lost.
    assert sum(r["total"] for r in rows) == 2 * (n + 10) and len({r["name"] for r in rows}) == n
    assert [r for r in rows if r["name"] == "1n5"] == [{"name": "1n5", "row": 0, "cell": 35, "total": 22, "candidate": "b", "votes": 18}]
    assert pa.total_allocated_bytes() - before < 200_000_000

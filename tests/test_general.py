"""Rolling totals, grids, spikes and intervals against brute force, and on odd input."""

import math
import random

import numpy as np
import pytest

from tidemark.operators.grid import regular_grid
from tidemark.operators.intervals import merge_ranges
from tidemark.operators.readings import latest
from tidemark.operators.rolling import rolling_totals
from tidemark.operators.spikes import implausible, sparse_part

DAY = 86_400_000
SAMPLES = "series_id long, ts_ms long, value double, seq long"
NAN, INF = float("nan"), float("inf")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_latest_rules(spark):
    df = spark.createDataFrame([(1, 5, 1.0, 1), (1, 5, 2.0, 3), (1, 5, 9.0, 2), (1, 6, 1.0, 4), (1, 6, 7.0, 4), (1, 7, 3.0, None), (1, 7, 4.0, 0), (1, 8, NAN, 9), (None, 1, 1.0, 1), (1, None, 1.0, 1), (1, 9, None, 1), (1, 5, 2.0, 3)], SAMPLES)
    got = {(a, b): c for a, b, c in rows(latest(df.selectExpr("*", "1 as _e", "'x' as _v")))}
    assert math.isnan(got.pop((1, 8)))
    assert got == {(1, 5): 2.0, (1, 6): 7.0, (1, 7): 4.0}


@pytest.mark.parametrize("windows", [(1,), (7, 30), (2, 5, 16)])
def test_rolling_against_brute_force(spark, windows):
    rng = random.Random(3)
    data = [(s, rng.randrange(-5 * DAY, 60 * DAY), float(rng.randrange(100)), i) for i in range(400) for s in (rng.randrange(3),)]
    data += [(0, 3 * DAY, NAN, 1000), (0, 3 * DAY + 1, INF, 1001), (0, 3 * DAY + 2, 1e300, 1002), (None, 1, 1.0, 1), (1, None, 1.0, 2), (9, 77, 1.0, 3)]
    got = {(r["series_id"], r["day"]): r for r in rolling_totals(spark.createDataFrame(data, SAMPLES), windows=windows).collect()}
    by = {}
    for s, t, v, q in data:
        if s is not None and t is not None and by.get((s, t), (None, -1))[1] < q:
            by[(s, t)] = (v, q)
    seen = 0
    for s in {k[0] for k in by}:
        days = [t // DAY for (x, t) in by if x == s]
        for d in range(min(days), max(days) + 1):
            r = got[(s, d)]
            seen += 1
            for n in windows:
                inside = [v for (x, t), (v, _) in by.items() if x == s and d - n < t // DAY <= d]
                fin = [v for v in inside if math.isfinite(v)]
                assert r[f"count_{n}"] == len(fin) and r[f"nonfinite_{n}"] == len(inside) - len(fin)
                assert r[f"sum_{n}"] == pytest.approx(math.fsum(fin))
                assert (r[f"mean_{n}"] is None) == (not fin)
    assert seen == len(got)


def test_rolling_empty_and_bad_windows(spark):
    empty = spark.createDataFrame([], SAMPLES)
    assert rows(rolling_totals(empty)) == []
    with pytest.raises(ValueError):
        rolling_totals(empty, windows=(0,))


def test_grid_states(spark):
    data = [(1, 0, 1.0, 1), (1, 12, 2.0, 2), (1, 13, 3.0, 5), (1, 13, 4.0, 6), (1, 51, 5.0, 7), (1, 200, 6.0, 8), (2, -15, 1.0, 1), (2, 5, NAN, 2), (3, 1, 1.0, 1), (None, 1, 1.0, 1), (1, None, 1.0, 1), (1, 30, None, 9)]
    steps = spark.createDataFrame([(1, 10), (1, 10), (2, 10), (4, 10), (3, 0), (None, 5)], "series_id long, scrape_ms long")
    df = spark.createDataFrame(data, SAMPLES).selectExpr("*", "0 as _slot", "'a' as state")
    got = sorted(rows(regular_grid(df, steps, max_gap_slots=2, off_ms=50)), key=lambda r: r[:2])
    assert [r for r in got if r[0] == 1][:7] == [(1, 0, 1.0, 1, "observed"), (1, 10, 4.0, 3, "observed"), (1, 20, 4.0, 0, "filled"), (1, 30, 4.0, 0, "filled"), (1, 40, None, 0, "missing"), (1, 50, 5.0, 1, "observed"), (1, 60, None, 0, "off")]
    assert {r[4] for r in got if r[0] == 1 and 60 <= r[1] < 200} == {"off"}
    two = [r for r in got if r[0] == 2]
    assert [r[1] for r in two] == [-20, -10, 0] and [r[4] for r in two] == ["observed", "filled", "observed"] and math.isnan(two[2][2])
    assert {r[0] for r in got} == {1, 2}
    short = rows(regular_grid(df, steps, max_gap_slots=2, off_ms=50, keep_off=False))
    assert sorted(short, key=lambda r: r[:2])[:6] == got[:6] and all(r[4] != "off" for r in short)


def test_grid_over_block_borders(spark, monkeypatch):
    import tidemark.operators.grid as g

    rng = random.Random(5)
    data = [(s, rng.randrange(-3000, 20000), float(i), i) for i, s in enumerate(rng.choices((1, 2), k=300))]
    steps = spark.createDataFrame([(1, 10), (2, 7)], "series_id long, scrape_ms long")
    df = spark.createDataFrame(data, SAMPLES)
    whole = sorted(rows(regular_grid(df, steps, off_ms=200)), key=repr)
    monkeypatch.setattr(g, "BLOCK_SLOTS", 4)
    assert sorted(rows(regular_grid(df, steps, off_ms=200)), key=repr) == whole
    a = sorted(rows(regular_grid(df, steps, off_ms=200, keep_off=False)), key=repr)
    assert a == [r for r in whole if r[4] != "off"]


def test_grid_empty(spark):
    steps = spark.createDataFrame([(1, 10)], "series_id long, scrape_ms long")
    assert rows(regular_grid(spark.createDataFrame([], SAMPLES), steps)) == []


def brute_periods(data):
    out = set()
    for e in {r[0] for r in data}:
        spans = sorted((a, b) for x, a, b in data if x == e and a is not None and b is not None and a < b)
        merged = []
        for a, b in spans:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(e, "period", a, b) for a, b in merged}
        out |= {(e, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


def test_merge_ranges(spark):
    rng = random.Random(7)
    data = [(rng.choice(["a", "b", None]), a, a + rng.choice([-5, 0, 1, 50, 400])) for a in (rng.randrange(-3000, 9000) for _ in range(400))]
    data += [("a", None, 5), ("a", 5, None), ("c", 2**63 - 1, -(2**63)), ("d", -(2**63), 2**63 - 1), ("d", 4, 5)] * 2
    df = spark.createDataFrame(data, "store_dir string, min_t long, max_t long").selectExpr("*", "1 as _a", "2 as kind")
    for chunk in (100, DAY):
        got = rows(merge_ranges(df, chunk=chunk))
        assert len(got) == len(set(got)) and set(got) == brute_periods(data)
    assert rows(merge_ranges(df.limit(0))) == []


def test_merge_ranges_over_chunks(spark):
    # Touching at a chunk's start, 1 ms short of it, one long range over empty and occupied chunks, nested in an earlier chunk's range, three chunks that touch, and a lone last one.
    data = [("a", 0, 100), ("a", 100, 130), ("b", 0, 99), ("b", 100, 130), ("c", 10, 950), ("c", 20, 30), ("c", 310, 320), ("c", 940, 960), ("c", 970, 980), ("d", 10, 90), ("d", 20, 310), ("d", 305, 306), ("d", 311, 312)]
    data += [("e", 50, 150), ("e", 150, 250), ("e", 250, 350), ("e", 360, 370), ("e", 900, 901), ("f", -150, -100), ("f", -100, -50), ("f", -49, 0)]
    got = rows(merge_ranges(spark.createDataFrame(data, "store_dir string, min_t long, max_t long"), chunk=100))
    assert len(got) == len(set(got)) and set(got) == brute_periods(data)


def test_merge_ranges_rests_on_sessions(spark, monkeypatch):
    """With windows that join no ranges but those of the same start, overlapping ranges must come out apart: no later step may redo the sessions."""
    import tidemark.operators.intervals as iv

    for data in ([("a", 0, 10), ("a", 5, 8), ("a", 9, 12), ("a", 20, 30)], [("a", 50, 150), ("a", 150, 250), ("a", 330, 340)]):
        df = spark.createDataFrame(data, "store_dir string, min_t long, max_t long")
        assert set(rows(merge_ranges(df, chunk=100))) == brute_periods(data)
        with monkeypatch.context() as m:
            m.setattr(iv.F, "session_window", lambda time, gap: iv.F.struct(time.alias("start")).alias("session_window"))
            assert set(rows(merge_ranges(df, chunk=100))) != brute_periods(data)


SOURCES = "series_id long, lo double, hi double, scrape_ms long, counter boolean"


def wave(n, step, seed, base=50.0):
    rng = np.random.default_rng(seed)
    t = np.arange(n) * step
    return t, base + 5 * np.sin(2 * np.pi * t / DAY) + np.cumsum(rng.normal(0, 0.05, n)) * 0.1 + rng.normal(0, 0.1, n)


def test_implausible_kinds(spark):
    step = 3_600_000
    t, v = wave(600, step, 1)
    bad = {50: 80.0, 51: 81.0, 200: -10.0, 300: NAN, 310: INF, 320: 1e9}
    v = v.copy()
    for i, x in bad.items():
        v[i] = x
    v[400:415] = v[400]
    v[500:] += 30  # a change of level that lasts
    data = [(1, int(a), float(b), i) for i, (a, b) in enumerate(zip(t, v))]
    counter = np.cumsum(np.random.default_rng(2).uniform(8, 12, 600))
    counter[300:] -= counter[300]  # a restart
    counter[100] += 500
    data += [(2, int(a), float(b), 0) for a, b in zip(t, counter)]
    data += [(3, int(a), 7.0 if i != 30 else 9.0, 0) for i, a in enumerate(t)]  # constant by nature, but for one spike
    data += [(4, int(a), 1.0, 0) for a in t[:3]] + [(5, 0, 1.0, 0)] + [(None, 1, 1.0, 1), (1, None, 1.0, 1), (1, 1, None, 1), (7, 1, 1e9, 1)]
    src = spark.createDataFrame([(1, 0.0, 100.0, step, False), (2, 0.0, None, step, True), (3, None, NAN, step, None), (4, None, None, step, False), (5, 2.0, None, step, False), (6, None, None, step, False), (None, 1.0, 1.0, step, True), (8, None, None, None, None)], SOURCES)
    got = {(r[0], r[1] // step): r[3] for r in rows(implausible(spark.createDataFrame(data, SAMPLES), src))}
    want = {(1, 50): "spike", (1, 51): "spike", (1, 200): "impossible", (1, 300): "impossible", (1, 310): "impossible", (1, 320): "impossible", (2, 100): "spike", (3, 30): "spike", (5, 0): "impossible"}
    want |= {(1, i): "stuck" for i in range(400, 415)}
    assert got == want


def test_implausible_same_in_any_chunks(spark, monkeypatch):
    import tidemark.operators.spikes as s

    step = 600_000
    t, v = wave(3000, step, 4)
    v = v.copy()
    rng = np.random.default_rng(9)
    for i in rng.choice(2900, 60, replace=False):
        v[i : i + int(rng.integers(1, 4))] += 40
    for i in (127, 500, 1020):
        v[i : i + 12] = v[i]
    df = spark.createDataFrame([(1, int(a), float(b), 0) for a, b in zip(t, v)], SAMPLES)
    src = spark.createDataFrame([(1, None, None, step, False)], SOURCES)
    one = sorted(rows(implausible(df, src)))
    monkeypatch.setattr(s, "CHUNK_READINGS", 128)
    assert sorted(rows(implausible(df, src))) == one and len(one) > 80


def test_implausible_empty(spark):
    assert rows(implausible(spark.createDataFrame([], SAMPLES), spark.createDataFrame([], SOURCES))) == []


def test_sparse_part_leaves_spikes_and_takes_rhythm():
    rng = np.random.default_rng(0)
    rhythm = np.outer(np.ones(30), 20 * (np.arange(24) == 6) - 20 * (np.arange(24) == 18))
    m = rhythm + rng.normal(0, 1, (30, 24))
    m[4, 10] += 40
    rest = sparse_part(m, np.ones_like(m, bool))
    assert abs(rest[4, 10]) > 30 and np.abs(np.delete(rest.ravel(), 4 * 24 + 10)).max() < 13


def test_implausible_in_a_source_stuck_most_of_the_time(spark):
    step = 3_600_000
    t, v = wave(600, step, 3)
    v = v.copy()
    v[50] += 80
    v[200:] = v[200]
    flat = np.full(600, 7.0)
    flat[[100, 300, 301, 302, 500]] = 9.0, 8.0, 9.0, 10.0, 9.0  # constant by nature, but for spikes
    data = [(i, int(a), float(b), 0) for i, x in ((1, v), (2, flat)) for a, b in zip(t, x)]
    src = spark.createDataFrame([(i, None, None, step, False) for i in (1, 2)], SOURCES)
    got = {(r[0], r[1] // step - int(t[0]) // step): r[3] for r in rows(implausible(spark.createDataFrame(data, SAMPLES), src))}
    assert {i for (e, i), k in got.items() if e == 1 and k == "stuck"} == set(range(200, 600)) and got[(1, 50)] == "spike"
    assert {k for (e, _), k in got.items() if e == 2} == {"spike"}


def test_spikes_rest_on_the_components(spark, monkeypatch):
    import tidemark.operators.spikes as s

    t, v = wave(1440, 600_000, 5)
    v = v.copy()
    odd = {60, 190, 191, 420, 1000, 1001, 1002}
    v[list(odd)] += 30
    args = (t, v, False, -np.inf, np.inf, 600_000, float(np.median(np.abs(np.diff(v)))), True)
    assert set(np.flatnonzero(s.flag_chunk(*args))) == odd
    assert set(np.flatnonzero(s.flag_chunk(t[144:288], v[144:288], *args[2:]))) == {46, 47}  # a single day has its components too
    monkeypatch.setattr(s, "sparse_part", lambda m, seen: m)
    assert len(odd & set(np.flatnonzero(s.flag_chunk(*args)))) < 4


def test_a_source_denser_than_its_step_is_cut(spark, monkeypatch):
    import tidemark.operators.spikes as s

    rng = np.random.default_rng(3)
    t = np.sort(rng.choice(3_600_000 * 30, 6000, replace=False))
    v = np.cumsum(rng.normal(0, 1, 6000))
    v[[1000, 3000, 3001, 5000]] += 400
    df = spark.createDataFrame([(1, int(a), float(b), 0) for a, b in zip(t, v)], SAMPLES)
    src = spark.createDataFrame([(1, None, None, 3_600_000, False)], SOURCES)
    one = sorted(rows(implausible(df, src)))
    sizes = []
    kept = s.written
    monkeypatch.setattr(s, "CHUNK_READINGS", 500)
    monkeypatch.setattr(s, "written", lambda d, name: (lambda w: (sizes.extend(r[0] for r in w.select("n").collect()) if name == "chunks" else None, w)[1])(kept(d, name)))
    assert sorted(rows(implausible(df, src))) == one and {r[1] for r in one} == set(t[[1000, 3000, 3001, 5000]].tolist())
    assert len(sizes) >= 11 and max(sizes) <= 500 + 110 and sum(sizes) == 6000

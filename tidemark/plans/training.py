"""Queries pN_ of the general data-preparation problems, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.grid import regular_grid
from tidemark.operators.intervals import merge_ranges
from tidemark.operators.readings import one_metric
from tidemark.operators.rolling import rolling_totals
from tidemark.operators.spikes import implausible
from tidemark.sources.tables import table

#: An unbroken silence longer than this means that the series was switched off.
OFF_MS = 259_200_000


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """(series_id, metric, unit, kind, lo, hi, scrape_ms, counter) of the registered series."""
    info = table(spark, folder, "metric_info")
    return one_metric(table(spark, folder, "series")).join(info, "metric").withColumn("counter", F.col("kind") == "counter")


def p1_trailing_totals(spark: SparkSession, folder: str) -> DataFrame:
    return rolling_totals(table(spark, folder, "samples"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    grid = regular_grid(table(spark, folder, "samples"), sources(spark, folder), off_ms=OFF_MS, keep_off=False)
    return grid.where("state in ('filled', 'missing')").select("series_id", "slot_ms")


def p4_grid(spark: SparkSession, folder: str) -> DataFrame:
    return regular_grid(table(spark, folder, "samples"), sources(spark, folder), off_ms=OFF_MS)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_flags(spark, folder).select("series_id", "ts_ms")


def p6_flags(spark: SparkSession, folder: str) -> DataFrame:
    return implausible(table(spark, folder, "samples"), sources(spark, folder))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return merge_ranges(table(spark, folder, "blocks"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_trailing_totals, p4_found, p4_grid, p6_found, p6_flags, p7_found)}


_READINGS = "SELECT series_id, ts_ms, max_by(value, seq) AS value FROM samples WHERE series_id IS NOT NULL AND ts_ms IS NOT NULL AND value IS NOT NULL GROUP BY series_id, ts_ms"

_SLOTS = f"""WITH r AS ({_READINGS}), m AS (SELECT series_id, min(metric) AS metric FROM series WHERE series_id IS NOT NULL AND metric IS NOT NULL GROUP BY series_id),
w AS (SELECT m.series_id, i.scrape_ms AS w FROM m JOIN metric_info i ON i.metric = m.metric),
s AS (SELECT x.series_id, x.ts_ms - ((x.ts_ms % w.w) + w.w) % w.w AS slot, w.w, x.ts_ms, x.value FROM r x JOIN w ON x.series_id = w.series_id),
raw AS (SELECT x.series_id, x.ts_ms - ((x.ts_ms % w.w) + w.w) % w.w AS slot, count(*) AS n FROM samples x JOIN w ON x.series_id = w.series_id WHERE x.ts_ms IS NOT NULL AND x.value IS NOT NULL GROUP BY 1, 2),
o AS (SELECT series_id, slot, w, max_by(value, ts_ms) AS value FROM s GROUP BY series_id, slot, w),
g AS (SELECT *, lead(slot) OVER (PARTITION BY series_id ORDER BY slot) AS nx FROM o),
e AS (SELECT series_id, slot, w, value, nx, unnest(range(slot + w, nx, w)) AS slot_ms FROM g WHERE nx > slot + w)"""


def exact_sql(v: str) -> str:
    """A finite double as a whole number in units of 2^-64."""
    return f"CAST(trunc((CASE WHEN isfinite({v}) THEN {v} ELSE 0.0 END) * 18446744073709551616.0) AS HUGEINT)"


def double_sql(total: str) -> str:
    """The double of a sum of such numbers."""
    a = f"abs({total})"
    return f"(CASE WHEN {total} < 0 THEN -1.0 ELSE 1.0 END * (CAST({a} >> 96 AS DOUBLE) * 4294967296.0 + CAST(({a} >> 64) & 4294967295 AS DOUBLE) + (CAST(({a} >> 32) & 4294967295 AS DOUBLE) / 4294967296.0 + CAST({a} & 4294967295 AS DOUBLE) / 18446744073709551616.0)))"


def _trailing_sql() -> str:
    cols, sums = [], []
    for n in (7, 30):
        over = f"OVER (PARTITION BY series_id ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        sums.append(f"CAST(sum(s) {over} AS HUGEINT) AS s{n}, CAST(sum(n) {over} AS BIGINT) AS n{n}, CAST(sum(x) {over} AS BIGINT) AS x{n}")
        cols.append(f"{double_sql(f's{n}')} AS sum_{n}, CASE WHEN n{n} > 0 THEN {double_sql(f's{n}')} / n{n} END AS mean_{n}, n{n} AS count_{n}, x{n} AS nonfinite_{n}")
    return f"""WITH r AS ({_READINGS}), d AS (SELECT series_id, CAST(floor(ts_ms / 86400000.0) AS BIGINT) AS day, coalesce(sum({exact_sql('value')}) FILTER (WHERE isfinite(value)), 0) AS s, count(*) FILTER (WHERE isfinite(value)) AS n, count(*) FILTER (WHERE NOT isfinite(value)) AS x FROM r GROUP BY 1, 2),
g AS (SELECT series_id, unnest(range(min(day), max(day) + 1)) AS day FROM d GROUP BY series_id),
f AS (SELECT g.series_id, g.day, coalesce(d.s, 0) AS s, coalesce(d.n, 0) AS n, coalesce(d.x, 0) AS x FROM g LEFT JOIN d ON g.series_id = d.series_id AND g.day = d.day), t AS (SELECT series_id, day, {", ".join(sums)} FROM f)
SELECT series_id, day, {", ".join(cols)} FROM t"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_trailing_totals": _trailing_sql(),
        "p4_found": f"{_SLOTS} SELECT series_id, slot_ms FROM e WHERE nx - slot - w <= {OFF_MS}",
        "p4_grid": f"""{_SLOTS} SELECT o.series_id, o.slot AS slot_ms, o.value, raw.n, 'observed' AS state FROM o JOIN raw ON raw.series_id = o.series_id AND raw.slot = o.slot
UNION ALL SELECT series_id, slot_ms, CASE WHEN nx - slot - w <= {OFF_MS} AND slot_ms - slot <= 3 * w THEN value END, 0, CASE WHEN nx - slot - w > {OFF_MS} THEN 'off' WHEN slot_ms - slot <= 3 * w THEN 'filled' ELSE 'missing' END FROM e""",
        "p7_found": """WITH r AS (SELECT store_dir, min_t, max_t FROM blocks WHERE min_t < max_t),
p AS (SELECT *, max(max_t) OVER (PARTITION BY store_dir ORDER BY min_t, max_t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM r),
g AS (SELECT *, sum(CASE WHEN seen IS NULL OR min_t > seen THEN 1 ELSE 0 END) OVER (PARTITION BY store_dir ORDER BY min_t, max_t ROWS UNBOUNDED PRECEDING) AS k FROM p),
q AS (SELECT store_dir, k, min(min_t) AS a, max(max_t) AS b FROM g GROUP BY store_dir, k), n AS (SELECT *, lead(a) OVER (PARTITION BY store_dir ORDER BY a) AS na FROM q)
SELECT store_dir, 'period' AS kind, a AS from_t, b AS to_t FROM q UNION ALL SELECT store_dir, 'gap', b, na FROM n WHERE na IS NOT NULL""",
    }

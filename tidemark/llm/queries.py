"""Queries pN_ of the text and sketch problems, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.distinct import count_distinct, partial_sets
from tidemark.llm.frequent import bounds, heavy_hitters, merge, sketch
from tidemark.llm.mixing import budgets, mix, shares
from tidemark.llm.packing import bound, pack
from tidemark.llm.quantiles import partial_counts, percentiles
from tidemark.llm.residue import residue, without_residue
from tidemark.llm.tokens import with_tokens
from tidemark.operators.joins import join_checked
from tidemark.operators.readings import one_metric
from tidemark.session import written
from tidemark.sources.tables import table

PROBS = (0.01, 0.25, 0.5, 0.75, 0.95, 0.99)


def _day() -> Column:
    return F.floor(F.col("ts_ms") / 86_400_000).cast("long")


def p2_series(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles for each series, from partial counts for each day."""
    rows = table(spark, folder, "samples").where("series_id is not null").withColumn("day", _day())
    return percentiles(partial_counts(rows, ["series_id"], "value", "day"), ["series_id"], "value", PROBS)


def p2_metric(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles for each metric of registered series."""
    rows = table(spark, folder, "samples").where("series_id is not null").withColumn("day", _day())
    parts = partial_counts(rows, ["series_id"], "value", "day")
    named = join_checked(parts, one_metric(table(spark, folder, "series")), ["series_id"])
    return percentiles(named, ["metric"], "value", PROBS)


#: Numbers as the tags spell them: digits with an optional sign, a point or comma before the decimals, an exponent, the unit "u" behind, and
#: spaces around. Other spellings (other units, whose scale isn't known, words, signs alone) are unreadable.
_NUMBER = r"^ *[+-]?(\d+([.,]\d*)?|[.,]\d+)([eE][+-]?\d+)? *u? *$"


def p2_zone(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of the readable numbers of took_ms and size_b, for each zone of their insert (null: none given)."""
    tags = table(spark, folder, "tags")
    zone = tags.where("name = 'zone' and value <> ''").groupBy("seq").agg(F.max("value").alias("zone"))
    rows = tags.where("name in ('took_ms', 'size_b')").where(F.col("value").rlike(_NUMBER))
    rows = rows.select("seq", "name", F.trim(F.translate("value", ",u", ".")).cast("double").alias("value"), _day().alias("day")).join(zone, "seq", "left")
    return percentiles(partial_counts(rows, ["name", "zone"], "value", "day"), ["name", "zone"], "value", PROBS)


def p3_combinations(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct clients, traces and series for each day, and each day with zone, build, and both of the same insert.

    Null and empty values are no values. An insert that carries zone or build with several values counts under the greatest; it counts under all of its clients and traces.
    """
    value = F.when(F.col("value") != "", F.col("value"))

    def of(name: str):  # noqa: ANN202
        return F.when(F.col("name") == name, value)

    def tagged(name: str):  # noqa: ANN202
        return lambda x: F.struct(F.lit(name).alias("counted"), x.alias("ident"))

    alone = F.when(F.col("seq").isNull(), F.xxhash64("series_id", "ts_ms", "name", "value"))  # a row without an insert's number stands for itself
    inserts = table(spark, folder, "tags").groupBy("seq", alone.alias("alone")).agg(
        F.max("series_id").alias("series_id"), F.max(_day()).alias("day"), F.max(of("zone")).alias("zone"), F.max(of("build")).alias("build"), F.collect_set(of("client")).alias("client"), F.collect_set(of("trace")).alias("trace")
    )
    kinds = F.concat(F.array(F.struct(F.lit("series_id").alias("counted"), F.col("series_id").cast("string").alias("ident"))), *(F.transform(c, tagged(c)) for c in ("client", "trace")))
    rows = inserts.select("day", "zone", "build", F.inline(kinds))
    dims = ["counted", "day", "zone", "build"]
    return count_distinct(partial_sets(rows, dims, "ident"), dims, [["counted", "day"], ["counted", "day", "zone"], ["counted", "day", "build"], dims], "ident")


def p3_names(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct values and series for each day and tag name, and for each name over all days, combined from the days' partial sets."""
    rows = table(spark, folder, "tags").where("name is not null").select(_day().alias("day"), "name", F.inline(F.array(F.struct(F.lit("value").alias("counted"), F.when(F.col("value") != "", F.col("value")).alias("ident")), F.struct(F.lit("series_id").alias("counted"), F.col("series_id").cast("string").alias("ident")))))
    dims = ["counted", "day", "name"]
    return count_distinct(partial_sets(rows, dims, "ident"), dims, [dims, ["counted", "name"]], "ident")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_hitters(table(spark, folder, "tags"), 0.01).select("name", "value")


def p5_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """What the sketch alone tells: candidates for 1 % of their name's rows, with count bounds."""
    return bounds(written(merge(sketch(table(spark, folder, "tags"))), "cells"), 0.01)


def _capacity(spark: SparkSession, folder: str, kind: str) -> int:
    return int(table(spark, folder, "containers").where(F.col("container_class") == kind).agg(F.min("capacity_tokens")).first()[0])


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    return written(with_tokens(docs), "sizes")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents whose pieces lie in more than one container."""
    packed = pack(_sized(spark, folder), _capacity(spark, folder, "wide"))
    return packed.groupBy("doc_id").agg(F.countDistinct("container").alias("n")).where("n > 1").select("doc_id")


def p8_wide(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_sized(spark, folder), _capacity(spark, folder, "wide"))


def p8_compact(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_sized(spark, folder), _capacity(spark, folder, "compact"))


def p8_bound(spark: SparkSession, folder: str) -> DataFrame:
    """For each class the containers that are filled, and the least number there can be."""
    sized = _sized(spark, folder)
    parts = [bound(sized, _capacity(spark, folder, k)).select(F.lit(k).alias("container_class"), "*") for k in ("compact", "wide")]
    return parts[0].unionByName(parts[1])


def _domains(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, domain): the domain of a document is the first topic of its thread's question; null without one."""
    docs = table(spark, folder, "documents")
    asked = docs.where("topics is not null").select(F.col("doc_id").alias("thread_id"), F.try_element_at("topics", F.lit(1)).alias("domain"))
    return docs.select("doc_id", "thread_id").join(asked, "thread_id", "left").select("doc_id", "domain")


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = _sized(spark, folder).join(_domains(spark, folder), "doc_id")
    return mix(docs, table(spark, folder, "mix_targets"))


def p9_budgets(spark: SparkSession, folder: str) -> DataFrame:
    """What each leaf of the tree of domains, languages and sources is to give, in characters."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars").join(_domains(spark, folder), "doc_id")
    out = budgets(docs, table(spark, folder, "mix_targets"), size="n_chars")
    return out.select("domain", "lang", "source", "size", F.round("budget").cast("long").alias("budget"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return shares(p9_mix(spark, folder), table(spark, folder, "mix_targets"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue(table(spark, folder, "documents")).select("doc_id").distinct()


def p10_kept(spark: SparkSession, folder: str) -> DataFrame:
    return without_residue(table(spark, folder, "documents")).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_series, p2_metric, p2_zone, p3_combinations, p3_names, p5_found, p5_bounds, p8_found, p8_wide, p8_compact, p8_bound, p9_mix, p9_shares, p9_budgets, p10_found, p10_kept)}


def _ranked(rows: str, keys: str) -> str:
    """Exact percentiles by rank, from one sorted list a group; `rows` gives (keys, value)."""
    value = "CASE WHEN lo = hi THEN lo WHEN lo = '-infinity' THEN lo WHEN hi = 'infinity' THEN hi ELSE lo + (hi - lo) * (h - floor(h)) END"
    return f"""WITH x AS ({rows}), o AS (SELECT {keys}, list_sort(list(value)) AS vs, count(*) AS k FROM x GROUP BY {keys}),
w AS (SELECT {keys}, vs, k, CAST(unnest([{", ".join(map(str, PROBS))}]) AS DOUBLE) AS p FROM o), h AS (SELECT *, p * (k - 1) AS h FROM w),
v AS (SELECT {keys}, k, p, h, vs[CAST(floor(h) AS BIGINT) + 1] AS lo, vs[CAST(ceil(h) AS BIGINT) + 1] AS hi FROM h)
SELECT {keys}, p, {value} AS value, k AS count FROM v"""


def _budgets_sql() -> str:
    """Three times the same step: the amount of each parent, filled into its children up to their capacities."""
    sql = """WITH d AS (SELECT q.topics[1] AS domain, x.lang, x.source, x.n_chars FROM documents x LEFT JOIN documents q ON q.doc_id = x.thread_id AND q.topics IS NOT NULL),
g AS (SELECT domain, lang, source, CAST(sum(n_chars) AS BIGINT) AS size FROM d GROUP BY ALL), n AS (SELECT source, sum(size) AS total FROM g GROUP BY source),
l0 AS (SELECT g.*, t.target_share * g.size / n.total AS w, CAST(g.size * t.max_repeats AS DOUBLE) AS c FROM g JOIN mix_targets t ON t.source = g.source JOIN n ON n.source = g.source WHERE g.size > 0 AND t.target_share > 0 AND t.max_repeats > 0),
a0 AS (SELECT least(CAST(sum(g.size) AS DOUBLE), (SELECT sum(c) FROM l0)) AS amount FROM g JOIN mix_targets t ON t.source = g.source)"""
    keys = ["domain", "lang", "source"]
    for i in range(1, 4):
        cols, up = ", ".join(keys[:i]), keys[: i - 1]
        join = " AND ".join(f"n.{k} IS NOT DISTINCT FROM a.{k}" for k in up) or "true"
        part = f"PARTITION BY {', '.join(up)}" if up else ""
        sql += f""", n{i} AS (SELECT {cols}, sum(w) AS w, sum(c) AS c FROM l0 GROUP BY {cols}), m{i} AS (SELECT n.*, a.amount FROM n{i} n JOIN a{i - 1} a ON {join}),
v{i} AS (SELECT *, (amount - coalesce(sum(c) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM m{i} WINDOW b AS ({part} ORDER BY c / w, {cols})),
a{i} AS (SELECT {cols}, least(c, w * max(lv) OVER ({part})) AS amount FROM v{i})"""
    return sql + " SELECT l.domain, l.lang, l.source, l.size, CAST(round(a.amount) AS BIGINT) AS budget FROM l0 l JOIN a3 a ON a.domain IS NOT DISTINCT FROM l.domain AND a.lang IS NOT DISTINCT FROM l.lang AND a.source = l.source"


def oracle_sql() -> dict[str, str]:
    day = "CAST(floor(ts_ms / 86400000.0) AS BIGINT)"
    good = "value IS NOT NULL AND NOT isnan(value)"
    levels = []
    for name, zone, build in (("counted+day", 0, 0), ("counted+day+zone", 1, 0), ("counted+day+build", 0, 1), ("counted+day+zone+build", 1, 1)):
        levels.append(f"SELECT counted, day, {'zone' if zone else 'CAST(NULL AS VARCHAR)'} AS zone, {'build' if build else 'CAST(NULL AS VARCHAR)'} AS build, '{name}' AS level, count(DISTINCT ident) AS n FROM r WHERE ident IS NOT NULL GROUP BY ALL")
    return {
        "p2_series": _ranked(f"SELECT series_id, value + 0.0 AS value FROM samples WHERE series_id IS NOT NULL AND {good}", "series_id"),
        "p2_metric": _ranked(f"SELECT m.metric, s.value + 0.0 AS value FROM samples s JOIN (SELECT series_id, min(metric) AS metric FROM series WHERE series_id IS NOT NULL AND metric IS NOT NULL GROUP BY series_id) m ON m.series_id = s.series_id WHERE {good.replace('value', 's.value')}", "metric"),
        "p2_zone": _ranked("SELECT t.name, z.zone, CAST(trim(replace(replace(t.value, ',', '.'), 'u', '')) AS DOUBLE) + 0.0 AS value FROM tags t LEFT JOIN (SELECT seq, max(value) AS zone FROM tags WHERE name = 'zone' AND value <> '' GROUP BY seq) z ON z.seq = t.seq WHERE t.name IN ('took_ms', 'size_b') AND regexp_full_match(t.value, ' *[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]+)? *u? *')", "name, zone"),
        "p3_combinations": f"""WITH i AS (SELECT seq, max(series_id) AS series_id, max({day}) AS day, max(CASE WHEN name = 'zone' AND value <> '' THEN value END) AS zone, max(CASE WHEN name = 'build' AND value <> '' THEN value END) AS build FROM tags GROUP BY seq),
r AS (SELECT 'series_id' AS counted, day, zone, build, CAST(series_id AS VARCHAR) AS ident FROM i UNION ALL SELECT t.name, i.day, i.zone, i.build, t.value FROM tags t JOIN i ON i.seq = t.seq WHERE t.name IN ('client', 'trace') AND t.value <> '') {" UNION ALL ".join(levels)}""",
        "p3_names": f"""WITH r AS (SELECT {day} AS day, name, 'value' AS counted, CASE WHEN value <> '' THEN value END AS ident FROM tags WHERE name IS NOT NULL UNION ALL SELECT {day}, name, 'series_id', CAST(series_id AS VARCHAR) FROM tags WHERE name IS NOT NULL)
SELECT counted, day, name, 'counted+day+name' AS level, count(DISTINCT ident) AS n FROM r WHERE ident IS NOT NULL GROUP BY ALL UNION ALL SELECT counted, CAST(NULL AS BIGINT), name, 'counted+name', count(DISTINCT ident) FROM r WHERE ident IS NOT NULL GROUP BY ALL""",
        "p9_budgets": _budgets_sql(),
        "p5_found": "SELECT name, value FROM (SELECT name, value, count(*) AS n, sum(count(*)) OVER (PARTITION BY name) AS k FROM tags WHERE value IS NOT NULL AND value <> '' GROUP BY name, value) WHERE n * 100 >= k",
    }

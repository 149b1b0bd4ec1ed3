"""Retrieval of series and samples by label matchers and a closed time range."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.joins import join_checked
from tidemark.operators.labels import ALL, canonical
from tidemark.operators.matchers import Matcher, all_of
from tidemark.operators.readings import latest
from tidemark.sources.tables import table

#: Up to so many selected series their ids go into the scan's filter, where Parquet statistics apply.
INLINE_IDS = 256
MIN_T, MAX_T = -(2**63), 2**63 - 1


def distinct_series(series: DataFrame) -> DataFrame:
    """(series_id, labels), one row an id. Null ids are dropped; a set registered again counts once, of different sets the first in canonical order."""
    one = series.where("series_id is not null").groupBy("series_id").agg(F.min(canonical(F.col("labels"))).alias("_a"))
    return one.select("series_id", F.map_from_entries(F.transform("_a", lambda e: F.struct(e["name"], e["value"]))).alias("labels"))


@dataclass(frozen=True)
class Store:
    """A labelled store: `series` (series_id, labels), `samples` (series_id, ts_ms, value, seq), and deleted ranges (series_id, min_t, max_t), if any."""

    series: DataFrame
    samples: DataFrame
    tombstones: DataFrame | None = None

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> Store:
        """The store of a folder with tables `series` and `samples`."""
        return cls(distinct_series(table(spark, folder, "series")), table(spark, folder, "samples"))

    def deleting(self, tombstones: DataFrame) -> Store:
        return replace(self, tombstones=tombstones)

    # Labels

    def label_index(self) -> DataFrame:
        """(name, value, series_id): the inverted index, with the pseudo-label that all series carry."""
        pairs = self.series.select("series_id", F.explode(F.concat(canonical(F.col("labels")), F.array(F.struct(F.lit(ALL).alias("name"), F.lit(ALL).alias("value"))))).alias("_l"))
        return pairs.select("_l.name", "_l.value", "series_id")

    def label_names(self) -> DataFrame:
        """Distinct names, in order; the pseudo-label too."""
        return self.label_index().select("name").distinct().orderBy("name")

    def label_values(self, name: str) -> DataFrame:
        """Distinct values of a name, in order; none for an unknown name."""
        return self.label_index().where(F.col("name") == name).select("value").distinct().orderBy("value")

    def symbols(self) -> DataFrame:
        """Distinct strings among names and values, without the pseudo-label."""
        return self.label_index().where(F.col("name") != ALL).select(F.explode(F.array("name", "value")).alias("symbol")).distinct()

    def postings(self, name: str, value: str) -> DataFrame:
        """Ids of the series with a label, ascending."""
        return self.label_index().where((F.col("name") == name) & (F.col("value") == value)).select("series_id").distinct().orderBy("series_id")

    def postings_sizes(self) -> DataFrame:
        """How many series each (name, value) has."""
        return self.label_index().groupBy("name", "value").agg(F.countDistinct("series_id").alias("n"))

    def sorted_series(self) -> DataFrame:
        """Series in the order of their canonical label sets: by the first label, then the next."""
        return self.series.withColumn("label_arr", canonical(F.col("labels"))).orderBy("label_arr", "series_id")

    # Series and samples

    def matching(self, matchers: Sequence[Matcher], parity: bool = False) -> DataFrame:
        """The series for which all matchers hold. `parity`: a matcher for a name that no series has selects nothing, even if it accepts ''."""
        found = self.series.where(all_of(F.col("labels"), matchers))
        if parity:
            for m in matchers:
                if m.name != ALL and not self.label_index().where(F.col("name") == m.name).limit(1).count():
                    return found.where(F.lit(False))
        return found

    def _rows(self, matchers: Sequence[Matcher], mint: int, maxt: int, parity: bool) -> DataFrame:
        low = max(mint, 0) if parity else mint
        rows = self.samples
        if low > MIN_T:
            rows = rows.where(F.col("ts_ms") >= low)
        if maxt < MAX_T:
            rows = rows.where(F.col("ts_ms") <= maxt)
        found = self.matching(matchers, parity).select("series_id")
        ids = [r[0] for r in found.limit(INLINE_IDS + 1).collect()]
        if len(ids) <= INLINE_IDS:
            return rows.where(F.col("series_id").isin(ids) if ids else F.lit(False))
        return join_checked(rows, found, ["series_id"], "left_semi")

    def chain(self, matchers: Sequence[Matcher], mint: int = MIN_T, maxt: int = MAX_T, parity: bool = False) -> DataFrame:
        """All rows of the selected series in [mint, maxt] as they came: equal times are kept, rows with a null time or value aren't."""
        return self._rows(matchers, mint, maxt, parity).where("ts_ms is not null and value is not null").select("series_id", "ts_ms", "value", "seq")

    def select(self, matchers: Sequence[Matcher], mint: int = MIN_T, maxt: int = MAX_T, *, with_labels: bool = False, parity: bool = False) -> DataFrame:
        """(series_id[, labels], ts_ms, value) of the selected series, mint <= ts_ms <= maxt, one row a time: the last write wins. Deleted ranges are left out.

        No matcher selects nothing. `parity`: times below 0 are never returned, and see `matching`. Rows have no order; sort by (series_id, ts_ms) if needed.
        """
        from tidemark.operators.tombstones import apply

        rows = latest(self._rows(matchers, mint, maxt, parity))
        if self.tombstones is not None:
            rows = apply(rows, self.tombstones)
        return join_checked(rows, self.series, ["series_id"]).select("series_id", "labels", "ts_ms", "value") if with_labels else rows

    def seek(self, matchers: Sequence[Matcher], t: int, maxt: int = MAX_T) -> DataFrame:
        """(series_id, ts_ms, value): of each selected series the first sample at or after `t`."""
        return self.select(matchers, t, maxt).groupBy("series_id").agg(F.min("ts_ms").alias("ts_ms"), F.min_by("value", "ts_ms").alias("value"))

    def respond(self, matchers: Sequence[Matcher], mint: int, maxt: int, return_metric: bool = True) -> DataFrame:
        """The nested response to a request: (id[, metric], values): an array of (t, v) in order for each series. A series' values are one row: meant for answers, not for whole stores."""
        rows = self.select(matchers, mint, maxt)
        out = rows.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct(F.col("ts_ms").alias("t"), F.col("value").alias("v")))).alias("values"))
        if not return_metric:
            return out.select(F.col("series_id").alias("id"), "values")
        return join_checked(out, self.series, ["series_id"]).select(F.col("series_id").alias("id"), canonical(F.col("labels")).alias("metric"), "values")


def merge_stores(stores: Sequence[DataFrame]) -> DataFrame:
    """Samples of several sources, later ones newer: (series_id, ts_ms, value). At equal times the last source wins, within a source the highest `seq`."""
    tagged = None
    for i, s in enumerate(stores):
        part = s.select("series_id", "ts_ms", "value", F.lit(i).alias("_src"), (F.col("seq") if "seq" in s.columns else F.lit(0)).cast("long").alias("seq"))
        tagged = part if tagged is None else tagged.unionByName(part)
    if tagged is None:
        raise ValueError("no source")
    newest = tagged.where("series_id is not null and ts_ms is not null and value is not null").groupBy("series_id", "ts_ms", "_src", "seq").agg(F.max("value").alias("value"))
    newest = newest.groupBy("series_id", "ts_ms", "_src").agg(F.max_by("value", "seq").alias("value"))
    return newest.groupBy("series_id", "ts_ms").agg(F.max_by("value", "_src").alias("value"))


def chain_stores(stores: Sequence[DataFrame]) -> DataFrame:
    """Samples of several sources one after the other; overlaps are kept."""
    out = stores[0].select("series_id", "ts_ms", "value")
    for s in stores[1:]:
        out = out.unionByName(s.select("series_id", "ts_ms", "value"))
    return out


def align_by_labels(stores: Sequence[Store]) -> DataFrame:
    """Samples of stores that number their series differently, matched by equal label sets: (labels as a canonical array, ts_ms, value), later stores newer."""
    parts = [join_checked(s.samples, s.series.select("series_id", canonical(F.col("labels")).alias("label_arr")), ["series_id"]).select("label_arr", "ts_ms", "value", F.lit(i).alias("_src"), "seq") for i, s in enumerate(stores)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.where("ts_ms is not null and value is not null")
    one = rows.groupBy("label_arr", "ts_ms", "_src").agg(F.max_by("value", "seq").alias("value"))
    return one.groupBy("label_arr", "ts_ms").agg(F.max_by("value", "_src").alias("value"))

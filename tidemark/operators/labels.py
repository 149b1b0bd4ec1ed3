"""Label sets: maps of name to value, with a canonical form that can be compared and grouped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The pseudo-label that every series carries; a matcher for it selects everything.
ALL = "ALL_POSTINGS"
METRIC = "__name__"


def canonical(labels: Column) -> Column:
    """The label set as an array of (name, value), sorted by name: the identity of a series. Null is the empty set; null values are left out."""
    kept = F.map_filter(F.coalesce(labels, F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull())
    return F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))


def from_pairs(pairs: Column) -> Column:
    """Labels from an array of (name, value) structs. A name that occurs twice is an error, as is a null name."""
    return F.map_from_entries(pairs)


def label(labels: Column, name: str) -> Column:
    """The value of a label, '' if the set lacks it: an empty label and a missing one are the same."""
    return F.coalesce(F.try_element_at(labels, F.lit(name)), F.lit(""))


def with_label(labels: Column, name: str, value: Column | str) -> Column:
    """Adds a label if the name is absent; else the set stays as it is."""
    v = F.lit(value) if isinstance(value, str) else value
    return F.when(F.map_contains_key(labels, name), labels).otherwise(F.map_concat(labels, F.create_map(F.lit(name), v)))


def without_label(labels: Column, name: str) -> Column:
    """The set without a name."""
    return F.map_filter(labels, lambda k, _: k != name)


def as_string(labels: Column) -> Column:
    """`{a=1,b=2}`, names in order."""
    return F.concat(F.lit("{"), F.array_join(F.transform(canonical(labels), lambda e: F.concat(e["name"], F.lit("="), e["value"])), ","), F.lit("}"))


def key_by(labels: Column, names: Sequence[str]) -> Column:
    """Grouping key: the labels of these names alone, as a canonical array."""
    return F.filter(canonical(labels), lambda e: e["name"].isin(list(names)) if names else F.lit(False))


def key_without(labels: Column, names: Sequence[str]) -> Column:
    """Grouping key: all labels but these and the metric's name, as a canonical array. Groups are told apart by values, never by a hash."""
    gone = [*names, METRIC]
    return F.filter(canonical(labels), lambda e: ~e["name"].isin(gone))


def key_string(key: Column) -> Column:
    """A grouping key as `{a=1,b=2}`."""
    return F.concat(F.lit("{"), F.array_join(F.transform(key, lambda e: F.concat(e["name"], F.lit("="), e["value"])), ","), F.lit("}"))

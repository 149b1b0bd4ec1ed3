"""The registered queries: complete, independent of the text subpackage, and equal to their SQL on the smallest tables."""

import os
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import compare
from tidemark.plans import reference, storage, training

FOLDER = "/root/testdata/sf0.001"
there = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def test_core_stands_alone():
    for p in (Path(entry.__file__).parent / "tidemark").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import) tidemark\.llm", p.read_text(), re.M), p


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p1_trailing_totals", "p4_found", "p6_found", "p7_found"} <= set(entry.queries())


@there
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["host", "metric", "bucket_ms", "max_value"] and df.count() > 20


#: Queries that are to give nothing: no matcher, no match, no valid pattern, no such label.
EMPTY = {"select_no_match", "select_without_matchers", "select_invalid_pattern", "select_regex_other_dialect", "select_parity_unknown_label"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_queries_give_rows(spark):
    """No query is checked by comparing nothing with nothing."""
    known = {**reference.queries(), **storage.queries(), **training.queries()}
    assert {k for k, f in known.items() if f(spark, "/root/testdata/sf0.01").isEmpty()} == EMPTY


@there
@pytest.mark.parametrize("name", ["p1_trailing_totals", "p4_found", "p4_grid", "p7_found", "select_not_regex", "select_parity_from_zero", "labels_without", "tsbs_5_8_1", "double_groupby_all", "lastpoint", "tombstone_apply", "compaction_plan", "kv_snapshot", "codec_roundtrip", "layout_rewrite", "retention_by_time", "block_meta", "block_compacted", "log_read", "log_repair", "append_commit", "append_fast", "kv_batch", "stream_register", "select_regex_newline"])
def test_equals_sql(spark, name):
    module = next(m for m in (training, storage, reference) if name in m.queries())
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    df = module.queries()[name](spark, FOLDER)
    cur = con.execute(module.oracle_sql()[name])
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert compare.key([tuple(r) for r in df.collect()], df.columns) == compare.key(cur.fetchall(), cols)


@there
def test_whole_reverse_scan_is_in_order(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW tags AS SELECT * FROM '{FOLDER}/tags.parquet'")
    want = con.execute(reference.oracle_sql()["kv_reverse_scan_all"]).fetchall()
    assert [tuple(r) for r in reference.queries()["kv_reverse_scan_all"](spark, FOLDER).collect()] == want and len(want) > 100

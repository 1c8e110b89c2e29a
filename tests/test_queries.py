"""Every registered query against DuckDB on the smallest tables."""

import glob
import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry_module
from quill.plans import registry

NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def con(folder):
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, folder, name):
    df = registry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got or name in {"boilerplate_lines", "noise_lines", "validate_sequence", "scans_to_read", "qa_coherence", "append_missing", "entity_link", "graph_topk"}, "no rows to compare"
    if name not in registry.oracle_sql():  # operators have tests of their own; here the rows are whole
        assert all(len(r) == len(columns) for r in got) and len(set(got)) == len(got)
        return
    rel = con.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [list(rel.columns).index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", ["approx_tokens", "well_formed", "orphan_docs", "filter_min_chars", "cap_per_doc", "chunk_ids", "entity_normalize", "append_missing"])
def test_no_text_is_shuffled(spark, folder, name):
    plan = registry.queries()[name](spark, folder)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    inputs = [x for x, how in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: (\w+)", plan) if how != "RoundRobinPartitioning"]  # spreads small files
    assert inputs and not any(re.search(r"\btexto?#", x) for x in inputs)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["query_id", "kind", "rank", "item", "text"] and df.count() > 0
    assert set(registry.queries()) <= set(entry_module.queries())


def test_every_query_on_empty_tables(spark, empty_folder):
    single = {"index_stats", "qa_fragments", "evaluate", "ab_indicators", "package_check"}  # aggregates over everything have one row; a graph without edges is a problem
    for name, f in registry.queries().items():
        assert f(spark, empty_folder).count() <= (name in single), name

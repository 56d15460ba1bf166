"""Registered queries against their SQL on the smallest tables, and the entry module."""

import importlib.util
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from rowgraph.plans.catalogue import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the tables")

CHOSEN = ["tokenize_counts", "phonetic_latin_keys", "fuzzy_pairs", "edges_intersection", "proposals", "typed_edges", "decisions_split", "override_split_mention", "apply_changes",
          "engine_process_changes", "engine_gc", "review_merge", "review_split_mention", "catalog_counts", "scripts_normalized", "scripts_phonetic", "json_changes"]


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.sql(f"create view {file.stem} as select * from '{file}'")
    found = QUERIES[name](spark, str(DATA))
    columns = sorted(found.columns)
    want = con.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    assert sorted(tuple(map(plain, r)) for r in found.select(*columns).collect()) == sorted(tuple(plain(r[i]) for i in places) for r in want.fetchall())


def test_entry_gives_rows(spark):
    found = entry_module.entry(spark)
    assert found.columns == ["edge_id", "src", "dst", "predicate"] and found.limit(1).count() == 1


def test_every_sql_has_its_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_the_entry_works_without_the_pipeline_package(monkeypatch):
    import builtins

    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name == "corpus_pipeline" or name.startswith("rowgraph.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", without)
    spec = importlib.util.spec_from_file_location("entry_alone", entry_module.__file__)
    alone = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(alone)
    assert set(alone.queries()) == set(QUERIES) and set(alone.oracle_sql()) == set(ORACLES)


def refuse(*args, **kwargs):
    raise AssertionError("not needed for this")


def test_most_connected_numbers_no_edge(spark, monkeypatch):
    from rowgraph.operators import graph

    monkeypatch.setattr(graph, "with_group_ids", refuse)
    assert QUERIES["most_connected"](spark, str(DATA)).limit(1).count() == 1


def test_changes_meet_the_feed_once(spark):
    plan = QUERIES["apply_changes"](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_the_store_is_written_without_a_checkpoint_before(spark, monkeypatch):
    from rowgraph.plans import engine

    monkeypatch.setattr(engine, "cut", refuse)
    assert QUERIES["engine_process_changes"](spark, str(DATA)).limit(1).count() == 1

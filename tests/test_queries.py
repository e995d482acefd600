"""Every query of the reference's operators against its SQL, and the entry point."""

import os
import re

import duckdb
import pytest
from strataweave.operators import artifacts, calling, planning, records, running, validation
from strataweave.plans import catalogue
from strataweave.sources import jsonl

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, data, sql, name):
    df = catalogue.QUERIES[name](spark, data)
    rows = df.collect()
    cursor = sql.execute(catalogue.ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr([plain(x) for _, x in sorted(zip(names, r, strict=True))]) for r in cursor.fetchall())
    assert sorted(repr([plain(r[c]) for c in sorted(names)]) for r in rows) == want


CALLS = {
    "decompose_cells": (records, "decompose"), "entity_rows": (records, "decompose"), "empty_collections": (records, "decompose"), "entity_keys": (records, "decompose"), "assemble_orders": (records, "assemble"), "assemble_root": (records, "assemble"),
    "step_expansion": (planning, "expand"), "plan_by_disposition": (planning, "plan"), "cache_hits_misses": (planning, "probe"), "export_lines": (jsonl, "export_lines"), "list_executions": (running, "executions"), "parse_versions": (artifacts, "parse_versions"),
    "rule_extractor": (calling, "RuleBased"), "validate_pattern": (validation, "faults"), "distinct_field_sets": (artifacts, "filled_fields"),
}


@pytest.mark.parametrize("name", CALLS)
def test_query_calls_its_operator(spark, data, monkeypatch, name):
    module, function = CALLS[name]
    called, own = [], getattr(module, function)
    monkeypatch.setattr(module, function, lambda *a, **k: called.append(1) or own(*a, **k))
    assert catalogue.QUERIES[name](spark, data).columns and called


def test_entry(spark):
    assert entry.entry(spark).columns and set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_does_not_know_the_training_data_operators():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, files in os.walk(os.path.join(root, "strataweave")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as text:
                        assert not re.search(r"strataweave\.llm|from strataweave import llm", text.read()), f

"""The store: commits are whole or absent, keyed tables give the latest row, identical rows are stored once."""

import pytest
from pyspark.sql import functions as F
from strataweave.errors import EngineError
from strataweave.plans.engine import as_cells
from strataweave.sources.store import Store

CELL = "record_id string, field_id string, entity string, status string, value_json string"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "s"))


def index(spark, *rows):
    return spark.createDataFrame(rows, "record_id string, state string, seq long")


def test_nothing_is_seen_before_the_commit(spark, store):
    with pytest.raises(RuntimeError), store.transaction() as t:
        t.append("record_index", index(spark, ("a", "draft", t.seq)))
        raise RuntimeError
    assert store.read("record_index").count() == 0
    with store.transaction() as t:
        t.append("record_index", index(spark, ("a", "draft", t.seq)))
        t.document("x", {"é": 1})
        assert store.read("record_index").count() == 0
    assert store.read("record_index").count() == 1 and store.document("x") == {"é": 1}


def test_of_two_writers_one_fails(spark, store):
    one, other = store.transaction(), store.transaction()
    a, b = one.__enter__(), other.__enter__()
    a.append("record_index", index(spark, ("a", "draft", a.seq)))
    b.append("record_index", index(spark, ("b", "draft", b.seq)))
    one.__exit__(None, None, None)
    with pytest.raises(EngineError):
        other.__exit__(None, None, None)
    assert [r["record_id"] for r in store.read("record_index").collect()] == ["a"]


def test_latest_row_of_a_key_stands_and_compaction_keeps_it(spark, store):
    for state in ("draft", "published"):
        with store.transaction() as t:
            t.append("record_index", index(spark, ("a", state, t.seq), (state, "x", t.seq)))
    want = {"a": "published", "draft": "x", "published": "x"}
    assert {r["record_id"]: r["state"] for r in store.read("record_index").collect()} == want and store.raw("record_index").count() == 4
    store.compact("record_index")
    assert store.raw("record_index").count() == 3 and {r["record_id"]: r["state"] for r in store.read("record_index").collect()} == want


def test_equal_cells_are_one(spark, store):
    rows = spark.createDataFrame([("r", "f", "", "present", "1"), ("r", "g", "", "present", "1")], CELL)
    for at in ("2024", "2025"):
        with store.transaction() as t:
            t.append_new("field_artifact", as_cells(rows, at))
    assert store.raw("field_artifact").count() == 2
    changed = rows.withColumn("value_json", F.lit("2")).where("field_id = 'f'")
    with store.transaction() as t:
        t.append_new("field_artifact", as_cells(changed, "2026"))
    assert {r["field_id"]: r["value_json"] for r in store.latest_cells().collect()} == {"f": "2", "g": "1"}


def test_other_formats_are_refused(spark, store):
    store.save_document("x", 1)
    store._put(store.manifest() | {"format": 9, "seq": 2})
    with pytest.raises(EngineError):
        Store(spark, store.root)

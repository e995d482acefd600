"""Context selectors, budgets, fallback, privacy; spans and re-anchoring; validation."""

import math
import re

import pytest
from pyspark.sql import functions as F
from strataweave.errors import EngineError
from strataweave.model.recipe import ContextPolicy, Source
from strataweave.model.schema import Constraints, FieldDefinition, Schema
from strataweave.operators import context, documents, validation

UNITS = [("d", "t:0", "title", "title", "A title", 0, []), ("d", "a:1", "paragraph", "abstract", "the cat sat on the mat", 1, ["open"]), ("d", "m:2", "paragraph", "methods", "the dog ran. the dog sat", 2, ["secret"]), ("d", "m:3", "paragraph", "methods", "cat and dog", 3, []), ("e", "x:0", "paragraph", "results", "nothing here", 0, [])]


@pytest.fixture
def units(spark):
    return spark.createDataFrame(UNITS, "source_id string, unit_id string, kind string, section string, text string, ordinal int, labels array<string>")


@pytest.fixture
def requests(spark):
    return spark.createDataFrame([("q1", "d", "cat"), ("q2", "e", "cat")], "request_id string, source_id string, query string")


def resolved(requests, units, policy, inputs=None, **more):
    chosen, state = context.resolve(requests, units, policy, inputs, **more)
    got = {}
    for r in chosen.orderBy("seq", "ordinal").collect():
        got.setdefault(r["request_id"], []).append(r["unit_id"])
    return got, {r["request_id"]: r for r in state.collect()}


def policy(*sources, **more):
    return ContextPolicy(tuple(s if isinstance(s, Source) else Source(*s) for s in sources), **more)


def test_sections_and_kinds_ignore_case_and_refuse_unknown_kinds(requests, units):
    got, state = resolved(requests, units, policy(("sections", {"names": ["METHODS"]})))
    assert got == {"q1": ["m:2", "m:3"]} and state["q1"]["used"] == 0 and not state["q2"]["satisfied"] and "context_unavailable" in state["q2"]["reason"]
    assert resolved(requests, units, policy(("unit_kinds", {"kinds": ["title"]})))[0] == {"q1": ["t:0"]}
    with pytest.raises(EngineError):
        resolved(requests, units, policy(("unit_kinds", {"kinds": ["nonsense"]})))
    with pytest.raises(EngineError):
        resolved(requests, units, policy(("nonsense",)))


def test_first_satisfying_source_is_used(requests, units):
    p = policy(("sections", {"names": ["nowhere"]}), ("sections", {"names": ["methods"]}, 3), ("sections", {"names": ["abstract"]}), full_document="allowed")
    got, state = resolved(requests, units, p)
    assert got == {"q1": ["a:1"], "q2": ["x:0"]} and (state["q1"]["used"], state["q2"]["used"]) == (2, 3)
    assert resolved(requests, units, p, start_at=3)[0] == {"q1": ["t:0", "a:1", "m:2", "m:3"], "q2": ["x:0"]}


def test_accumulate_joins_sources_in_order(requests, units):
    got, _ = resolved(requests, units, policy(("sections", {"names": ["methods"]}), ("sections", {"names": ["abstract", "methods"]}), accumulate=True))
    assert got == {"q1": ["m:2", "m:3", "a:1"]}


def test_full_documents_need_permission(requests, units):
    assert resolved(requests, units, policy(("full_document",)))[0] == {}
    assert len(resolved(requests, units, policy(("full_document",), full_document="allowed"))[0]["q1"]) == 4
    got, state = resolved(requests, units, policy(("raw_document",), full_document="allowed"))
    assert got["q1"] == ["raw:d"] and state["q1"]["tokens"] == 0


def test_budgets_cut_skip_or_fail(requests, units):
    sections = ("sections", {"names": ["abstract", "methods"]})
    assert resolved(requests, units, policy(sections, max_units=2))[0]["q1"] == ["a:1", "m:2"]
    assert resolved(requests, units, policy(sections, max_chars=30))[0]["q1"] == ["a:1"]
    assert resolved(requests, units, policy(sections, max_sections=1))[0]["q1"] == ["a:1"]
    got, state = resolved(requests, units, policy(sections, ("unit_kinds", {"kinds": ["title"]}), max_units=2, on_budget="skip"))
    assert got["q1"] == ["t:0"] and state["q1"]["used"] == 1
    got, state = resolved(requests, units, policy(sections, max_units=2, on_budget="fail"))
    assert "q1" not in got and state["q1"]["reason"] == "context_budget_exceeded"


def test_missing_may_proceed_and_none_is_enough(requests, units):
    _, state = resolved(requests, units, policy(("sections", {"names": ["nowhere"]}), on_missing="proceed"))
    assert state["q1"]["satisfied"] and state["q1"]["n_units"] == 0
    _, state = resolved(requests, units, policy(("none",)))
    assert state["q2"]["satisfied"] and state["q2"]["used"] == 0


def test_labels_keep_units_out(requests, units):
    got, _ = resolved(requests, units, policy(("sections", {"names": ["methods", "abstract"]}), forbidden_labels=("secret",)))
    assert got == {"q1": ["a:1", "m:3"]}


def test_evidence_and_cells(requests, units, spark):
    spans = spark.createDataFrame([("q1", "a:1", 4, 7), ("q1", "a:1", 4, 7), ("q1", "m:3", 0, 3)], "request_id string, unit_id string, start int, end int")
    chosen, _ = context.resolve(requests, units, policy(("prior_evidence", {"expand_chars": 4})), {"spans": spans})
    assert {(r["unit_id"], r["text"]) for r in chosen.collect()} == {("a:1:0-11", "the cat sat"), ("m:3:0-7", "cat and")}
    cells = spark.createDataFrame([("q1", "f", "", "present", "1"), ("q1", "g", "a[]=1", "unknown", None)], "request_id string, field_id string, entity string, status string, value_json string")
    chosen, _ = context.resolve(requests, units, policy(("structured_fields",)), {"cells": cells})
    assert [r["text"] for r in chosen.orderBy("ordinal").collect()] == ["f: 1", "g: <no value>  [status=unknown]"]


def test_billable_sources_wait_for_leave(requests, units):
    p = policy(Source("sections", {"names": ["methods"]}, billable=True), ("sections", {"names": ["abstract"]}))
    assert resolved(requests, units, p)[0]["q1"] == ["a:1"] and resolved(requests, units, p, allow_billable=True)[0]["q1"] == ["m:2", "m:3"]


def test_bm25_against_a_plain_computation(requests, units, spark):
    query = "the cat cat"
    got = {r["unit_id"]: r["score"] for r in context.bm25(units, spark.createDataFrame([("d", query)], "source_id string, query string"), "source_id", 9).collect()}
    pool = {u[1]: re.findall("[a-z0-9]+", u[4].lower()) for u in UNITS if u[0] == "d"}
    average = sum(map(len, pool.values())) / len(pool)
    want = {}
    for name, words in pool.items():
        total = 0.0
        for term in query.split():
            df = sum(term in w for w in pool.values())
            tf = words.count(term)
            total += math.log(1 + (len(pool) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / average))
        if total > 0:
            want[name] = round(total, 9)
    assert got == want


def test_context_hash_follows_texts_and_origins(units):
    base = units.withColumn("origin", F.lit("x"))
    h = lambda df: {r[0]: r[1] for r in context.context_hash(df, "source_id").collect()}
    assert h(base) == h(base.orderBy(F.desc("ordinal")))
    assert h(base)["d"] != h(base.withColumn("origin", F.lit("y")))["d"] and h(base)["e"] != h(base.withColumn("text", F.concat("text", F.lit("."))))["e"]


def test_reanchoring_has_five_outcomes(spark):
    units = spark.createDataFrame([("d", "u1", 0, "same text here"), ("d", "u2", 1, "moved away"), ("d", "u3", 2, "twice twice")], "source_id string, unit_id string, ordinal int, text string")
    spans = [("d", "same", "u1", 0, 4, "same"), ("d", "moved", "u1", 3, 8, "moved"), ("d", "two", "u9", 0, 5, "twice"), ("d", "gone", "u1", 0, 4, "gone"), ("d", "none", "u1", 0, 0, ""), ("d", "null", "u1", 0, 0, None)]
    got = {r["span_id"]: r for r in documents.reanchor(spark.createDataFrame(spans, "source_id string, span_id string, unit_id string, start int, end int, text string"), units).collect()}
    assert {k: r["outcome"] for k, r in got.items()} == {"same": "unchanged", "moved": "reanchored", "two": "ambiguous", "gone": "lost", "none": "unverifiable", "null": "unverifiable"}
    assert (got["moved"]["unit_id"], got["moved"]["start"]) == ("u2", 0)


def test_units_of_sections(spark):
    df = spark.sql("SELECT 's' AS source_id, array(named_struct('section', 'a', 'text', 'One. Two.'), named_struct('section', 'b', 'text', 'Three')) AS x")
    whole = documents.with_offsets(documents.units_of_sections(df, F.col("x"))).orderBy("ordinal").collect()
    assert [(u["unit_id"], u["doc_start"]) for u in whole] == [("a:0", 0), ("b:1", 10)]
    assert [u["text"] for u in documents.units_of_sections(df, F.col("x"), True).orderBy("ordinal").collect()] == ["One.", "Two.", "Three"]


FIELDS = Schema(
    "s", "1",
    (
        FieldDefinition("n", "integer", constraints=Constraints(minimum=0, maximum=5)), FieldDefinition("mode", constraints=Constraints(enum=("a", "b"))), FieldDefinition("open", constraints=Constraints(enum=("a",), open_vocabulary=True)),
        FieldDefinition("tags", multivalued=True, constraints=Constraints(min_items=1, max_items=2, pattern="^x")), FieldDefinition("must", required=True), FieldDefinition("flag", "boolean"), FieldDefinition("g[].must", required=True), FieldDefinition("text", constraints=Constraints(min_length=2, max_length=3)),
    ),
)


@pytest.mark.parametrize(
    ("field", "status", "value", "codes"),
    [
        ("n", "present", "3", []), ("n", "present", "-1", ["minimum"]), ("n", "present", "6", ["maximum"]), ("n", "present", "true", ["type"]), ("n", "present", "2.5", ["type"]), ("n", "present", "null", []), ("n", "present", "[1]", ["unexpected_list"]),
        ("mode", "present", '"a"', []), ("mode", "present", '"c"', ["enum"]), ("mode", "not_reported", None, []), ("open", "present", '"c"', []), ("tags", "present", '["x1"]', []), ("tags", "present", "[]", ["min_items"]), ("tags", "present", '["x","x","y"]', ["max_items", "pattern"]),
        ("tags", "present", '"x"', ["not_a_list"]), ("must", "not_extracted", None, ["required"]), ("must", "not_reported", None, []), ("flag", "present", "1", ["type"]), ("flag", "present", "false", []), ("text", "present", '"a"', ["min_length"]), ("text", "present", '"abcd"', ["max_length"]), ("nowhere", "present", "1", ["undefined_field"]),
    ],
)
def test_structural_faults(spark, field, status, value, codes):
    cells = spark.createDataFrame([("r", field, "", status, value)], "record_id string, field_id string, entity string, status string, value_json string")
    assert sorted(r["code"] for r in validation.faults(cells, FIELDS.frame(spark)).collect()) == codes


def test_required_fields_are_due_in_every_entity_that_has_cells(spark):
    cells = spark.createDataFrame([("r", "x", "g[]=1", "present", "1"), ("r", "g[].must", "g[]=2", "present", "1")], "record_id string, field_id string, entity string, status string, value_json string")
    got = {(r["field_id"], r["entity"]) for r in validation.missing_required(cells, FIELDS.frame(spark)).collect()}
    assert got == {("must", ""), ("g[].must", "g[]=1")}


def test_validators(spark):
    rows = [("present", "Cat", None, 1, ["a cat"]), ("present", "Dog", None, 1, ["a cat"]), ("present", "x", None, 0, None), ("not_reported", None, None, 0, None), ("not_reported", None, "why", 0, None)]
    df = spark.createDataFrame(rows, "status string, value string, reason string, n_spans int, texts array<string>")
    got = df.select(validation.require_evidence(), validation.supports_value(), validation.in_vocabulary(["Cat"]), validation.honest_abstention()).collect()
    assert [tuple(r) for r in got] == [("pass", "pass", "pass", "pass"), ("pass", "review", "fail", "pass"), ("review", "review", "fail", "pass"), ("pass", "pass", "pass", "review"), ("pass", "pass", "pass", "pass")]

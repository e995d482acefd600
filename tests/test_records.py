"""Records as cells and back; codecs; JSON lines."""

import json

import pytest
from pyspark.sql import functions as F
from strataweave.errors import EngineError
from strataweave.model.schema import Collection, FieldDefinition, Schema
from strataweave.operators import records
from strataweave.sources import jsonl

S = Schema(
    "s", "1",
    (FieldDefinition("title"), FieldDefinition("design.kind"), FieldDefinition("groups[].n", "integer"), FieldDefinition("groups[].tags", multivalued=True), FieldDefinition("groups[].tests[].name"), FieldDefinition("rows[].v", "integer")),
    (Collection("groups[]", "local_id"), Collection("groups[].tests[]", "local_id"), Collection("rows[]")),
)
RECORDS = {
    "a": {"title": "T", "design": {"kind": "k"}, "groups": [{"n": 1, "tags": ["x", "y"], "tests": [{"name": "p"}, {"name": "q"}]}, {"n": 2.5, "tags": [], "tests": []}], "rows": [{"v": 1}, {"v": 2}]},
    "b": {"title": None, "groups": []},
    "c": {},
    "d": {"title": 'qu"ote\n', "groups": [{"n": None}]},
}


def frame(spark, rows=RECORDS):
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in rows.items()], "record_id string, record string")


def test_every_declared_field_has_a_cell_in_every_entity(spark):
    cells, entities = records.decompose(frame(spark), S)
    got = {(r["record_id"], r["field_id"], r["entity"]): (r["status"], r["value_json"]) for r in cells.collect()}
    assert got["a", "title", ""] == ("present", '"T"') and got["b", "title", ""] == ("not_reported", None) and got["c", "title", ""] == ("not_extracted", None)
    assert got["a", "groups[].tests[].name", "groups[]=#0/groups[].tests[]=#1"] == ("present", '"q"')
    assert json.loads(got["a", "groups[].tags", "groups[]=#0"][1]) == ["x", "y"] and got["d", "groups[].n", "groups[]=#0"] == ("not_reported", None)
    e = {(r["record_id"], r["entity"]): r for r in entities.collect()}
    assert e["b", "groups[]=∅"]["position"] == -1 and ("c", "groups[]=∅") not in e and e["a", "groups[]=#1/groups[].tests[]=∅"]["parent"] == "groups[]=#1"


def test_assembly_gives_back_what_was_there(spark):
    cells, entities = records.decompose(frame(spark), S)
    got = {r["record_id"]: json.loads(r["record"]) for r in records.assemble(cells, entities, S).collect()}
    assert got["a"] == RECORDS["a"]
    assert got["b"] == {"groups": []} and got["c"] == {} and got["d"] == {"title": 'qu"ote\n', "groups": [{}]}
    whole = {r["record_id"]: json.loads(r["record"]) for r in records.assemble(cells, entities, S, include_absent=True).collect()}
    assert whole["b"]["title"] is None and whole["c"]["design"] == {"kind": None}


def test_unreadable_documents_and_strange_identities(spark):
    rows = [("x", "{not json"), ("y", None), ("z", '{"groups": [{"local_id": "a/b=c@d", "n": 1}, {"local_id": {"value": "w"}, "n": 2}]}')]
    cells, entities = records.decompose(spark.createDataFrame(rows, "record_id string, record string"), S)
    keys = {r["entity"] for r in entities.where("record_id = 'z' AND entity <> ''").collect()}
    assert {"groups[]=a%2Fb%3Dc%40d", "groups[]=w"} <= keys
    assert {r["status"] for r in cells.where("record_id IN ('x', 'y')").collect()} == {"not_extracted"}


def test_order_of_members_is_their_position(spark):
    many = {"m": {"rows": [{"v": i} for i in range(25)]}}
    cells, entities = records.decompose(frame(spark, many), S)
    shuffled = cells.orderBy(F.rand(3)), entities.orderBy(F.rand(4))
    assert json.loads(records.assemble(*shuffled, S).first()["record"])["rows"] == many["m"]["rows"]


def test_wrapped_values(spark):
    wrappers = {
        "present": {"extraction_status": "extracted", "value": 1}, "not_reported": {"extraction_status": "not_reported"}, "unknown": {"extraction_status": "not_reported", "unreported_reason": "undetermined"},
        "not_applicable": {"extraction_status": "not_applicable"}, "extraction_failed": {"extraction_status": "failed"},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in wrappers.items()], "want string, doc string")
    status, value, reason = records.wrapped_decode(F.parse_json("doc"))
    both = df.select("want", status.alias("status"), value.alias("value"), reason.alias("reason"))
    assert all(r["want"] == r["status"] for r in both.collect())
    back = both.withColumn("doc", records.wrapped_encode(F.col("status"), F.col("value"), F.col("reason"), F.lit(0)))
    again = records.wrapped_decode(F.parse_json("doc"))[0]
    assert back.where(again != F.col("want")).count() == 0


def test_json_lines(spark, tmp_path):
    lines = ['{"record": {"title": "a"}, "record_id": "r1", "schema_ref": "s@2", "source": {"source_id": "x", "source_version": "1"}, "parsed": {"source_id": "x", "source_version": "1", "parse_version": "p", "units": [{"unit_id": "u", "text": "ab"}, {"unit_id": "v", "text": "c", "kind": "title"}]}}', "", "  ", '{"record_id": "r2", "title": "b"}', '{"title": "c"}', "no json"]
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join(lines))
    got = {r["record_id"]: r for r in jsonl.read_records(spark, str(path), "s@1").collect()}
    assert len(got) == 4 and json.loads(got["r1"]["record"]) == {"title": "a"} and got["r1"]["schema_ref"] == "s@2" and got["r2"]["schema_ref"] == "s@1"
    assert sum(r["record"] is None for r in got.values()) == 1
    units = jsonl.units_of(jsonl.read_records(spark, str(path))).orderBy("ordinal").collect()
    assert [(u["unit_id"], u["kind"], u["doc_start"]) for u in units] == [("u", "paragraph", 0), ("v", "title", 3)]


def test_gold_and_review_lines(spark, tmp_path):
    gold = tmp_path / "gold.jsonl"
    gold.write_text('{"name": "g", "frozen_at": "now"}\n{"record_id": "r", "field_id": "f", "status": "present", "value": [1], "also_acceptable": [[2], "x"]}\n')
    head, rows = jsonl.load_gold(spark, str(gold))
    assert head["name"] == "g" and rows.first()["value"] == "[1]" and rows.first()["also"] == ["[2]", '"x"']
    assert json.loads(jsonl.gold_lines(rows).first()[0])["also_acceptable"] == [[2], "x"]
    (tmp_path / "none.jsonl").write_text('{"name": "g"}\n')
    with pytest.raises(EngineError):
        jsonl.load_gold(spark, str(tmp_path / "none.jsonl"))
    (tmp_path / "rev.jsonl").write_text('{"item_id": "1", "decision": ""}\n{"item_id": "2", "decision": "accept", "rationale": "y", "edited_value": ""}\n')
    assert [tuple(r) for r in jsonl.read_decisions(spark, str(tmp_path / "rev.jsonl")).collect()] == [("2", "accept", "y", None)]
    for bad in ("{", '{"item_id": "1", "decision": "maybe"}', '{"item_id": "1", "decision": "edit"}'):
        (tmp_path / "bad.jsonl").write_text(bad)
        with pytest.raises(EngineError):
            jsonl.read_decisions(spark, str(tmp_path / "bad.jsonl"))

"""Schemas from JSON Schema, LinkML, Pydantic and struct types; configuration."""

import pytest
from pyspark.sql import types as T
from strataweave.errors import EngineError
from strataweave.sources import config
from strataweave.sources.declarations import from_json_schema, from_linkml, from_pydantic, from_struct

DOCUMENT = {
    "type": "object",
    "required": ["title"],
    "properties": {
        "title": {"type": "string", "maxLength": 9, "description": "t", "x-field-recipe": "r@1"},
        "size": {"type": ["integer", "null"], "minimum": 0},
        "mode": {"anyOf": [{"$ref": "#/$defs/Mode"}, {"type": "string"}]},
        "modes": {"type": "array", "items": {"$ref": "#/$defs/Mode"}, "minItems": 1},
        "design": {"type": "object", "properties": {"kind": {"enum": ["a", "b"]}}},
        "groups": {"type": "array", "items": {"$ref": "#/$defs/Group"}},
        "free": {"type": "object"},
    },
    "$defs": {
        "Mode": {"type": "string", "enum": ["x", "y"]},
        "Group": {"type": "object", "properties": {"local_id": {"type": "string"}, "n": {"type": "number"}, "parts": {"type": "array", "items": {"$ref": "#/$defs/Group"}}}},
    },
}


def test_json_schema():
    s = from_json_schema(DOCUMENT, "s", "1", {"design.kind": "kind"})
    f = {x.path: x for x in s.fields}
    assert set(f) == {"title", "size", "mode", "modes", "design.kind", "groups[].local_id", "groups[].n", "free"}
    assert f["title"].required and f["title"].recipe_ref == "r@1" and f["title"].constraints.max_length == 9
    assert f["size"].base_type == "integer" and f["size"].annotations == {"nullable": True} and f["size"].constraints.minimum == 0
    assert f["mode"].constraints.enum == ("x", "y") and f["mode"].constraints.open_vocabulary and f["mode"].base_type == "string"
    assert f["modes"].multivalued and f["modes"].constraints.enum == ("x", "y") and f["modes"].constraints.min_items == 1
    assert f["design.kind"].field_id == "kind" and f["groups[].n"].base_type == "number" and f["free"].base_type == "object"
    assert s.collections() == ["groups[]", "groups[].parts[]"] and s.identity_field("groups[]") == "local_id"


def test_json_schema_refuses_what_it_cannot_resolve():
    with pytest.raises(EngineError):
        from_json_schema({"properties": {"a": {"$ref": "#/$defs/Nothing"}}}, "s", "1")
    deep = {"type": "string"}
    for _ in range(20):
        deep = {"type": "object", "properties": {"a": deep}}
    with pytest.raises(EngineError):
        from_json_schema(deep, "s", "1")


def test_linkml(tmp_path):
    (tmp_path / "base.yaml").write_text(
        """
classes:
  ExtractedValue: {attributes: {value: {range: Any}, status: {range: string}}}
  ExtractedMode: {is_a: ExtractedValue, description: wrapped mode, slot_usage: {value: {multivalued: true, any_of: [{range: Mode}, {range: string}]}}}
  Named: {attributes: {local_id: {range: string, in_subset: [deterministic]}}}
enums: {Mode: {permissible_values: {x: {}, y: {}}}}
"""
    )
    (tmp_path / "main.yaml").write_text(
        """
name: study
version: "2"
imports: [base, "linkml:types"]
slots: {title: {range: string, required: true}}
classes:
  Study: {tree_root: true, slots: [title], attributes: {groups: {range: Group, multivalued: true}, mode: {range: ExtractedMode}, first: {range: Group, inlined: false}, at: {range: date}}}
  Group: {is_a: Named, attributes: {n: {range: integer, minimum_value: 0}, inner: {range: Group, multivalued: true}}}
"""
    )
    s = from_linkml(str(tmp_path / "main.yaml"))
    f = {x.path: x for x in s.fields}
    assert s.ref == "study@2" and set(f) == {"title", "mode", "first", "at", "groups[].local_id", "groups[].n"}
    assert f["mode"].multivalued and f["mode"].constraints.open_vocabulary and f["mode"].constraints.enum == ("x", "y") and f["mode"].description == "wrapped mode" and not f["mode"].deterministic
    assert f["first"].base_type == "string" and f["first"].annotations["references"] == "Group" and f["at"].base_type == "string"
    assert f["groups[].local_id"].deterministic and f["groups[].n"].constraints.minimum == 0 and s.identity_field("groups[]") == "local_id"
    assert f["title"].required and s.collections() == ["groups[]", "groups[].inner[]"]


def test_pydantic():
    from pydantic import BaseModel, Field

    class Part(BaseModel):
        local_id: str
        n: int | None = None

    class Whole(BaseModel):
        title: str = Field(description="t")
        parts: list[Part] = []

    s = from_pydantic(Whole, "w", "1")
    assert {f.path for f in s.fields} == {"title", "parts[].local_id", "parts[].n"} and s.by_id()["title"].required


def test_struct_types(spark):
    struct = T._parse_datatype_string("a int, b array<string>, c struct<d:double,e:date>, g array<struct<local_id:string,x:boolean>>, m map<string,int>")
    s = from_struct(struct, "t", "1")
    assert {(f.path, f.base_type, f.multivalued) for f in s.fields} == {("a", "integer", False), ("b", "string", True), ("c.d", "number", False), ("c.e", "string", False), ("g[].local_id", "string", False), ("g[].x", "boolean", False), ("m", "object", False)}


def test_configuration():
    text = "store: /s/${env:NAME}\nadapters: {main: {api_key: '${env:KEY:none}'}}"
    out = config.load(text, {"NAME": "x"})
    assert out == {"store": "/s/x", "adapters": {"main": {"api_key": "none"}}}
    assert config.redacted(out)["adapters"]["main"]["api_key"] == "***" and config.redacted(out)["store"] == "/s/x"
    for bad in ("store: ${env:GONE}", "unknown: 1", "[1]"):
        with pytest.raises(EngineError):
            config.load(bad, {})

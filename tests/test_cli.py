"""The command line over a whole workflow."""

import json

import bed_project as bed
import pytest
from strataweave import cli
from strataweave.model.codec import to_value
from strataweave.model.migration import dump_migrations

pytestmark = pytest.mark.usefixtures("interpreted")


def run(spark, capsys, store, *argv, code=0, **project):
    got = cli.main(["--store", store, *argv, "--json"], spark, **({"wrapped": True, "adapters": {"main": bed.model()}} | project))
    out = capsys.readouterr()
    assert got == code, out.err
    return json.loads(out.out) if out.out.strip() else json.loads(out.err)


def test_workflow(spark, tmp_path, capsys):
    store = str(tmp_path / "s")
    go = lambda *argv, **more: run(spark, capsys, store, *argv, **more)
    document = {"type": "object", "properties": {"a": {"type": "string"}, "b": {"type": "string"}}}
    (tmp_path / "1.json").write_text(json.dumps(document))
    document["properties"]["c"] = {"type": "string"}
    (tmp_path / "2.json").write_text(json.dumps(document))
    assert go("schema", "register", str(tmp_path / "1.json"), "s", "1", wrapped=False)["ref"] == "s@1"
    go("schema", "register", str(tmp_path / "2.json"), "s", "2")
    assert go("schema", "list") == ["s@1", "s@2"]
    assert [c["kind"] for c in go("schema", "diff", "s@1", "s@2")["changes"]] == ["added"]
    (tmp_path / "new.yaml").write_text(go("migration", "new", "s@1", "s@2"))
    assert go("migration", "validate", str(tmp_path / "new.yaml"), code=1)["s@1->s@2"]  # its recipe isn't known
    (tmp_path / "m.yaml").write_text("{id: m, from_schema: s@1, to_schema: s@2, steps: [{id: t, kind: copy, reads: [a], writes: [c]}]}")
    assert go("migration", "validate", str(tmp_path / "m.yaml")) == {"m": []} and go("migration", "register", str(tmp_path / "m.yaml")) == ["m"]
    assert go("migration", "path", "s@1", "s@2") == ["m"] and go("migration", "list")[0]["steps"] == 1
    (tmp_path / "r.yaml").write_text("recipes: [{name: r, version: '1'}]\nvocabularies: [{name: v, version: '1', values: [x]}]\n")
    assert go("recipe", "register", str(tmp_path / "r.yaml")) == ["r@1", "v@1"] and go("recipe", "list") == ["r@1"] and go("vocabulary", "register", str(tmp_path / "r.yaml")) == ["v@1"]
    (tmp_path / "in.jsonl").write_text('{"record_id": "x", "a": "1", "b": "2"}\n{"record_id": "y", "a": "3"}\n')
    assert go("ingest", str(tmp_path / "in.jsonl"), "--schema", "s@1", wrapped=False)["records"] == 2
    assert go("plan", "s@2")["totals"]["n_steps"] == 2
    done = go("run", "s@2", wrapped=False)
    assert done["published"] == 2 and go("status", done["execution_id"])["status"] == "succeeded"
    assert go("record", "x", wrapped=False) == {"a": "1", "b": "2", "c": "1"}
    assert [r["kind"] for r in go("diff", "x")] == ["added"] and go("report", done["execution_id"])["by_kind"]["added"] == 2
    assert len(go("provenance", "show", "x", "c")) == 1 and go("currency")["current"] == 6
    go("export", str(tmp_path / "out"), wrapped=False)
    go("review", "export", str(tmp_path / "rev"))
    assert go("review", "list") == []
    assert go("resume", "nothing", code=2)["code"] == "execution_unknown" and go("record", "nobody", code=2)["code"] == "record_unknown"
    (tmp_path / "gold.jsonl").write_text('{"name": "g"}\n{"record_id": "x", "field_id": "c", "status": "present", "value": "9"}\n')
    assert go("evaluate", str(tmp_path / "gold.jsonl"), "s@2", "--gate", "precision>=0.5", code=1)["gates"][0]["passed"] is False
    assert go("reanchor", "p1") == {}


def test_text_output_and_configuration(spark, tmp_path, capsys):
    (tmp_path / "c.yaml").write_text(f"store: {tmp_path}/s\n")
    assert cli.main(["--config", str(tmp_path / "c.yaml"), "schema", "list"], spark) == 0 and capsys.readouterr().out.strip() == "[]"
    assert cli.main(["schema", "list"], spark) == 2 and "config_invalid" in capsys.readouterr().err
    r = bed.registry()
    assert dump_migrations(list(r.migrations.values())) and to_value(r.recipes["cue@1"])["name"] == "cue"

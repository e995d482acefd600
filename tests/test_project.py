"""Whole migrations of a small corpus: reuse, calls, cache, budgets, escalation, shadow, review, evaluation, re-anchoring, export."""

import json
from dataclasses import replace

import bed_project as bed
import pytest
from pyspark.sql import functions as F
from strataweave.errors import EngineError
from strataweave.functions.registry import register
from strataweave.model.migration import ExecutionPolicy, Migration, Step
from strataweave.model.recipe import ContextPolicy, Escalation, Recipe, Source
from strataweave.operators.calling import Failing, RuleBased, Scripted
from strataweave.plans.engine import with_policy
from strataweave.project import Project
from strataweave.sources import jsonl

LOSSY = ExecutionPolicy(allow_lossy=True)
pytestmark = pytest.mark.usefixtures("interpreted")


def made(spark, tmp_path, n=8, registry=None, adapters=None, **more):
    p = Project(spark, str(tmp_path / "store"), registry or bed.registry(), adapters or {"main": bed.model()}, wrapped=True, **more)
    assert p.ingest_jsonl(bed.write_corpus(tmp_path / "in.jsonl", n)) == {"records": n, "refused": 0, "cells": 13 * n, "faults": 0}
    return p


def states(p, run):
    return {r["step_key"]: (r["disposition"], r["state"]) for r in p.store.read("execution_step").where(F.col("execution_id") == run).collect()}


def test_a_corpus_through_four_versions(spark, tmp_path):
    p = made(spark, tmp_path)
    before = {r["artifact_id"] for r in p.store.latest_cells().collect()}
    plan, one = p.migrate("trial@1.1")
    assert (one.status, one.published, one.metrics["calls"]) == ("succeeded", 8, 8)
    assert [d["disposition"] for d in plan.summary()] == ["semantic"] and plan.totals()["touching_source"] == 8
    cells = p.store.latest_cells().collect()
    assert before < {r["artifact_id"] for r in cells}  # nothing else was written
    cue = {r["record_id"]: r for r in cells if r["field_id"] == "tasks[].cue"}
    assert {c["status"] for c in cue.values()} == {"not_reported"}  # the model saw the evidence of the name only
    # a rename costs nothing and keeps its cell
    record = p.get_record("rep:1")
    assert record["tasks"][0]["response_modality"]["value"] == ["press"] and "response_mode" not in record["tasks"][0]

    again = p.run(p.plan("trial@1.1"))
    assert again.metrics["calls"] == 0 and again.records == 8

    _, two = p.migrate("trial@1.2", LOSSY)
    assert two.status == "succeeded" and two.metrics["calls"] == 0
    assert [a["is_healthy"] for a in p.get_record("rep:1")["arms"]] == [True, False]

    _, three = p.migrate("trial@1.3", LOSSY)
    assert (three.status, three.published) == ("partial", 6)  # rep:0 and rep:4 are reopened
    assert {r["record_id"] for r in p.reviews().collect()} == {"rep:0", "rep:4"}
    assert {r["record_id"]: r["schema_ref"] for r in p.records().collect()}["rep:0"] == "trial@1.2"
    report = p.report(three.execution_id)
    assert report["changed"] == 0 and report["review_rate"] == 0.25

    # decisions: one accepted, one edited
    items = {r["record_id"]: r["item_id"] for r in p.reviews().collect()}
    decisions = spark.createDataFrame([(items["rep:0"], "accept", "fine", None), (items["rep:4"], "edit", "no", '"cohorts"')], "item_id string, decision string, rationale string, edited_value string")
    assert p.decide(decisions) == 2 and p.reviews().count() == 0 and p.review_report()["by_state"] == {"accepted": 1, "edited": 1}
    plan, four = p.migrate("trial@1.3", LOSSY, record_ids=["rep:0", "rep:4"])
    assert four.published == 2 and {d["disposition"] for d in plan.summary()} == {"reuse"}
    assert p.get_record("rep:4")["design"]["structure"]["value"] == "cohorts"

    # the whole path at once for what is left; one recipe changed
    plan, five = p.migrate("trial@1.4", LOSSY)
    assert (five.status, five.published, five.metrics["calls"]) == ("succeeded", 8, 8)
    assert p.status(five.execution_id)["status"] == "succeeded"
    assert {r["state"] for r in p.currency().select("state").distinct().collect()} <= {"current", "accepted", "stale"}
    p.export(str(tmp_path / "out"))
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 8 and all(x["record"]["tasks"][0]["cue"] for x in lines) and all(x["provenance"] == sorted(x["provenance"], key=lambda c: (c["field_id"], c["entity"])) for x in lines)
    history = p.provenance("rep:4", "design.structure").collect()
    assert [r["actor"] for r in history][0] == "import" and "human" in [r["actor"] for r in history]
    assert p.diff_record("rep:4").where("kind = 'added'").count() == 0
    p.close()


def test_evidence_first_then_the_methods(spark, tmp_path):
    """The name's evidence is in the abstract, so the first source satisfies and the model never sees the methods unless it asks for more."""
    r = bed.registry()
    name = "cue"
    asking = ContextPolicy((Source("prior_evidence"), Source("sections", {"names": ["methods"]}), Source("sections", {"names": ["results"]})))
    r.recipes["cue@1"] = Recipe(name, "1", "{context}", ("tasks[].cue",), "main", context=asking, escalation=Escalation(True, max_escalations=2))
    model = RuleBased(rules={"tasks[].cue": [(f"{c} cue", [c]) for c in bed.CUES] + [("went well", ["none"])]}, otherwise={"tasks[].cue": {"status": "needs_more_context"}})
    p = made(spark, tmp_path, 8, r, {"main": model})
    _, run = p.migrate("trial@1.1")
    assert run.published == 8 and run.metrics["calls"] == 8 * 2  # those without methods are shown the results
    cells = {x["record_id"]: x for x in p.store.latest_cells().where("field_id = 'tasks[].cue'").collect()}
    assert json.loads(cells["rep:1"]["value_json"]) == ["auditory"] and json.loads(cells["rep:7"]["value_json"]) == ["none"]
    assert [(e["unit_id"], e["start"], e["text"]) for e in cells["rep:1"]["evidence"]] == [("methods:2", 2, "auditory cue")]
    levels = {(a["step_key"].split("|")[0], a["level"]) for a in p.store.read("attempt").collect()}
    assert levels == {(f"rep:{i}", k) for i in range(8) for k in (0, 1)}
    p.close()


def test_caps_failures_and_resuming(spark, tmp_path):
    r = bed.registry()
    r.recipes["cue@1"] = replace(r.recipes["cue@1"], context=ContextPolicy((Source("sections", {"names": ["abstract"]}),)), max_attempts=1)
    p = made(spark, tmp_path, 6, r)
    plan = p.plan("trial@1.1")
    capped = p.run(with_policy(plan, max_calls=2), execution_id="x")
    assert (capped.metrics["calls"], capped.published, capped.status) == (2, 2, "partial")
    assert sorted(s for _, s in states(p, "x").values()) == ["blocked"] * 4 + ["succeeded"] * 2
    with pytest.raises(EngineError) as e:
        p.run(p.plan("trial@1.1"), execution_id="x")
    assert e.value.code == "execution_exists"
    p.engine.adapters["main"] = Failing()
    failed = p.run(p.plan("trial@1.1"), execution_id="y")
    assert failed.published == 2 and sorted(s for _, s in states(p, "y").values()) == ["failed"] * 4  # those published before plan nothing
    p.engine.adapters["main"] = bed.model()
    resumed = p.resume("y")
    assert resumed.metrics["calls"] == 4 and {s for _, s in states(p, "y").values()} == {"succeeded"} and p.store.current().where("schema_ref = 'trial@1.1'").count() == 6
    with pytest.raises(EngineError):
        p.resume("nothing")
    p.registry.recipes["new@1"] = Recipe("new", "1")
    with pytest.raises(EngineError) as e:
        p.run(plan)
    assert e.value.code == "registry_moved"
    p.close()


def boom(ctx):
    if ctx.record_id.endswith("3"):
        raise ValueError("no")
    return {"title": ctx.reads["title"].upper()}


def shout(value, status):
    return ("review", "loud") if value and value[0].endswith("1") else True


def test_a_failing_record_stays_alone_and_policies_gate(spark, tmp_path):
    register("transform", "boom", "1", boom)
    register("validator", "quiet", "1", shout)
    r = bed.registry()
    r.migrations.clear()
    step = Step("t", "derive", ("title",), ("title",), transform="boom@1", fidelity="lossy")
    r.migrations["m"] = Migration("m", "trial@1.0", "trial@1.1", (step, Step("c", "semantic", ("title",), ("tasks[].cue",), "tasks[]", recipe="cue@1", validators=("quiet@1",))), acknowledged=("tasks[].cue",))
    p = made(spark, tmp_path, 5, r, {"main": Scripted(answers={"c": {"tasks[].cue": ["x1"]}, "rep:2|c": ["fine"]})}, shadow={"cue@1": "cue@2"})
    blocked = p.plan("trial@1.1")
    assert blocked.blocked == {"trial@1.0": "fidelity_not_permitted"} and blocked.steps.count() == 0
    _, run = p.migrate("trial@1.1", LOSSY)
    got = states(p, run.execution_id)
    assert got["rep:3|m|t|"] == ("deterministic", "failed") and got["rep:2|m|t|"][1] == "succeeded"
    assert got["rep:2|m|c|tasks[]=t1"][1] == "succeeded" and got["rep:1|m|c|tasks[]=t1"][1] == "review_needed"
    assert run.published == 1 and p.get_record("rep:2")["title"]["value"] == "REPORT 2"
    shadow = {a["outcome"] for a in p.store.read("attempt").where("kind = 'shadow'").collect()}
    assert shadow == {"agree"}
    p.close()


def test_evaluation_and_reanchoring(spark, tmp_path):
    p = made(spark, tmp_path, 6)
    cues = [(f"rep:{i}", "tasks[].cue", "tasks[]=t1", "present", json.dumps([bed.CUES[i % 3]]), ['["any"]'], "") for i in range(4)]
    gold = spark.createDataFrame(cues, "record_id string, field_id string, entity string, status string, value string, also array<string>, note string")
    r = p.registry.recipes["cue@1"]
    p.registry.recipes["cue@1"] = replace(r, context=ContextPolicy((Source("sections", {"names": ["methods"]}), Source("sections", {"names": ["abstract"]}))))
    out = p.evaluate(gold, "trial@1.1", gates=["precision>=0.9", "recall>=0.9", "cost_usd<=1"])
    score = out["scores"]["tasks[].cue"]
    assert (score["n"], score["true_positive"], score["missed"]) == (4, 3, 1) and score["precision"] == 1.0 and score["recall"] == 0.75  # rep:0 has no methods
    assert {g["gate"]: g["passed"] for g in out["gates"]} == {"precision>=0.9": True, "recall>=0.9": False, "cost_usd<=1": True} and not out["passed"]
    assert p.store.current().where("schema_ref = 'trial@1.1'").count() == 4

    # a new parse: everything in one unit, one abstract lost
    lines = []
    for i in range(6):
        x = bed.report(i)
        text = " ".join(u["text"] for u in x["parsed"]["units"] if not (i == 5 and u["section"] == "abstract"))
        lines.append({"source_id": f"s{i}", "source_version": "1", "parse_version": "p2", "unit_id": "all", "kind": "section", "section": "all", "text": text, "ordinal": 0})
    with p.store.transaction() as t:
        t.append("document_unit", spark.createDataFrame(lines))
    dry = p.reanchor("p2")
    assert dry["lost"] == 1 and dry["reanchored"] == 8 and p.reanchor("p2", dry_run=False) == dry
    names = {r["record_id"]: r for r in p.store.latest_cells().where("field_id = 'tasks[].name'").collect()}
    assert names["rep:1"]["evidence"][0]["unit_id"] == "all" and (names["rep:5"]["evidence"], names["rep:5"]["unlocated"]) == ([], 1)
    assert p.accept_legacy(F.col("field_id") == "title") == 6
    p.close()


def test_stale_cells_can_be_sent_to_review(spark, tmp_path):
    r = bed.registry()
    r.migrations["m11"] = replace(r.migrations["m11"], steps=(replace(r.migrations["m11"].steps[0], context={"sequence": ["none"]}),))
    p = made(spark, tmp_path, 3, r, {"main": Scripted(answers={"cue": {"tasks[].cue": {"status": "not_reported", "reason": "x"}}})})
    p.store.save_document("x", 1)
    cells = p.store.latest_cells().where("field_id = 'design.n_arms'").drop("artifact_id", "value_hash", "created_at", "hashes")
    from strataweave.plans.engine import as_cells

    old = as_cells(cells.withColumn("hashes", F.create_map(F.lit("field_def:design.n_arms"), F.lit("old"))), "2999")
    with p.store.transaction() as t:
        t.append_new("field_artifact", old)
    plan = p.plan("trial@1.1", on_stale="review")
    assert plan.stale.select("field_id").distinct().collect()[0][0] == "design.n_arms" and plan.stale.count() == 3
    run = p.run(plan)
    assert run.published == 0 and p.reviews().where("reason LIKE 'stale%'").count() == 3
    p.close()


def test_repeated_and_broken_lines(spark, tmp_path):
    p = Project(spark, str(tmp_path / "store"), bed.registry(), wrapped=True)
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join([json.dumps(bed.report(1)), json.dumps(bed.report(1)), "{broken", ""]))
    assert p.ingest_jsonl(str(path))["records"] == 1 and p.store.read("record_index").count() == 1
    assert p.ingest(jsonl.read_records(spark, str(path)).where("false"))["records"] == 0
    assert p.get_record("nobody") is None
    p.close()

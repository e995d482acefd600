"""A small corpus of trials over five schema versions, with transforms, recipes and an offline model."""

from __future__ import annotations

import json

from strataweave.functions.registry import register
from strataweave.model.migration import Migration, Step
from strataweave.model.recipe import ContextPolicy, Recipe, Source, Vocabulary
from strataweave.model.registry import Registry
from strataweave.model.schema import Collection, Constraints, FieldDefinition, Schema
from strataweave.operators.calling import RuleBased
from strataweave.plans.engine import Result

PARTS = (Collection("arms[]", "local_id"), Collection("tasks[]", "local_id"))
KINDS = ("parallel", "crossover", "single_group")
KINDS_2 = ("parallel", "crossover", "single_group", "cohorts")


def _base(**changes) -> list[FieldDefinition]:
    f = FieldDefinition
    out = {
        "local_id": f("local_id", required=True, deterministic=True),
        "title": f("title", description="Title of the report", recipe_ref="front@1"),
        "structure": f("design.structure", field_id="design.structure", description="How people are assigned", constraints=Constraints(enum=KINDS, vocabulary_ref="Structure@1"), recipe_ref="design@1"),
        "n_arms": f("design.n_arms", "integer", description="Number of arms", constraints=Constraints(minimum=0), recipe_ref="design@1"),
        "arm_id": f("arms[].local_id", required=True, deterministic=True),
        "arm_n": f("arms[].n", "integer", description="People in the arm", constraints=Constraints(minimum=0), recipe_ref="arm@1"),
        "condition": f("arms[].condition", multivalued=True, description="Conditions of the people", recipe_ref="arm@1"),
        "task_id": f("tasks[].local_id", required=True, deterministic=True),
        "task_name": f("tasks[].name", description="Name of the task", recipe_ref="task@1"),
        "response": f("tasks[].response_mode", multivalued=True, description="How people answer", constraints=Constraints(enum=("press", "speech", "gaze"), open_vocabulary=True), recipe_ref="task@1"),
    }
    return list((out | changes).values())


def schemas() -> list[Schema]:
    f = FieldDefinition
    renamed = f("tasks[].response_modality", field_id="tasks[].response_mode", multivalued=True, description="How people answer", constraints=Constraints(enum=("press", "speech", "gaze"), open_vocabulary=True), recipe_ref="task@1")
    cue = lambda v: f("tasks[].cue", multivalued=True, description="Sense that the cue is for", constraints=Constraints(enum=("visual", "auditory", "tactile"), open_vocabulary=True), recipe_ref=f"cue@{v}")
    healthy = f("arms[].is_healthy", "boolean", description="Whether the arm has no condition", deterministic=True)
    wide = f("design.structure", description="How people are assigned, cohorts too", constraints=Constraints(enum=KINDS_2, vocabulary_ref="Structure@2"), recipe_ref="design@1")
    n1 = f("arms[].n", "integer", description="People in the arm", constraints=Constraints(minimum=1), recipe_ref="arm@1")
    return [
        Schema("trial", "1.0", tuple(_base()), PARTS),
        Schema("trial", "1.1", tuple(_base(response=renamed, cue=cue(1))), PARTS),
        Schema("trial", "1.2", tuple(_base(response=renamed, cue=cue(1), healthy=healthy)), PARTS),
        Schema("trial", "1.3", tuple(_base(response=renamed, cue=cue(1), healthy=healthy, structure=wide)), PARTS),
        Schema("trial", "1.4", tuple(_base(response=renamed, cue=cue(2), healthy=healthy, structure=wide, arm_n=n1)), PARTS),
    ]


def is_healthy(reads, params):
    """No condition, or only the healthy one."""
    from pyspark.sql import functions as F

    conditions = F.from_json(reads["arms[].condition"], "array<string>")
    return {"arms[].is_healthy": F.when(conditions.isNotNull(), F.to_json(F.array(~F.exists(conditions, lambda c: F.lower(c) != "healthy")))).substr(F.lit(2), F.length(F.to_json(F.array(~F.exists(conditions, lambda c: F.lower(c) != "healthy")))) - 2)}


def remap(ctx):
    """By the vocabulary; a reopened value is for review."""
    vocabulary = ctx.vocabularies["Structure@2"]
    value = ctx.reads.get("design.structure")
    status = ctx.statuses.get("design.structure", "not_extracted")
    if value == "boom":
        raise ValueError("boom")
    held = status in ("present", "review_required")
    if held and value in vocabulary.reopens:
        return Result({"design.structure": value}, {"design.structure": "review_required"}, "reopened")
    if held:
        return {"design.structure": vocabulary.replaces.get(value, value)}
    return Result({"design.structure": None}, {"design.structure": status})


def registry() -> Registry:
    register("transform", "is-healthy", "1", is_healthy, "columns")
    register("transform", "remap-structure", "1", remap)
    r = Registry()
    for s in schemas():
        r.add_schema(s)
    r.add_vocabulary(Vocabulary("Structure", "1", KINDS))
    r.add_vocabulary(Vocabulary("Structure", "2", KINDS_2, reopens=("single_group",)))
    first = ContextPolicy((Source("prior_evidence"), Source("sections", {"names": ["methods"]})))
    for v in ("1", "2"):
        r.add_recipe(Recipe("cue", v, f"v{v}: which cue in {{context}}", ("tasks[].cue",), "main", context=first))
    r.add_migration(Migration("m11", "trial@1.0", "trial@1.1", (Step("cue", "semantic", ("tasks[].name",), ("tasks[].cue",), "tasks[]", recipe="cue@1", validators=("require_evidence",)),)))
    r.add_migration(Migration("m12", "trial@1.1", "trial@1.2", (Step("healthy", "derive", ("arms[].condition",), ("arms[].is_healthy",), "arms[]", transform="is-healthy@1", fidelity="lossy"),)))
    r.add_migration(Migration("m13", "trial@1.2", "trial@1.3", (Step("structure", "remap", ("design.structure",), ("design.structure",), transform="remap-structure@1", vocabularies=("Structure@2",), fidelity="lossy"),)))
    r.add_migration(Migration("m14", "trial@1.3", "trial@1.4", (Step("cue2", "semantic", ("tasks[].name",), ("tasks[].cue",), "tasks[]", recipe="cue@2"),), acknowledged=("arms[].n",)))
    return r


CUES = ("visual", "auditory", "tactile")


def model(**more) -> RuleBased:
    return RuleBased(rules={"tasks[].cue": [(f"{c} cue", [c]) for c in CUES]}, usd_in=3.0, usd_out=15.0, **more)


def report(i: int) -> dict:
    """One line of the corpus: record, source and parse. Every seventh has no methods."""
    cue, structure = CUES[i % 3], "single_group" if i % 4 == 0 else "parallel"
    name = f"task {i}"
    sections = [("title", f"Report {i}"), ("abstract", f"People did {name}."), ("methods", f"A {cue} cue came first."), ("results", "It went well.")]
    if i % 7 == 0:
        del sections[2]
    units = [{"unit_id": f"{s}:{k}", "kind": "section", "section": s, "text": t, "ordinal": k} for k, (s, t) in enumerate(sections)]
    wrap = lambda v, spans=(): {"extraction_status": "extracted", "value": v, "evidence": {"status": "present", "sets": [{"source_id": f"s{i}", "spans": list(spans)}]}}
    at = units[1]["text"].index(name)
    record = {
        "local_id": f"r{i}",
        "title": wrap(f"Report {i}"),
        "design": {"structure": wrap(structure), "n_arms": wrap(2)},
        "arms": [{"local_id": "a1", "n": wrap(10 + i), "condition": wrap(["healthy"])}, {"local_id": "a2", "n": wrap(20), "condition": wrap(["asthma"])}],
        "tasks": [{"local_id": "t1", "name": wrap(name, [{"unit_id": "abstract:1", "start_char": at, "end_char": at + len(name), "text": name}]), "response_mode": wrap(["press"])}],
    }
    source = {"source_id": f"s{i}", "source_version": "1", "content_hash": "h", "uri": "", "media_type": "text/plain", "labels": []}
    return {"record_id": f"rep:{i}", "schema_ref": "trial@1.0", "record": record, "source": source, "parsed": {"source_id": f"s{i}", "source_version": "1", "parse_version": "p1", "units": units}}


def write_corpus(path, n: int = 8) -> str:
    path.write_text("\n\n".join(json.dumps(report(i)) for i in range(n)) + "\n")
    return str(path)

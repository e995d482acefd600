"""Schemas, differences, migrations, the registry and its graph, recipes, and their JSON and YAML forms."""

import bed_project as bed
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from strataweave.errors import CODES, EngineError
from strataweave.model import codec
from strataweave.model.migration import ExecutionPolicy, Migration, Step, dump_migrations, load_migrations, parse_ref, scaffold
from strataweave.model.recipe import ContextPolicy, Escalation, Source, load_recipes, policy_from
from strataweave.model.registry import Registry
from strataweave.model.schema import Collection, Constraints, FieldDefinition, Schema, diff_schemas


def schema(version, *fields, **more):
    return Schema("s", version, tuple(fields), **more)


def kinds(a, b, **more):
    return sorted((c.kind, c.field_id) for c in diff_schemas(schema("1", *a), schema("2", *b), **more).changes)


F = FieldDefinition


def test_meaning_is_apart_from_place_and_bounds():
    a = F("x.y", description="two  words", field_id="f")
    assert a.semantic_key == F("z", description="two words", field_id="f").semantic_key
    assert a.semantic_key == F("x.y", description="two words", field_id="f", constraints=Constraints(minimum=0)).semantic_key
    assert a.structural_key != F("x.y", description="two words", field_id="f", constraints=Constraints(minimum=0)).structural_key
    assert a.semantic_key != F("x.y", description="two words", field_id="f", constraints=Constraints(enum=("a",))).semantic_key


def test_differences():
    assert kinds([F("a")], [F("b")]) == [("added", "b"), ("removed", "a")]
    assert kinds([F("a", field_id="i")], [F("b", field_id="i")]) == [("renamed", "i")]
    assert kinds([F("a")], [F("b")], renames={"a": "b"}) == [("renamed", "b")]
    assert kinds([F("g[].a", field_id="i")], [F("a", field_id="i")]) == [("collection_removed", "g[]"), ("nesting_changed", "i")]
    assert kinds([F("a")], [F("a", "integer", multivalued=True, required=True, recipe_ref="r@1", description="d")]) == sorted((k, "a") for k in ("type_changed", "cardinality_changed", "requiredness_changed", "recipe_changed", "description_changed"))


@pytest.mark.parametrize(
    ("old", "new", "kind"),
    [
        (dict(enum=("a", "b")), dict(enum=("a",)), "constraint_narrowed"),
        (dict(enum=("a",)), dict(enum=("a", "b")), "constraint_widened"),
        (dict(enum=("a",)), dict(enum=("b",)), "constraint_narrowed"),
        (dict(enum=("a",), open_vocabulary=True), dict(enum=("a",)), "constraint_narrowed"),
        (dict(minimum=0), dict(minimum=1), "constraint_narrowed"),
        (dict(), dict(minimum=0), "constraint_narrowed"),
        (dict(maximum=5), dict(maximum=4), "constraint_narrowed"),
        (dict(maximum=5), dict(), "constraint_widened"),
        (dict(min_items=2), dict(min_items=1), "constraint_widened"),
        (dict(pattern="a"), dict(pattern="b"), "constraint_narrowed"),
        (dict(pattern="a"), dict(), "constraint_widened"),
        (dict(vocabulary_ref="v@1"), dict(vocabulary_ref="v@2"), "vocabulary_changed"),
    ],
)
def test_constraints(old, new, kind):
    assert kinds([F("a", constraints=Constraints(**old))], [F("a", constraints=Constraints(**new))]) == [(kind, "a")]


def test_verdicts_and_candidates():
    d = diff_schemas(schema("1", F("given_name")), schema("2", F("given_names"), F("other")))
    assert d.verdicts() == {"shape": False, "values": False, "semantics": False}
    assert [c[:2] for c in d.candidates] == [("given_name", "given_names")]


@given(st.permutations(range(5)))
@settings(max_examples=20, deadline=None)
def test_hash_of_a_schema_ignores_the_order_of_fields(order):
    fields = [F(f"f{i}", description=str(i)) for i in range(5)]
    assert schema("1", *[fields[i] for i in order]).schema_hash == schema("1", *fields).schema_hash


def test_registry_is_immutable_and_checks_migrations():
    r = bed.registry()
    with pytest.raises(EngineError):
        r.add_schema(Schema("trial", "1.0", (F("other"),)))
    bad = Migration("x", "trial@1.0", "trial@1.1", (Step("s", "copy", ("nowhere",), ("nothing",)),), branch="b")
    problems = " ".join(r.check(bad))
    assert "nothing" in problems and "nowhere" in problems and "tasks[].cue" in problems
    with pytest.raises(EngineError) as e:
        r.add_migration(Migration("m11b", "trial@1.0", "trial@1.1", bed.registry().migrations["m11"].steps))
    assert e.value.code == "path_ambiguous"
    assert r.latest("trial").ref == "trial@1.4" and r.reachable("trial@1.2") == ["trial@1.3", "trial@1.4"]


def graph(*edges):
    r = Registry()
    for ref in {x for e in edges for x in e[:2]}:
        r.add_schema(Schema("g", ref, (F("a"),)))
    for k, (a, b, fidelity, semantic) in enumerate(edges):
        kind = dict(kind="semantic", recipe=None) if semantic else dict(kind="copy", reads=("a",))
        r.migrations[f"e{k}"] = Migration(f"e{k}", f"g@{a}", f"g@{b}", (Step("s", writes=("a",), fidelity=fidelity, **kind),))
    return r


def test_paths_by_preference():
    r = graph(("1", "2", "lossless", True), ("2", "3", "lossless", True), ("1", "3", "lossy", False), ("3", "1", "lossless", False))
    ids = lambda p: [m.migration_id for m in r.path("g@1", "g@3", p)]
    assert ids("fidelity") == ["e0", "e1"] and ids("cost") == ["e2"] and ids("hops") == ["e2"] and ids("latency") == ["e2"]
    assert r.path("g@1", "g@1") == []
    with pytest.raises(EngineError):
        r.path("g@1", "g@9")
    assert [len(p) for p in r.paths("g@1", "g@3", most=1)] == [1]


def test_steps_in_order_and_cycles():
    m = Migration("m", "a@1", "a@2", (Step("z", "copy", ("x",), ("y",)), Step("b", "copy", ("y",), ("w",)), Step("a", "copy", ("q",), ("x",)), Step("c", "copy", ("q",), ("v",), after=("b",))))
    assert [s.step_id for s in m.ordered_steps()] == ["a", "z", "b", "c"]
    with pytest.raises(EngineError) as e:
        Migration("m", "a@1", "a@2", (Step("a", "copy", ("x",), ("y",)), Step("b", "copy", ("y",), ("x",)))).levels()
    assert e.value.code == "cycle"
    with pytest.raises(EngineError):
        Step("s", "evidence_semantic", (), ("x",), context={"full_document": "allowed"})


def test_policy_gates():
    lossy, gone = (Migration("m", "a@1", "a@2", (Step("s", "copy", ("x",), ("y",), fidelity=f),)) for f in ("lossy", "destructive"))
    assert not ExecutionPolicy().permits(lossy) and ExecutionPolicy(allow_lossy=True).permits(lossy)
    assert not ExecutionPolicy(allow_destructive=True).permits(gone) and ExecutionPolicy(allow_destructive=True, destructive_named=("m",)).permits(gone)
    assert not ExecutionPolicy(allow_destructive=True).permits(lossy)
    p = ExecutionPolicy(providers_denied=("x",), provider_attributes={"region": "eu"})
    assert p.permits_provider("y", {"region": "eu"}) and not p.permits_provider("y") and not p.permits_provider("x", {"region": "eu"})


def test_yaml_and_json_are_exact_inverses():
    r = bed.registry()
    every = list(r.migrations.values())
    assert load_migrations(dump_migrations(every)) == every
    back = codec.registry_from_value(codec.registry_to_value(r))
    assert back.registry_hash == r.registry_hash
    assert load_migrations("migrations:\n- {id: m, from_schema: a@1, to_schema: a@2, steps: [{id: s, kind: copy, reads: [x], writes: [y]}]}")[0].steps[0].writes == ("y",)
    with pytest.raises(EngineError):
        load_migrations("{id: m, from_schema: a, to_schema: b, nonsense: 1}")


def test_scaffold_leaves_decisions_open():
    a, b = bed.schemas()[:2]
    m = scaffold(diff_schemas(a, b), b)
    assert not m.approved and [(s.kind, s.writes) for s in m.steps] == [("semantic", ("tasks[].cue",))] and "renamed" in m.notes


def test_recipes_from_yaml():
    text = """
recipes:
- {name: r, version: "1", prompt: "{context}", outputs: [a], model: m, context: {sequence: [prior_evidence, {selector: sections, params: {names: [methods]}}], max_units: 2}, escalation: {enabled: true}}
vocabularies:
- {name: v, version: "1", values: [a, b], replaces: {c: a}}
"""
    r, v = load_recipes(text)
    assert r.context.sequence[1].params == {"names": ["methods"]} and r.escalation.enabled and v.replaces == {"c": "a"}


def test_effective_sequence_and_escalation():
    p = ContextPolicy((Source("sections"),))
    names = lambda p: [s.selector for s in p.effective_sequence()]
    assert names(p) == ["sections"]
    assert names(ContextPolicy((Source("sections"),), full_document="allowed")) == ["sections", "full_document"]
    assert names(ContextPolicy((Source("sections"),), full_document="required")) == ["full_document"]
    e = Escalation(True, on_unknown=True)
    assert e.wants_more({"a": "needs_more_context"}) and e.wants_more({"a": {"status": "unknown"}}) and not e.wants_more({"a": 1})


def test_collections_and_rekey():
    s = Schema("s", "1", (F("g[].a[].x"), F("y")), (Collection("g[]", "id"),))
    assert s.collections() == ["g[]", "g[].a[]"] and Schema.parent_collection("g[].a[]") == "g[]" and Schema.relative("g[].a[].x", "g[].a[]") == "x"
    assert s.rekey({"y": "z"}).by_id()["z"].path == "y"
    with pytest.raises(KeyError):
        s.rekey({"nowhere": "z"})


def test_errors_have_known_codes():
    assert EngineError("transport").retryable and not EngineError("cycle").retryable and EngineError("cycle", "m", at=1).row()["at"] == 1
    assert len(CODES) >= 35
    with pytest.raises(ValueError):
        EngineError("no such code")


def test_migration_files():
    text = """
id: m
from_schema: a@1
to_schema: a@2
description: why
acknowledged: {x: gone}
is_downgrade: true
steps:
- {id: s1, kind: structural, reads: ["field:a", "vocab:V@1"], writes: ["field:b"], transform: t@1, fidelity: potentially_lossy}
- {id: s2, kind: source_semantic, reads: ["evidence:a", "source:parsed"], writes: [c], recipe: r@1, entity_scope: "g[]", context: {sequence: [prior_evidence, {sections: [methods]}], full_document_fallback: forbidden}, on_missing_context: block}
- {id: s3, kind: evidence_semantic, writes: ["field:d"], recipe: r@1}
"""
    (m,) = load_migrations(text)
    assert load_migrations(dump_migrations([m])) == [m] and m.direction == "downgrade" and m.because == {"x": "gone"} and m.acknowledged == ("x",)
    one, two, three = m.steps
    assert (one.reads, one.vocabularies, one.writes, one.fidelity, one.deterministic) == (("a",), ("V@1",), ("b",), "potentially_lossy", True)
    assert (two.refs, two.scope, two.touches_source, three.touches_source, three.semantic) == (("evidence:a", "source:parsed"), "g[]", True, False, True)
    assert policy_from(dict(two.context)).sequence[1] == Source("sections", {"names": ["methods"]})
    own = Migration("n", "a@1", "a@2", (Step("c", "copy", ("x",), ("y",)), Step("d", "default", (), ("z",), params={"value": 1}), Step("e", "derive", ("x",), ("w",), transform="t@1")))
    (back,) = load_migrations(dump_migrations([own], portable=True))
    assert "structural" in dump_migrations([own], portable=True) and [s.kind for s in back.steps] == ["copy", "default", "derived"] and back.steps[0] == own.steps[0]
    for bad in ("fields:a", "field:", "a"):
        with pytest.raises(EngineError):
            parse_ref(bad)
    assert parse_ref("vocab:V@1") == ("vocab", "V@1")
    for more in ({"kind": "structural"}, {"kind": "reextraction"}, {"kind": "evidence_semantic", "context": {"full_document_fallback": "allowed"}}):
        with pytest.raises(EngineError):
            Step("s", writes=("x",), **more)


def test_policy_goes_by_the_worst_step():
    steps = (Step("s", "copy", ("x",), ("y",), fidelity="lossy"), Step("t", "copy", ("x",), ("z",), fidelity="destructive"))
    m = Migration("m", "a@1", "a@2", steps)
    assert ExecutionPolicy(allow_destructive=True, destructive_named=("m",)).permits(m)
    assert not ExecutionPolicy(allow_lossy=True, allow_destructive=True, destructive_named=("t",)).permits(m)


def test_long_paths_and_equal_hops():
    r = graph(*((str(k), str(k + 1), "lossless", False) for k in range(20)), ("0", "20a", "lossless", True), ("20a", "20", "lossless", True))
    assert len(r.path("g@0", "g@20")) in (2, 20) and max(len(p) for p in r.paths("g@0", "g@20")) == 20
    r = graph(("1", "2", "lossy", False), ("2", "4", "lossless", False), ("1", "3", "lossless", False), ("3", "4", "lossless", True))
    assert [m.migration_id for m in r.path("g@1", "g@4", "hops")] == ["e2", "e3"]


def test_compatibility_of_an_added_field():
    a, b = Schema("g", "1", (F("a"),)), Schema("g", "2", (F("a"), F("b")))
    assert diff_schemas(a, b).verdicts() == {"shape": False, "values": True, "semantics": False}
    c = Schema("g", "3", (F("a", required=True),))
    assert diff_schemas(a, c).verdicts() == {"shape": False, "values": True, "semantics": True}
    narrow = [Schema("g", str(k), (F("a", constraints=Constraints(maximum=x)),)) for k, x in enumerate((9.0, 5.0))]
    assert diff_schemas(*narrow).verdicts() == {"shape": True, "values": False, "semantics": False}

"""Model calls: decoding, retries, fallbacks, limits; and in bulk."""

import pytest
from strataweave.errors import EngineError
from strataweave.model.recipe import Escalation, Recipe
from strataweave.operators.calling import Answer, Call, Failing, Limiter, RuleBased, Scripted, Seeded, ask, check_output, decode, permitted_adapters

ROW = {"step_key": "k", "record_id": "r", "entity": "", "step_id": "s", "level": 0, "context": "a red ball", "writes": ["a"], "reads": {}, "cache_key": "c"}


def call(model, recipe=None, **more):
    adapters = {"main": model, **more.pop("others", {})}
    return Call(recipe or Recipe("r", "1", "look: {context}", ("a",), "main", ("backup",)), adapters, frozenset(adapters), **more)


def test_decode_shapes():
    assert decode({"a": 1, "b": None}, ["a", "b", "c"]) == [
        {"field_id": "a", "status": "present", "value_json": "1", "reason": None, "quotes": []},
        {"field_id": "b", "status": "not_reported", "value_json": None, "reason": None, "quotes": []},
        {"field_id": "c", "status": "not_reported", "value_json": None, "reason": "the model did not answer", "quotes": []},
    ]
    assert decode("x", ["a"])[0]["value_json"] == '"x"'
    assert decode({"value": [1], "evidence": [{"text": "q"}, "p"]}, ["a"])[0] == {"field_id": "a", "status": "present", "value_json": "[1]", "reason": None, "quotes": ["q", "p"]}
    assert decode({"a_b": 2}, ["a.b"])[0]["value_json"] == "2"
    assert decode({"a": {"status": "nonsense", "value": 1}}, ["a"])[0]["status"] == "unknown"
    with pytest.raises(EngineError):
        decode("x", ["a", "b"])


def test_rules_quote_what_they_saw():
    got = call(RuleBased(rules={"a": [("blue", 1), ("red", 2)]})).answer(ROW, Limiter(None))
    assert got["error"] is None and got["cells"][0]["value_json"] == "2" and got["cells"][0]["quotes"] == ["red"] and got["tokens_in"] > 0


def test_retries_then_the_fallback():
    got = call(Failing(), others={"backup": Scripted(answers={"s": {"a": 1}})}).answer(ROW, Limiter(None, sleep=lambda s: None))
    assert [t["outcome"] for t in got["tries"]] == ["transport"] * 3 + ["ok"] and got["cells"][0]["value_json"] == "1"
    got = call(Failing(code="context_unsupported")).answer(ROW, Limiter(None))
    assert len(got["tries"]) == 1 and got["error"] == "context_unsupported"


def test_an_adapters_own_fault_is_a_row():
    class Broken(Failing):
        def generate(self, request):
            raise KeyError("x")

    got = call(Broken()).answer(ROW, Limiter(None))
    assert got["error"] == "context_unsupported" and "KeyError" in got["message"]


def test_output_schema_and_fingerprint():
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "maximum": 3}}}
    assert check_output(schema, {"a": 4}) and check_output(schema, {"a": True}) and check_output(schema, {}) and not check_output(schema, {"a": 3})
    assert check_output({"type": "array", "items": {"enum": [1]}}, [1, 2]) == ["$[1]: not permitted"]
    bad = Scripted(answers={"s": {"a": 9}})
    got = call(bad, output_schema=schema).answer(ROW, Limiter(None, sleep=lambda s: None))
    assert got["error"] == "schema_invalid" and len(got["tries"]) == 3
    once = Recipe("r", "1", "p", ("a",), "main", retry_schema_failures=False)
    assert len(call(bad, once, output_schema=schema).answer(ROW, Limiter(None))["tries"]) == 1
    pinned = Recipe("r", "1", "p", ("a",), "main", fingerprint="local/other")
    assert call(Scripted(answers={"s": 1}), pinned).answer(ROW, Limiter(None))["error"] == "fingerprint_mismatch"


def test_forbidden_providers_are_not_asked():
    from strataweave.model.migration import ExecutionPolicy

    adapters = {"main": Scripted(provider="x"), "backup": Scripted(provider="y", answers={"s": 1})}
    may = permitted_adapters(adapters, ExecutionPolicy(providers_denied=("x",)))
    assert may == {"backup"}
    got = Call(Recipe("r", "1", "p", ("a",), "main", ("backup",)), adapters, may).answer(ROW, Limiter(None))
    assert [t["adapter"] for t in got["tries"]] == ["backup"]


def test_limiter_spaces_calls():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(round(s, 3))
        now[0] += s

    limit = Limiter(4, lambda: now[0], sleep)
    for _ in range(3):
        limit.wait()
    assert slept == [0.25, 0.25]


def test_escalation_signal_and_prompts():
    r = Recipe("r", "1", "{record_id} {entity} {groups_n} {missing}|{context}", ("a",), "main", escalation=Escalation(True))
    c = call(Scripted(answers={"s": {"a": "needs_more_context"}}), r)
    assert c.prompt(ROW | {"reads": {"groups[].n": "3"}}) == "r  3 |a red ball"
    assert c.answer(ROW, Limiter(None))["wants_more"]


def test_in_bulk_every_request_has_a_row(spark):
    rows = [(f"k{i}", "r", "", "s", ["a"], f"c{i}", "a red ball", {"x": "1"}, 0) for i in range(20)]
    df = spark.createDataFrame(rows, "step_key string, record_id string, entity string, step_id string, writes array<string>, cache_key string, context string, reads map<string,string>, level int")
    model = Seeded(inner=RuleBased(rules={"a": [("red", 1)]}), rate=0.5)
    got = {r["step_key"]: r for r in ask(df, call(model), 2).collect()}
    again = {r["step_key"]: r for r in ask(df, call(model), 3).collect()}
    assert len(got) == 20 and {k: len(r["tries"]) for k, r in got.items()} == {k: len(r["tries"]) for k, r in again.items()}
    assert {len(r["tries"]) for r in got.values()} > {1} and all((r["error"] is None) == (r["cells"] is not None) for r in got.values())


def test_answers_may_carry_their_own_counts():
    class Counted(Failing):
        def generate(self, request):
            return Answer({"a": 1}, 7, 8, "f")

    got = call(Counted(usd_in=1e6, usd_out=0)).answer(ROW, Limiter(None))
    assert (got["tokens_in"], got["tokens_out"], got["usd"], got["fingerprint"]) == (7, 8, 7.0, "f")


def test_failures_of_a_hosted_model():
    inner = RuleBased(rules={"x": [("a", "b")]})
    ask = lambda adapter, **more: adapter.generate({"step_key": "s", "attempt": 1, "writes": ["x"], "context": "a", "prompt": "p" * 400, "record_id": "r", "step_id": "t"} | more)
    for adapter, more, code in (
        (Seeded(inner=inner, rate_limited=1.0), {}, "rate_limited"), (Seeded(inner=inner, rate=1.0), {}, "transport"), (Seeded(inner=inner, max_input_tokens=50), {}, "context_unsupported"),
        (Seeded(inner=inner, accepts_binary=False), {"binary": True}, "context_unsupported"),
    ):
        with pytest.raises(EngineError) as e:
            ask(adapter, **more)
        assert e.value.code == code
    assert ask(Seeded(inner=inner, garbled=1.0)).output == {"__garbled__": True} and ask(Seeded(inner=inner, max_input_tokens=200, accepts_binary=False)).output["x"]["value"] == "b"
    kept = [ask(Seeded(inner=inner, garbled=0.5), step_key=str(k)).output for k in range(200)]
    assert 60 < sum("x" in k for k in kept) < 140 and kept == [ask(Seeded(inner=inner, garbled=0.5), step_key=str(k)).output for k in range(200)]

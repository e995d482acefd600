"""Hashes, references and text functions: columns against their Python twins and brute force."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from strataweave.errors import EngineError
from strataweave.functions import ids, registry, text
from strataweave.functions.status import gold_matches

JSON = st.recursive(st.none() | st.booleans() | st.integers(-(10**12), 10**12) | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=12)


@given(JSON)
@settings(max_examples=60, deadline=None)
def test_canonical_json_ignores_order_of_members(value):
    def turned(v):
        if isinstance(v, dict):
            return {k: turned(v[k]) for k in reversed(list(v))}
        return [turned(x) for x in v] if isinstance(v, list) else v

    assert ids.canonical_json(value) == ids.canonical_json(turned(value))
    assert ids.content_hash(value) == ids.content_hash(turned(value))


def test_hashes_of_columns_are_those_of_values(spark):
    rows = [("a", None), ('q"uo\nte', "é 日本 😀"), ("", "x")]
    df = spark.createDataFrame(rows, "b string, a string")
    got = [r[0] for r in df.select(ids.content_hash_col(b=F.col("b"), a=F.col("a"))).collect()]
    assert got == [ids.content_hash({"a": a, "b": b}) for b, a in rows]
    assert [r[0] for r in df.select(ids.text_hash_col(F.col("b"))).collect()] == [ids.text_hash(b) for b, _ in rows]


def test_nothing_but_finite_numbers_has_a_canonical_form():
    with pytest.raises(ValueError):
        ids.canonical(float("nan"))
    with pytest.raises(TypeError):
        ids.canonical(object())


def test_references_and_slugs(spark):
    assert ids.split_ref("a@b@2") == ("a@b", "2")
    with pytest.raises(ValueError):
        ids.split_ref("nothing")
    df = spark.createDataFrame([("a@b@2", "Über-Großes  Ding!")], "ref string, t string")
    row = df.select(ids.ref_name_col(F.col("ref")), ids.ref_version_col(F.col("ref")), ids.slug_col(F.col("t"))).first()
    assert tuple(row) == ("a@b", "2", ids.slug("Über-Großes  Ding!"))


@given(st.lists(st.tuples(st.sampled_from(["groups[]", "groups[].tests[]"]), st.text(min_size=1, max_size=6)), max_size=3))
@settings(max_examples=50, deadline=None)
def test_entity_keys_come_apart_again(parts):
    assert ids.parse_entity_key(ids.entity_key(*parts)) == parts


def test_scope(spark):
    rows = [("", "", True), ("a[]=1", "a[]", True), ("a[]=1/a[].b[]=2", "a[].b[]", True), ("a[]=1", "", False), ("a[]=1/a[].b[]=2", "a[]", False)]
    df = spark.createDataFrame(rows, "e string, s string, w boolean")
    assert df.where(ids.in_scope_col(F.col("e"), F.col("s")) != F.col("w")).count() == 0


def brute(t, n):
    return [i for i in range(len(t) - len(n) + 1) if t[i : i + len(n)] == n] if n else []


def test_occurrences_against_brute_force(spark):
    rows = [("aaaa", "aa"), ("abcabc", "abc"), ("x", "xx"), ("", "a"), ("abc", ""), ("😀a😀a😀", "😀a😀"), ("a.b.c", "."), ("a\\Eb\\Eb", "\\Eb"), ("tail aa", "aa"), ("日本日本日", "日本日")]
    df = spark.createDataFrame(rows, "t string, n string")
    got = df.select("t", "n", text.occurrences(F.col("t"), F.col("n")).alias("o"), text.count_occurrences(F.col("t"), F.col("n")).alias("c"), text.find_unique(F.col("t"), F.col("n")).alias("u")).collect()
    for r in got:
        want = brute(r["t"], r["n"])
        assert (r["o"], r["c"], r["u"]) == (want, len(want), want[0] if len(want) == 1 else None), r


def test_sentences_tokens_slices(spark):
    t = "One. Two!  Three? four"
    df = spark.createDataFrame([(t,)], "t string")
    row = df.select(text.sentences(F.col("t")), text.tokens(F.col("t")), text.slice_expanded(F.col("t"), F.lit(5), F.lit(8), 2), text.clip(F.lit("x" * 130)), text.tokens_for_budget(F.lit(9)), text.tokens_for_context(F.lit(9))).first()
    assert row[0] == ["One.", "Two!", "Three?", "four"]
    assert row[1] == re.findall("[a-z0-9]+", t.lower())
    assert row[2] == t[3:10] and len(row[3]) == 120
    assert (row[4], row[5]) == (text.estimate(9), 3)


def test_backoff_grows_to_its_limit():
    assert [text.backoff_s(a, 0.5, 2, 3) for a in (1, 2, 3, 4, 5)] == [0.5, 1, 2, 3, 3]


def test_gold_match_takes_any_acceptable_value(spark):
    rows = [("present", "1", "present", "1", [], True), ("present", "1", "present", "2", ["2"], True), ("present", "1", "present", "3", ["2"], False), ("not_reported", None, "not_reported", None, [], True), ("present", "1", "unknown", None, [], False)]
    df = spark.createDataFrame(rows, "gs string, gv string, s string, v string, also array<string>, w boolean")
    assert df.where(~gold_matches(F.col("gs"), F.col("gv"), F.col("s"), F.col("v"), F.col("also")).eqNullSafe(F.col("w"))).count() == 0


def test_functions_are_what_their_source_is():
    def one(ctx):
        return 1

    def other(ctx):
        return 2

    registry.register("transform", "t-test", "1", one)
    registry.register("transform", "t-test", "1", one)
    with pytest.raises(EngineError):
        registry.register("transform", "t-test", "1", other)
    assert registry.find("transform", "t-test").call is one
    registry.register("transform", "t-test", "2", other)
    with pytest.raises(EngineError):
        registry.find("transform", "t-test")

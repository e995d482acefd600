"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import pytest
from strataweave.llm import decontaminate, fingerprint, html_text, linededup, packing, quality, secrets, simhash, toxicity, urls

LONG = " ".join(f"word{i % 977}x" for i in range(30_000))
ODD = [
    (1, "alpha beta gamma delta epsilon zeta"),
    (1, "alpha beta gamma delta epsilon zeta"),
    (2, None),
    (3, ""),
    (None, "alpha beta gamma delta epsilon zeta"),
    (4, " \n\t "),
    (5, LONG),
    (6, "one"),
    (7, "ÀÉ ßtraße 日本語 \U0001f600 <|endoftext|>"),
]
#: Names that the operators use for themselves.
EXTRA = "id, row, fp, key, rest, node, length, task, nth, rank, score, label, line, no, k1, a, b, gone, part, path, host".split(", ")


def docs_of(spark, rows=ODD):
    df = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in EXTRA:
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def labels_of(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def items_of(spark, rows=((10, "beta gamma delta epsilon zeta"), (11, None), (12, ""), (13, "one"), (14, LONG), (15, "日本語"), (None, "alpha"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def pages_of(spark, rows=((1, "http://a.com/x", "<p>hi"), (1, "http://a.com/x", "<p>hi"), (2, None, None), (None, "nohost", ""), (3, "http://", "<div>" * 2000 + "deep"))):
    df = spark.createDataFrame(list(rows), "page_id long, url string, html string")
    for name in EXTRA:
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def _toxic(spark, docs, labels):
    return toxicity.score(docs, toxicity.fit(docs, labels))


def _quality(spark, docs, labels):
    return quality.score(docs, quality.fit(docs, labels))


RUNS = {
    "decontaminate": lambda s, d: decontaminate.contained_items(d, items_of(s)),
    "decontaminate_filter": lambda s, d: decontaminate.decontaminate(d, items_of(s)),
    "packing": lambda s, d: packing.pack(d),
    "simhash": lambda s, d: simhash.simhash_components(d),
    "near_dedup": lambda s, d: simhash.near_dedup(d),
    "lines": lambda s, d: linededup.dedup_lines(d),
    "secrets": lambda s, d: secrets.find_secrets(d),
    "fingerprint": lambda s, d: fingerprint.fingerprint(d),
    "edited": lambda s, d: fingerprint.edited_likeness(d),
    "toxicity": lambda s, d: _toxic(s, d, labels_of(s, [(1, None, 1), (5, 0, None), (6, 1, 0), (None, 1, 1)])),
    "toxicity_unlabelled": lambda s, d: _toxic(s, d, labels_of(s)),
    "quality": lambda s, d: _quality(s, d, labels_of(s, [(1, 1, 1), (5, 0, None), (6, 1, 0), (None, 1, 1), (3, None, None)])),
    "quality_unlabelled": lambda s, d: _quality(s, d, labels_of(s)),
    "keep_good": lambda s, d: quality.keep_good(d, quality.fit(d, labels_of(s, [(1, 1, 1), (5, 0, None), (6, 1, 0)])), least=0.0),
    "drop_toxic": lambda s, d: toxicity.drop_toxic(d, toxicity.fit(d, labels_of(s, [(1, None, 1), (5, 0, None), (6, 1, 0)])), least=1.1),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows_and_clashing_names(spark, name):
    rows = RUNS[name](spark, docs_of(spark)).collect()
    if name in ("simhash", "lines", "secrets", "fingerprint", "edited", "toxicity", "quality", "toxicity_unlabelled", "quality_unlabelled", "keep_good", "drop_toxic"):
        assert len(rows) == len(ODD)
        assert sorted(r[0] for r in rows if r[0] is not None) == sorted(i for i, _ in ODD if i is not None)


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, name):
    assert RUNS[name](spark, docs_of(spark, [])).collect() == []


def test_html_and_urls(spark):
    for run in (html_text.extract, lambda p: urls.judge(p, urls.rule_table(spark))):
        assert len(run(pages_of(spark)).collect()) == 5
        assert run(pages_of(spark, [])).collect() == []


def test_simhash_defined_results(spark):
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.simhash_components(docs_of(spark)).collect()}
    by_id = {k[0]: (k[1], v) for k, v in got.items()}
    assert by_id[2][0] == by_id[3][0] == by_id[4][0] == 0 and by_id[3][1] == by_id[4][1] == 2
    assert by_id[None] == by_id[1] and by_id[1][1] == 1


def test_packing_counts_every_token(spark):
    rows = packing.pack(docs_of(spark)).collect()
    encode = packing.encoder(packing.default_tokenizer_path())
    assert sum(r["length"] for r in rows) == sum(len(encode(t or "")) + 1 for _, t in ODD)
    pieces = [r for r in rows if r["doc_id"] == 5]
    assert len(pieces) > 10 and all(r["length"] == 2048 for r in pieces if r["piece"])


def test_fingerprint_of_empty_texts(spark):
    rows = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprint(docs_of(spark)).collect()}
    assert rows[2] == rows[3] == rows[4] and set(rows[2]) == {"0"} and rows[6] != rows[2] and rows[1] == rows[None]


def test_no_labels_no_decision(spark):
    assert {r["score"] for r in RUNS["toxicity_unlabelled"](spark, docs_of(spark)).collect()} == {0.0}
    assert {r["score"] for r in RUNS["quality_unlabelled"](spark, docs_of(spark)).collect()} == {0.5}

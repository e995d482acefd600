"""The pipeline's stages, one after the other, against brute force over the same rows."""

import math
import re
import zlib
from collections import defaultdict

import corpus_pipeline as pipeline
import pyarrow as pa
import xxhash
from strataweave.llm import common, decontaminate, linededup, packing, quality
from test_methods import _lines_brute


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def _texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_against_brute_force(spark, data):
    docs = common.table(spark, data, "documents")
    labels = common.table(spark, data, "labels").select("doc_id", "quality")
    held, columns = _texts(docs), docs.columns

    # quality: the rows whose score, taken one by one, is high enough
    model = quality.fit(docs, labels)
    kept = pipeline.quality_stage(spark, docs, data)
    want = {d: t for d, t in held.items() if model.score(pa.array([t]))[0] >= 0.7}
    assert kept.columns == columns and _texts(kept) == want and 0 < len(want) < len(held)

    # lines: equal to all pairs of lines
    kept = common.cut(kept)
    lines = common.cut(pipeline.line_stage(spark, kept, data))
    want = {d: t for d, t, *_ in _lines_brute(spark, sorted(want.items()))}
    assert lines.columns == columns and _texts(lines) == want
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    # SimHash: the least id of each group that all pairs of fingerprints give
    fp = {d: _fingerprint(t) for d, t in want.items()}
    least = {d: d for d in fp}
    changed = True
    while changed:
        changed = False
        for a in fp:
            for b in fp:
                if least[a] < least[b] and (fp[a] ^ fp[b]).bit_count() <= 3:
                    least[b], changed = least[a], True
    single = common.cut(pipeline.simhash_stage(spark, lines, data))
    want = {d: t for d, t in want.items() if least[d] == d}
    assert single.columns == columns and _texts(single) == want

    # decontamination: no document holds 0.8 of an item's shingles
    items = [decontaminate.item_shingles(r.text, 5) for r in common.table(spark, data, "benchmark").collect()]

    def clean(text):
        words = common.normal_words(text)
        shingles = {k: {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} for k in {len(x[0]) for x in items if x}}
        return not any(x and sum(s in shingles[len(x[0])] for s in x) >= math.ceil(0.8 * len(x) - 1e-9) for x in items)

    left = common.cut(pipeline.decontamination_stage(spark, single, data))
    want = {d: t for d, t in want.items() if clean(t)}
    assert left.columns == columns and _texts(left) == want

    # packing: every token of every document once, nothing over the length
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.default_tokenizer_path())
    ids = {d: [*own.encode(t, add_special_tokens=False).ids, 0] for d, t in want.items()}
    got, sequences = defaultdict(list), defaultdict(list)
    for r in sorted(pipeline.packing_stage(spark, left, data).collect(), key=lambda r: (r.doc_id, r.piece)):
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
        got[r.doc_id] += part
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == ids
    for places in sequences.values():
        assert [o for o, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048


def test_line_stage_on_near_copies(spark, data, monkeypatch):
    made, meet = [], linededup._meet

    def counted(keyed):
        pairs, larger = meet(keyed)
        made.append((keyed.count(), pairs.count()))
        return pairs, larger

    monkeypatch.setattr(linededup, "_meet", counted)
    page = ["all copies of this page open with one line", "seen {} times by {} of our many readers", "the last of its lines was changed {} and {}"]
    texts = [(i, "\n".join(x.format(i % 5, i // 5) for x in page)) for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    assert _texts(pipeline.line_stage(spark, docs, data)) == {d: t for d, t, *_ in _lines_brute(spark, texts)}
    assert all(pairs <= n for n, pairs in made), made  # of 30 near copies of a line, all pairs would be 435


def test_run_is_its_stages(spark, data):
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    docs = common.table(spark, data, "documents")
    for _, stage in pipeline.STAGES[:-1]:
        docs = common.cut(stage(spark, docs, data))
    pieces = lambda df: sorted(tuple(r[:5]) for r in df.collect())
    assert pieces(pipeline.run(spark, data)) == pieces(pipeline.packing_stage(spark, docs, data))


def test_empty_table_passes_through(spark, data):
    docs = common.table(spark, data, "documents").where("false")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.count() == 0
    assert pipeline.packing_stage(spark, docs, data).count() == 0


def test_stages_on_odd_rows(spark, data):
    from test_cases import ODD

    rows = [(i, t, None if i == 6 else "en", "s", None) for i, t in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {name: stage(spark, docs, data) for name, stage in pipeline.STAGES}
    for name in list(kept)[:-1]:
        assert kept[name].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda name: sorted((r.doc_id for r in kept[name].collect()), key=str)
    every = sorted((i for i, _ in ODD), key=str)
    assert ids("line_dedup") == every and ids("benchmark_decontamination") == every
    assert ids("simhash_near_dedup") == sorted([1, 1, 2, 5, 6, 7, None], key=str)  # the repeated row is one document; 2, 3 and 4 have no words; the null id stays
    assert set(ids("quality_classifier")) <= set(every)
    lines = {(r.doc_id, r.text) for r in kept["line_dedup"].collect()}
    assert (1, ODD[0][1]) in lines and (2, None) in lines and (4, " \n\t ") in lines
    pieces = kept["best_fit_packing"].collect()
    assert {r.doc_id for r in pieces} == {i for i, _ in ODD} and all(r.offset + r.length <= 2048 for r in pieces)

"""Each operator against a brute-force form, an exact round trip or held-out accuracy."""

import hashlib
import html
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from strataweave.llm import common, components, decontaminate, fingerprint, html_text, linededup, packing, quality, secrets, simhash, toxicity, urls

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark, data):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


def test_word_hashes_agree_with_words():
    texts = ["Ab c, -- dé F", None, "a b", "— …", "", "ab zz c", "x y_z 日本 語"]
    words, offsets = common.word_hashes(pa.array(texts))
    seen = {}
    for k, t in enumerate(texts):
        own = common.normal_words(t)
        assert offsets[k + 1] - offsets[k] == len(own)
        for w, h in zip(own, words[offsets[k] : offsets[k + 1]], strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    sliced, _ = common.word_hashes(pa.array(texts).slice(5))
    assert (sliced == words[offsets[5] :]).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5100)] + [(7, 7), (9000, 9000)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = components.connected_components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()
    assert len(got) == len({r.node for r in got}) == len(root)
    assert {r.node: r.root for r in got} == {x: find(x) for x in root}


def test_containment_against_sets(spark, data, docs):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    items |= {900: "the of", 901: "the"}
    want = set()
    for i, t in items.items():
        own = set(decontaminate.item_shingles(t, 5))
        for d, text in docs.items():
            w = common.normal_words(text)
            k = len(next(iter(own)))
            held = own & {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
            if len(held) >= 0.8 * len(own):
                want.add((d, i, len(own), len(held)))
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    source = spark.read.parquet(f"{data}/documents.parquet")
    for block in (decontaminate.INDEX_SHINGLES, 500):
        got = decontaminate.contained_items(source, table, index_shingles=block).collect()
        assert {tuple(r)[:4] for r in got} == want and len(got) == len(want)
    left = {r.doc_id for r in decontaminate.decontaminate(source, table).collect()}
    assert left == set(docs) - {x[0] for x in want}


def test_plan_is_whole_and_dominance_loses_nothing():
    rng = random.Random(1)

    def exact(items, cap):
        best = len(items)

        def go(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(items):
                best = len(bins)
                return
            for b in {*bins}:
                if b + items[k] <= cap:
                    j = bins.index(b)
                    go(k + 1, [*bins[:j], b + items[k], *bins[j + 1 :]])
            go(k + 1, [*bins, items[k]])

        go(0, [])
        return best

    for _ in range(150):
        cap, n = rng.choice([10, 20, 37]), rng.randint(1, 9)
        items = sorted((rng.randint(1, cap) for _ in range(n)), reverse=True)
        fixed, left = packing.reduce_by_dominance(Counter(items), cap)
        assert sum(m for _, m in fixed) + exact(sorted(Counter(left).elements(), reverse=True), cap) == exact(items, cap)
        patterns, got = packing.plan(Counter(items), cap), Counter()
        for sizes, m in patterns:
            assert sum(sizes) <= cap
            for s in sizes:
                got[s] += m
        assert got == Counter(items)


def test_packing_round_trip(spark, data, docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.default_tokenizer_path())
    ids = {d: np.array([*own.encode(t, add_special_tokens=False).ids, 0], "<u4") for d, t in docs.items()}
    rows = packing.pack(spark.read.parquet(f"{data}/documents.parquet")).collect()
    sequences, ends = defaultdict(list), Counter()
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == ends[r.doc_id] and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        ends[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert ends == {d: len(x) for d, x in ids.items()}
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= math.ceil(sum(ends.values()) / 2048) * 1.02 + 1


def test_main_text_of_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.extract(pages).collect():
        inside = raw[r.page_id][raw[r.page_id].index("<article>") + 9 : raw[r.page_id].index("</article>")]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]+>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inside)).split())


def test_furniture_goes():
    page = """<html><head><title>x</title></head><body class="has-sidebar"><header><h1>Site</h1></header><div class="cookie-notice">We use</div><main><article><h1>T &amp; U</h1>
    <p>One <b>two</b>three<br>four<p>five<div class="ad">buy</div><div>Share this</div><aside>rel</aside><form>f<input></form><section class="comments"><article>c</article></section>
    <ul><li>x<li>y</ul></article></main><footer>f</footer><script>var a = "<p>no</p>"</script></body>"""
    assert [t for t, _, kept in html_text.blocks(page)[0] if kept] == ["T & U", "One twothree four", "five", "Share this", "x", "y"]
    assert html_text.blocks("<div>a</div><!-- <p>b</p> --><p>c &lt; d")[0] == [("a", True, True), ("c < d", True, True)]
    assert html_text.blocks("<nav>m</nav><article>l<p>a</article>b")[0] == [("m", True, False), ("l", True, True), ("a", False, True), ("b", True, False)]


def test_text_after_the_last_tag_stays():
    texts = lambda page: [t for t, _, kept in html_text.blocks(page)[0] if kept]
    assert texts("a < b and more") == ["a < b and more"] and texts("<p>x < 5 and y <3 or so") == ["x < 5 and y <3 or so"]
    assert texts("<p>one<a href='x") == ["one"] and texts("<p>one</p") == ["one"] and texts("a < b <!-- c") == ["a < b"]


def test_dropped_elements_end_where_their_end_tag_is_left_out():
    texts = lambda page: [t for t, _, kept in html_text.blocks(page)[0] if kept]
    assert texts('<table><tr><td class="menu">m<table><tr><td>n<td>o</table><td>article<tr class="ad"><td>x<tr><td>y</table><p>z') == ["article", "y", "z"]
    assert texts('<ul><li class="share">s<ul><li>t</ul><li>u</ul><p>article') == ["u", "article"] and texts('<ul><li class="share">s</ul><p>article') == ["article"]
    assert texts('<dl><dt>a<dd class="ad">b<dt>c</dl>') == ["a", "c"] and texts('<div><ul><li class="share">s</div>article') == ["article"]
    assert texts('<div><p class="ad">b<p>c</div>') == ["c"] and texts('<ul><li class="share">s</li>t<li>u</ul>') == ["t", "u"]


def test_odd_tags():
    texts = lambda page: [t for t, _, kept in html_text.blocks(page)[0] if kept]
    assert texts("<p>x</p>tail 3 < 5 more") == ["x", "tail 3 < 5 more"] and texts("<p title=it's>Hello</p> it's") == ["Hello", "it's"]
    assert texts("a <button> b<p>c") == ["a b", "c"] and texts("a<object>b") == ["a b"] and texts("<p title='a>b' x=\"c>d\" y=>t</p>") == ["t"]
    assert texts("a<!b>c</>d<?e>f") == ["acdf"] and texts("a<textarea>b</textarea >c") == ["a c"] and texts("<script>x") == []


@pytest.mark.parametrize("page", ["<a ", "<svg>", "<!-- ", "</ ", '<a b="', "<a =' ", "<button>", "<p", "&", "<div>"])
def test_long_pages_take_time_in_proportion(page):
    began = time.perf_counter()
    html_text.blocks(page * (1_000_000 // len(page)))
    assert time.perf_counter() - began < 5
    rows = [k % 3 for k in range(4000)]
    assert len(html_text.common_lines([1] * 4000, [1] * 4001)) == 4000 and len(html_text.common_lines(rows, rows[1:] + [7])) == 3999
    assert time.perf_counter() - began < 6


def test_halved_alignment(monkeypatch):
    monkeypatch.setattr(html_text, "LCS_BITS", 8)
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(15))] for _ in range(2))
        found = [a[k] for k in html_text.common_lines(a, b)]
        rest = iter(b)
        assert all(x in rest for x in found) and len(found) == int(html_text._lengths(a, b)[-1])


def _pages_brute(rows):
    """The texts of pages without a declared article and with one line a paragraph: lines shared with the nearest page of other lines go."""
    lines = {i: re.findall("<p>(.*?)</p>", page) for i, _, page in rows}
    split = {i: re.match("http://([^/]*)(.*)", url).groups() for i, url, _ in rows}
    paths = {}
    for i, (host, path) in split.items():
        key = (host, tuple(lines[i]))
        paths[key] = min(path, paths.get(key, path))
    out = {}
    for i, (host, _) in split.items():
        own = (host, tuple(lines[i]))
        order = sorted((path, k[1]) for k, path in paths.items() if k[0] == host)
        at = order.index((paths[own], own[1]))
        sides = [order[k] for k in (at - 1, at + 1) if 0 <= k < len(order)]
        alike = lambda p: len(os.path.commonprefix([p[0], paths[own]]))
        gone = html_text.common_lines(lines[i], list(max(sides, key=alike)[1])) if sides else []
        out[i] = " ".join(x for k, x in enumerate(lines[i]) if k not in gone)
    return out


def test_pages_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        host = rng.choice(["a.org", "a.org", "b.net", f"h{i}.com"])
        page = "".join(f"<p>{rng.choice(['Home', 'News', 'About us'])}</p>" for _ in range(rng.randrange(3))) + "".join(f"<p>text {rng.randrange(40)}</p>" for _ in range(rng.randrange(5)))
        rows.append((i, f"http://{host}/{rng.choice('xyz')}/{i}", page))
        if rng.random() < 0.3:
            rows.append((1000 + i, f"http://{host}/{rng.choice('xyz')}/{i}c", page))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(frame.repartition(5)).collect()} == _pages_brute(rows)
    totals = html_text.deletions(frame).first()
    assert totals.n_shared == totals.n_deleted == totals.n_only > 50


def test_differencing_of_neighbours(spark):
    page = "<body><div>Menu line</div><div>Welcome</div><p>Story {0} one</p><p>Story {0} two</p><div>Bottom</div></body>"
    rows = [(i, f"http://h.com/a/{i:03}", page.format(i)) for i in range(40)] + [(100 + i, "http://copy.com/x", page.format(7)) for i in range(3)] + [(200, "http://alone.com/", page.format(8))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} one Story {i} two" for i in range(40))
    assert got[100] == got[102] == "Menu line Welcome Story 7 one Story 7 two Bottom" and got[200].startswith("Menu line")
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(html_text.common_lines(a, b)) == best[-1][-1]


def test_simhash_against_all_pairs(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(0, 300))] for _ in range(40)]
    texts = [" ".join(rng.choice(words) if rng.random() < 0.01 else w for w in rng.choice(base)) + rng.choice(["", "  ", "\n"]) for _ in range(400)]
    want = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        want.append(sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h)))
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                if (want[i] ^ want[j]).bit_count() <= 3 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.simhash_components(df).collect()}
    assert got == {i: (want[i], label[i]) for i in range(len(texts))}
    kept = {r.doc_id for r in simhash.near_dedup(df).collect()}
    assert kept == set(label)


def test_links_in_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 16)
    rng = np.random.default_rng(2)
    center = int(rng.integers(0, 2**63))
    fps = {center} | {center ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (300, 2)) if a != b} | {int(x) for x in rng.integers(0, 2**63, 500)}
    links = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
    assert all((r.a ^ r.b).bit_count() <= 6 for r in links)
    root = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links)).collect()}
    near = {x for x in fps if (x ^ center).bit_count() <= 3}
    assert len({root[x] for x in near}) == 1 and set(root) == near
    sizes = simhash.groups(spark.createDataFrame([(x,) for x in fps], "fp long")).groupBy("grp").count().agg({"count": "max"}).first()[0]
    assert sizes <= 16


def test_near_dedup_of_repeated_ids(spark):
    same, other = "one two three four five six seven", "a text of its own that nothing else is like at all"
    rows = [(0, same), (1, same), (1, other), (2, same + " "), (None, same)]
    kept = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(0, same), (1, other), (None, same)], key=str)


def test_stars_with_many_neighbours(spark):
    edges = [(0, k) for k in range(1, 3000)] + [(5000 + k, 2 * k) for k in range(1500)] + [(9000, 9001)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(3000)}, **{5000 + k: 0 for k in range(1500)}, 9000: 9000, 9001: 9000}


def test_ownership_against_brute_force(spark):
    rng = random.Random(12)
    values = ["".join(rng.sample("abcdefghijkLMNOPQRSTUVWXYZ0123456789", 24)) + f"aZ{k}" for k in range(40)]
    rows = [(k, " and ".join(rng.choice(values[: rng.choice([3, 40])]) for _ in range(rng.randrange(4))), rng.choice(["a", "b", "c", "d", None]), rng.choice(["x", "y", None])) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    owners, repos = defaultdict(set), defaultdict(set)
    spans = {k: [m for m in re.finditer(r"\S+", t) if len(m[0]) > 20] for k, t, _, _ in rows}
    for k, _, owner, repo in rows:
        for m in spans[k]:
            owners[m[0]].add(owner)
            repos[m[0]].add((owner, repo))
    verdict = lambda v: "live" if len(owners[v]) == len(repos[v]) == 1 else "example" if len(owners[v]) > 2 else "shared"
    for r in secrets.find_secrets(df).collect():
        want = [(m.start(), m.end(), len(owners[m[0]]), len(repos[m[0]]), verdict(m[0])) for m in spans[r.doc_id] if verdict(m[0]) != "example"]
        assert [(x.start, x.end, x.n_owners, x.n_repos, x.verdict) for x in r.spans or []] == want


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Far:
        conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: default)})
        sparkContext = type("Context", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch_dir(Far)


def _within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _near_lines(x, y):
    """One word apart where one has five words or more; one character apart, of five or more, where both have fewer."""
    a, b = x.split(" "), y.split(" ")
    if max(len(a), len(b)) < 5:
        a, b = x, y
    return max(len(a), len(b)) >= 5 and abs(len(a) - len(b)) <= 1 and _within_one(a, b)


def _lines_brute(spark, rows):
    from pyspark.sql import functions as F

    last = 2**63 - 1
    first = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if x.strip(" \t\r\f\x0b"):
                first[x] = min(first.get(x, last), last if d is None else d)
    order = {r.line: (first[r.line], r.h) for r in spark.createDataFrame([(x,) for x in first] or [("a",)], "line string").withColumn("h", F.xxhash64("line")).collect() if r.line in first}
    near = {}
    for x in first:
        near_by = [first[y] for y in first if y != x and order[y] < order[x] and _near_lines(x, y)]
        if near_by:
            near[x] = min(near_by)
    out = []
    for d, t in rows:
        seen, keep, exact, close, of = set(), [], 0, 0, set()
        for x in [] if t is None else t.split("\n"):
            if x not in first:
                keep.append(x)
                continue
            again = (last if d is None else d) > first[x] or x in seen
            if x in near:
                close += 1
                of.add(near[x])
            if again:
                exact += 1
                of.add(first[x])
            if x not in near and not again:
                keep.append(x)
            seen.add(x)
        out.append((-1 if d is None else d, None if t is None else "\n".join(keep), exact, close, sorted(of)))
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [32, 4])
def test_lines_against_all_pairs(spark, monkeypatch, group):
    monkeypatch.setattr(linededup, "GROUP", group)
    rng = random.Random(4)
    words = "alpha beta gamma delta epsi zeta".split()
    base = [" ".join(rng.choice(words[: rng.choice([2, 6])]) for _ in range(rng.randint(1, 9))) for _ in range(60)]

    def changed(x):
        i, k = rng.randrange(len(x)), rng.random()
        return x if k < 0.5 else x[:i] + rng.choice("abé ") + x[i + (k < 0.7) :] if k < 0.85 else x[:i] + x[i + 1 :]

    rows = [(rng.choice([i, i, i, None]), "\n".join(changed(rng.choice(base)) for _ in range(rng.randint(0, 9)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "a\nb\nab\n \n\n"), (502, "a\nb\nab\n \n\n")]
    rows += [(510 + i, f"a line of {i} that comes with every number\nshort {i}\n {i} a  b c\n{'-' * i}") for i in range(60)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((-1 if r.doc_id is None else r.doc_id, r.text, r.n_exact, r.n_near, r.dup_of) for r in got), key=str) == _lines_brute(spark, rows)


def test_lines_of_a_group_make_no_more_pairs_than_rows(spark, monkeypatch):
    made, meet = [], linededup._meet

    def counted(keyed):
        pairs, larger = meet(keyed)
        made.append((keyed.count(), pairs.count()))
        return pairs, larger

    monkeypatch.setattr(linededup, "_meet", counted)
    # 40 lines share their first half with each other; beside it some differ in one word, some in more
    start = "every one of these lines starts"
    rows = [(i, f"{start} a {i % 7} b {i // 7} c d") for i in range(40)] + [(100 + i, f"{start} a 1 b 2 c {i}") for i in range(5)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text, r.n_exact, r.n_near, r.dup_of) for r in got), key=str) == _lines_brute(spark, rows)
    assert len(made) > 1 and all(pairs <= n for n, pairs in made), made


def test_banded_distance_against_the_whole_matrix(spark):
    from pyspark.sql import functions as F

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(7)
    rows = []
    for _ in range(800):
        a = [rng.choice("abé\U0001f600") for _ in range(rng.randint(4, 14))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "b", "é"])
        rows.append((a, b))
    df = spark.createDataFrame([*rows, (["a"], ["b"]), (list("abcdef"), ["b"]), (None, list("abcd"))], "a array<string>, b array<string>")
    for most in (1, 2, 3):
        for r in df.select("a", "b", linededup.banded_distance(F.col("a"), F.col("b"), most).alias("d")).collect():
            if r.a is None or min(len(r.a), len(r.b)) <= most:
                assert r.d is None
            else:
                want = distance(r.a, r.b)
                assert r.d == (want if want <= most else -1), (r, most)


def test_lines_without_python(spark, data):
    plan = linededup.query(spark, data)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_secret_spans(spark, docs, data):
    rows = secrets.query(spark, data).collect()
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in rows:
        t = docs[r.doc_id]
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))
        assert hashlib.sha256(text.encode()).hexdigest() == r.base_sha256
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("owned")) == text


def test_ownership_tells_examples_from_live(spark):
    live, example = "aB3dE5gH7jK9mN1pQ3sT5vX7", "zY9xW7vU5tS3rQ1pN9mL7kJ5"
    rows = [(k, f"see {example} here", f"owner{k % 5}", f"repo{k}") for k in range(10)] + [(50, f"use {live} now password=abcdefghijklmnop", "me", "mine"), (51, "ſecret=abcdefghijklmnop token:pass secret=", "me", "mine")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r for r in secrets.find_secrets(df).collect()}
    assert [(x.kind, x.verdict) for x in got[50].spans] == [(3, "live"), (0, "live")]
    assert all(got[k].spans is None for k in range(10)) and got[51].spans is None


def test_shared_values_stay(spark):
    twice, languages, example = "aB3dE5gH7jK9mN1pQ3sT5vX7", "qW2eR4tY6uI8oP1aS3dF5gH7", "zY9xW7vU5tS3rQ1pN9mL7kJ5"
    rows = [(1, f"use {twice} now", "a", "en"), (2, f"use {twice} now", "b", "en"), (3, f"or {languages}", "a", "en"), (4, f"or {languages}", "a", "de")] + [(10 + k, f"see {example}", f"o{k}", "en") for k in range(3)]
    got = {r.doc_id: [x.verdict for x in r.spans or []] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()}
    assert all(got[k] == ["shared"] for k in (1, 2, 3, 4)) and all(got[10 + k] == [] for k in range(3))


def test_likeness_is_close_and_unbiased(spark, docs, data):
    rows = {r.doc_id: r for r in fingerprint.query(spark, data).collect()}
    order = sorted(docs)
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [common.normal_words(t)] for i in range(max(1, len(w) - 4)) if w}
    errors = []
    for d, n in zip(order, order[1:] + order[:1], strict=True):
        t, u, r = docs[d], docs[n], rows[d]
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for x, y, got in ((t, edited, r.near_edited), (t, u, r.near_next)):
            a, b = shingles(x), shingles(y)
            errors.append(got - (len(a & b) / len(a | b) if a | b else 1.0))
    assert np.sqrt(np.mean(np.square(errors))) < 0.04 and abs(np.mean(errors)) < 0.01
    same = {}
    for d in order:
        assert same.setdefault(docs[d], rows[d].fingerprint) == rows[d].fingerprint


def _auc(score, label):
    import pandas as pd

    rank = pd.Series(score).rank().to_numpy()
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


@pytest.mark.parametrize(("module", "label", "least"), [(toxicity, "toxic", 0.9), (quality, "quality", 0.97)])
def test_held_out_accuracy(spark, module, label, least):
    got = module.query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert _auc(got.score.to_numpy(), got[label].to_numpy()) >= least
    folds, rest = (5, 0) if label == "toxic" else (4, 2)
    assert all(zlib.crc32(str(d).encode()) % folds == rest for d in got.doc_id)


def test_non_negative_correction_keeps_the_risk_up():
    rng = np.random.default_rng(1)

    def rows(n, share):
        each = [np.unique(np.concatenate([rng.integers(10, 400, 20), rng.integers(0, 10, 3) if rng.random() < share else []]).astype(np.int64)) for _ in range(n)]
        return toxicity.Rows(np.concatenate(each), np.ones(sum(map(len, each)), np.float32), np.concatenate([[0], np.cumsum([len(x) for x in each])]))

    w, b = toxicity.nnpu(rows(150, 1.0), rows(1500, 0.2), 400, 0.2)
    assert w[:10].mean() > 0.3 and np.abs(w[10:]).mean() < 0.1 and b < 0


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    model = quality.Model(np.zeros(len(quality.STATS)), np.ones(len(quality.STATS)))
    model.w, model.v, model.bias = rng.normal(size=len(model.w)).astype(np.float32), rng.normal(size=model.v.shape).astype(np.float32), 0.3
    f, x = rng.choice(5000, 30, replace=False), rng.normal(size=30).astype(np.float32)
    got = model.raw(quality.Rows(f, x, np.array([0, 30])))[0][0]
    pairs = sum(float(model.v[f[i]] @ model.v[f[j]]) * x[i] * x[j] for i in range(30) for j in range(i))
    assert got == pytest.approx(0.3 + float(model.w[f] @ x) + pairs, rel=1e-3)


def test_url_equivalence(spark):
    link = '<html><head><link rel="canonical" href="{}"></head>'.format
    rows = [
        (1, "http://a.org/x", link("http://b.example.com/en/1")), (2, "http://b.example.com/en/1", ""), (3, "https://A.org/x/#f", ""), (6, "http://c.org/r", '<meta http-equiv="refresh" content="0; url=/x2">'),
        (7, "http://c.org/x2", link("http://www.example.com/en/9")), (8, "http://q.net/es/1", link("http://c.org/x2")), (9, "http://example.com", ""), (10, "http://sub.www.example.com/en/", ""), (11, "http://d.org/1", link("http://x.net/fr/")),
    ]
    frame = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(frame, urls.rule_table(spark)).collect()}
    assert got[3] == (None, "allow")  # another scheme and path, and no link
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(frame, urls.rule_table(spark), forms=True).collect()}
    assert got == {1: (None, "block"), 2: ("example.com/en/", "block"), 3: (None, "block"), 6: (None, "allow"), 7: (None, "allow"), 8: ("net/es/", "block"), 9: (None, "allow"), 10: ("www.example.com/en/", "allow"), 11: (None, "block")}
    redirects = spark.createDataFrame([("http://d.org/1", "http://e.org/2"), ("http://e.org/2", "http://f.com/ok")], "from_url string, to_url string")
    more = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id int, url string, html string"), urls.rule_table(spark), redirects).collect()}
    assert more[11] == "allow"  # f.com is explicitly allowed


def test_links_of_every_spelling(spark):
    page, blocked = "http://h.org/a/b/page.html?x=1", "http://q.net/es/1"
    spellings = {
        '<meta http-equiv="Refresh" content="0; URL=http://q.net/es/1">': blocked, '<LINK REL="Canonical" HREF="http://q.net/es/1">': blocked,
        '<link rel=canonical href="http://h/p?a=1&amp;b=2">': "http://h/p?a=1&b=2", '<link rel=canonical href="http://h/&#x65;&#101;&eacute;?a&copy=1&lt">': "http://h/eeé?a&copy=1<",
        '<link rel=canonical href="next.html">': "http://h.org/a/b/next.html", '<link rel=canonical href="?id=2">': "http://h.org/a/b/page.html?id=2", '<link rel=canonical href="../x">': "http://h.org/a/x",
        '<link rel=canonical href="./../../../y/./z?u=http://b/c">': "http://h.org/y/z?u=http://b/c", '<link rel=canonical href="/r/../s">': "http://h.org/s", '<link rel=canonical href="//g.org/z">': "http://g.org/z",
        '<link rel=canonical href="#top">': "http://h.org/a/b/page.html?x=1", '<base href="/n/"><link rel=canonical href="m">': "http://h.org/n/m", '<link rel=canonical href="mailto:a@b.c">': None,
    }
    rows = [(k, page, html) for k, html in enumerate(spellings)]
    found = urls.page_links(spark.createDataFrame(rows, "page_id int, url string, html string").coalesce(1), "url", "html").collect()
    assert [r.to_url for r in found] == [x for x in spellings.values() if x]
    pages = [(1, "http://a.org/d/1", '<meta http-equiv="Refresh" content="0; url=../e?a=1&amp;b=2">'), (2, "http://a.org/e?a=1&b=2", '<link rel="Canonical" href="http://q.net/es/1">'), (3, blocked, "")]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(pages, "page_id int, url string, html string"), urls.rule_table(spark)).collect()}
    assert got == {1: "block", 2: "block", 3: "block"}


def _judged_brute(rows, redirects, rules):
    """Verdicts of (id, url, targets) by walking over all links."""
    names = {u for _, u, ts in rows for u in (u, *ts)} | {u for pair in redirects for u in pair if u}
    near = defaultdict(set)
    for a, b in [(u, t) for _, u, ts in rows for t in ts] + [(a, b) for a, b in redirects if a and b]:
        near[a].add(b)
        near[b].add(a)

    def own(url):
        host, _, path = url.removeprefix("http://").partition("/")
        fits = [(-len(text), verdict != "block", verdict) for verdict, text in rules for h, _, p in [text.partition("/")] if (host == h or host.endswith("." + h)) and ("/" + path).startswith("/" + p)]
        return min(fits)[2] if fits else None

    out = {}
    for i, url, _ in rows:
        seen, todo = {url}, [url]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        found = {own(x) for x in seen & names}
        out[i] = own(url) or ("block" if "block" in found and "allow" not in found else "allow")
    return out


def test_urls_against_brute_force(spark):
    rng = random.Random(6)
    hosts = ["a.org", "b.org", "x.example.com", "www.example.com", "s.net", "t.net"]
    every = [f"http://{h}/{p}/{k}" for h in hosts for p in ("en", "es", "q") for k in range(9)]
    rules = [*urls.RULES, ("allow", "b.org/q/"), ("block", "b.org/q/"), ("block", "t.net/q/")]
    tag = lambda t: rng.choice(['<LINK href="{}" Rel=\'x Canonical\'>', '<link rel="canonical" href="{}">', "<meta http-equiv=Refresh content='3;URL={}'>"]).format(t)
    rows = [(i, rng.choice(every), [rng.choice(every) for _ in range(rng.choice([0, 0, 0, 0, 1, 2]))]) for i in range(200)]
    redirects = [(rng.choice(every), rng.choice(every)) for _ in range(20)] + [(None, every[0]), (every[0], None)]
    frame = spark.createDataFrame([(i, u, "<p>x</p>" + "".join(map(tag, ts))) for i, u, ts in rows], "page_id int, url string, html string")
    got = urls.judge(frame, urls.rule_table(spark, rules), spark.createDataFrame(redirects, "from_url string, to_url string")).collect()
    want = _judged_brute(rows, redirects, rules)
    assert {r.page_id: r.verdict for r in got} == want and {"block", "allow"} == set(want.values())
    plain = {r.page_id: r.verdict for r in urls.judge(frame, urls.rule_table(spark)).collect()}
    assert plain == _judged_brute(rows, [], urls.RULES)
    import duckdb

    pages = frame.toPandas()
    found = duckdb.sql(urls.ORACLE).fetchall() if len(pages) else []
    assert {r[0]: r[4] for r in found} == plain


def test_urls_without_python(spark, data):
    plan = urls.query(spark, data)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_items_of_any_id_and_repeated(spark):
    from decimal import Decimal

    text = "alpha beta gamma delta epsilon zeta eta"
    docs = spark.createDataFrame([(Decimal(1), f"so {text} it goes"), (Decimal(2), "nothing of the kind here at all"), (None, text)], "doc_id decimal(10,0), text string")
    items = spark.createDataFrame([(k, text) for k in (True, True, False, None)], "item_id boolean, text string")
    got = decontaminate.contained_items(docs, items, index_shingles=4).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == sorted([(d, i) for d in (Decimal(1), None) for i in (True, False, None)], key=str)
    assert {(r.n_shingles, r.n_shared, r.containment) for r in got} == {(3, 3, 1.0)}

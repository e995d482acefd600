"""URL filters with redirect equivalence, in DataFrame operations only.

Rules (host, path prefix; allow or block) judge a URL directly: a rule fits its host and all subdomains where the URL's path starts with the
rule's; the longest fitting rule wins, block before allow among equally long ones. URLs that are the same resource are linked: by redirects (every meta refresh
of a page, or rows of a redirect table) and by canonical links (every rel=canonical). One resource is one address as RFC 3986 has it (the case of scheme and host, a default port, an
empty path and the fragment make no difference); with forms=True http and https, any port 80 or 443 and slashes at the path's end make none either. Connected components over these links carry decisions to aliases that no rule fits: an alias is
blocked if a member of its component is blocked by a rule and none is allowed by one; explicit allows take precedence.

Hosts are matched against rules by equality: each URL's host gives its suffixes, each of them its rules, so no URL is compared with every rule
(rules are a list of any length, joined; small ones are broadcast by Spark's own size check).

Defined results: a null URL or one without :// has empty host and path, no rule and no links, and is allowed; repeated rows are judged each; character references
in targets are decoded as HTML does in attributes; relative targets are resolved against the page's URL, or its first <base href>, as RFC 3986 has it, and absolute ones stay as they are spelled;
targets of other schemes (mailto:) and relative ones of a page without host are left out; an empty table gives no rows; extra columns aren't read."""

from __future__ import annotations

import html as entities
import json
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm.common import cut, table
from strataweave.llm.components import connected_components

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ://, up to # or end; empty without ://."""
    after = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.coalesce(F.when(F.locate("://", url) > 0, F.substring_index(after, "#", 1)), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.substring_index(F.substring_index(_rest(url), "?", 1), "/", 1), _UP, _LOW)


def path_of(url: Column) -> Column:
    rest = F.substring_index(_rest(url), "?", 1)
    return F.substring(rest, F.length(F.substring_index(rest, "/", 1)) + 1, F.length(rest))


def scheme_of(url: Column) -> Column:
    return F.translate(F.substring_index(url, "://", 1), _UP, _LOW)


def resource_key(url: Column, forms: bool = False) -> Column:
    """The form shared by spellings of one address: scheme://host/path?query without fragment and default port; with forms, without scheme, port and final slashes. Null for URLs without host."""
    rest, scheme, path = _rest(url), scheme_of(url), path_of(url)
    port = F.lit(":(80|443)$") if forms else F.when(scheme == "http", ":80$").when(scheme == "https", ":443$").otherwise(":$")
    host = F.regexp_replace(host_of(url), port, F.lit(""))
    query = F.when(F.locate("?", rest) > 0, F.substring(rest, F.locate("?", rest), F.length(rest))).otherwise("")
    if forms:
        return F.when(host != "", F.concat(F.lit("//"), host, F.regexp_replace(path, "/+$", ""), query))
    return F.when(host != "", F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), query))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = [(text, verdict, *(lambda h, s, p: (h.lower(), s + p))(*text.partition("/"))) for verdict, text in rules]
    return spark.createDataFrame(rows, "rule string, rule_verdict string, rule_host string, rule_path string")


def by_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (row, host, path, ...) with rule and rule_verdict: those of the longest fitting rule, or null."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hosts = urls.select("host").where("host <> ''").distinct().select("host", F.explode(suffixes).alias("rule_host")).join(rules, "rule_host")
    per_host = hosts.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.length("rule")).alias("len"), (F.col("rule_verdict") != "block").alias("weak"), "rule", "rule_verdict", "rule_path"))).alias("fits"))
    best = F.get(F.filter("fits", lambda r: F.col("path").startswith(r["rule_path"])), F.lit(0))
    return urls.join(per_host, "host", "left").withColumn("best", best).withColumns({"rule": F.col("best.rule"), "rule_verdict": F.col("best.rule_verdict")}).drop("fits", "best")


def _bind(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unescape(value: Column) -> Column:
    """An attribute's value with its character references decoded: numbers, and names with ; or, where neither = nor a letter or digit follows, the old ones without."""
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    numbers = F.from_json(F.lit(json.dumps({str(k): entities.unescape(f"&#{k};") for k in (0, 13, *range(128, 160))})), "map<string,string>")

    def number(code: Column) -> Column:
        valid = (code < 0xD800) | code.between(0xE000, 0x10FFFF)
        return F.coalesce(F.try_element_at(numbers, code.cast("string")), F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")), F.lit("\ufffd"))

    def sign(reference: Column) -> Column:
        digits = F.regexp_replace(reference, "^#[xX]?0*|;$", "")
        code = F.when(F.length(digits) > 7, F.lit(1 << 24)).otherwise(F.conv(F.concat(F.lit("0"), digits), 16, 10).cast("int"))
        decimal = F.when(F.length(digits) > 7, F.lit(1 << 24)).otherwise(F.concat(F.lit("0"), digits).cast("int"))
        return F.when(reference.startswith("#"), _bind(F.when(reference.rlike("^#[xX]"), code).otherwise(decimal), number)).when(reference != "", F.try_element_at(names, reference))

    def decoded(x: Column) -> Column:
        reference = F.regexp_extract(x, r"^(#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[A-Za-z][A-Za-z0-9]*;|[A-Za-z][A-Za-z0-9]*(?![A-Za-z0-9=;]))", 1)
        return _bind(reference, lambda r: F.coalesce(F.concat(sign(r), F.substring(x, F.length(r) + 1, F.length(x))), F.concat(F.lit("&"), x)))

    def whole(parts: Column) -> Column:
        return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), decoded), ""))

    return F.when(value.contains("&"), _bind(F.split(value, "&"), whole)).otherwise(value)


def _without_dots(path: Column) -> Column:
    """A path that begins with / without its . and .. segments."""
    stack = lambda s, x: F.when(x == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).when(x == ".", s).otherwise(F.concat(s, F.array(x)))

    def kept(parts: Column) -> Column:
        last = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.lit("/"), F.array_join(F.concat(F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), stack), last), "/"))

    return _bind(F.split(path, "/"), kept)


def resolved(target: Column, base: Column) -> Column:
    """The URL that a target names on a page; null where it has another scheme or is relative and the page has no host."""

    def relative(w: Column) -> Column:
        own, tail, path = w["own"], w["tail"], w["path"]
        merged = F.when(own.startswith("/"), own).otherwise(F.concat(F.when(path == "", "/").otherwise(F.regexp_extract(path, "^.*/", 0)), own))
        place = F.when(own != "", F.concat(_without_dots(merged), tail)).when(tail.startswith("?"), F.concat(path, tail)).otherwise(F.concat(path, w["query"]))
        return F.when(w["host"] != "", F.concat(w["scheme"], F.lit("://"), w["host"], place))

    def named(w: Column) -> Column:
        t, b = w["target"], w["base"]
        pieces = F.struct(F.regexp_extract(t, "^[^?#]*", 0).alias("own"), F.regexp_extract(t, "[?#].*", 0).alias("tail"), scheme_of(b).alias("scheme"), host_of(b).alias("host"), path_of(b).alias("path"), F.regexp_extract(_rest(b), r"\?.*", 0).alias("query"))
        absolute = F.when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), t).when(t.startswith("//") & (host_of(b) != ""), F.concat(scheme_of(b), F.lit(":"), t))
        return F.coalesce(absolute, F.when(~t.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), _bind(pieces, relative)))

    return _bind(F.struct(target.alias("target"), base.alias("base")), named)


#: Tags that may hold a link, what makes one canonical or a redirect, and where the targets are; in RE2's syntax too.
TAGS = r"(?is)<(?:link|meta|base)\b[^>]*>"
CANONICAL = r"""(?is)^<link\b.*\brel\s*=\s*(?:"[^"]*\bcanonical\b|'[^']*\bcanonical\b|canonical\b)"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b"""
TO_URL = r"""(?is)\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*["']?([^"'\s>]+)"""


def page_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(from_url, to_url): all canonical links and meta refreshes of the pages."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    tags = F.regexp_extract_all(html, F.lit(TAGS), F.lit(0))
    target = lambda t: F.when(t.rlike(CANONICAL), F.regexp_extract(t, HREF, 1)).when(t.rlike(REFRESH), F.regexp_extract(t, TO_URL, 1)).otherwise("")
    base = F.get(F.filter(F.transform("tags", lambda t: F.when(t.rlike(r"(?i)^<base\b"), F.regexp_extract(t, HREF, 1)).otherwise("")), lambda x: x != ""), F.lit(0))
    own = pages.where(F.col(url_col).isNotNull() & html.rlike("(?i)canonical|refresh")).select(F.col(url_col).alias("from_url"), tags.alias("tags"))
    found = own.select("from_url", F.coalesce(base, F.lit("")).alias("base"), F.explode(F.filter(F.transform("tags", target), lambda x: x != "")).alias("to_url"))
    based = F.when(F.col("base") != "", F.coalesce(resolved(unescape(F.col("base")), F.col("from_url")), F.col("from_url"))).otherwise(F.col("from_url"))
    # written before and after, so that neither the patterns nor the resolution are repeated in other parts of the plan
    return cut(cut(found).select("from_url", resolved(unescape(F.col("to_url")), based).alias("to_url"))).where("to_url IS NOT NULL")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", default: str = "allow", forms: bool = False) -> DataFrame:
    """(id_col, host, path, rule, verdict) of every row. redirects: (from_url, to_url), besides what the pages themselves say; rows with a null end are left out."""
    url = F.col("url")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.withColumns({"host": host_of(url), "path": path_of(url), "node": resource_key(url, forms)})
    judged = cut(by_rule(rows, rules), gathered=True)
    links = page_links(pages, url_col, html_col) if html_col else None
    if redirects is not None:
        own = redirects.select("from_url", "to_url")
        links = own if links is None else links.unionByName(own)
    # the decisions of all addresses, by resource; targets that aren't pages count too
    marked = judged.where("node IS NOT NULL").select("node", "rule_verdict")
    if links is not None:
        links = cut(links)
        targets = links.select(F.explode(F.array("from_url", "to_url")).alias("url")).distinct().withColumns({"host": host_of(url), "path": path_of(url), "node": resource_key(url, forms)})
        marked = marked.unionByName(by_rule(targets, rules).where("node IS NOT NULL").select("node", "rule_verdict"))
        parts = connected_components(links.select(resource_key(F.col("from_url"), forms).alias("a"), resource_key(F.col("to_url"), forms).alias("b")))
    says = lambda verdict: F.coalesce(F.bool_or(F.col("rule_verdict") == verdict), F.lit(False))
    decided = marked.groupBy("node").agg(says("allow").alias("allows"), says("block").alias("blocks"))
    if links is not None:
        whole = decided.join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
        roots = whole.groupBy("root").agg(F.bool_or("allows").alias("allows"), F.bool_or("blocks").alias("blocks"))
        decided = whole.select("node", "root").join(roots, "root").select("node", "allows", "blocks")
    inherited = F.when(F.col("blocks") & ~F.col("allows"), "block").otherwise(default)
    out = judged.join(decided.where("blocks AND NOT allows"), "node", "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("rule_verdict", inherited).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark))


#: Links of every absolute or rooted target and what a page's own folder gives; base tags, dots in paths and references but &amp; are left to the tests.
ORACLE = r"""
WITH RECURSIVE p AS (SELECT row_number() OVER () AS row, page_id, url, html FROM pages),
tag AS (SELECT url, unnest(regexp_extract_all(html, {TAGS})) AS t FROM p WHERE url IS NOT NULL AND regexp_matches(html, '(?i)canonical|refresh')),
raw AS (SELECT url AS f, split_part(substring(url, position('://' IN url) + 3), '/', 1) AS h, replace(CASE WHEN regexp_matches(t, {CANONICAL}) THEN regexp_extract(t, {HREF}, 1) WHEN regexp_matches(t, {REFRESH}) THEN regexp_extract(t, {TO_URL}, 1) ELSE '' END, '&amp;', '&') AS x FROM tag),
link AS (
  SELECT f, CASE WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN x WHEN starts_with(x, '//') THEN split_part(f, '://', 1) || ':' || x WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(x, '/') THEN split_part(f, '://', 1) || '://' || h || x WHEN starts_with(x, '?') THEN regexp_extract(f, '^[^?#]*') || x WHEN starts_with(x, '#') THEN f ELSE regexp_extract(regexp_extract(f, '^[^?#]*'), '^.*/') || x END AS t
  FROM raw WHERE x <> ''
), u AS (SELECT url FROM p UNION SELECT f FROM link UNION SELECT t FROM link),
u0 AS (SELECT url, lower(split_part(url, '://', 1)) AS scheme, CASE WHEN position('://' IN url) > 0 THEN split_part(substring(url, position('://' IN url) + 3), '#', 1) ELSE '' END AS rest FROM u WHERE url IS NOT NULL),
u1 AS (SELECT *, split_part(rest, '?', 1) AS plain, CASE WHEN position('?' IN rest) > 0 THEN substring(rest, position('?' IN rest)) ELSE '' END AS query FROM u0),
u2 AS (SELECT *, lower(split_part(plain, '/', 1)) AS host, substring(plain, length(split_part(plain, '/', 1)) + 1) AS path FROM u1),
q AS (
  SELECT url, host, path, CASE WHEN host <> '' THEN scheme || '://' || regexp_replace(host, CASE scheme WHEN 'http' THEN ':80$' WHEN 'https' THEN ':443$' ELSE ':$' END, '') || CASE WHEN path = '' THEN '/' ELSE path END || query END AS node FROM u2
), rules(rule, rv) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
r AS (SELECT rule, rv, split_part(rule, '/', 1) AS rh, substring(rule, length(split_part(rule, '/', 1)) + 1) AS rp FROM rules),
best AS (SELECT url, arg_max(rule, length(rule)) AS rule, arg_max(rv, length(rule)) AS rv FROM q JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY url),
mark AS (SELECT node, coalesce(bool_or(rv = 'allow'), false) AS a, coalesce(bool_or(rv = 'block'), false) AS b FROM q LEFT JOIN best USING (url) WHERE node IS NOT NULL GROUP BY node),
edge AS (SELECT x.node AS a, y.node AS b FROM link JOIN q x ON x.url = f JOIN q y ON y.url = t WHERE x.node IS NOT NULL AND y.node IS NOT NULL),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
walk(origin, here) AS (SELECT node, node FROM mark UNION SELECT walk.origin, both_ways.b FROM walk JOIN both_ways ON walk.here = both_ways.a),
decided AS (SELECT origin AS node, bool_or(mark.a) AS a, bool_or(mark.b) AS b FROM walk JOIN mark ON walk.here = mark.node GROUP BY origin)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(rv, CASE WHEN b AND NOT a THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN q USING (url) LEFT JOIN best USING (url) LEFT JOIN decided USING (node)
"""
for _name, _pattern in {"TAGS": TAGS, "CANONICAL": CANONICAL, "HREF": HREF, "REFRESH": REFRESH, "TO_URL": TO_URL}.items():
    ORACLE = ORACLE.replace(f"{{{_name}}}", "'" + _pattern.replace("'", "''") + "'")

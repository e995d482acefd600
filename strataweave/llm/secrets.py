r"""Secret scans with corpus-wide ownership frequency.

Base kinds are found by pattern in every text (see BASE). Besides these, every other token that could be a credential (TOKEN: long, of letters and
digits mixed, of high entropy) is a candidate. Candidates and base finds are hashed, and the hashes aggregated over the corpus by distinct
repositories and owners: a value that many owners carry is a widely copied example; one that belongs to a single owner looks live. Base spans
always stay; a candidate token becomes a span (kind `owned`) unless it is such an example: a key in a document that is copied to a second owner or
repository is `shared`, and stays.

Aggregation is in steps, first by (hash, owner, repository), so that a value in a third of all rows costs one row a task; values that more than a thousandth of
all finds hold meet their counts by broadcast (a thousand values at most). Values themselves never leave their task, only digests do.

Defined results: null text counts as empty; null owner or repository count as one owner or repository of their own; repeated rows are scanned each; rows without finds are returned
with zero counts; an empty table gives no rows; extra columns are not read. Offsets are code points, ends exclusive."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm.common import counted_join, cut, steps, table, text_column

#: kind, pattern, group whose length counts, its least length; in the order in which kinds are listed
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),  # the maximal runs of 16 and more
)
KINDS = {"assign": 0, "access": 1, "hex": 2, "owned": 3}
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, order of kind, end), sorted."""
    out = []
    for order, (_, pattern, group, least) in enumerate(BASE):
        out += [(m.start(), order, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of tokens that look like credentials and touch no base span."""
    out = []
    for m in TOKEN.finditer(text):
        token = m.group()
        if any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token) and entropy(token) >= 3.5:
            if not any(s < m.end() and m.start() < e for s, _, e in base):
                out.append((m.start(), m.end()))
    return out


def digest(value: str) -> str:
    return hashlib.sha256(value.encode("utf-8")).hexdigest()[:32]


def _secret(text: str, order: int, start: int, end: int) -> str:
    """The value itself: of an assignment what is assigned."""
    if order == 0:
        return BASE[0][1].match(text, start, end).group(2)
    return text[start:end]


_SPANS = "array<struct<start: int, kind: int, end: int, digest: string>>"


def scan(df: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """One row for each row of df: id, owner, repo, base and candidate spans with digests, counts, digest of the base spans."""
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), text_column(df, text_col).alias("text"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("digest", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text"):
            spans, sums = [], []
            for text in part.column("text").to_pylist():
                base = base_spans(text)
                found = [(s, k, e, digest(_secret(text, k, s, e))) for s, k, e in base]
                found += [(s, 3, e, digest(text[s:e])) for s, e in candidates(text, base)]
                spans.append([dict(zip(("start", "kind", "end", "digest"), x, strict=True)) for x in sorted(found)])
                sums.append(hashlib.sha256(",".join(f"{BASE[k][0]}:{s}:{e}" for s, k, e in base).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("owner"), part.column("repo"), pa.array(spans, span), pa.array(sums, pa.string())], ["id", "owner", "repo", "found", "base_sha256"])

    return source.mapInArrow(run, f"id {kind}, owner string, repo string, found {_SPANS}, base_sha256 string")


def ownership(each: DataFrame) -> DataFrame:
    """(digest, n, n_owners, n_repos) of every value found (digest, owner, repo), over the whole corpus; n: how often."""
    pairs = each.groupBy("digest", "owner", "repo").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("digest", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return owners.groupBy("digest").agg(F.sum("n").alias("n"), F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "lang", max_owners: int = 1, max_repos: int = 1, example_owners: int = 3) -> DataFrame:
    """Per row: id, base_sha256, found (start, kind, end, digest, n_owners, n_repos, verdict). Verdicts: live (at most max_owners owners and max_repos
    repositories), example (example_owners or more owners), shared (between)."""
    rows = cut(scan(df, id_col, text_col, owner_col, repo_col).withColumn("row", F.monotonically_increasing_id()))
    each = rows.where(F.size("found") > 0).select("row", "owner", "repo", F.explode("found").alias("x")).select("row", "owner", "repo", "x.*")
    counts = cut(ownership(each.select("digest", "owner", "repo")), gathered=True)
    total = counts.agg(F.sum("n")).first()[0] or 0
    verdict = F.when((F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos), "live").when(F.col("n_owners") >= example_owners, "example").otherwise("shared")
    judged = counted_join(each.drop("owner", "repo"), counts, ["digest"], "n", total).select("row", F.struct("start", "kind", "end", "digest", "n_owners", "n_repos", verdict.alias("verdict")).alias("x"))
    kept = judged.where("x.kind < 3 OR x.verdict <> 'example'").groupBy("row").agg(F.array_sort(F.collect_list("x")).alias("spans"))
    return rows.join(kept, "row", "left").select(F.col("id").alias(id_col), "base_sha256", "spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners are the documents' sources; a source's repositories are told apart by language."""
    out = find_secrets(table(spark, sf_dir, "documents"))
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int,digest:string,n_owners:bigint,n_repos:bigint,verdict:string>>"))
    names = F.array(*(F.lit(k) for k in KINDS))
    of = lambda k: F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("long")
    as_text = F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")
    judged = lambda v: F.size(F.filter(spans, lambda x: x["verdict"] == v)).cast("long")
    return out.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), "base_sha256", as_text.alias("spans"), judged("live").alias("n_live"), judged("example").alias("n_example"), judged("shared").alias("n_shared"))

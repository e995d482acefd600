"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item (short) is sought inside documents (long): a document matches if it holds at least `threshold` of the item's distinct word shingles.
Items are partitioned by their number of distinct shingles. A partition of items with at most u shingles keeps, of each item, a MinHash sketch
of its least hash values, as many as an item of its size n can miss and still match, plus one: n - ceil(threshold * n) + 1. Whoever holds
enough of the item holds one of these, so testing a document's shingles against the sketches finds every match (no false negative, however
long the document is). A partition is only tried by documents with at least ceil(threshold * l) shingles, l being its least item. Candidates are
verified on the shingles themselves, not on hashes.

Documents are read once for each block of items and never shuffled; a block's index is bounded by INDEX_SHINGLES whatever the benchmark's size.

Words: lower-cased, all but letters and digits removed, cut at white space. Items of fewer than `width` words have one shingle, all their
words, sought as a run of that length. Defined results: null or wordless items match nothing; null or wordless documents match nothing;
repeated documents match each, an item repeated with one id and text counts once; null ids are returned as null; extra columns are not read; an empty side gives no rows."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from strataweave.llm.common import normal_words, run_hashes, steps, table, text_column, word_hashes

#: Most distinct shingles of one block of items (about 100 bytes each on the driver and in each Python worker).
INDEX_SHINGLES = 1_000_000


def item_shingles(text: str | None, width: int) -> list[tuple[str, ...]]:
    """Distinct shingles of an item, in order."""
    words = normal_words(text)
    if not words:
        return []
    k = min(width, len(words))
    return list(dict.fromkeys(tuple(words[i : i + k]) for i in range(len(words) - k + 1)))


class Index:
    """The sketches of one block of items, by size partition."""

    def __init__(self, items: list[tuple[object, str | None]], width: int, threshold: float):
        self.items: list[tuple[object, list[tuple[str, ...]], int]] = []
        parts: dict[tuple[int, int], list[int]] = defaultdict(list)
        for item_id, text in items:
            if shingles := item_shingles(text, width):
                parts[len(shingles[0]), len(shingles).bit_length()].append(len(self.items))
                self.items.append((item_id, shingles, math.ceil(threshold * len(shingles) - 1e-9)))
        #: (words in a shingle, least number of shingles a document needs, sorted sketch values, item of each value)
        self.parts = []
        for (k, _), members in sorted(parts.items()):
            values, owners = [], []
            for m in members:
                _, shingles, need = self.items[m]
                hashes = np.sort(_hashes(shingles))
                keep = hashes[: len(hashes) - need + 1]
                values.append(keep)
                owners.append(np.full(len(keep), m))
            values, owners = np.concatenate(values), np.concatenate(owners)
            order = np.argsort(values, kind="stable")
            self.parts.append((k, min(self.items[m][2] for m in members), values[order], owners[order], _filter(values)))

    def candidates(self, texts: pa.Array) -> list[tuple[int, int]]:
        """Distinct (text, item) pairs in which the text holds a sketch value of the item."""
        words, offsets = word_hashes(texts)
        runs = {k: run_hashes(words, k) for k in {p[0] for p in self.parts}}
        out = []
        for k, need, values, owners, seen in self.parts:
            h = runs[k]
            at = np.flatnonzero(seen[h & np.uint64(len(seen) - 1)])
            left = np.searchsorted(values, h[at], side="left")
            count = np.searchsorted(values, h[at], side="right") - left
            at, left, count = at[count > 0], left[count > 0], count[count > 0]
            text = np.searchsorted(offsets, at, side="right") - 1
            inside = (at + k <= offsets[text + 1]) & (offsets[text + 1] - offsets[text] - k + 1 >= need)
            text, left, count = text[inside], left[inside], count[inside]
            if len(text):
                take = np.repeat(left - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                out.append(np.unique(np.repeat(text, count) * len(self.items) + owners[take]))
        return [divmod(int(x), len(self.items)) for x in np.unique(np.concatenate(out))] if out else []

    def matches(self, texts: pa.Array) -> Iterator[tuple[int, object, int, int]]:
        """(text, item id, shingles of the item, of which the text holds) for every match."""
        held, last = {}, -1
        for row, m in self.candidates(texts):
            if row != last:
                words, held, last = normal_words(texts[row].as_py()), {}, row
            item_id, shingles, need = self.items[m]
            k = len(shingles[0])
            if k not in held:
                held[k] = set(zip(*(words[j:] for j in range(k)), strict=False))
            if (shared := sum(s in held[k] for s in shingles)) >= need:
                yield row, item_id, len(shingles), shared


def _hashes(shingles: list[tuple[str, ...]]) -> np.ndarray:
    flat, _ = word_hashes(pa.array([" ".join(w for s in shingles for w in s)], pa.large_string()))
    k = len(shingles[0])
    return run_hashes(flat, k)[::k]


def _filter(values: np.ndarray) -> np.ndarray:
    """A table over low bits that rules most hashes out with one look."""
    seen = np.zeros(1 << max(16, int(len(values) * 16).bit_length()), bool)
    seen[values & np.uint64(len(seen) - 1)] = True
    return seen


def _blocks(docs: DataFrame, items: DataFrame, width: int, threshold: float, item_id: str, text_col: str, index_shingles: int) -> Iterator[Broadcast]:
    """The index of each block of items, broadcast; a block holds index_shingles shingles or few more."""
    own = items.select(F.col(item_id).alias("id"), text_column(items, text_col).alias("text")).distinct()
    # an item has fewer shingles than half its characters
    blocks = max(1, math.ceil((own.agg(F.sum(F.length("text") / 2).cast("long")).first()[0] or 0) / index_shingles))
    for block in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("text", "id"), F.lit(blocks)) == block).collect()
        yield docs.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in rows], width, threshold))


_COUNTS = (StructField("n_shingles", IntegerType()), StructField("n_shared", IntegerType()), StructField("containment", DoubleType()))


def contained_items(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", index_shingles: int = INDEX_SHINGLES) -> DataFrame:
    """One row for each document and item that it contains: doc_id, item_id, n_shingles, n_shared, containment."""
    kinds = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("id"), text_column(docs, text_col).alias("text"))
    schema = to_arrow_schema(StructType([StructField("doc_id", docs.schema[doc_id].dataType), StructField("item_id", items.schema[item_id].dataType), *_COUNTS]))
    out = None
    for index in _blocks(docs, items, width, threshold, item_id, text_col, index_shingles):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for part in steps(batches, "text"):
                if found := list(index.value.matches(part.column("text"))):
                    row, item, n, shared = zip(*found, strict=True)
                    columns = [part.column("id").take(pa.array(row)), pa.array(item, schema.field(1).type), pa.array(n, pa.int32()), pa.array(shared, pa.int32())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([s / k for s, k in zip(shared, n, strict=True)])], schema=schema)

        found = source.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, n_shingles int, n_shared int, containment double")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, item_id: str = "item_id", text_col: str = "text", index_shingles: int = INDEX_SHINGLES) -> DataFrame:
    """The rows of docs, all columns, whose text contains no item; nothing is shuffled."""
    for index in _blocks(docs, items, width, threshold, item_id, text_col, index_shingles):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for part in steps(batches, text_col):
                gone = {row for row, *_ in index.value.matches(part.column(text_col))}
                yield part.filter(pa.array([i not in gone for i in range(part.num_rows)])) if gone else part

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH toks AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\s]+', '', 'g'), '\s+'), lambda w: w <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\s]+', '', 'g'), '\s+'), lambda w: w <> '') FROM benchmark
), ishort AS (
  SELECT DISTINCT least(5, len(w)) AS k FROM toks WHERE side = 'i' AND len(w) > 0
), ish AS (
  SELECT DISTINCT id, k, array_to_string(w[p : p + k - 1], ' ') AS s FROM (SELECT id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM toks WHERE side = 'i' AND len(w) > 0)
), dsh AS (
  SELECT DISTINCT id, k, array_to_string(w[p : p + k - 1], ' ') AS s FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM toks, ishort WHERE side = 'd' AND len(w) >= k)
), n AS (SELECT id, count(*) AS n FROM ish GROUP BY id),
hits AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared FROM dsh d JOIN ish i USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_shingles, CAST(shared AS INTEGER) AS n_shared, shared / n AS containment
FROM hits JOIN n ON n.id = item_id WHERE shared >= ceil(0.8 * n - 1e-9)
"""

"""SimHash near-dedup with pivot distance tables.

Every text gets a 64-bit fingerprint (majority of the bits of its shingles' XXH64). Equal fingerprints collapse first. Fingerprints are dealt
into groups that agree in two of max_bits + 2 bit blocks (any pair within max_bits differing bits agrees in two at least, so no link is lost); a group
that is too large is dealt again by the bits that its members don't share yet. Inside a group a table of Hamming distances to many reference fingerprints (pivots) discards every pair whose coordinates differ by more than
max_bits somewhere (the triangle inequality), and the survivors are verified by the exact distance. Distances to a pivot lie within a few bits
of 32, so a pivot table alone would leave a constant share of all pairs to look at; the blocks only decide which pairs meet at all.

Defined results: null text counts as empty; a text of no words has fingerprint 0 and is linked like any other; repeated rows give a result
each; a null id stays null and never becomes a component's id unless all its ids are null; an empty table gives no rows; extra columns of
the input are never read."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm.common import counted_join, cut, steps, table, text_column
from strataweave.llm.components import connected_components

#: Fingerprints that are compared in one group; larger groups are split by further bits.
GROUP = 4096
PIVOTS = np.random.default_rng(11).integers(0, 2**64, 24, dtype=np.uint64)
_PAIRS = 1 << 20


def shingle_digests(data: bytes, width: int = 3) -> list[int]:
    """XXH64 (seed 42) of every run of width words of the bytes, A-Z lower-cased; of the whole sequence where words are fewer."""
    words = data.lower().split()  # of bytes: ASCII letters; space and \x09-\x0D
    if not words:
        return []
    if len(words) < width:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return [digest(join(run), 42) for run in zip(*(words[j:] for j in range(width)), strict=False)]


def fingerprints(texts: list[bytes | None], width: int = 3) -> np.ndarray:
    """Fingerprints (unsigned): a bit is set if it is in over half of the text's shingle digests."""
    out = np.zeros(len(texts), np.uint64)
    hashes: list[int] = []
    rows, starts = [], []

    def flush() -> None:
        if rows:
            bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
            n = np.diff([*starts, len(hashes)])
            out[rows] = np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        hashes.clear(), rows.clear(), starts.clear()

    for i, text in enumerate(texts):
        if found := shingle_digests(text or b"", width):
            rows.append(i)
            starts.append(len(hashes))
            hashes += found
            if len(hashes) > 100_000:
                flush()
    flush()
    return out


def with_fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, r, fp) of every row; r is a hash of the text, fp the fingerprint as a signed long. The text never leaves its task."""
    kind = df.schema[id_col].dataType.simpleString()
    text = text_column(df, text_col)
    source = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("r"), text.cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "data"):
            fp = fingerprints(part.column("data").to_pylist(), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("r"), pa.array(fp)], ["id", "r", "fp"])

    return source.mapInArrow(run, f"id {kind}, r long, fp long")


def _edges(width: int, max_bits: int) -> list[int]:
    """The bits where max_bits + 2 blocks of nearly equal width begin, and the end."""
    return [round(width * k / (max_bits + 2)) for k in range(max_bits + 3)]


def _star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links a-b as links of every node to the least node of its part."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    out = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[out], nodes[label[out]]


def linked(group: np.ndarray, fp: np.ndarray, first: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links, as stars, among fingerprints of the same group; rows are sorted by group and by first, the distance to the first pivot."""
    coordinates = np.bitwise_count(fp[:, None] ^ PIVOTS[None, 1:]).astype(np.int8)
    left, right, held = [], [], 0
    at, shift = np.arange(len(fp)), 1
    while len(at):
        at = at[at + shift < len(fp)]
        at = at[(group[at] == group[at + shift]) & (first[at + shift] - first[at] <= max_bits)]  # sorted: who fails now fails at every later shift
        for part in np.array_split(at, len(at) // _PAIRS + 1):
            near = part[(np.abs(coordinates[part] - coordinates[part + shift]) <= max_bits).all(axis=1)] if len(part) else part
            near = near[np.bitwise_count(fp[near] ^ fp[near + shift]) <= max_bits]
            if len(near):
                left.append(fp[near])
                right.append(fp[near + shift])
                held += len(near)
            if held > 2 * _PAIRS:
                a, b = _star(np.concatenate(left), np.concatenate(right))
                left, right, held = [a], [b], len(a)
        shift += 1
    return _star(np.concatenate(left), np.concatenate(right)) if left else (fp[:0], fp[:0])


def _bits(v: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(v, at).bitwiseAND(F.lit((1 << width) - 1))


def _dealt(v: Column, width: int, group: Column, max_bits: int) -> tuple[list[Column], int]:
    """(key, v) for every two of max_bits + 2 blocks of the low `width` bits of v: the key says group, which two and what is in them, v what is in the other blocks; the width of those."""
    edges = _edges(width, max_bits)
    blocks = list(zip(edges, edges[1:], strict=False))
    out, most = [], 0
    for k, (i, j) in enumerate(combinations(range(len(blocks)), 2)):
        key = F.xxhash64(group, F.lit(k), *(_bits(v, lo, hi - lo) for lo, hi in (blocks[i], blocks[j])))
        rest, at = F.lit(0).cast("long"), 0
        for n, (lo, hi) in enumerate(blocks):
            if n not in (i, j):
                rest, at = rest.bitwiseOR(F.shiftleft(_bits(v, lo, hi - lo), at)), at + hi - lo
        out.append(F.struct(key.alias("key"), rest.alias("v")))
        most = max(most, at)
    return out, most


def groups(distinct: DataFrame, max_bits: int = 3) -> DataFrame:
    """(fp, grp): groups of GROUP fingerprints at most, such that any two within max_bits bits of each other are together in one.

    Fingerprints are dealt by any two of max_bits + 2 blocks; larger groups are dealt again in the same way by the bits that they don't share yet. Each step leaves three fifths of
    the bits (of three bits and five blocks), and as many bits as GROUP has can't differ in more ways, so the steps end."""
    out, width = [], 64
    items = distinct.select("fp", F.col("fp").alias("v"), F.lit(0).cast("long").alias("grp"))
    while True:
        slots, left = _dealt(F.col("v"), width, F.col("grp"), max_bits)
        each = items.select("fp", F.inline(F.array(*slots)))
        size = each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        if 1 << left <= GROUP:
            return reduce(DataFrame.unionByName, [*out, each.select("fp", F.col("key").alias("grp"))])
        size = cut(size, gathered=True)
        out.append(each.join(size.where(f"n <= {GROUP}").select("key"), "key").select("fp", F.col("key").alias("grp")))
        large = size.where(f"n > {GROUP}").select("key")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, out)
        items, width = cut(each.join(large, "key").select("fp", "v", F.col("key").alias("grp")), gathered=True), left


def links(distinct: DataFrame, max_bits: int = 3) -> DataFrame:
    """(a, b): links that connect all fingerprints (column fp, distinct) within max_bits bits of each other; each group gives fewer links than it has members."""
    first = F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(PIVOTS[:1].view(np.int64)[0])))).alias("d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            part = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "fp", "d")]
            part = part if rest is None else [np.concatenate(x) for x in zip(rest, part, strict=True)]
            if not len(part[0]):
                continue
            last = int(np.searchsorted(part[0], part[0][-1]))  # the last group may go on in the next batch
            rest = [x[last:] for x in part]
            yield from found(*(x[:last] for x in part))
        if rest is not None:
            yield from found(*rest)

    def found(grp: np.ndarray, fp: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = linked(grp, np.ascontiguousarray(fp).view(np.uint64), d, max_bits)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return groups(distinct, max_bits).select("grp", "fp", first).repartition("grp").sortWithinPartitions("grp", "d").mapInArrow(run, "a long, b long")


def _components(docs: DataFrame, max_bits: int) -> DataFrame:
    """Rows (id, fp, ...) with component_id."""
    least = cut(docs.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), gathered=True)
    parts = connected_components(links(least.select("fp"), max_bits))
    reach = parts.join(least, parts["node"] == least["fp"]).groupBy("root").agg(F.min("least").alias("reach"))
    ends = parts.join(reach, "root").select(F.col("node").alias("fp"), "reach")
    ids = least.join(ends, "fp", "left").select("fp", "n", F.coalesce("reach", "least").alias("component_id"))
    return counted_join(docs, ids, ["fp"], "n", docs.count())


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 3) -> DataFrame:
    """(id_col, fp, component_id) of every row; component_id is the least id reachable over links of max_bits bits or fewer."""
    docs = cut(with_fingerprint(df, id_col, text_col, width).select("id", "fp"))
    return _components(docs, max_bits).select(F.col("id").alias(id_col), "fp", "component_id")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of df that stay: of each component those with the least id (more than one only where that id is repeated in it); null ids stay."""
    docs = _components(cut(with_fingerprint(df, id_col, text_col, width)), max_bits)
    gone = docs.where("id <> component_id").select(F.col("id").alias("_gone"), F.col("r").alias("_r")).distinct()
    row = F.xxhash64(text_column(df, text_col))
    return df.join(gone, (df[f"`{id_col}`"] == F.col("_gone")) & (row == F.col("_r")), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

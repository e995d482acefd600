"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Every word shingle is hashed once; the hash picks a bin and a value, and each bin keeps its least value. Empty bins are filled by optimal
densification: bin i asks bins h(i, 1), h(i, 2), ... until one isn't empty and takes its value. Of each bin the low `bits` bits are stored.
The likeness of two fingerprints is the share of equal bins, corrected for the chance 2^-bits that different values agree.

Words and shingles are those of common.py (five words; a text of fewer has one shingle). Defined results: null text counts as empty; texts
without words have the fingerprint of zeros and nothing else has: likeness 1 among themselves, 0 to any other; repeated rows have a result each; an
empty table gives no rows; extra columns are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataweave.llm.common import cut, mix, shingle_hashes, steps, table, text_column, word_hashes

BINS, BITS, WIDTH = 512, 4, 5
_EMPTY = np.uint64(2**64 - 1)


def bin_minima(hashes: np.ndarray, offsets: np.ndarray, bins: int) -> np.ndarray:
    """(texts, bins): the least hash in each bin, _EMPTY where there is none."""
    n = len(offsets) - 1
    out = np.full(n * bins, _EMPTY)
    if len(hashes):
        row = np.repeat(np.arange(n), np.diff(offsets))
        key = row * bins + (hashes >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
        np.minimum.at(out, key, hashes & np.uint64(2**48 - 1))
    return out.reshape(n, bins)


def densify(minima: np.ndarray) -> np.ndarray:
    """Optimal densification of every row that has a full bin at all."""
    out, bins = minima.copy(), minima.shape[1]
    full = minima != _EMPTY
    row, col = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        if attempt <= 64 * bins:
            ask = (mix(col.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        else:
            ask = full[row].argmax(axis=1)
        hit = full[row, ask]
        out[row[hit], col[hit]] = minima[row[hit], ask[hit]]
        row, col = row[~hit], col[~hit]
    return out


def signatures(texts: pa.Array, width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """(texts, bins) of small unsigned integers: the low bits of the densified minima, hashed with their bin. Rows without shingles are zero."""
    words, offsets = word_hashes(texts)
    hashes, bounds = shingle_hashes(words, offsets, width)
    dense = densify(bin_minima(hashes, bounds, bins))
    # with the bin's number, so that a value copied into many bins has other low bits in each
    spread = dense + np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    low = (mix(spread) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    empty = bounds[1:] == bounds[:-1]
    low[empty] = 0
    low[~empty & (low == 0).all(axis=1), 0] = 1
    return low


def pack_bits(low: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Each row's low bits side by side."""
    if bits == 8:
        return [r.tobytes() for r in low]
    each = np.unpackbits(low[:, :, None], axis=2, bitorder="little")[:, :, :bits].reshape(len(low), -1)
    return [r.tobytes() for r in np.packbits(each, axis=1, bitorder="little")]


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of the shingle sets, row by row, from 0 to 1."""
    chance = 2.0**-bits
    out = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)
    none = (a == 0).all(axis=1), (b == 0).all(axis=1)
    return np.where(none[0] | none[1], (none[0] & none[1]).astype(float), out)


def _digits(column: str):
    return F.lower(F.hex(column))


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """(id_col, fingerprint) of every row; nothing is shuffled."""
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), text_column(df, text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(pack_bits(signatures(part.column("text"), width, bins, bits), bits), pa.binary())], [id_col, "fingerprint"])

    return source.mapInArrow(run, f"`{id_col}` {kind}, fingerprint binary").withColumn("fingerprint", _digits("fingerprint"))


# the query: every document against an edited form and the next document --------------------------------------------------------

_RESULT = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compared(texts: list[str], following: list[str], sig: np.ndarray, next_sig: np.ndarray) -> list[pa.Array]:
    """The result columns of texts, each with the text that follows it."""
    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]
    other = signatures(pa.array(edited, pa.large_string()))
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e.encode("utf-8")).digest() for e in edited], pa.binary()),
        pa.array(pack_bits(sig), pa.binary()),
        pa.array(pack_bits(other), pa.binary()),
        pa.array(likeness(sig, other)),
        pa.array(likeness(sig, next_sig)),
    ]


def edited_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint, that of its edited form (last half replaced by the next row's beginning) and both likenesses; next is by id (null
    first, ties by text), after the last the first.

    Texts are range-partitioned by id once and compared in order within each task; a task's last row waits for the next task's first, so only those
    rows, two a task, are brought together afterwards. Until then digests stay binary, half as long as their digits."""
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), text_column(df, text_col).alias("text"))
    names = ["id", *(c.split()[0] for c in _RESULT.split(", ")), "part", "first_text", "last_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = held = None
        id_type = pa.int64()
        for part in steps(batches, "text", 2 << 20):
            ids, texts, id_type = part.column("id"), part.column("text").to_pylist(), part.schema.field("id").type
            sig = signatures(part.column("text"))
            first = texts[0] if first is None else first
            if held is not None:
                ids = pa.concat_arrays([held[0], ids])
                texts, sig = [held[1], *texts], np.concatenate([held[2], sig])
            n = len(texts) - 1
            if n:
                none = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())]
                yield pa.RecordBatch.from_arrays([ids.slice(0, n), *_compared(texts[:-1], texts[1:], sig[:-1], sig[1:]), *none], names)
            held = ids.slice(n), texts[-1], sig[-1:]
        if held is not None:
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
            ends = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first], pa.string()), pa.array([held[1]], pa.string())]
            yield pa.RecordBatch.from_arrays([held[0].cast(id_type), *none, *ends], names)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text"):
            columns = _compared(part.column("text").to_pylist(), part.column("following").to_pylist(), signatures(part.column("text")), signatures(part.column("following")))
            yield pa.RecordBatch.from_arrays([part.column("id"), *columns], names[:7])

    ordered = source.repartitionByRange("id").sortWithinPartitions("id", "text")
    done = cut(ordered.mapInArrow(run, f"id {kind}, {_RESULT}, part int, first_text string, last_text string"))
    every = Window.orderBy("part")
    following = F.coalesce(F.lead("first_text").over(every), F.first("first_text").over(every))
    last = done.where("part IS NOT NULL").select("id", F.col("last_text").alias("text"), following.alias("following"))
    rows = done.where("part IS NULL").select(names[:7]).unionByName(last.mapInArrow(ends, f"id {kind}, {_RESULT}"))
    return rows.withColumns({c: _digits(c) for c in names[2:5]}).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))

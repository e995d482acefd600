"""Shared pieces: table reading, durable intermediate tables, bounded batches and vectorised word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles at once; a single longer text is a step of its own.
STEP_BYTES = 1 << 20
_OWN_DIR: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where that is unset, one folder of our own on one machine (tests), and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="strataweave-"))
    return _OWN_DIR[0]


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_cut(df: DataFrame, gathered: bool = False) -> tuple[DataFrame, str]:
    """Write df as Parquet to the shared folder and read it back: lineage ends here and a lost executor costs no recomputation.

    gathered: for small rows that come out of a shuffle. They go to fewer files, a sixteenth of the shuffle's partitions but one for each core at least, since
    every file costs several calls to the file system (and, on a local one, processes), whatever is in it. No file marks the job's success: who reads knows of it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/sw-{uuid.uuid4().hex}"
    if gathered:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16))
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, gathered: bool = False) -> DataFrame:
    return write_cut(df, gathered)[0]


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage: Spark's cleaner then removes the shuffle files and broadcast tables of what has ended, and generated classes go, before a long run takes more."""
    spark._jvm.System.gc()


def discard(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def counted_join(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """left joined with right, which has one row a key and says in `count` (left out of the result) how many rows of left carry it; total: the rows of left.

    Keys that more than a thousandth of left carries, so a thousand at most, are joined by broadcast where the rows are; no other key can weigh on a task."""
    few = F.broadcast(right.where(F.col(count) > total // 1000).drop(count))
    rest = left.join(few.select(*keys), keys, "left_anti").join(right.where(F.col(count) <= total // 1000).drop(count), keys)
    return left.join(few, keys).unionByName(rest)


def text_column(df: DataFrame, name: str = "text"):
    """The text column, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def steps(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches that hold at most max_bytes in a string or binary column (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + max_bytes, side="right")))
            yield batch.slice(start, end - start)
            start = end


#: What a word loses: all but letters, digits and white space (RE2).
NOT_WORD = r"[^\p{L}\p{N}\p{Z}\s\x{85}\x{1c}-\x{1f}]+"


def _tokens(texts: pa.Array) -> pa.Array:
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), NOT_WORD, "")
    return pc.list_parent_indices(lists := pc.utf8_split_whitespace(plain)), lists.flatten(), len(lists)


def normal_words(text: str | None) -> list[str]:
    """The words of a text: lower-cased, all but letters, digits and white space removed, cut at white space."""
    return [w for w in _tokens(pa.array([text], pa.large_string()))[1].to_pylist() if w]


_BYTES = np.random.default_rng(7).integers(1, 2**64, 256, dtype=np.uint64)
_POWERS = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    if len(_POWERS[0]) < n:
        for k, r in enumerate((0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 2**64))):
            p = np.full(n, np.uint64(r), np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text, one after the other, and where each text's words begin (n + 1 offsets)."""
    words, _, offsets = word_and_prefix_hashes(texts, ())
    return words, offsets


def word_and_prefix_hashes(texts: pa.Array, prefixes: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Hashes of all words, for each length those of the words' first so many bytes (0 where a word isn't longer), and the texts' offsets.

    A hash is a polynomial over UTF-8 bytes, taken for all words at once from prefix sums; no word is a Python object."""
    parents, tokens, n = _tokens(texts)
    parents = parents.to_numpy(zero_copy_only=False)
    bounds = np.frombuffer(tokens.buffers()[1], np.int64, len(tokens) + 1, tokens.offset * 8) if len(tokens) else np.zeros(1, np.int64)
    start, end = bounds[:-1] - bounds[0], bounds[1:] - bounds[0]
    if (there := end > start).sum() < len(start):
        start, end, parents = start[there], end[there], parents[there]
    offsets = np.searchsorted(parents, np.arange(n + 1))
    if not len(start):
        return np.zeros(0, np.uint64), [np.zeros(0, np.uint64) for _ in prefixes], offsets
    data = np.frombuffer(tokens.buffers()[2], np.uint8, bounds[-1] - bounds[0], bounds[0])
    power, inverse = _powers(max(len(data) + 1, 1 << 16))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * power[: len(data)], out=sums[1:])
    short = [np.where(end - start > k, mix((sums[np.minimum(start + k, end)] - sums[start]) * inverse[start] + np.uint64(k << 32)), np.uint64(0)) for k in prefixes]
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64)), short, offsets


_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * _B
    h = h ^ (h >> np.uint64(27))
    h = h * _C
    return h ^ (h >> np.uint64(31))


def run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width words, for all starts in the flat array (runs across texts too; the caller leaves those out)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(width), np.uint64)
    for j in range(width):
        h = mix(h * _A + words[j : j + n])
    return h


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of every text and their offsets. A text of fewer words has one shingle, its whole sequence; one without words has none."""
    lengths = np.diff(offsets)
    counts = np.where(lengths >= width, lengths - width + 1, (lengths > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(counts)])
    runs = run_hashes(words, width)
    starts = np.repeat(offsets[:-1] - out_offsets[:-1], counts) + np.arange(out_offsets[-1])
    out = np.zeros(out_offsets[-1], np.uint64)
    long = np.repeat(lengths >= width, counts)
    out[long] = runs[starts[long]]
    for short in range(1, width):
        if len(rows := np.flatnonzero(lengths == short)):
            h = np.full(len(rows), np.uint64(short), np.uint64)
            for j in range(short):
                h = mix(h * _A + words[offsets[rows] + j])
            out[out_offsets[rows]] = h
    return out, out_offsets

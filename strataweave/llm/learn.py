"""What the two classifiers share: folds, bounded training samples, sparse rows and scoring in place."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.llm.common import steps, text_column


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(-1)).cast("int")


def sample(df: DataFrame, id_col: str, most: int, seed: int) -> DataFrame:
    """About most rows of df at most, chosen by a hash of the id: all rows where there are fewer."""
    n = df.count()
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * most / n))


class Rows:
    """Sparse rows: features and values of each, one after the other."""

    def __init__(self, features: np.ndarray, values: np.ndarray, offsets: np.ndarray):
        self.features, self.values, self.offsets = features, values, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def take(self, at: np.ndarray) -> Rows:
        count = np.diff(self.offsets)[at]
        offsets = np.concatenate([[0], np.cumsum(count)])
        pick = np.repeat(self.offsets[at] - offsets[:-1], count) + np.arange(offsets[-1])
        return Rows(self.features[pick], self.values[pick], offsets)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.offsets))


Featurise = Callable[[pa.Array], Rows]


def collect_rows(df: DataFrame, text_col: str, label: str | None, featurise: Featurise) -> tuple[Rows, np.ndarray]:
    """Features (and labels) of a bounded sample, computed where the texts are and brought to the driver in a fixed order."""
    source = df.select(F.xxhash64(text_column(df, text_col)).alias("order"), (F.col(label) if label else F.lit(1)).cast("double").alias("label"), text_column(df, text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text"):
            rows = featurise(part.column("text"))
            offsets = pa.array(rows.offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((rows.features, pa.int32()), (rows.values, pa.float32()))]
            yield pa.RecordBatch.from_arrays([part.column("order"), part.column("label"), *lists], ["order", "label", "features", "values"])

    got = source.mapInArrow(run, "order long, label double, features array<int>, values array<float>").toArrow().sort_by([("order", "ascending"), ("label", "ascending")])
    if not got.num_rows:
        return Rows(np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(1, np.int64)), np.zeros(0)
    f, v = (got.column(c).combine_chunks() for c in ("features", "values"))
    offsets = f.offsets.to_numpy().astype(np.int64)
    rows, labels = Rows(f.flatten().to_numpy().copy(), v.flatten().to_numpy().copy(), offsets - offsets[0]), got.column("label").to_numpy().copy()
    del got, f, v
    pa.default_memory_pool().release_unused()
    return rows, labels


def with_score(df: DataFrame, id_col: str, text_col: str, score: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """(id_col, score) of every row; score is sent along with the task and nothing is shuffled."""
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), text_column(df, text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(score(part.column("text")), pa.float64())], [id_col, "score"])

    return source.mapInArrow(run, f"`{id_col}` {kind}, score double")


def keep_scored(df: DataFrame, text_col: str, score: Callable[[pa.Array], np.ndarray], least: float) -> DataFrame:
    """The rows of df, all columns, whose text scores at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, text_col):
            yield part.filter(pa.array(score(part.column(text_col)) >= least))

    return df.mapInArrow(run, df.schema)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

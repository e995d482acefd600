"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its distinct hashed words (values of one over the root of their number), statistics of its structure (case, signs,
digits, repeats, line and word lengths, ...; standardised on the training rows) and its length. Every feature has a weight and a vector of
`RANK` factors; the score adds the pairwise interactions of all features, in time linear in their number by the sum-of-squares identity:
sum over pairs <v_i, v_j> x_i x_j = half the sum over factors of ((sum v x)^2 - sum (v x)^2). Learnt by Adam on the logistic loss over at most
MOST_ROWS labelled rows (chosen by a hash of the id; all where there are fewer).

Defined results: a null or empty text has no words and the statistics of an empty text, and is scored like any other; repeated rows are scored each; without
any label, or with one label only, every score is that label's share (0.5 without labels); an empty table gives no rows; null labels are left out; a null
id is in no fold; extra columns are not read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm.common import table, word_hashes
from strataweave.llm.learn import Rows, collect_rows, fold, keep_scored, sample, sigmoid, with_score

MOST_ROWS = 16000
SPACE = 15  # bits of the hashed words
RANK = 8
STATS = ("upper", "lower", "digit", "mark", "symbol", "space", "upper_words", "marked_ends", "mixed_ends", "repeats", "lonely_marks", "distinct", "word_length", "word_spread", "log_words", "log_chars", "log_lines", "short_lines", "ended_lines", "question")

_UPPER, _LOWER, _DIGIT, _MARK, _SYMBOL, _SPACE = (1 << k for k in range(6))


def _classes() -> np.ndarray:
    """Class of every code point of the basic plane; others count as letters without case."""
    import unicodedata

    out = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        kind = unicodedata.category(chr(c))
        out[c] = {"Lu": _UPPER, "Ll": _LOWER, "Nd": _DIGIT}.get(kind, _SPACE if chr(c).isspace() else _MARK if chr(c) in ".,;:?!'\"-()" else _SYMBOL if kind[0] in "PS" else 0)
    return out


_TABLE: list[np.ndarray] = []


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def statistics(texts: pa.Array, words: np.ndarray, offsets: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """(texts, len(STATS)): shares and logarithms, all within a few units; zeros for an empty text."""
    if not _TABLE:
        _TABLE.append(_classes())
    strings = [t or "" for t in texts.to_pylist()]
    n = len(strings)
    chars = np.array([len(t) for t in strings], np.int64)
    bounds = np.concatenate([[0], np.cumsum(chars)])
    codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _TABLE[0][np.minimum(codes, 0xFFFF)]
    out = np.zeros((n, len(STATS)), np.float32)
    per_char = np.maximum(chars, 1)
    for k, bit in enumerate((_UPPER, _LOWER, _DIGIT, _MARK, _SYMBOL, _SPACE)):
        out[:, k] = _sums((kind & bit) > 0, bounds) / per_char
    # tokens: runs without white space; no token crosses from one text into the next
    solid = (kind & _SPACE) == 0
    edge = np.zeros(len(codes) + 1, bool)
    edge[bounds] = True
    starts = np.flatnonzero(solid & (edge[:-1] | ~np.concatenate([[False], solid[:-1]])))
    ends = np.flatnonzero(solid & (edge[1:] | ~np.concatenate([solid[1:], [False]])))
    tokens = np.searchsorted(starts, bounds)
    n_tokens = np.maximum(np.diff(tokens), 1)
    length = ends - starts + 1
    upper, lower, sign = (np.concatenate([[0], np.cumsum((kind & bit) > 0, dtype=np.int64)]) for bit in (_UPPER, _LOWER, _MARK | _SYMBOL))
    inside = lambda total: total[ends + 1] - total[starts]
    last = kind[ends] if len(ends) else kind[:0]
    twice = (length > 1) & ((kind[np.maximum(ends - 1, 0)] if len(ends) else kind[:0]) & (_MARK | _SYMBOL) > 0) & (last & (_MARK | _SYMBOL) > 0)
    for k, flags in (
        (6, (inside(upper) > 1) & (inside(lower) == 0)),
        (7, twice),
        (8, twice & (last & _SYMBOL > 0)),
        (10, inside(sign) == length),
        (12, length / 10),
        (13, (length / 10.0) ** 2),
    ):
        out[:, k] = np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.float64)])[tokens]) / n_tokens
    out[:, 13] = np.sqrt(np.maximum(0, out[:, 13] - out[:, 12] ** 2))
    n_words = np.diff(offsets)
    same = np.concatenate([words[1:] == words[:-1], [False]]) if len(words) else np.zeros(0, bool)
    out[:, 9] = _sums(same, offsets) / np.maximum(n_words, 1)
    out[:, 11] = distinct / np.maximum(n_words, 1)
    out[:, 14], out[:, 15] = np.log1p(n_words) / 5, np.log1p(chars) / 7
    newline = codes == 10
    lines = _sums(newline, bounds) + (chars > 0)
    out[:, 16] = np.log1p(lines) / 3
    at = np.flatnonzero(newline)
    before = np.maximum(at - 1, 0)
    own = np.searchsorted(bounds, at, side="right") - 1
    gap = at - np.maximum(np.concatenate([[0], at[:-1]]), bounds[own]) if len(at) else at
    out[:, 17] = np.bincount(own, gap < 30, n) / np.maximum(lines, 1)
    out[:, 18] = (np.bincount(own, kind[before] & _MARK > 0, n) + np.array([t[-1:] in tuple(".!?") for t in strings])) / np.maximum(lines, 1)
    out[:, 19] = _sums(codes == ord("?"), bounds) / n_tokens
    return out


def featurise(texts: pa.Array) -> Rows:
    """Distinct hashed words first, then the statistics (features from 2^SPACE on)."""
    words, offsets = word_hashes(texts)
    n = len(texts)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    key = np.unique((owner << SPACE) | (words >> np.uint64(64 - SPACE)).astype(np.int64))
    distinct = np.bincount(key >> SPACE, minlength=n)
    stats = statistics(texts, words, offsets, distinct)
    wide = distinct + len(STATS)
    bounds = np.concatenate([[0], np.cumsum(wide)])
    features, values = np.zeros(bounds[-1], np.int64), np.zeros(bounds[-1], np.float32)
    is_word = np.arange(bounds[-1]) - np.repeat(bounds[:-1], wide) < np.repeat(distinct, wide)
    features[is_word] = key & ((1 << SPACE) - 1)
    values[is_word] = (1 / np.sqrt(np.maximum(distinct, 1)))[key >> SPACE]
    features[~is_word] = np.tile((1 << SPACE) + np.arange(len(STATS)), n)
    values[~is_word] = stats.ravel()
    return Rows(features, values, bounds)


class Model:
    """A factorisation machine; statistics are standardised before use."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, share: float = 0.5):
        width = (1 << SPACE) + len(STATS)
        rng = np.random.default_rng(5)
        self.mean, self.spread, self.share, self.learnt = mean, spread, share, False
        self.bias, self.w = 0.0, np.zeros(width, np.float32)
        self.v = rng.normal(0, 0.01, (width, RANK)).astype(np.float32)

    def standard(self, rows: Rows) -> Rows:
        """Statistics in standard units, within 4, over the root of their number."""
        values, stat = rows.values.copy(), rows.features >= 1 << SPACE
        k = rows.features[stat] - (1 << SPACE)
        values[stat] = np.clip((values[stat] - self.mean[k]) / self.spread[k], -4, 4) / np.sqrt(len(STATS))
        return Rows(rows.features, values, rows.offsets)

    def raw(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """(score before the sigmoid, sums of v x by factor) of standardised rows, in one pass over their features."""
        x, starts = rows.values[:, None], rows.offsets[:-1]
        vx = self.v[rows.features] * x
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        linear = np.add.reduceat(self.w[rows.features] * rows.values, starts)
        return self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def score(self, texts: pa.Array) -> np.ndarray:
        if not self.learnt:
            return np.full(len(texts), self.share)
        return sigmoid(self.raw(self.standard(featurise(texts)))[0].astype(np.float64))


def train(rows: Rows, labels: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.02, decay: float = 1e-3) -> Model:
    stat = rows.features >= 1 << SPACE
    table = rows.values[stat].reshape(-1, len(STATS))
    share = float(labels.mean()) if len(labels) else 0.5
    model = Model(table.mean(axis=0) if len(table) else np.zeros(len(STATS)), table.std(axis=0) + 1e-3 if len(table) else np.ones(len(STATS)), share)
    if share in (0.0, 1.0) or not len(labels):
        return model
    rows, rng = model.standard(rows), np.random.default_rng(3)
    model.learnt, model.bias = True, float(np.log(share / (1 - share)))
    epochs = max(epochs, min(120, 3000 * batch // max(1, len(labels) * 4)))
    state = [np.zeros_like(model.w), np.zeros_like(model.w), np.zeros_like(model.v), np.zeros_like(model.v)]
    step, m_b, v_b = 0, 0.0, 0.0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in np.array_split(order, max(1, len(order) // batch)):
            part, y = rows.take(at), labels[at]
            z, sums = model.raw(part)
            step += 1
            g = ((sigmoid(z) - y) / len(at)).astype(np.float32)
            own = part.owners()
            gx = g[own] * part.values
            used, place = np.unique(part.features, return_inverse=True)
            gw = np.bincount(place, gx, len(used)).astype(np.float32) + decay * model.w[used] / len(at)
            each = gx[:, None] * (sums[own] - model.v[part.features] * part.values[:, None])
            gv = np.stack([np.bincount(place, each[:, f], len(used)) for f in range(RANK)], axis=1).astype(np.float32) + decay * model.v[used] / len(at)
            fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
            for (m, v), grad, param in ((state[:2], gw, model.w), (state[2:], gv, model.v)):
                m[used] = 0.9 * m[used] + 0.1 * grad
                v[used] = 0.999 * v[used] + 0.001 * grad**2
                param[used] -= rate * (m[used] / fix1) / (np.sqrt(v[used] / fix2) + 1e-6)
            gb = float(g.sum())
            m_b, v_b = 0.9 * m_b + 0.1 * gb, 0.999 * v_b + 0.001 * gb * gb
            model.bias -= rate * (m_b / fix1) / (np.sqrt(v_b / fix2) + 1e-6)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = MOST_ROWS) -> Model:
    """Learn from a bounded sample of the labelled texts."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label IS NOT NULL AND id IS NOT NULL")
    chosen = sample(marked.groupBy("id").agg(F.max("label").alias("label")), "id", most_rows, 4)
    rows, y = collect_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id"), "text", "label", featurise)
    return train(rows, y)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return with_score(docs, id_col, text_col, model.score)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.7) -> DataFrame:
    """The rows of docs that score at least `least`."""
    return keep_scored(docs, text_col, model.score, least)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.select("doc_id", "quality").where(fold("doc_id", 4) != 2))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))

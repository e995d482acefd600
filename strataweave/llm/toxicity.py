"""Toxicity: non-negative positive-unlabelled learning of a numpy classifier.

Confirmed toxic texts are the positives; unlabelled texts are a sample of all documents, whatever they hold. The risk of a linear classifier on
hashed features is estimated from both with the class prior (the share of toxic texts): prior * R+(positive) + max(0, R-(unlabelled) - prior *
R-(positive)). Where the second part turns negative the step goes against it (the non-negative correction), so that the classifier doesn't
learn its positives by heart. Features say which words, and beginnings of words of 4, 5 and 6 bytes, a whole text has; weights are kept
sparse (soft threshold), so that the many harmless words of a long text add nothing.

Training rows: at most MOST_POSITIVE positives and MOST_UNLABELLED unlabelled texts, chosen by a hash of the id; all rows where there are fewer.

Defined results: a null or wordless text scores what no evidence scores; repeated rows are scored each; without a positive label every score is 0;
an empty table gives no rows; null labels are no positives; a null id is in no fold and scored like any other; extra columns are not read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm.common import table, word_and_prefix_hashes
from strataweave.llm.learn import Rows, collect_rows, fold, keep_scored, sample, sigmoid, with_score

MOST_POSITIVE, MOST_UNLABELLED = 4000, 12000
SPACE = 20
PREFIXES = (4, 5, 6)
#: Features kept for training: those that the most positives have beyond their share.
CHOSEN = 4000


def _keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word and beginning of a word, repeats included."""
    words, short, offsets = word_and_prefix_hashes(texts, PREFIXES)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    owners, hashes = [owner], [words]
    for s in short:
        there = s != 0
        owners.append(owner[there])
        hashes.append(s[there])
    return np.concatenate(owners), (np.concatenate(hashes) >> np.uint64(64 - SPACE)).astype(np.int64)


def featurise(texts: pa.Array) -> Rows:
    owner, feature = _keys(texts)
    key = np.unique((owner << SPACE) | feature)
    offsets = np.searchsorted(key, np.arange(len(texts) + 1) << SPACE)
    return Rows(key & ((1 << SPACE) - 1), np.ones(len(key), np.float32), offsets)


class Model:
    """Sparse weights: score = sigmoid(bias + sum of the weights of the features that a text has)."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float, empty: bool = False):
        self.features, self.weights, self.bias, self.empty = features, weights.astype(np.float64), float(bias), empty

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.empty:
            return np.zeros(len(texts))
        table = np.zeros(1 << SPACE, np.int32)
        table[self.features] = np.arange(1, len(self.features) + 1)
        owner, feature = _keys(texts)
        place = table[feature]
        known = place > 0
        key = np.unique(owner[known] * (len(self.features) + 1) + place[known])
        z = np.bincount(key // (len(self.features) + 1), self.weights[key % (len(self.features) + 1) - 1], len(texts)) + self.bias
        return sigmoid(z)


def nnpu(positive: Rows, unlabelled: Rows, width: int, prior: float, rounds: int = 300, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk (logistic loss; Adam, with a soft threshold on the weights)."""
    w, b = np.zeros(width), np.log(prior / (1 - prior))
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    p_own, u_own = positive.owners(), unlabelled.owners()
    n_p, n_u = max(1, len(positive)), max(1, len(unlabelled))
    sparse = 0.012 * n_p**-0.5  # as large as the gradient that chance gives a feature
    for t in range(1, rounds + 1):
        zp = np.bincount(p_own, w[positive.features], len(positive)) + b
        zu = np.bincount(u_own, w[unlabelled.features], len(unlabelled)) + b
        sp, su = sigmoid(zp), sigmoid(zu)
        negative = np.logaddexp(0, zu).sum() / n_u - prior * np.logaddexp(0, zp).sum() / n_p
        g_plus, g_u, g_p = prior * (sp - 1) / n_p, su / n_u, -prior * sp / n_p  # of R+(positive), R-(unlabelled), -prior R-(positive)
        gp, gu = (g_plus + g_p, g_u) if negative >= 0 else (-g_p, -g_u)
        grad = np.bincount(positive.features, gp[p_own], width) + np.bincount(unlabelled.features, gu[u_own], width)
        grad_b = gp.sum() + gu.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2, 0.9 * mb + 0.1 * grad_b, 0.999 * vb + 0.001 * grad_b**2
        step = rate / (1 - 0.9**t)
        scale = np.sqrt(v / (1 - 0.999**t)) + 1e-5
        w = w - step * m / scale
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * sparse / scale)
        b -= step * mb / (np.sqrt(vb / (1 - 0.999**t)) + 1e-5)
    return w, b


def train(positive: Rows, unlabelled: Rows, prior: float) -> Model:
    """Choose the features that tell, then learn their weights."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(0, np.int64), np.zeros(0), 0, empty=True)
    in_p, in_u = (np.bincount(x.features, minlength=1 << SPACE) for x in (positive, unlabelled))
    share_p, share_u = (in_p + 0.1) / (len(positive) + 1), (in_u + 0.1) / (len(unlabelled) + 1)
    gain = np.where(in_p >= 2, in_p * np.log(share_p / share_u), 0)
    chosen = np.argsort(-gain, kind="stable")[:CHOSEN]
    chosen = np.sort(chosen[gain[chosen] > 0])
    place = np.full(1 << SPACE, -1)
    place[chosen] = np.arange(len(chosen))

    def only(rows: Rows) -> Rows:
        at = place[rows.features]
        before = np.concatenate([[0], np.cumsum(at >= 0)])
        return Rows(at[at >= 0], rows.values[at >= 0], before[rows.offsets])

    w, b = nnpu(only(positive), only(unlabelled), len(chosen), min(0.9, max(1e-3, prior)))
    used = w != 0
    return Model(chosen[used], w[used], b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", prior: float | None = None, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """Learn from the texts labelled 1 and from unlabelled texts; prior: the share of label 1 among the labels where not given."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label IS NOT NULL AND id IS NOT NULL")
    if prior is None:
        prior = marked.agg(F.avg("label")).first()[0] or 0.0
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = sample(marked.where("label = 1").select("id").distinct(), "id", most_positive, 1)
    positive, _ = collect_rows(texts.join(F.broadcast(chosen), "id"), "text", None, featurise)
    unlabelled, _ = collect_rows(sample(texts, "id", most_unlabelled, 2), "text", None, featurise)
    return train(positive, unlabelled, prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return with_score(docs, id_col, text_col, model.score)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs that score below least."""
    return keep_scored(docs, text_col, lambda texts: -model.score(texts), np.nextafter(-least, 0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs.where(fold("doc_id", 5) != 0), labels.select("doc_id", "toxic").where(fold("doc_id", 5) != 0))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

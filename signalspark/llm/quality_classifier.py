"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled texts, with a class prior, minimise the non-negative unbiased risk of a linear model
over measures of style. The model is fitted on bounded samples of rows; every text is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NOT_WHITE, Words, beside, bounded_ids, one_text_each, slices, struct, utf8

#: Byte classes whose share of the words is a measure.
CLASSES = (b"#$%&*@^~`", b"|<>{}[]\\/_=+", b"!?", b".", b",;:", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(0xC2, 0xF5)))
_CLASS = np.full(256, len(CLASSES), np.uint8)
for _i, _bytes in enumerate(CLASSES):
    _CLASS[list(_bytes)] = _i
N_MEASURES = len(CLASSES) + 6


def style(texts: list[bytes]) -> np.ndarray:
    """The measures of each text: byte classes for each word, repeats of the words just before, lengths; 0 if empty."""
    words = Words(texts, NOT_WHITE)
    n = words.counts()
    per_word = np.maximum(n, 1)
    k = len(CLASSES) + 1
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    of_byte = np.repeat(np.arange(len(texts)) * k, lengths) + _CLASS[words.buf]
    counts = np.bincount(of_byte, minlength=len(texts) * k).reshape(-1, k)[:, : len(CLASSES)]
    hashes = words.hashes()

    def same_as(back: int) -> np.ndarray:
        again = (hashes[back:] == hashes[:-back]) & (words.row[back:] == words.row[:-back])
        return np.bincount(words.row[back:][again], minlength=len(texts))

    size = np.bincount(words.row, weights=words.end - words.start, minlength=len(texts))
    lines = np.fromiter((t.count(b"\n") + 1 for t in texts), np.int64, len(texts))
    letters = np.maximum(counts[:, 6] + counts[:, 7], 1)
    columns = [*np.sqrt(counts / per_word[:, None]).T, np.sqrt(same_as(1) / per_word), np.sqrt(same_as(2) / per_word), np.log1p(n) / 5, size / per_word / 10, np.sqrt(lines / per_word), counts[:, 6] / letters]
    return np.stack(columns, axis=1)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = 1500, rate: float = 0.03, decay: float = 1e-4) -> Model:
    """Minimises prior * E+[loss] + max(0, Eu[loss as negative] - prior * E+[loss as negative]) with logistic loss.

    Where the second term falls below zero it is raised again, which is what keeps it from overfitting.
    Without positives or unlabelled rows every text scores the prior.
    """
    n = unlabelled.shape[1] if unlabelled.size else N_MEASURES
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(n), np.ones(n), np.zeros(n), float(np.log(prior / (1 - prior))))
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    p, u = (np.hstack((x, np.ones((len(x), 1)))) for x in (p, u))
    w = np.zeros(n + 1)
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        gp, gu = np.clip(p @ w, -30, 30), np.clip(u @ w, -30, 30)
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        d_negative = su @ u / len(u) - prior * (sp @ p) / len(p)
        grad = -d_negative if negative < 0 else prior * ((sp - 1) @ p) / len(p) + d_negative
        grad = grad + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, w[:-1], float(w[-1]))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def style_of(texts: pa.Array) -> pa.Array:
    rows = [r for part in slices(texts) for r in style(part)]
    return pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))


def _measured(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """The measures of one document for each of a bounded set of ids; only these numbers reach the driver."""
    chosen = one_text_each(docs, ids, id_col, text_col).select(id_col, style_of(F.col("raw")).alias("x"))
    rows = chosen.toArrow().sort_by(id_col)["x"].to_pylist()
    return np.array(rows).reshape(-1, N_MEASURES)


def train(docs: DataFrame, labels: DataFrame, *, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_positive: int = 6000, max_unlabelled: int = 12000) -> Model:
    """A model from rows where `learn_from` (over the id) holds.

    Trusted positives are at most max_positive ids with label 1 (an id labelled twice counts as 1 if it ever is); the
    unlabelled texts are at most max_unlabelled ids, whatever their label; the class prior is the share of label 1 among
    all labelled rows learned from. An id of several documents counts with one text (the one of least hash).
    """
    known = labels.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{label_col}`").alias("label")).filter(learn_from & F.col("label").isNotNull())
    prior = known.select(F.avg(F.col("label").cast("double"))).first()[0]
    prior = min(max(prior if prior is not None else 0.5, 0.01), 0.99)
    few = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias(text_col))
    positive = _measured(few, bounded_ids(known.filter("label = 1").select(id_col), id_col, max_positive), id_col, text_col)
    unlabelled = _measured(few, bounded_ids(few.select(id_col).filter(learn_from), id_col, max_unlabelled), id_col, text_col)
    return fit(positive, unlabelled, prior)


def scored(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """docs plus score (0 to 1; higher: label 1 likelier) and predicted (1 if score >= 0.5).

    Null and empty texts are scored as texts without words. Rows are scored by themselves. Columns named score or
    predicted are replaced. An empty table gives an empty table.
    """

    @F.arrow_udf("struct<score: double>")
    def of(texts: pa.Array) -> pa.Array:
        found = [model.scores(style(part)) for part in slices(texts)]
        return struct(score=pa.array(np.concatenate([*found, np.zeros(0)]), pa.float64()))

    rows, own = beside(docs, ("score", "predicted"), of(utf8(F.col(f"`{text_col}`"))))
    out = rows.select(*own, F.col("value.score").alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))

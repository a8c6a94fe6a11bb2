"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words and word beginnings, hashed. Besides a weight for each term, the machine learns a
short vector for each, whose products weigh pairs of terms in one text. It is fitted on a bounded sample of labelled
rows; every text is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FOLD, Words, beside, bounded_ids, byte_class, one_text_each, slices, struct, utf8

#: Words are runs of ASCII letters, digits and bytes of other code points.
WORD = byte_class(without=bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Hash buckets; how many bytes the beginnings of words have.
BUCKETS, BEGINNINGS = 1 << 20, (4, 5, 6, 7)


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and of the beginnings of every longer word, repeats included."""
    words = Words(texts, WORD, FOLD)
    rows, hashes = [words.row], [words.hashes()]
    for size in BEGINNINGS:
        longer = np.flatnonzero(words.end - words.start > size)
        start = words.start[longer]
        rows.append(words.row[longer])
        hashes.append(words.hashes(start, start + size) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return np.concatenate(rows), (np.concatenate(hashes) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass(frozen=True)
class Machine:
    """column: for each bucket its column, or -1; then a weight and a vector for each column."""

    column: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        row, bucket = terms(texts)
        column = self.column[bucket]
        known = column >= 0
        both = np.unique(row[known] * np.int64(len(self.weights) + 1) + column[known])
        row, column = both // (len(self.weights) + 1), both % (len(self.weights) + 1)
        z = self.logits(row, column, len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def logits(self, row: np.ndarray, column: np.ndarray, n: int) -> np.ndarray:
        z = self.bias + np.bincount(row, weights=self.weights[column], minlength=n)
        for v in self.vectors.T:
            total = np.bincount(row, weights=v[column], minlength=n)
            z += (total**2 - np.bincount(row, weights=v[column] ** 2, minlength=n)) / 2
        return z


def select(row: np.ndarray, bucket: np.ndarray, label: np.ndarray, least: int = 3, gain: float = 12.0) -> np.ndarray:
    """All buckets whose presence in a text tells something about its label: chi-squared over `gain`, and in `least` texts
    or more. The others keep weight 0: as columns of their own they learn the labels' noise by heart."""
    n, ones = len(label), label.sum()
    present = np.bincount(bucket, minlength=BUCKETS).astype(float)
    with_one = np.bincount(bucket, weights=label[row], minlength=BUCKETS)
    spread = present * (n - present) * ones * (n - ones)
    told = np.where(spread > 0, n * (n * with_one - present * ones) ** 2 / np.maximum(spread, 1), 0)
    return np.flatnonzero((told > gain) & (present >= min(least, max(1, ones))))


def fit(row: np.ndarray, bucket: np.ndarray, label: np.ndarray, *, rank: int = 4, steps: int = 160, rate: float = 0.05, decay: float = 2e-5, gain: float = 12.0, least: int = 3) -> Machine:
    """Logistic loss by Adam over all rows, the best of its steps on every eighth row, which isn't learned from.

    row, bucket: the distinct terms of each text. Without both labels every text scores the share of ones.
    """
    share = np.clip(label.mean() if len(label) else 0.5, 0.01, 0.99)
    start = float(np.log(share / (1 - share)))
    chosen = select(row, bucket, label, least, gain) if 0 < label.sum() < len(label) else np.zeros(0, np.int64)
    column = np.full(BUCKETS, -1, np.int32)
    column[chosen] = np.arange(len(chosen))
    rng = np.random.default_rng(11)
    w, v = np.zeros(len(chosen)), rng.normal(0, 0.01, (len(chosen), rank))
    if not len(chosen):
        return Machine(column, start, np.zeros(1), np.zeros((1, rank)))
    known = column[bucket] >= 0
    row, col = row[known], column[bucket[known]]
    aside = np.arange(len(label)) % 8 == 7 if len(label) >= 400 else np.zeros(len(label), bool)
    best, held = (np.inf, None), None
    params = [np.array([start]), w, v]
    moment = [[np.zeros_like(x), np.zeros_like(x)] for x in params]
    for t in range(1, steps + 1):
        machine = Machine(column, float(params[0][0]), params[1], params[2])
        z = np.clip(machine.logits(row, col, len(label)), -30, 30)
        loss = np.logaddexp(0, z) - label * z
        judged = loss[aside].mean() if aside.any() else loss.mean()
        if judged < best[0]:
            best, held = (judged, t), [x.copy() for x in params]
        error = np.where(aside, 0, 1 / (1 + np.exp(-z)) - label) / max(1, (~aside).sum())
        at = error[row]
        grads = [np.array([error.sum()]), np.bincount(col, weights=at, minlength=len(chosen)) + decay * params[1], np.empty_like(params[2])]
        for f in range(rank):
            vf = params[2][:, f]
            total = np.bincount(row, weights=vf[col], minlength=len(label))
            grads[2][:, f] = np.bincount(col, weights=at * (total[row] - vf[col]), minlength=len(chosen)) + decay * vf
        for x, g, (m, s) in zip(params, grads, moment, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return Machine(column, float(held[0][0]), held[1], held[2])


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def terms_of(texts: pa.Array) -> pa.Array:
    out = []
    for part in slices(texts):
        row, bucket = terms(part)
        both = np.unique(row * np.int64(BUCKETS) + bucket)
        out += [x.tolist() for x in np.split(both % BUCKETS, np.searchsorted(both // BUCKETS, np.arange(1, len(part))))]
    return pa.array(out, pa.list_(pa.int32()))


def train(docs: DataFrame, labels: DataFrame, *, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 12000, **params) -> Machine:
    """A machine from at most max_rows labelled ids where `learn_from` (over the id) holds.

    An id labelled twice counts as 1 if it ever is; an id of several documents counts with one text (the one of least
    hash). Of all hashed terms those learn that tell something about the label (see select); however many they are.
    """
    known = labels.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{label_col}`").alias("label")).filter(learn_from & F.col("label").isNotNull())
    few = bounded_ids(known, id_col, max_rows)
    label_of = known.join(F.broadcast(few), id_col, "left_semi").groupBy(id_col).agg(F.max("label").alias("label"))
    rows = one_text_each(docs, few, id_col, text_col).join(F.broadcast(label_of), id_col)
    found = rows.select(id_col, "label", terms_of(F.col("raw")).alias("terms")).toArrow().sort_by(id_col).combine_chunks()
    label = found["label"].to_numpy().astype(float)
    lists = found["terms"].combine_chunks() if found.num_rows else pa.array([], pa.list_(pa.int32()))
    row = np.repeat(np.arange(len(label)), np.diff(lists.offsets.to_numpy())) if found.num_rows else np.zeros(0, np.int64)
    return fit(row, lists.flatten().to_numpy().astype(np.int64), label, **params)


def scored(docs: DataFrame, machine: Machine, *, text_col: str = "text") -> DataFrame:
    """docs plus score (0 to 1; higher: toxic likelier) and predicted (1 if score >= 0.5).

    Null and empty texts have no terms. Rows are scored by themselves. Columns named score or predicted are replaced.
    An empty table gives an empty table.
    """

    @F.arrow_udf("struct<score: double>")
    def of(texts: pa.Array) -> pa.Array:
        found = [machine.scores(part) for part in slices(texts)]
        return struct(score=pa.array(np.concatenate([*found, np.zeros(0)]), pa.float64()))

    rows, own = beside(docs, ("score", "predicted"), of(utf8(F.col(f"`{text_col}`"))))
    out = rows.select(*own, F.col("value.score").alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))

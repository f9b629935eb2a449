"""Quality classification by supervised subword embeddings.

Hashed words and character n-grams have learned vectors; a document is the
average of its vectors, and a softmax over two outputs gives its class. Both
layers are trained by stochastic gradient descent in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytehash as B
from .sampling import labelled_sample

#: log2 of the number of vectors, their length, lengths of character n-grams in bytes, sampled rows of each class.
BITS, DIM, SIZES, ROWS_PER_CLASS = 17, 10, (3, 4), 2000
#: Texts up to this many bytes are handled together.
SLICE = 1 << 18
#: The vector of a repeated word.
REPEAT = 0
_U = np.uint64


@dataclass
class Model:
    vectors: np.ndarray
    output: np.ndarray  # 2 x DIM

    def by_feature(self) -> np.ndarray:
        """What each feature adds to the difference of the outputs: averaging is linear, so the two layers can be multiplied beforehand."""
        return (self.vectors @ (self.output[1] - self.output[0])).astype(np.float32)


def _features(raw: np.ndarray, off: np.ndarray, i: int, j: int):
    """Lists of (features, index of each row's first one (n + 1)): words, then character n-grams.

    n-grams lie within a word with the blanks at its sides as its borders;
    case and punctuation count.
    """
    a = int(off[i])
    data, at = raw[a : off[j]], off[i : j + 1] - a
    n = len(data)
    space = B.SPACE[data]
    data = np.where(space, np.uint8(32), data)
    c = B.prefix_sums(data)
    _, inv = B._powers(n + 1)
    shift = _U(64 - BITS)
    starts, ends, first = B.word_spans(data, at)
    words = B.span_hashes(c, starts, ends)
    out = [((words >> shift).astype(np.int32), first)]
    # A word that repeats the one before it is a token of its own: repetition has no n-gram in common.
    fresh = np.ones(len(words) + 1, dtype=bool)
    fresh[1:-1] = words[1:] != words[:-1]
    fresh[first] = True
    again = np.flatnonzero(~fresh)
    out.append((np.full(len(again), REPEAT, dtype=np.int32), np.searchsorted(again, first)))
    owner_end = np.repeat(at[1:], np.diff(at))
    blanks = np.concatenate([[0], np.cumsum(space)])
    for size in SIZES:
        if n < size:
            continue
        p = np.flatnonzero((blanks[size - 1 : n] == blanks[1 : n - size + 2]) & (np.arange(n - size + 1) + size <= owner_end[: n - size + 1]))
        h = (c[p + size] - c[p]) * inv[p]
        h ^= h >> _U(32)
        h *= _U(0xB5297A4D3F84D5B5 + 2 * size)
        out.append(((h >> shift).astype(np.int32), np.searchsorted(p, at)))
    return out


def train(labels: np.ndarray, texts: pa.Array, epochs: int = 4, rate: float = 0.5) -> Model:
    """Plain SGD with a falling rate; the rows of the rarer class weigh more, up to equal shares."""
    raw, off = B.buffers(texts)
    rows = []
    for k in range(len(texts)):
        index, n = np.unique(np.concatenate([f for f, _ in _features(raw, off, k, k + 1)]), return_counts=True)
        rows.append((index, (n / max(n.sum(), 1)).astype(np.float32)))
    rng = np.random.default_rng(5)
    vectors = ((rng.random((1 << BITS, DIM), dtype=np.float32)) - 0.5) / DIM
    output = np.zeros((2, DIM), dtype=np.float32)
    weight = len(labels) / (2 * np.maximum(np.bincount(labels, minlength=2), 1))
    steps, total = 0, epochs * len(rows)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            index, x = rows[k]
            lr = rate * (1 - steps / total)
            steps += 1
            hidden = x @ vectors[index]
            logits = output @ hidden
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[k]] -= 1
            p *= weight[labels[k]]
            back = output.T @ p
            output -= lr * np.outer(p, hidden)
            vectors[index] -= lr * len(index) ** 0.5 * x[:, None] * back
    return Model(vectors, output)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", learn_from: Column | None = None) -> Model | None:
    """A model from a bounded sample of the rows labelled 0 or 1 for which ``learn_from`` holds; None without any."""
    usable = labels.where(F.col(label_col).isin(0, 1))
    table, _ = labelled_sample(docs, id_col, text_col, usable.where(learn_from) if learn_from is not None else usable, label_col, ROWS_PER_CLASS)
    if not table.num_rows:
        return None
    return train(table.column("label").to_numpy().astype(int), table.column("text"))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score double in 0..1), one row per row of ``docs``; the score is the softmax output of label 1.

    Cases: null and empty texts, and all texts without a model, score 0.5.
    Texts are read whole. Rows are independent, so repeats, null ids and empty
    tables need no care; other columns are ignored.
    """
    dtype = dict(docs.select(id_col).dtypes)[id_col]
    if model is None:
        return docs.select(id_col, F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model.by_feature())

    def run(batches):
        gain = shared.value
        for b in batches:
            raw, off = B.buffers(b.column(0))
            off, owner = B.segments(raw, off)
            total, count = np.zeros(len(owner)), np.zeros(len(owner))
            for i, j in B.slices(off, SLICE):
                for f, r in _features(raw, off, i, j):
                    full = np.flatnonzero(np.diff(r))
                    if len(full):
                        total[i + full] += np.add.reduceat(gain[f].astype(np.float64), r[:-1][full])
                        count[i + full] += np.diff(r)[full]
            total, count = (np.bincount(owner, x, b.num_rows) for x in (total, count))
            p = 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(p)], names=["__id", "score"])

    rows = docs.select(F.col(text_col).alias("__text"), F.col(id_col).alias("__id"))
    return rows.mapInArrow(run, f"__id {dtype}, score double").withColumnRenamed("__id", id_col)

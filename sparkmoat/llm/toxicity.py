"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words also count by their stems (first letters), so that a compound or an
inflected form not met in training is still recognised.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytehash as B
from .sampling import labelled_sample

#: log2 of the number of hashed features.
BITS = 20
#: Bytes that make a stem.
STEMS = (4, 5)
_U = np.uint64
_SEED = (_U(0x243F6A8885A308D3), _U(0x13198A2E03707344), _U(0xA4093822299F31D0))


@dataclass
class SparseWeights:
    """What training leaves: the features with a weight other than 0, and a constant."""

    index: np.ndarray
    value: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS, dtype=np.float32)
        w[self.index] = self.value
        return w


def _features(raw: np.ndarray, off: np.ndarray, i: int, j: int):
    """(row, feature) of all unigrams, bigrams and skip-grams with one word between, of rows i..j."""
    h, at, *stems = B.hash_words(raw, off, i, j, sep=B.PUNCT, stems=STEMS)
    row = np.repeat(np.arange(j - i), np.diff(at))
    shift = _U(64 - BITS)
    rows, feats = [row] * (1 + len(STEMS)), [B.mix(x ^ _SEED[0] + _U(k)) >> shift for k, x in enumerate([h, *stems])]
    for gap in (1, 2):
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            rows.append(row[gap:][same])
            feats.append(B.mix(h[:-gap][same] * _SEED[gap] + h[gap:][same]) >> shift)
    return np.concatenate(rows), np.concatenate(feats).astype(np.int64)


def train(labels: np.ndarray, texts: pa.Array, weights: np.ndarray, epochs: int = 5, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1) -> SparseWeights:
    """FTRL-proximal with per-coordinate rates; a feature counts once a text. weights: importance of each row."""
    raw, off = B.buffers(texts)
    rows = []
    for i, j in B.slices(off, B.PART):
        r, f = _features(raw, off, i, j)
        key = np.unique(r * (1 << BITS) + f)
        rows += np.split((key & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(key >> BITS, np.arange(1, j - i)))
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = bias = 0.0
    rng = np.random.default_rng(7)

    def weight(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            f, y = rows[k], labels[k]
            w = weight(z[f], n[f])
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30)))
            g = (p - y) * weights[k]
            s = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha
            z[f] += g - s * w
            n[f] += g * g
            sb = (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha
            zb += g - sb * bias
            nb += g * g
            bias = -zb / ((beta + np.sqrt(nb)) / alpha)
    met = np.flatnonzero(n)
    w = weight(z[met], n[met])
    return SparseWeights(met[w != 0].astype(np.int32), w[w != 0].astype(np.float32), float(bias))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", learn_from: Column | None = None) -> SparseWeights | None:
    """Weights from a bounded sample of the labelled rows for which ``learn_from`` holds; None without any.

    Labels are 0 and 1; others and null are left out. The rarer label may be
    drawn more often; rows are weighted so that the sample stands for all.
    """
    usable = labels.where(F.col(label_col).isin(0, 1))
    table, totals = labelled_sample(docs, id_col, text_col, usable.where(learn_from) if learn_from is not None else usable, label_col)
    if not table.num_rows:
        return None
    y = table.column("label").to_numpy().astype(float)
    share = np.array([totals.get(v, 0) / max((y == v).sum(), 1) for v in (0, 1)])
    share /= share.max()
    return train(y, table.column("text"), share[y.astype(int)])


def score_of(docs: DataFrame, model: SparseWeights | None, text_col: str = "text") -> Column:
    """The score (double in 0..1) of each row of ``docs`` as a column. Only the text goes to Python; null and empty texts have the constant alone, and without a model every score is 0."""
    if model is None:
        return F.lit(0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        return pa.array(scores(shared.value, text))

    return scored(F.col(text_col))


def scores(model: SparseWeights, text: pa.Array) -> np.ndarray:
    """The score of each text, from parts of B.PART bytes: several arrays of numbers are made for each byte and word."""
    dense = _dense(model)
    raw, off = B.buffers(text)
    sums = np.zeros(len(text))
    for i, j in B.slices(off, B.PART):
        r, f = _features(raw, off, i, j)
        hit = np.flatnonzero(dense[f])
        key = np.unique(r[hit] * (1 << BITS) + f[hit])
        sums[i:j] = np.bincount(key >> BITS, weights=dense[key & ((1 << BITS) - 1)], minlength=j - i)
    return 1 / (1 + np.exp(-np.clip(sums + model.bias, -30, 30)))


def _dense(model: SparseWeights) -> np.ndarray:
    """The weights by feature, made once for a model."""
    if getattr(model, "made", None) is None:
        model.made = model.dense()
    return model.made


def score(docs: DataFrame, model: SparseWeights | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, out_col: str = "score") -> DataFrame:
    """(id_col, out_col double in 0..1), one row per row of ``docs``; ``keep`` names columns to carry instead of the id alone.

    Cases: see ``score_of``. Rows are independent, so repeats, null ids and
    empty tables need no care; columns that aren't asked for are ignored.
    """
    names = keep or [id_col]
    if out_col in names:
        raise ValueError(f"out_col {out_col!r} is a column of the table; name another")
    return docs.select(*names, score_of(docs, model, text_col).alias(out_col))

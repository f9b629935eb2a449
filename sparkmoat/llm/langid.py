"""Language identification by error-correcting output codes over character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytehash as B
from .sampling import labelled_sample

#: log2 of the number of hashed n-grams; lengths of n-grams in bytes.
BITS, SIZES = 15, (2, 3, 4)
#: Texts up to this many bytes are handled together.
SLICE = 1 << 18
#: Rows sampled for each language.
ROWS_PER_LANGUAGE = 1500
#: Under this lead of the nearest codeword over the next, a prediction is ambiguous.
LEAD = 0.25
_U = np.uint64


def codewords(classes: int, seed: int = 11) -> np.ndarray:
    """A matrix of -1 and 1, a row for each class: all distinct columns if there are few classes, else random ones with a large least distance."""
    if classes < 2:
        return np.ones((classes, 1))
    if classes <= 6:
        bits = 2 ** (classes - 1) - 1
        columns = [[1 if k == 0 else (1 if (c >> (k - 1)) & 1 else -1) for k in range(classes)] for c in range(bits)]
        return np.array(columns, dtype=float).T
    bits, rng, best, most = int(np.ceil(10 * np.log2(classes))), np.random.default_rng(seed), None, -1
    for _ in range(100):
        code = rng.choice([-1.0, 1.0], (classes, bits))
        apart = (bits - code @ code.T) / 2
        np.fill_diagonal(apart, bits)
        useful = (np.abs(code.sum(axis=0)) < classes).all()
        if useful and apart.min() > most:
            best, most = code, apart.min()
    return best if best is not None else code


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # n-grams x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit, summing to 1


def _grams(raw: np.ndarray, off: np.ndarray, i: int, j: int):
    """(bin of each n-gram, index of each row's first one (n + 1)), sizes after one another in each row."""
    a = int(off[i])
    data, at = B.LOWER[raw[a : off[j]]], off[i : j + 1] - a
    data = np.where(B.SPACE[data], np.uint8(32), data)
    n = len(data)
    c = B.prefix_sums(data)
    _, inv = B._powers(n + 1)
    owner_end = np.repeat(at[1:], np.diff(at))  # end of the row of each position
    place = np.arange(n)
    rows, bins = [], []
    for size in SIZES:
        if n < size:
            continue
        p = place[: n - size + 1]
        p = p[p + size <= owner_end[: n - size + 1]]
        h = (c[p + size] - c[p]) * inv[p]
        h ^= h >> _U(32)
        h *= _U(0x9E6C63D0876A9A47 + 2 * size)
        bins.append((h >> _U(64 - BITS)).astype(np.int32))
        rows.append(np.searchsorted(p, at))
    return bins, rows


def _row_margins(model_w: np.ndarray, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Mean weight of each row's n-grams, rows x bits."""
    n = len(off) - 1
    off, owner = B.segments(raw, off)
    out, count = np.zeros((len(owner), model_w.shape[1]), dtype=np.float64), np.zeros(len(owner))
    for x, y in B.slices(off, SLICE):
        bins, rows = _grams(raw, off, x, y)
        for b, r in zip(bins, rows):
            full = np.flatnonzero(np.diff(r))
            if len(full):
                out[x + full] += np.add.reduceat(model_w[b], r[:-1][full], axis=0)
                count[x + full] += np.diff(r)[full]
    if len(owner) > n:
        count = np.bincount(owner, count, n)
        out = np.stack([np.bincount(owner, c, n) for c in out.T], axis=1)
    return out / np.maximum(count, 1)[:, None]


def train(languages: list[str], labels: np.ndarray, texts: pa.Array, epochs: int = 4, rate: float = 2.0) -> Model:
    """A logistic classifier for each bit of the codewords, by stochastic steps with AdaGrad rates. labels: indices into languages."""
    code = codewords(len(languages))
    bits = code.shape[1]
    raw, off = B.buffers(texts)
    rows = []
    for k in range(len(texts)):
        bins, _ = _grams(raw, off, k, k + 1)
        index, n = np.unique(np.concatenate(bins), return_counts=True) if bins else (np.zeros(0, np.int32), np.zeros(0))
        rows.append((index, (n / max(n.sum(), 1)).astype(np.float64)))
    w, g2, bias = np.zeros((1 << BITS, bits)), np.full((1 << BITS, bits), 1e-6), np.zeros(bits)
    share = len(labels) / (len(languages) * np.maximum(np.bincount(labels, minlength=len(languages)), 1))
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            index, x = rows[k]
            y = code[labels[k]]
            g = -y / (1 + np.exp(np.clip(y * (x @ w[index] + bias), -30, 30))) * share[labels[k]]
            grad = x[:, None] * g
            g2[index] += grad * grad
            w[index] -= rate * grad / np.sqrt(g2[index])
            bias -= 0.01 * g
    got = np.array([x @ w[i] + bias for i, x in rows]).reshape(len(rows), bits)
    right = (np.sign(got) == code[labels]).mean(axis=0) if len(rows) else np.ones(bits)
    trust = np.maximum(right - 0.5, 1e-3)
    return Model(languages, code, w.astype(np.float32), bias, trust / trust.sum())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn_from: Column | None = None) -> Model | None:
    """A model from about ROWS_PER_LANGUAGE rows of each language for which ``learn_from`` holds; None without any."""
    usable = docs.where(learn_from) if learn_from is not None else docs
    table, _ = labelled_sample(docs, id_col, text_col, usable.select(id_col, lang_col), lang_col, ROWS_PER_LANGUAGE)
    if not table.num_rows:
        return None
    names = table.column("label").to_pylist()
    languages = sorted(set(names))
    return train(languages, np.array([languages.index(x) for x in names]), table.column("text"))


def decode(margins: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss-weighted decoding: (nearest codeword, its probability, whether it is ambiguous)."""
    loss = np.log1p(np.exp(-np.clip(margins[:, None, :] * model.code[None], -30, 30))) @ model.trust
    order = np.argsort(loss, axis=1, kind="stable")
    best = order[:, 0]
    p = np.exp(-len(model.trust) * (loss - loss.min(axis=1, keepdims=True)))
    p = 1 / p.sum(axis=1)
    lead = np.full(len(loss), np.inf) if loss.shape[1] < 2 else np.take_along_axis(loss, order[:, 1:2], 1)[:, 0] - loss.min(axis=1)
    return best, p, lead < LEAD


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score double in 0..1, ambiguous), one row per row of ``docs``.

    Cases: a null text, and one without any letter, is ``und`` with score 0
    and not ambiguous; without a model all are. Texts are read whole. Rows are
    independent, so repeats, null ids, ties (the language that comes first by
    name) and empty tables need no care; other columns are ignored.
    """
    dtype = dict(docs.select(id_col).dtypes)[id_col]
    nothing = [F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous")]
    if model is None:
        return docs.select(id_col, *nothing)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        names = np.array([*model.languages, "und"], dtype=object)
        for b in batches:
            raw, off = B.buffers(b.column(0))
            letter = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            m = _row_margins(model.weights, raw, off) + model.bias
            best, p, unsure = decode(m, model)
            best, p, unsure = np.where(letter, best, len(model.languages)), np.where(letter, p, 0.0), unsure & letter
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(names[best].tolist(), pa.string()), pa.array(p), pa.array(unsure)], names=["__id", "lang_pred", "score", "ambiguous"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(text.alias("__text"), text.rlike("\\p{L}").alias("__letter"), F.col(id_col).alias("__id"))
    return rows.mapInArrow(run, f"__id {dtype}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("__id", id_col)

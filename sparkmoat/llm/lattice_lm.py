"""Language-model scores by a subword lattice: the probability of a text summed over all its segmentations.

The pieces are those of an existing vocabulary, and its scores weight their
first use; two rounds of expectation-maximisation over the training documents'
word counts turn them into probabilities. A word, with the mark of its start,
is a lattice whose edges are the pieces that fit; the forward recursion in log
space sums over all paths. Single bytes are pieces, so every text has one.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytehash as B
from .scratch import Scratch

#: The mark of a word's start in the vocabulary.
START = "▁".encode()
#: Most words whose counts are sent to every executor; the others are joined.
FREQUENT = 1 << 17
#: Words counted together in a task and the bytes of text that they come from, words of one lattice batch, bytes of a word up to which words are handled together.
REMEMBERED, READ, TOGETHER, SHORT = 200_000, 1 << 26, 20_000, 48
ROUNDS, SMOOTH = 2, 0.05
_U = np.uint64


@dataclass
class Pieces:
    """A vocabulary: its pieces as bytes, single bytes included, and the natural log of their weights; the end of a text comes last."""

    pieces: list[bytes]
    logp: np.ndarray

    def prepare(self) -> "Lattice":
        return Lattice(self)


def read_pieces(model_file: str) -> Pieces:
    """The pieces of a sentencepiece model. Ranks stand as negative scores in a BPE model: they weight pieces as 1 / (1 + rank)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    weight: dict[bytes, float] = {}
    scores = [sp.get_score(i) for i in range(sp.get_piece_size())]
    ranks = min(scores) < -1000
    for i, s in enumerate(scores):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
            weight[sp.id_to_piece(i).encode()] = 1 / (1 - s) if ranks else float(np.exp(s))
    least = min(weight.values(), default=1.0)
    for b in range(256):
        weight.setdefault(bytes([b]), least / 256)
    names = sorted(weight)
    w = np.array([*(weight[n] for n in names), np.mean([*weight.values()])])
    return Pieces(names, np.log(w / w.sum()))


class Lattice:
    def __init__(self, vocabulary: Pieces):
        self.index = {p: i for i, p in enumerate(vocabulary.pieces)}
        self.logp = vocabulary.logp
        flat = np.frombuffer(b"".join(vocabulary.pieces), np.uint8)
        sizes = np.array([len(p) for p in vocabulary.pieces])
        ends = np.cumsum(sizes)
        h = B.span_hashes(B.prefix_sums(flat), ends - sizes, ends)
        self.hashes, self.slots = h, np.full(1 << 22, -1, dtype=np.int32)
        self.slots[h >> _U(42)] = np.arange(len(h))
        # Pieces whose slot another one took.
        self.others = np.flatnonzero(self.slots[h >> _U(42)] != np.arange(len(h)))
        self.others = self.others[np.argsort(h[self.others])]
        self.shared = np.zeros(1 << 22, dtype=bool)
        self.shared[h[self.others] >> _U(42)] = True
        self.lengths = [x for x in np.unique(sizes).tolist()]

    def edges(self, words: np.ndarray):
        """For words of one length (rows of bytes): for each piece length the piece at each start, -1 for none."""
        m, n = words.shape
        power, inv = B._powers(n + 1)
        c = np.zeros((m, n + 1), dtype=_U)
        np.cumsum(B._VALUE[words] * power[:n], axis=1, out=c[:, 1:])
        for size in self.lengths:
            if size > n:
                break
            h = B.mix((c[:, size:] - c[:, :-size]) * inv[: n - size + 1] + _U(size))
            slot = h >> _U(42)
            found = self.slots[slot]
            wrong = self.hashes[found] != h
            found[wrong] = -1
            if len(self.others) and (again := wrong & self.shared[slot]).any():
                k = np.minimum(np.searchsorted(self.hashes[self.others], h[again]), len(self.others) - 1)
                found[again] = np.where(self.hashes[self.others[k]] == h[again], self.others[k], -1)
            yield size, found

    def _paths(self, edges, m: int, n: int, backward: bool = False) -> np.ndarray:
        """Log of the summed weight of the paths from the start to each place (backward: from each place to the end)."""
        out = np.full((m, n + 1), -np.inf)
        out[:, n if backward else 0] = 0
        weights = [(size, np.where(ids >= 0, self.logp[ids], -np.inf)) for size, ids in edges]
        for j in range(n - 1, -1, -1) if backward else range(1, n + 1):
            parts = [w[:, j] + out[:, j + s] for s, w in weights if j + s <= n] if backward else [w[:, j - s] + out[:, j - s] for s, w in weights if s <= j]
            # Log of the sum of exponentials; a single byte always fits, so the largest is finite.
            stacked = np.stack(parts)
            most = stacked.max(axis=0)
            stacked -= most
            np.exp(stacked, out=stacked)
            out[:, j] = most + np.log(stacked.sum(axis=0))
        return out

    def _long(self, word: bytes, expected: np.ndarray | None = None, count: float = 0.0) -> float:
        """The same for one long word, place by place."""
        n, get, logp, longest = len(word), self.index.get, self.logp, self.lengths[-1]
        fore = np.full(n + 1, -np.inf)
        fore[0] = 0
        links = []
        for j in range(1, n + 1):
            ends = [(i, p) for i in range(max(0, j - longest), j) if (p := get(word[i:j])) is not None]
            fore[j] = np.logaddexp.reduce([fore[i] + logp[p] for i, p in ends])
            if expected is not None:
                links.append(ends)
        if expected is not None:
            back = np.full(n + 1, -np.inf)
            back[n] = 0
            for j in range(n, 0, -1):
                for i, p in links[j - 1]:
                    expected[p] += count * np.exp(fore[i] + logp[p] + back[j] - fore[n])
                    back[i] = np.logaddexp(back[i], logp[p] + back[j])
        return float(fore[n])

    def score(self, words: list[bytes], counts: np.ndarray | None = None) -> np.ndarray:
        """Log probability of each word; with ``counts`` the expected count of every piece instead."""
        out = np.zeros(len(words)) if counts is None else np.zeros(len(self.logp))
        full = [START + w for w in words]
        groups: dict[int, list[int]] = {}
        for k, w in enumerate(full):
            groups.setdefault(len(w), []).append(k)
        for n, members in groups.items():
            if n > SHORT:
                for k in members:
                    got = self._long(full[k], None if counts is None else out, 0 if counts is None else counts[k])
                    if counts is None:
                        out[k] = got
                continue
            for a in range(0, len(members), TOGETHER):
                part = members[a : a + TOGETHER]
                rows = np.frombuffer(b"".join([full[k] for k in part]), np.uint8).reshape(-1, n)
                edges = [*self.edges(rows)]
                fore = self._paths(edges, len(part), n)
                if counts is None:
                    out[part] = fore[:, n]
                    continue
                back = self._paths(edges, len(part), n, backward=True)
                for size, ids in edges:
                    at = np.nonzero(ids >= 0)
                    p = ids[at]
                    use = np.exp(fore[at] + self.logp[p] + back[at[0], at[1] + size] - fore[at[0], n]) * counts[part][at[0]]
                    out += np.bincount(p, use, len(out))
        return out


def _texts(column: pa.Array):
    """Words of each row, A-Z lower-cased."""
    for text in column.cast(pa.binary()).to_pylist():
        yield (text or b"").lower().split()  # of bytes: ASCII letters and ASCII white space only


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, c) over all rows; counted within tasks first."""

    def run(batches):
        seen: Counter = Counter()
        read = 0
        for b in batches:
            for words in _texts(b.column(0)):
                seen.update(words)
                read += sum(map(len, words))
                if len(seen) > REMEMBERED or read > READ:
                    yield pa.RecordBatch.from_arrays([pa.array([*seen.keys()], pa.binary()).cast(pa.string()), pa.array([*seen.values()], pa.int64())], names=["word", "c"])
                    seen, read = Counter(), 0
        yield pa.RecordBatch.from_arrays([pa.array([*seen.keys()], pa.binary()).cast(pa.string()), pa.array([*seen.values()], pa.int64())], names=["word", "c"])

    return docs.select(text_col).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _fitted(pieces: Pieces, expected: np.ndarray, ends: float) -> Pieces:
    expected = expected + SMOOTH
    expected[-1] = ends + SMOOTH
    return Pieces(pieces.pieces, np.log(expected / expected.sum()))


def learn(counts: DataFrame, ends: int, start: Pieces, rounds: int = ROUNDS) -> Pieces:
    """Piece probabilities that fit the word counts, by expectation-maximisation. Every round covers all words; one number a piece is sent back."""
    now = start
    for _ in range(rounds):
        shared = counts.sparkSession.sparkContext.broadcast(now)

        def run(batches, shared=shared):
            lattice = shared.value.prepare()
            total = np.zeros(len(lattice.logp))
            for b in batches:
                total += lattice.score(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_numpy().astype(float))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "e"])

        expected = np.zeros(len(now.logp))
        for r in counts.select("word", "c").mapInArrow(run, "piece long, e double").groupBy("piece").agg(F.sum("e")).collect():
            expected[r[0]] = r[1]
        now = _fitted(now, expected, ends)
    return now


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> dict[bytes, int]:
    """The words above the least count that at most ``most`` words reach: that bounds what is sent to the driver and the executors."""
    level = F.when(F.col("c") < 4096, F.col("c")).otherwise(F.lit(4096) + F.floor(8 * F.log2(F.col("c") / 4096)).cast("long"))
    left, lowest = most, None
    for r in sorted(counts.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).collect(), key=lambda r: -r["l"]):
        left -= r["n"]
        if left < 0:
            break
        lowest = r["c"]
    if lowest is None:
        return {}
    got = counts.where(F.col("c") >= lowest).select("word", "c").toArrow()
    return dict(zip(got.column("word").cast(pa.binary()).to_pylist(), got.column("c").to_pylist()))


def score(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", learn_from: Column | None = None) -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``.

    Words are runs of anything but space and \\t-\\r, A-Z lower-cased; the end
    of a text is one more token. base_score is the log10 probability under
    word frequencies with 0.1 added to each count, counted over the rows for
    which ``learn_from`` holds; score is the log10 probability under the
    lattice. n_known counts tokens that occur in training.

    Counts of the most frequent words (a fixed number) are sent to every
    executor; other words of a document are joined with the count table, so
    nothing that grows with the corpus is held in one place.

    Cases: null and empty texts have the end token only. Without a training
    row N, V and all counts are 0. Repeated rows each get their row; null ids
    are ids like any other; an empty table gives an empty result; other
    columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    training = docs.where(learn_from) if learn_from is not None else docs
    counts = scratch.put(word_counts(training, text_col), "counts")
    ends = training.count()
    said, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n_all, v_all = said + ends, distinct + (ends > 0)
    den = n_all + 0.1 * (v_all + 1)
    common = frequent_words(counts)
    model = learn(counts, ends, pieces)
    log10 = 1 / np.log(10)
    lattice_of = model.prepare().score([*common]) * log10
    ready = {w: (float(np.log10((c + 0.1) / den)), x) for (w, c), x in zip(common.items(), lattice_of.tolist())}
    shared = spark.sparkContext.broadcast((model, ready))
    dtype = dict(docs.select(id_col).dtypes)[id_col]

    def run(batches):
        model, ready = shared.value
        lattice, get = model.prepare(), ready.get
        end_base, end_score = np.log10((ends + 0.1) / den), model.logp[-1] * log10
        for b in batches:
            raw_sizes = b.column(3).to_numpy()
            at = 0
            while at < b.num_rows:
                end, held = at + 1, int(raw_sizes[at])
                while end < b.num_rows and held + raw_sizes[end] <= B.SLICE:
                    held += int(raw_sizes[end])
                    end += 1
                tallies = [Counter(words) for words in _texts(b.column(2).slice(at, end - at))]
                new = [w for w in set().union(*tallies) if w not in ready]
                rare_score = dict(zip(new, (lattice.score(new) * log10).tolist())) if new else {}
                known, base, total, rare, n_rare = [], [], [], [], []
                for tally in tallies:
                    logs = [*map(get, tally)]
                    tf = tally.values()
                    seen = [(n, p) for n, p in zip(tf, logs) if p is not None]
                    left = [x for x, p in zip(tally, logs) if p is None]
                    known.append(int(ends > 0) + sum([n for n, _ in seen]))
                    base.append(end_base + sum([n * p[0] for n, p in seen]))
                    total.append(end_score + sum([n * p[1] for n, p in seen]) + sum([tally[w] * rare_score[w] for w in left]))
                    rare += left
                    n_rare.append(len(left))
                tokens = [1 + t.total() for t in tallies]
                ids, keys = b.column(0).slice(at, end - at), b.column(1).slice(at, end - at)
                owner = np.repeat(np.arange(end - at), n_rare)
                counts_of = pa.array([tallies[i][w] for i, w in zip(owner.tolist(), rare)], pa.int64())
                own = pa.array([f" {k}" for k in keys.to_pylist()], pa.string())
                for m, columns in ((end - at, (ids, keys, own, 0, tokens, known, base, total, 1)), (len(rare), (ids.take(pa.array(owner)), keys.take(pa.array(owner)), pa.array(rare, pa.binary()).cast(pa.string()), counts_of, 0, 0, 0.0, 0.0, 0))):
                    kinds = (None, None, None, *[pa.int64()] * 3, *[pa.float64()] * 2, pa.int64())
                    arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) if isinstance(c, list) else pa.array(np.full(m, c), t) for c, t in zip(columns, kinds)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["__id", "key", "word", "tf", "n", "known", "base", "score", "row"])
                at = end

    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("size"))
    parts = rows.mapInArrow(run, f"__id {dtype}, key long, word string, tf long, n long, known long, base double, score double, row long")
    # A document's own row has a "word" with a blank in it, which no word has: it passes the join unchanged.
    joined = parts.join(counts, "word", "left").select(
        "__id", "key", "n", "row", "score", (F.col("known") + F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("known"),
        (F.col("base") + F.col("tf") * F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(den))).alias("base"),
    )
    sums = joined.groupBy("__id", "key").agg(*(F.sum(c).alias(c) for c in ("n", "row", "score", "known", "base")))
    whole = lambda c: F.expr(f"{c} div row")  # noqa: E731  equal rows were added up
    out = sums.select(
        F.col("__id").alias(id_col), whole("n").alias("n_tokens"), whole("known").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("row")).alias("base_score"), (F.col("score") / F.col("row")).alias("score"), F.explode(F.sequence(F.lit(1), F.col("row").cast("int"))).alias("__time"),
    )
    return out.drop("__time")

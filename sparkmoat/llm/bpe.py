"""Byte-level BPE: speculate with greedy longest match, verify every adjacent pair, merge only what fails.

A sequence of tokens is the BPE encoding of its bytes if and only if, for each
two neighbours, encoding just their bytes gives those two tokens again. Greedy
longest match proposes a sequence for each distinct word; all distinct pairs of
neighbours of a batch are tested at once in numpy; words with a failing pair
are merged exactly.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as Unicode defines it; Python's own \s also has \x1c-\x1f.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_SPLIT_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+", re.ASCII)
#: Pieces of a text handled at once, distinct words and their characters remembered, characters of texts handled together.
PIECES, REMEMBERED, LETTERS, TOGETHER = 200_000, 300_000, 1 << 23, 1 << 20


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: itself if it is printable Latin-1, else the next one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """A tokenizer read from a tokenizers JSON file of kind byte-level BPE."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, alphabet = spec["model"], _byte_alphabet()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for t, i in ids.items():
            self.bytes[i] = bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode()
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        # rank -1: a single byte, which nothing made
        self.rank, self.left, self.right = np.full(size, -1), np.arange(size), np.arange(size)
        self.pair: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            x, y, z = ids[a], ids[b], ids[a + b]
            self.pair[x, y] = (r, z)
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = r, x, y
        keys = np.array([x * size + y for x, y in self.pair], dtype=np.int64)
        order = np.argsort(keys)
        self.size, self.keys, self.key_rank = size, keys[order], np.array([r for r, _ in self.pair.values()], dtype=np.int64)[order]
        self.single = [ids[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        # Only tokens that the merges make may be proposed.
        self.known = {self.bytes[i]: i for i in ids.values() if self.rank[i] >= 0 or len(self.bytes[i]) == 1}
        self.longest = max(map(len, self.known), default=1)
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memory: dict[str, bytes] = {}
        #: What remembered words are decoded to, where that isn't their own bytes again.
        self.other: dict[str, bytes] = {}
        self.letters = 0
        self.good: dict[int, bool] = {}
        self.merged = 0

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n, known, longest = [], 0, len(word), self.known, self.longest
        while at < n:
            end = min(n, at + longest)
            while (t := known.get(word[at:end])) is None:
                end -= 1
            out.append(t)
            at = end
        return out

    def merge(self, word: bytes) -> list[int]:
        """The exact encoding: again and again the pair of least rank, the leftmost first."""
        if len(word) <= 32:
            return self._merge_short([self.single[b] for b in word])
        toks: list[int | None] = [self.single[b] for b in word]
        n, pair = len(toks), self.pair
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*m, i, toks[i], toks[i + 1]) for i in range(n - 1) if (m := pair.get((toks[i], toks[i + 1])))]
        heap = [(r, i, z, a, b) for r, z, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, z, a, b = heapq.heappop(heap)
            j = after[i]
            if toks[i] != a or j >= n or toks[j] != b:
                continue
            toks[i], toks[j] = z, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := pair.get((z, toks[k])):
                    heapq.heappush(heap, (m[0], i, m[1], z, toks[k]))
            if (h := before[i]) >= 0 and (m := pair.get((toks[h], z))):
                heapq.heappush(heap, (m[0], h, m[1], toks[h], z))
        return [t for t in toks if t is not None]

    def _merge_short(self, toks: list[int]) -> list[int]:
        pair, none = self.pair, (1 << 60, -1)
        made = [pair.get(p, none) for p in zip(toks, toks[1:])]
        while made and (best := min(made)) is not none:
            i = made.index(best)
            toks[i : i + 2] = [best[1]]
            del made[i]
            if i:
                made[i - 1] = pair.get((toks[i - 1], toks[i]), none)
            if i < len(made):
                made[i] = pair.get((toks[i], toks[i + 1]), none)
        return toks

    def _cross(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of a and b; very large where there is none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], np.iinfo(np.int64).max) if len(self.keys) else np.full(len(a), np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether the bytes of both are encoded as just those two.

        Undoes the merges that made the two sides, the latest first. While a
        side still is as it was, a merge across the border must not come before
        the one that is undone; of equal ranks the left one comes first.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        good = self._cross(a, b) == np.iinfo(np.int64).max
        live = np.flatnonzero(good)
        a, b = a[live], b[live]
        while len(live):
            ra, rb = self.rank[a], self.rank[b]
            go = (ra >= 0) | (rb >= 0)  # else both are single bytes: nothing is left to undo
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            undo_a = ra > rb
            limit = np.where(undo_a, ra, rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            bad = self._cross(a, b) < limit
            good[live[bad]] = False
            live, a, b = live[~bad], a[~bad], b[~bad]
        return good

    def learn(self, words: list[str]) -> None:
        """Encodes words that aren't remembered yet."""
        raw = [w.encode() for w in words]
        guesses = [self.propose(w) for w in raw]
        lengths = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter((t for g in guesses for t in g), np.int64, int(lengths.sum()))
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(guesses)), lengths)
            inner = owner[1:] == owner[:-1]
            pairs, back = np.unique(flat[:-1][inner] * self.size + flat[1:][inner], return_inverse=True)
            ok = self.compatible(pairs // self.size, pairs % self.size)
            for w in np.unique(owner[1:][inner][~ok[back]]):
                guesses[w] = self.merge(raw[w])
                self.merged += 1
        self.letters += sum(map(len, words))
        for w, b, g in zip(words, raw, guesses):
            self.memory[w] = np.array(g, dtype=np.int32).tobytes()
            if (back := b"".join([self.bytes[t] for t in g])) != b:
                self.other[w] = back

    def _pieces(self, text: str):
        """Runs of at most PIECES words, or the id of a special token."""
        parts = self.special_split.split(text) if self.special_split and any(s in text for s in self.special) else [text]
        for part in parts:
            if part in self.special:
                yield self.special[part]
            elif part:
                found = (_SPLIT_ASCII if part.isascii() else _SPLIT).finditer(part)
                while run := [m.group() for m in islice(found, PIECES)]:
                    yield run

    def encode_batch(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """For each text its ids as int32 bytes, and the bytes that those ids decode to."""
        ids: list[list[bytes]] = [[] for _ in texts]
        back: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        held = 0

        def flush():
            nonlocal held
            if len(self.memory) > REMEMBERED or self.letters > LETTERS:
                self.memory.clear()
                self.other.clear()
                self.letters = 0
            new = set().union(*(p for _, p in waiting)) - self.memory.keys() if waiting else set()
            if new:
                self.learn(list(new))
            look, other = self.memory.__getitem__, self.other
            for i, p in waiting:
                ids[i].append(b"".join([*map(look, p)]))
                back[i].append(b"".join([other[w] if w in other else w.encode() for w in p]) if other else "".join(p).encode())
            waiting.clear()
            held = 0

        for i, text in enumerate(texts):
            for run in self._pieces(text):
                if isinstance(run, int):
                    flush()
                    ids[i].append(np.int32(run).tobytes())
                    back[i].append(self.bytes[run])
                else:
                    waiting.append((i, run))
                    held += len(run)
                    if held >= PIECES:
                        flush()
        flush()
        return [b"".join(x) for x in ids], [b"".join(x) for x in back]

    def decode(self, ids) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _loaded(path: str) -> ByteBPE:
    with open(path, encoding="utf-8") as f:
        return ByteBPE(f.read())


def _tokenizer(name: str) -> ByteBPE:
    """The tokenizer in an executor: from the files that the driver has sent."""
    return _loaded(SparkFiles.get(name))


def _send(docs: DataFrame, tokenizer: str) -> str:
    docs.sparkSession.sparkContext.addFile(tokenizer)
    return tokenizer.rsplit("/", 1)[-1]


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """(id_col, ids array<int>, decoded string), one row per row of ``docs``.

    tokenizer: path of a tokenizers JSON file of kind byte-level BPE, which is
    sent to the executors. Special tokens in a text are taken as such, none
    are added, and decoding keeps them.

    Cases: a null text is empty, and an empty text has no ids and decodes to
    the empty text. Long texts are encoded in runs of PIECES words, so memory
    is bounded by the text itself. Repeated rows, null ids and empty tables
    need no care: rows are independent. Other columns are ignored.
    """
    name = _send(docs, tokenizer)
    dtype = dict(docs.select(id_col).dtypes)[id_col]

    def run(batches):
        bpe = _tokenizer(name)
        for b in batches:
            texts, sizes = b.column(1), b.column(2).to_numpy()
            at = 0
            while at < b.num_rows:
                end, held = at + 1, int(sizes[at])
                while end < b.num_rows and held + sizes[end] <= TOGETHER:
                    held += int(sizes[end])
                    end += 1
                ids, back = bpe.encode_batch([x or "" for x in texts.slice(at, end - at).to_pylist()])
                off = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                text = pa.array([x.decode("utf-8", "replace") for x in back] if decode else [None] * len(back), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), lists, text], names=["__id", "ids", "decoded"])
                at = end

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("size"))
    out = rows.mapInArrow(run, f"__id {dtype}, ids array<int>, decoded string")
    return out.withColumnRenamed("__id", id_col)


def decode_ids(rows: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the text that the ids in ``ids_col`` decode to; null stays null."""
    name = _send(rows, tokenizer)

    @F.pandas_udf("string")
    def decode(ids):
        bpe = _tokenizer(name)
        return ids.map(lambda x: None if x is None else bpe.decode(x))

    return rows.withColumn(out_col, decode(F.col(ids_col)))

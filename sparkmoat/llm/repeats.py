"""Which of very many 64-bit keys do several owners have? A filter of a checked size, made in one narrow shuffle.

Keys travel as blocks of 40-bit fingerprints instead of rows, dealt over
buckets by their top bits, so a key costs five bytes and hot keys cost two
fingerprints a block. Each bucket finds what it has more than once and answers
with bits of its own; the bits of all buckets are the filter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import BATCH, batches_of

_U = np.uint64
#: Keys that a bucket holds on average, and that a task gathers before it sends them on.
BUCKET, BLOCK = 1 << 20, 1 << 18
#: Bits for each repeated key (two of them are set), and all bits together at most: 64 MB.
PER_KEY, MOST = 16, 1 << 29


class Filter:
    """Tests 64-bit keys: false means that one owner alone has the key. True is almost always right, until MOST bits are too few; so who needs certainty counts what passes."""

    def __init__(self, shift: int, start: np.ndarray, mask: np.ndarray, bits: np.ndarray):
        self.shift, self.start, self.mask, self.bits = shift, start, mask, bits

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        bucket, print_ = split(keys, self.shift)
        out = self.start[bucket] >= 0
        for at in probes(print_):
            at = np.maximum(self.start[bucket], 0) + (at & self.mask[bucket])
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def split(keys: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each key (its top ``shift`` bits) and the 40 bits after that."""
    bucket = (keys >> _U(64 - shift)).astype(np.int64) if shift else np.zeros(len(keys), dtype=np.int64)
    return bucket, (keys << _U(shift)) >> _U(24)


def probes(prints: np.ndarray) -> list[np.ndarray]:
    return [prints.astype(np.int64), ((prints * _U(0x9E3779B97F4A7C15)) >> _U(24)).astype(np.int64)]


def pack(prints: np.ndarray) -> bytes:
    return prints.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _blocks(keys: np.ndarray, owners: np.ndarray, shift: int) -> pa.RecordBatch:
    """One row a bucket: the fingerprints of the keys, twice if two owners have it."""
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    first = np.concatenate([[True], (keys[1:] != keys[:-1])])
    other = np.concatenate([[False], (keys[1:] == keys[:-1]) & (owners[1:] != owners[:-1])])
    # of each key its first row, and one more if a second owner follows
    again = np.unique(keys[other])
    keys = np.sort(np.concatenate([keys[first], again]))
    bucket, prints = split(keys, shift)
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]].astype(np.int32)), pa.array([pack(prints[i:j]) for i, j in zip(edges[:-1], edges[1:])], pa.binary())], names=["bucket", "prints"])


def repeated(rows: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], about: int) -> Filter:
    """The filter of keys that at least two owners have.

    ``keys`` gives arrays of keys and of their owners (64-bit) for a batch of
    ``rows``; ``about`` is the number of keys to expect, which sets the number
    of buckets. An owner whose rows lie in several blocks may count as two.
    """
    shift = max(4, int(np.ceil(np.log2(max(about, 1) / BUCKET))) if about > BUCKET else 4)
    most = max(MOST >> shift, 64)

    def send(batches):
        held, n = [], 0
        for b in batches:
            for k, who in keys(b):
                held.append((k, who))
                n += len(k)
                if n >= BLOCK:
                    yield _blocks(*(np.concatenate(x) for x in zip(*held)), shift)
                    held, n = [], 0
        if n:
            yield _blocks(*(np.concatenate(x) for x in zip(*held)), shift)

    def mark(key, table):
        got = np.sort(np.concatenate([unpack(x.as_buffer()) for x in table.column("prints").combine_chunks()]))
        got = np.unique(got[1:][got[1:] == got[:-1]])
        bits = min(max(64, 1 << int(np.ceil(np.log2(max(PER_KEY * len(got), 1))))), 1 << (most.bit_length() - 1))
        marks = np.zeros(bits, dtype=bool)
        for at in probes(got):
            marks[at & (bits - 1)] = True
        return pa.table({"bucket": [key[0].as_py()], "bits": pa.array([np.packbits(marks, bitorder="little").tobytes()] if len(got) else [b""], pa.binary())}, schema=pa.schema([("bucket", pa.int32()), ("bits", pa.binary())]))

    with batches_of(rows.sparkSession, BATCH):
        found = rows.mapInArrow(send, "bucket int, prints binary").groupBy("bucket").applyInArrow(mark, "bucket int, bits binary").collect()  # MOST bits in all
    start, mask, parts, at = np.full(1 << shift, -1, dtype=np.int64), np.zeros(1 << shift, dtype=np.int64), [], 0
    for r in found:
        if len(r.bits):
            start[r.bucket], mask[r.bucket] = at, 8 * len(r.bits) - 1
            parts.append(np.frombuffer(bytes(r.bits), dtype=np.uint8))
            at += 8 * len(r.bits)
    return Filter(shift, start, mask, np.concatenate(parts) if parts else np.zeros(1, dtype=np.uint8))


def tally(rows: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]], about: int) -> np.ndarray:
    """How often keys occur, in two rows of counters; see ``counted``. A power of two of counters in all, four times as many as keys, up to 2^23 (32 MB).

    It orders keys by frequency, the same way everywhere. Keys that share both
    their counters with others look more frequent than they are.
    """
    size = 1 << int(np.clip(np.ceil(np.log2(max(about, 8) * 2)), 4, 22))
    block = 2 * size // 16

    def count(batches):
        got, seen = np.zeros(2 * size, dtype=np.uint32), 0
        for b in batches:
            for k in keys(b):
                for at in slots(k, size):
                    spot, times = np.unique(at, return_counts=True)
                    got[spot] += times.astype(np.uint32)
                seen += len(k)
        if seen:
            for k, x in enumerate(got.reshape(-1, block)):
                yield pa.RecordBatch.from_arrays([pa.array([seen % 64]), pa.array([k]), pa.array([x.tobytes()], pa.binary())], names=["salt", "block", "n"])

    def add(key, table):
        total = np.zeros(block, dtype=np.uint32)
        for x in table.column("n"):
            total += np.frombuffer(x.as_buffer(), dtype=np.uint32)
        return pa.table({"block": [key[-1].as_py()], "n": [total.tobytes()]})

    once = rows.mapInArrow(count, "salt long, block long, n binary").groupBy("salt", "block").applyInArrow(add, "block long, n binary")
    out = np.zeros(2 * size, dtype=np.uint32)
    with batches_of(rows.sparkSession, BATCH):
        sums = once.groupBy("block").applyInArrow(add, "block long, n binary").collect()  # one sum of each block
    for r in sums:
        out[r.block * block : (r.block + 1) * block] = np.frombuffer(bytes(r.n), dtype=np.uint32)
    return out


def slots(keys: np.ndarray, size: int) -> list[np.ndarray]:
    return [size * k + ((keys * m) >> _U(40)).astype(np.int64) % size for k, m in enumerate((_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)))]


def counted(counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    x, y = slots(keys, len(counts) // 2)
    return np.minimum(counts[x], counts[y])


def parity(hashes: np.ndarray, first: np.ndarray, bits: int) -> np.ndarray:
    """For each of the sets of ``hashes`` (they start at ``first``) a bitmap of ``bits`` bits as 64-bit words: bit b is the parity of its values that fall on b.

    Values that two sets share cancel out in the XOR of their bitmaps, so it
    has at most as many bits as the sets have values that only one of them has.
    """
    n = np.diff(np.append(first, len(hashes)))
    out = np.zeros((len(first), bits // 64), dtype=np.int64)
    step = max((1 << 19) // bits, 1)
    for i in range(0, len(first), step):
        j = min(i + step, len(first))
        part = hashes[first[i] : first[i] + n[i:j].sum()]
        spot = np.repeat(np.arange(j - i), n[i:j]) * bits + (part * _U(0xBF58476D1CE4E5B9) >> _U(40)).astype(np.int64) % bits
        odd = np.bincount(spot, minlength=(j - i) * bits).astype(np.uint8) & 1
        out[i:j] = np.packbits(odd.reshape(j - i, bits), axis=1, bitorder="little").view("<i8")
    return out


def apart(words: int, percent: int) -> str:
    """SQL that is false only for pairs of sets, of n and n2 values with bitmaps m0_.. and m0_2.., that can't reach ``percent``: too many values are in one of them alone."""
    differ = " + ".join(f"bit_count(m{k}_ ^ m{k}_2)" for k in range(words))
    return f"{100 + percent} * ({differ}) <= {100 - percent} * (n + n2)"

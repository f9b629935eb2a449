"""Vectorised hashing of words and n-grams over Arrow string buffers.

A text is handled as UTF-8 bytes in one numpy array. Prefix sums of a
polynomial hash (mod 2^64) give the hash of any byte span with two look-ups,
so no Python object is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_RNG = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, and an odd base with its inverse mod 2^64.
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The separators of words: space and \t \n \v \f \r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: All ASCII that is neither a letter nor a digit: the separators of plain words.
PUNCT = np.ones(256, dtype=bool)
PUNCT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Bytes handled at once; and where several 64-bit arrays are made for each byte beside other large ones.
SLICE, PART = 1 << 20, 1 << 18
_POW = np.ones(1, dtype=_U)
_INV = np.ones(1, dtype=_U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        n = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            made = []
            for base in (_BASE, _INVERSE):
                a = np.full(n, base, dtype=_U)
                a[0] = 1
                made.append(np.cumprod(a, dtype=_U))
        _POW, _INV = made
    return _POW, _INV


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """c with c[i] = sum over k < i of value(data[k]) * base^k."""
    power, _ = _powers(len(data) + 1)
    c = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(_VALUE[data] * power[: len(data)], out=c[1:])
    return c


def span_hashes(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inv = _powers(len(c))
    return mix((c[ends] - c[starts]) * inv[starts] + (ends - starts).astype(_U))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (n + 1) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def slices(off: np.ndarray, limit: int = SLICE):
    """Row ranges (i, j) of at most ``limit`` bytes, one row at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def _cuts(data: np.ndarray, limit: int, sep: np.ndarray = SPACE):
    """Ranges of a long text that end after a separator, so no word is split."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + limit, n)
        if end < n:
            back = np.flatnonzero(sep[data[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
            else:  # one word longer than the limit
                while end < n and not sep[data[end]]:
                    ahead = np.flatnonzero(sep[data[end : end + limit]])
                    end = end + (int(ahead[0]) if len(ahead) else min(limit, n - end))
        yield at, end
        at = end


def segments(raw: np.ndarray, off: np.ndarray, limit: int = 4 * SLICE) -> tuple[np.ndarray, np.ndarray]:
    """Offsets in which rows above ``limit`` bytes are cut after blanks, and the row of each part: bounds the memory for long texts."""
    if not len(off) or np.diff(off).max(initial=0) <= limit:
        return off, np.arange(len(off) - 1)
    cuts, owner = [], []
    for k in range(len(off) - 1):
        parts = [(0, 0)] if off[k] == off[k + 1] else list(_cuts(raw[off[k] : off[k + 1]], SLICE)) if off[k + 1] - off[k] > limit else [(0, 0)]
        cuts += [off[k] + x for x, _ in parts]
        owner += [k] * len(parts)
    return np.array([*cuts, off[-1]], dtype=np.int64), np.array(owner, dtype=np.int64)


def word_spans(data: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and the index of the first word of each row (n + 1). off: relative to data."""
    word = ~sep[data]
    n = len(data)
    first = np.zeros(n + 1, dtype=bool)
    first[off] = True  # a row's first byte starts anew
    before = np.empty(n, dtype=bool)
    if n:
        before[0] = False
        before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | first[:n]))
    after = np.zeros(n, dtype=bool)
    after[:-1] = word[1:] & ~first[1:n]
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_words(raw: np.ndarray, off: np.ndarray, i: int, j: int, lower: bool = True, sep: np.ndarray = SPACE, stems: tuple[int, ...] = ()) -> tuple:
    """Hashes of all words of rows i..j, the index of each row's first word (n + 1), and for each of ``stems`` the hashes of the words' first bytes."""

    def one(data, off):
        data = LOWER[data] if lower else data
        starts, ends, at = word_spans(data, off, sep)
        c = prefix_sums(data)
        return [span_hashes(c, starts, ends), *(span_hashes(c, starts, np.minimum(ends, starts + k)) for k in stems)], at

    a, b = int(off[i]), int(off[j])
    if b - a <= 4 * SLICE or j - i > 1:
        found, at = one(raw[a:b], off[i : j + 1] - a)
    else:
        parts = [one(raw[a + x : a + y], np.array([0, y - x]))[0] for x, y in _cuts(raw[a:b], SLICE, sep)]
        found = [np.concatenate(p) for p in zip(*parts)]
        at = np.array([0, len(found[0])])
    return found[0], at, *found[1:]


def shingle(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words; of the whole sequence if it is shorter; none if it is empty."""
    if not len(h):
        return h
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, dtype=_U)
    for k in range(width):
        out = mix(out * _U(0xD6E8FEB86659FD93) + h[k : k + n])
    return out

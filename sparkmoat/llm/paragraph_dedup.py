"""Repeated passages by paragraph MinHash banding.

A paragraph is what stands between two line breaks (the whole text, if there
are none), at its real length.

A passage that was copied into a text may start and end anywhere, too. So there
are also windows that start at an anchor, and anchors depend on the words
alone: of every SPAN successive five-word shingles the one with the smallest
hash is an anchor. Windows of WINDOW words that start at the same anchor and are
similar have their first CORE words in common, so the CORE words are their one
band, and the passage. Two texts that share CORE + SPAN - 1 words share a band.

1. A first pass over the texts finds the bands that several documents have. They
   travel as five-byte fingerprints in blocks (``repeats``), not as rows.
2. A second pass gives rows for the paragraphs that have such a band.
3. Equal paragraphs are one class. Classes that collide in a band are compared
   by exact Jaccard similarity of their shingle sets.
4. Components of similar classes that reach several documents are repeated
   passages; touching paragraphs of a document with the same first
   document are joined to one span.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytehash as B
from . import repeats
from .scratch import Scratch, components, salted_join, salted_pairs

WIDTH, WINDOW, SPAN = 5, 24, 12
#: What two windows of 0.8 have in common: 18 of their 20 shingles, so all but the last two words.
CORE = 22
#: 64-bit words of the bitmaps that tell paragraphs apart before they are compared.
WORDS = 4
#: Bytes of text to a key, roughly: sets the number of buckets that keys are dealt over.
BYTES_A_KEY = 20
_U = np.uint64
_MAPS = [f"m{k}_" for k in range(WORDS)]


def tune(percent: int, recall: float = 0.995, rows: int = 2) -> int:
    """The number of bands of ``rows`` values that finds a pair at the threshold with a chance of ``recall``."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - (percent / 100) ** rows)))


def _sliding(a: np.ndarray, width: int, f) -> np.ndarray:
    """f (minimum or maximum) over every ``width`` successive values."""
    have, out = 1, a
    while have < width:
        step = min(have, width - have)
        out = f(out[:-step], out[step:])
        have += step
    return out


def anchors(every: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the shingles that are the smallest of some SPAN successive ones of their text. at: first word of each text (n + 1)."""
    if len(every) < SPAN:
        return np.zeros(0, np.int64)
    end = np.maximum(np.repeat(at[1:] - WIDTH + 1, np.diff(at)), 0)[: len(every)]
    place = np.arange(len(every))
    low = _sliding(every, SPAN, np.minimum)
    low = np.where(place[: len(low)] + SPAN <= end[: len(low)], low, 0)
    edge = np.zeros(SPAN - 1, dtype=_U)
    return np.flatnonzero((_sliding(np.concatenate([edge, low, edge]), SPAN, np.maximum) == every) & (place < end))


def _shingled(column: pa.Array):
    """(first row, shingle hashes of some rows, first word of each of them (n + 1), first word of each of their newline paragraphs (m + 1), its row)."""
    raw, off = B.buffers(column)
    for i, j in B.slices(off):
        a, b = off[i], off[j]
        cut = np.unique(np.concatenate([off[i : j + 1], a + np.flatnonzero(raw[a:b] == 10)]))
        if len(cut) < 2:
            continue
        parts = [B.hash_words(raw, cut, p, q, sep=B.PUNCT) for p, q in B.slices(cut, B.PART)]
        h = np.concatenate([x for x, _ in parts])
        if len(h) < WIDTH:
            continue
        before = np.cumsum([0, *(len(x) for x, _ in parts)])
        line = np.concatenate([*(at[:-1] + n for (_, at), n in zip(parts, before)), before[-1:]])
        yield i, B.shingle(h, WIDTH), line[np.searchsorted(cut, off[i : j + 1])], line, np.searchsorted(off[i : j + 1], cut[:-1], side="right") - 1


def _lines(every: np.ndarray, at: np.ndarray, line: np.ndarray, row: np.ndarray, shortest: int):
    """(row, first word in it, number of words, hash of all words) of the newline paragraphs of ``shortest`` words or more, and their shingles in one array."""
    size = np.diff(line)
    keep = np.flatnonzero(size >= max(shortest, WIDTH))
    row, start, size = row[keep], line[keep], size[keep]
    n = size - WIDTH + 1
    first = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(first, n)
    s = every[np.repeat(start, n) + place]
    para = np.zeros(0, dtype=_U)
    if len(s):
        para = B.mix(np.add.reduceat(B.mix(s + place.astype(_U) * _U(0x9E3779B97F4A7C15)), first) + n.astype(_U))
    return row, start - at[row], size, para, s


def _windows(every: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word in it, hash of the CORE words) of the windows."""
    place = anchors(every, at)
    row = np.searchsorted(at, place, side="right") - 1
    k = place + CORE <= at[row + 1]
    place, row = place[k], row[k]
    para = np.full(len(place), CORE, dtype=_U)
    for step in (*range(0, CORE - WIDTH, WIDTH), CORE - WIDTH):
        para = B.mix(para * _U(0x9E3779B97F4A7C15) + every[place + step])
    return row, place - at[row], para


def _bands(s: np.ndarray, n: np.ndarray, percent: int, rows: int) -> np.ndarray:
    """The MinHash bands of successive runs of ``n`` shingles, one row each."""
    bands = tune(percent, rows=rows)
    mult = np.random.default_rng(4099).integers(1, 2**62, (bands, rows), dtype=np.int64).astype(_U) * _U(2) + _U(1)
    out, first = np.zeros((len(n), bands), dtype=_U), np.cumsum(n) - n
    if len(n):
        g = B.mix(s)
        for k in range(bands):
            key = np.full(len(n), k + 1, dtype=_U)
            for m in mult[k]:
                key = B.mix(key * _U(0xD6E8FEB86659FD93) + np.minimum.reduceat(g * m, first))
            out[:, k] = key
    return out


def _found(column: pa.Array, shortest: int, percent: int, rows: int):
    """For some rows of ``column``: (first row, (row, start, size, hash, shingles, bands) of their newline paragraphs, (row, start, hash) of their windows)."""
    for i, every, at, line, row in _shingled(column):
        row, start, size, para, s = _lines(every, at, line, row, shortest)
        yield i, (row, start, size, para, s, _bands(s, size - WIDTH + 1, percent, rows)), _windows(every, at)


def _sets(s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct upper halves of successive runs of ``n`` shingles, sorted, and how many each has."""
    keys = np.unique((np.repeat(np.arange(len(n), dtype=_U), n) << _U(32)) | (s >> _U(32)))
    return (keys & _U(0xFFFFFFFF)).astype(np.uint32), np.bincount((keys >> _U(32)).astype(np.int64), minlength=len(n))


def _binary(g: np.ndarray, n: np.ndarray) -> pa.Array:
    """Successive runs of ``n`` 32-bit values, each as one value."""
    off = np.zeros(len(n) + 1, dtype=np.int32)
    np.cumsum(4 * n, out=off[1:])
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(off), pa.py_buffer(g)])


def _paragraphs(docs: DataFrame, shared, shortest: int, percent: int, rows: int) -> DataFrame:
    """(id, pos, len, para, bands, n, grams, m0...): the newline paragraphs with a band that the filter lets through, and the windows; bands is null for windows.

    n, grams (the distinct shingles) and their bitmap are given once for equal
    paragraphs of a slice of texts, and null in the others.
    """
    names = ["id", "pos", "len", "para", "bands", "n", "grams", *_MAPS]

    def run(batches):
        test = shared.value
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, (row, start, size, para, s, bands), (wrow, wstart, core) in _found(b.column(1), shortest, percent, rows):
                k = np.flatnonzero(test(core))
                if len(k):
                    none = [pa.nulls(len(k), t) for t in (pa.list_(pa.int64()), pa.int64(), pa.binary(), *[pa.int64()] * WORDS)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i + wrow[k]]), pa.array(wstart[k].astype(np.int32)), pa.array(np.full(len(k), CORE, np.int32)), pa.array(core[k].view(np.int64)), *none], names=names)
                met = test(bands.ravel()).reshape(bands.shape)
                k = np.flatnonzero(met.any(axis=1))
                if not len(k):
                    continue
                off = np.concatenate([[0], np.cumsum(met[k].sum(axis=1))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(bands[k][met[k]].view(np.int64)))
                n = size - WIDTH + 1
                first = np.cumsum(n) - n
                _, once = np.unique(para[k], return_index=True)
                own = k[once]
                at = np.concatenate([[0], np.cumsum(n[own])])
                flat = s[np.repeat(first[own] - at[:-1], n[own]) + np.arange(at[-1])]
                g, count = _sets(flat, n[own])
                maps = repeats.parity(g.astype(_U) << _U(32), np.cumsum(count) - count, 64 * WORDS).T
                spot = np.full(len(k), -1)
                spot[once] = np.arange(len(once))
                take = pa.array(np.maximum(spot, 0), mask=spot < 0)
                given = [pa.array(count.astype(np.int64)), _binary(g, count), *(pa.array(np.ascontiguousarray(m)) for m in maps)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i + row[k]]), pa.array(start[k].astype(np.int32)), pa.array(size[k].astype(np.int32)), pa.array(para[k].view(np.int64)), lists, *(x.take(take) for x in given)], names=names)

    return docs.mapInArrow(run, "id long, pos int, len int, para long, bands array<long>, n long, grams binary, " + ", ".join(f"{m} long" for m in _MAPS))


def _parts(batch: pa.RecordBatch, *columns: int, rows: int = 4096, values: int = 1 << 20):
    """Slices of at most ``rows`` rows and about ``values`` shingles, one row at least."""
    size = sum(pc.binary_length(batch.column(c)).to_numpy().astype(np.int64) for c in columns) // 4
    for i, j in B.slices(np.concatenate([[0], np.cumsum(size)]), values):
        for at in range(i, j, rows):
            yield batch.slice(at, min(rows, j - at))


def _keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of each row under the number of the row, and how many each has."""
    rows = column.to_pylist()
    n = np.array([len(x) // 4 for x in rows], dtype=np.int64)
    return (np.repeat(np.arange(len(n), dtype=_U), n) << _U(32)) | np.frombuffer(b"".join(rows), np.uint32), n


def _similar(scratch: Scratch, pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of (a, b) those whose sets reach the similarity."""
    pairs = scratch.put(pairs, "pairs")
    total = max(pairs.count(), 1)
    out = pairs
    for end, other in (("b", "a"), ("a", "b")):
        deg = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("deg"))
        side = classes.select(F.col("para").alias(end), F.col("grams").alias(f"g_{end}")).join(deg, end)
        out = salted_join(out, side, [end], other, "deg", total).drop("deg")

    def run(batches):
        for b in batches:
            for part in _parts(b, 2, 3):
                (x, n), (y, m) = _keys(part.column(2)), _keys(part.column(3))
                z = np.sort(np.concatenate([x, y]))
                both = np.bincount((z[1:][z[1:] == z[:-1]] >> _U(32)).astype(np.int64), minlength=part.num_rows)
                yield part.filter(pa.array(100 * both >= percent * (n + m - both))).select([0, 1])

    links = scratch.put(out.select("a", "b", "g_a", "g_b").mapInArrow(run, "a long, b long"), "links")
    scratch.drop(pairs)
    return links


def _clusters(scratch: Scratch, classes: DataFrame, percent: int) -> DataFrame:
    """(id, component) of the classes that are similar to another, of (para, times, bands, n, grams, m0...).

    The classes of a band are first compared with one of them, the hub: the one
    with the most copies, as that is what its variants were made from. Then
    bands whose classes lie in several components are looked at again: the
    classes outside the largest component are compared with all of another
    component whose sizes and bitmaps allow the similarity.
    """
    banded = scratch.put(classes.select("para", "times", F.explode("bands").alias("band")), "banded")
    n_banded = max(banded.count(), 1)
    lists = banded.groupBy("band").agg(F.max(F.struct("times", "para"))["para"].alias("hub"), F.count(F.lit(1)).alias("len")).where("len > 1")
    met = scratch.put(salted_join(banded, lists, ["band"], "para", "len", n_banded), "met")
    scratch.drop(banded)
    edges = _similar(scratch, met.where("para <> hub").select(F.col("hub").alias("a"), F.col("para").alias("b")).distinct(), classes, percent)
    labels = scratch.put(components(scratch, edges), "labels")

    named = scratch.put(met.select("band", "para").join(labels, F.col("para") == F.col("id"), "left").select("band", "para", F.coalesce("component", "para").alias("comp")), "named")
    scratch.drop(met)
    per = named.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("size"))
    tops = per.groupBy("band").agg(F.max(F.struct("size", "comp")).alias("t"), F.sum("size").alias("len"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("band", F.col("t.comp").alias("major"), "len")
    here = salted_join(named, scratch.put(tops, "tops"), ["band"], "para", "len", n_banded).join(classes.select("para", "n", *_MAPS), "para")
    here = scratch.put(here, "here")
    may = f"comp <> comp2 and (comp = major or para2 < para) and 100 * least(n, n2) >= {percent} * greatest(n, n2) and {repeats.apart(WORDS, percent)}"
    across = salted_pairs(here.where("comp <> major"), here, "band", "para", ("para", "comp", "n", *_MAPS), n_banded).where(may)
    more = _similar(scratch, across.select(F.least("para", "para2").alias("a"), F.greatest("para", "para2").alias("b")).distinct(), classes, percent)
    scratch.drop(named, here)
    return scratch.put(components(scratch, labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(more)), "labels")


def _spans(batches):
    """Of (id, first_id, pos, len, cluster), sorted by id, first_id, pos: the spans of what touches, with their clusters."""

    def spans(t):
        ids, first, pos, size, cluster = (c.to_numpy() for c in t.columns)
        end = pos.astype(np.int64) + size
        group = np.concatenate([[0], np.cumsum((ids[1:] != ids[:-1]) | (first[1:] != first[:-1]))])
        base = group * (1 << 40)
        far = np.maximum.accumulate(base + end)  # the furthest end so far in the group
        begin = np.concatenate([[True], (group[1:] != group[:-1]) | ((base + pos)[1:] > far[:-1])])
        at, span = np.flatnonzero(begin), np.cumsum(begin) - 1
        last = np.append(at[1:], len(ids)) - 1
        order = np.lexsort((cluster, span))
        keep = order[np.concatenate([[True], (span[order][1:] != span[order][:-1]) | (cluster[order][1:] != cluster[order][:-1])])]
        off = np.concatenate([[0], np.cumsum(np.bincount(span[keep], minlength=len(at)))]).astype(np.int32)
        start, stop = pos[at].astype(np.int64), far[last] - base[last]
        columns = [ids[at], start, stop, stop - start, cluster[keep][off[:-1]], first[at], ids[at] > first[at]]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.ListArray.from_arrays(pa.array(off), pa.array(cluster[keep]))], names=["id", "start_word", "end_word", "n_words", "cluster_id", "first_id", "removable", "clusters"])

    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        if not t.num_rows:
            continue
        ids, first = t.column(0).to_numpy(), t.column(1).to_numpy()
        cut = int(np.flatnonzero((ids != ids[-1]) | (first != first[-1]))[-1]) + 1 if (ids[0], first[0]) != (ids[-1], first[-1]) else 0
        if cut:  # the last group may go on
            yield spans(t.slice(0, cut))
        held = t.slice(cut)
    if held is not None and held.num_rows:
        yield spans(held)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, rows: int = 2, shortest: int = WINDOW) -> DataFrame:
    """(id_col, start_word, end_word, n_words, cluster_id, first_id, removable, clusters), one row for every span of a document that other documents repeat.

    Words are lower-cased (A-Z) runs of letters, digits and non-ASCII, counted
    from 0; end_word is behind the last. A span joins touching paragraphs whose
    clusters have the same first_id, the smallest id of a document that holds
    them, and removable says that this document isn't the first. clusters are
    all of the span's clusters, cluster_id the smallest; documents with the same
    passage have a cluster in common. Spans with different first_id may overlap.
    Documents without a repeated passage have no row.

    Newline paragraphs of ``shortest`` words or more count, but never those of
    fewer than WIDTH words, which have no shingle.

    Cases: null, empty and short texts have no paragraphs. Rows that repeat an
    id count as one document, rows without an id as none. An empty table gives
    an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def keys(b):
        ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for i, (row, _, _, _, _, bands), (wrow, _, core) in _found(b.column(1), shortest, percent, rows):
            yield core, ids[i + wrow]
            yield bands.ravel(), np.repeat(ids[i + row], bands.shape[1])

    shared = docs.sparkSession.sparkContext.broadcast(repeats.repeated(base, keys, size // BYTES_A_KEY))
    paras = scratch.put(_paragraphs(base, shared, shortest, percent, rows), "paras")
    windows, lines = paras.where("bands is null").select("id", "pos", "len", "para"), paras.where("bands is not null")

    # What passes the filter by chance is a class of one document, which comes to nothing.
    both = windows.groupBy("para").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("times")).where("first_id < last_id")
    both = scratch.put(both.select("para", "times", F.col("para").alias("cluster"), "first_id"), "windows")
    classes = lines.groupBy("para").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("times"), *(F.max(c).alias(c) for c in ("bands", "n", "grams", *_MAPS)))
    classes = scratch.put(classes, "classes")
    labels = _clusters(scratch, classes, percent)
    known = classes.select("para", "low", "high", "times").join(labels, F.col("para") == F.col("id"), "left").select("para", "low", "high", "times", F.coalesce("component", "para").alias("cluster"))
    reach = known.groupBy("cluster").agg(F.min("low").alias("first_id"), F.max("high").alias("last_id")).where("first_id < last_id").select("cluster", "first_id")
    known = scratch.put(known.join(reach, "cluster").select("para", "times", "cluster", "first_id"), "known")

    total = max(paras.count(), 1)
    spots = [salted_join(x, y, ["para"], "id", "times", total).select("id", "first_id", "pos", "len", "cluster") for x, y in ((windows, both), (lines.select("id", "pos", "len", "para"), known))]
    # Paragraphs of a document that touch become one span if their passages have the same first document, so a span is removable as a whole or not at all.
    sorted_spots = spots[0].unionAll(spots[1]).repartition("id").sortWithinPartitions("id", "first_id", "pos")
    spans = sorted_spots.mapInArrow(_spans, "id long, start_word long, end_word long, n_words long, cluster_id long, first_id long, removable boolean, clusters array<long>")
    return spans.withColumnRenamed("id", id_col)

"""Near-duplicate linking by a signature-coordinate inverted join.

Every document has K coordinates, pairs of MinHash values. A document is posted under
(coordinate, value) pairs; documents that meet under at least MATCH of the K
coordinates are candidates, and their full shingle sets decide.

* Prefix: two documents that agree on MATCH of K coordinates agree on COMMON
  among the first K - MATCH + COMMON of each, in any order that holds for all.
  The order is by rarity, so only a document's rarest coordinates are posted.
* Skip: lists with one posting, and lists whose members are already in one
  component, are never merged.
* Copies: documents with equal sets are one class, and only classes are posted.

With Jaccard >= 0.8 two documents agree on a coordinate with a chance of 0.64
or more; the chance of fewer than MATCH=7 of K=32 is below 3e-7 a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytehash as B
from . import repeats
from .scratch import Scratch, components, lookup, salted_join, salted_pairs

#: A coordinate is a pair of MinHash values, so unrelated texts hardly ever agree on one.
K, MATCH = 32, 7
#: Coordinates that two documents must have in common in their prefixes, which are longer by COMMON - 1 for that.
COMMON = 2
#: Lists up to this length are compared pair by pair; ratio of the size classes for longer ones.
SHORT, CLASS = 32, 1.06
#: 64-bit words of the bitmaps that tell sets of a crowded list apart before they are compared; places before a shingle that are looked up for one that two sets met under already.
WORDS, BEFORE = 32, 32
#: Members that are compared with one hub in one go.
STAR = 512
_U = np.uint64
_RNG = np.random.default_rng(977)
_MULT = _RNG.integers(1, 2**63, 2 * K, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_ADD = _RNG.integers(1, 2**63, 2 * K, dtype=np.int64).astype(_U)
_SET = (_U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB))
_MAPS = [f"m{k}_" for k in range(WORDS)]


def shingle_sets(raw: np.ndarray, off: np.ndarray, width: int):
    """For each row its sorted distinct shingle hashes."""
    for i, j in B.slices(off, B.PART):
        h, at = B.hash_words(raw, off, i, j)
        for k in range(j - i):
            yield np.unique(B.shingle(h[at[k] : at[k + 1]], width))


def _signed(batch: pa.RecordBatch, width: int) -> pa.RecordBatch:
    raw, off = B.buffers(batch.column(1))
    n, hi, lo, sigs = [], [], [], []
    for i, j in B.slices(off):
        sets = list(shingle_sets(raw, off[i : j + 1], width))
        count = np.array([len(s) for s in sets], dtype=np.int64)
        sig = np.zeros((j - i, K), dtype=np.uint32)
        key = np.zeros((2, j - i), dtype=_U)
        full = np.flatnonzero(count)
        if len(full):
            flat = np.concatenate([sets[x] for x in full])
            at = np.concatenate([[0], np.cumsum(count[full])[:-1]])
            for k in range(K):
                x, y = (np.minimum.reduceat(flat * _MULT[q] + _ADD[q], at) for q in (2 * k, 2 * k + 1))
                sig[full, k] = B.mix(x ^ B.mix(y)) >> _U(32)
            for k in range(2):
                key[k, full] = np.add.reduceat(B.mix(flat ^ _SET[k]), at)
        n.append(count)
        hi.append(key[0])
        lo.append(key[1])
        sigs += [r.tobytes() for r in sig]
    join = lambda x, t: np.concatenate(x).view(t) if x else np.zeros(0, t)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(join(n, np.int64)), pa.array(join(hi, np.int64)), pa.array(join(lo, np.int64)), pa.array(sigs, pa.binary())], names=["id", "n", "hi", "lo", "sig"])


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n, hi, lo, sig): size, 128-bit key and MinHash signature of each row's shingle set."""

    def run(batches):
        for b in batches:
            yield _signed(b, width)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, hi long, lo long, sig binary")


def _tokens(column: pa.Array) -> np.ndarray:
    """Signatures as (rows, K) 64-bit tokens: coordinate and value hashed together."""
    raw, _ = B.buffers(column)
    raw = raw[: len(column) * K * 4] if column.offset == 0 else np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    sig = np.frombuffer(raw.tobytes(), dtype=np.uint32).reshape(-1, K).astype(_U)
    return B.mix(sig | (np.arange(K, dtype=_U) << _U(32)))


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle sets as one array of hashes, and the size of each set."""
    raw, off = B.buffers(column)
    return np.frombuffer(raw[off[0] : off[-1]].tobytes(), dtype=_U), np.diff(off) // 8


def postings(scratch: Scratch, reps: DataFrame, n_reps: int) -> DataFrame:
    """(token, id, alone): of each class its rarest coordinates that another class shares; alone counts those that none shares.

    Coordinates are ordered by the exact number of classes that have them. The
    first K - MATCH + COMMON are the prefix; those that one class alone has
    come first and need no posting, so most classes post little or nothing.
    A filter of what repeats keeps most of those from being shuffled at all.
    """

    def each(b):
        for at in range(0, b.num_rows, 4096):
            part = b.slice(at, 4096)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            yield _tokens(part.column(1)).ravel(), np.repeat(ids, K)

    table = reps.select("id", "sig")
    shared = reps.sparkSession.sparkContext.broadcast(repeats.repeated(table, each, K * n_reps))

    def run(batches):
        test = shared.value
        for b in batches:
            for tokens, ids in each(b):
                k = test(tokens)
                yield pa.RecordBatch.from_arrays([pa.array(tokens[k].view(np.int64)), pa.array(ids[k])], names=["token", "id"])

    every = scratch.put(table.mapInArrow(run, "token long, id long"), "tokens")
    sizes = every.groupBy("token").agg(F.count(F.lit(1)).alias("len")).where("len > 1")
    shared = salted_join(every, sizes, ["token"], "id", "len", every.count())
    order = Window.partitionBy("id").orderBy("len", "token")
    ranked = shared.withColumn("r", F.row_number().over(order)).withColumn("alone", K - F.count(F.lit(1)).over(Window.partitionBy("id")))
    posted = scratch.put(ranked.where(F.col("r") + F.col("alone") <= K - MATCH + COMMON).select("token", "id", "alone"), "posted")
    scratch.drop(every)
    return posted


def _agreeing(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Of (a, b), those with at least MATCH equal coordinates and sizes that allow the threshold."""

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint32).reshape(-1, K) for k in (2, 3))
            yield b.filter(pa.array((x == y).sum(axis=1) >= MATCH)).select([0, 1])

    return pairs.mapInArrow(run, "a long, b long")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(id, comp, n, grams): the full shingle sets of (id, text, comp)."""

    def run(batches):
        for b in batches:
            raw, off = B.buffers(b.column(1))
            found = list(shingle_sets(raw, off, width))
            n = np.array([len(s) for s in found], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n), pa.array([s.tobytes() for s in found], pa.binary())], names=["id", "comp", "n", "grams"])

    return texts.select("id", "text", "comp").mapInArrow(run, "id long, comp long, n long, grams binary")


def _compare(percent: int, width: int):
    """For rows (key, salt, member, id, text), sorted so, where the row with member 0 is the key's own: (a, b) of the keys and members whose sets reach the threshold."""

    def run(batches):
        at, hub = None, None
        for b in batches:
            raw, off = B.buffers(b.column(4))
            key, salt, member, ids = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            keep = np.zeros(b.num_rows, dtype=bool)
            for i, x in enumerate(shingle_sets(raw, off, width)):
                if not member[i]:
                    at, hub = (key[i], salt[i]), x
                elif at == (key[i], salt[i]):
                    both = len(np.intersect1d(hub, x, assume_unique=True))
                    keep[i] = 100 * both >= percent * (len(hub) + len(x) - both)
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(ids[keep])], names=["a", "b"])

    return run


def _confirm(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges (a, b) of ``pairs`` whose full sets reach the threshold. Signatures are compared first, then sets.

    Only texts are shuffled for that, each once for every ``a`` that it is a
    member of; they meet the text of ``a``, which goes out once for every STAR
    members, and sets are made and compared as rows stream by.
    """

    def with_both(pairs, total, table, column):
        """pairs with ``column`` of both ends; an end in very many pairs is salted."""
        out = pairs
        for end, other in (("b", "a"), ("a", "b")):
            # counted in the written pairs, so that the first join isn't run again for the second
            sizes = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("deg"))
            side = table.select(F.col("id").alias(end), F.col(column).alias(f"{column}_{end}"), F.col("n").alias(f"n_{end}")).join(sizes, end)
            out = salted_join(out, side, [end], other, "deg", total).drop("deg")
        return out

    pairs = scratch.put(pairs, "pairs")
    total = pairs.count()
    if not total:
        return pairs.select("a", "b")
    sized = with_both(pairs, total, reps, "sig").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    likely = scratch.put(_agreeing(sized.select("a", "b", "sig_a", "sig_b"), reps), "likely")
    scratch.drop(pairs)
    if not likely.limit(1).count():
        return likely

    parts = likely.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts"))
    dealt = likely.join(parts, "a").select(F.col("a").alias("key"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"), F.lit(1).alias("member"), F.col("b").alias("id"))
    hubs = parts.select(F.col("a").alias("key"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("member"), F.col("a").alias("id"))
    wanted = scratch.put(dealt.unionAll(hubs), "wanted")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    met = lookup(texts, wanted, "id").select("key", "salt", "member", "id", "text")
    met = met.repartition("key", "salt").sortWithinPartitions("key", "salt", "member")
    edges = scratch.put(met.mapInArrow(_compare(percent, width), "a long, b long"), "links")
    scratch.drop(likely, wanted)
    return edges


def _crowded(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, crowd: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components among the members (id, comp) of lists too long to compare pair by pair.

    Such lists come from many near copies of one text that are just under the
    threshold among each other, or from very common shingles. Their full sets
    are posted under their rarest shingles: two sets that reach the threshold
    share one among the first n - need + 1 of each, where need is the overlap
    that their sizes ask for, at least ``percent`` of either set. A near copy's
    rarest shingles are its own changes, so copies that differ in their changes
    never meet. Shingles that one set alone has come first and aren't posted;
    the others are ordered by a tally of them all. Of a list of sets of about
    one size, only those stay in which the shingle stands in the first ninth (at
    80 percent) and not the first fifth that a much smaller set would need.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = scratch.put(_sets(lookup(texts, crowd, "id"), width).dropDuplicates(["id"]), "crowded")
    total = sets.agg(F.sum("n")).first()[0]
    if not total:
        return sets.select(F.col("id").alias("a"), F.col("id").alias("b"))

    def grams(b):
        for at in range(0, b.num_rows, 1024):
            part = b.slice(at, 1024)
            flat, n = _grams(part.column(1))
            yield flat, np.repeat(part.column(0).to_numpy(zero_copy_only=False), n)

    def again(b):
        for flat, _ in grams(b):
            yield flat[met.value(flat)]

    send = sets.sparkSession.sparkContext.broadcast
    table = sets.select("id", "grams")
    met = send(repeats.repeated(table, grams, total))
    tally = send(repeats.tally(table, again, total))

    def post(batches):
        counts = tally.value
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                flat, n = _grams(part.column(3))
                row, often = np.repeat(np.arange(len(n)), n), np.where(met.value(flat), repeats.counted(counts, flat), 0)
                order = np.lexsort((flat, often, row))
                pos = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
                k = np.flatnonzero((often[order] > 0) & (100 * pos <= (100 - percent) * n[row]))
                ids, comp = (part.column(c).to_numpy(zero_copy_only=False)[row[k]] for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(flat[order[k]].view(np.int64)), *map(pa.array, (ids, comp, n[row[k]], pos[k]))], names=["token", "id", "comp", "n", "pos"])

    def mapped(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                flat, n = _grams(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, repeats.parity(flat, np.cumsum(n) - n, 64 * WORDS).T.copy())], names=["id", *_MAPS])

    posted = scratch.put(sets.select("id", "comp", "n", "grams").mapInArrow(post, "token long, id long, comp long, n long, pos long"), "rare")
    n_posted = max(posted.count(), 1)
    # Two sets have in common at most what follows their first common shingle in either, so a place is of use only if that is enough for the smallest set of its list.
    lists = posted.groupBy("token").agg(F.count(F.lit(1)).alias("len"), F.min("n").alias("low"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y")
    lists = scratch.put(lists.select("token", "len", "low"), "lists")
    every, posted = posted, scratch.put(salted_join(posted, lists, ["token"], "id", "len", n_posted).where(f"{100 + percent} * (n - pos) >= {percent} * (n + low)").drop("len", "low"), "fits")
    scratch.drop(every, lists)
    per = posted.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("size"))
    tops = per.groupBy("token").agg(F.max(F.struct("size", "comp")).alias("t"), F.sum("size").alias("len"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    tops = scratch.put(tops.select("token", F.col("t.comp").alias("major"), "len", (F.col("len") - F.col("t.size")).alias("rest")), "tops")
    places = scratch.put(salted_join(posted, tops, ["token"], "id", "len", n_posted), "places")
    marked = scratch.put(places.select("id").distinct(), "marked")
    maps = lookup(table, marked, "id").select("id", "grams").mapInArrow(mapped, "id long, " + ", ".join(f"{m} long" for m in _MAPS))
    # A pair is made once, under its first common shingle: it passes there if it passes under a later one.
    before = F.collect_list("token").over(Window.partitionBy("id").orderBy("pos").rowsBetween(-BEFORE, -1))
    here = scratch.put(places.withColumn("before", before).join(maps, "id"), "here")
    need = f"ceil({percent} * (n + n2) / {100 + percent}D - 1e-9)"
    pairs = salted_pairs(here.where("comp <> major"), here, "token", "id", ("id", "comp", "n", "pos", "before", *_MAPS), n_posted, "rest").where(
        f"comp <> comp2 and (comp = major or id2 < id) and 100 * least(n, n2) >= {percent} * greatest(n, n2) and least(n - pos, n2 - pos2) >= {need} and {repeats.apart(WORDS, percent)} and not arrays_overlap(before, before2)"
    )
    pairs = scratch.put(pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct(), "rare-pairs")
    scratch.drop(sets, posted, tops, places, marked, here)
    return pairs


def _keyed(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with a column __node that tells different texts of one id apart, and (__node, __real) of the nodes that aren't ids; None if no id repeats."""
    key = F.col(id_col).cast("long")
    again = scratch.put(docs.where(key.isNotNull()).groupBy(key.alias("__real")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__real"), "again")
    if not again.limit(1).count():
        return docs.withColumn("__node", key), None
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    texts = docs.select(key.alias("__real"), sha.alias("__sha")).join(again, "__real", "left_semi").distinct()
    # Nodes of their own are below all ids.
    low = docs.agg(F.min(key)).first()[0]
    names = scratch.put(texts.select("__real", "__sha", (F.lit(min(low, 0) - 1) - F.monotonically_increasing_id()).alias("__own")), "names")
    keyed = docs.withColumn("__real", key).withColumn("__sha", sha).join(names, ["__real", "__sha"], "left").withColumn("__node", F.coalesce("__own", "__real"))
    return keyed.drop("__real", "__sha", "__own"), names.select(F.col("__own").alias("__node"), "__real")


def _nodes(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` with their __node, and (__node, id, n_shingles, component_id, kept), one row per row of ``docs``."""
    keyed, names = _keyed(scratch, docs, id_col, text_col)
    found = _components(scratch, keyed, "__node", text_col, width, percent)
    if names is None:
        return keyed, found.withColumn("id", F.col("__node"))
    found = scratch.put(found.join(names, "__node", "left").select("__node", F.coalesce("__real", "__node").alias("id"), "n_shingles", "component_id"), "found")
    first = found.groupBy("component_id").agg(F.min("id").alias("first"))
    found = found.join(first, "component_id", "left").select("__node", "id", "n_shingles", F.col("first").alias("component_id"))
    return keyed, found.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Near-duplicate components: (id_col, n_shingles, component_id, kept), one row per row of ``docs``.

    A-Z are lower-cased and words are runs of anything but space and \\t-\\r. A
    row's set is its distinct runs of ``width`` words, the whole sequence if it
    is shorter. Rows are linked when 100 * intersection >= percent * union, and
    component_id is the smallest id that links lead to. kept: the row's id is
    its component_id.

    How pairs are avoided inside large groups: equal sets are one class. Each
    class is first compared with one hub, the member with most in common with
    others of the list, and that of its hubs that it meets most often; confirmed links give components. Then only
    pairs from different components that still share a list are compared, in
    long lists only those that also share a rare shingle where they must. So a
    group of near copies costs pairs in proportion to its size, and no link
    between components is left out.

    Cases: null and empty texts, and those without words, have n_shingles 0 and
    are linked with nothing. Rows that repeat an id are rows of their own, with
    the links of their own texts; a
    row without an id is linked with nothing, has component_id null and is
    kept. An empty table gives an empty result; other columns are ignored.
    """
    _, found = _nodes(Scratch(docs.sparkSession), docs, id_col, text_col, width, percent)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def _components(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """``near_duplicates`` where all rows of one id have the same text."""
    signed = scratch.put(signatures(docs, id_col, text_col, width), "signed")
    real = signed.where("n > 0 and id is not null")
    classes = scratch.put(real.groupBy("hi", "lo", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("sig").alias("sig")), "classes")
    reps = classes.select(F.col("rep").alias("id"), "n", "sig")
    posted = postings(scratch, reps, classes.count())
    # The hub is the member with most in common with others: in a group of near copies that is the one with the fewest changes.
    common = F.shiftleft(F.col("alone").cast("long"), 40) + F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    lists = posted.groupBy("token").agg(F.count(F.lit(1)).alias("len"), F.min_by("id", common).alias("hub"), F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    n_posted = posted.count()
    met = scratch.put(salted_join(posted, lists.select("token", "len", "hub"), ["token"], "id", "len", n_posted).select("token", "id", "hub", "len"), "met")
    scratch.drop(posted)

    stars = met.where("id <> hub").groupBy(F.col("hub").alias("a"), F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    best = stars.withColumn("r", F.expr("row_number() over (partition by b order by c desc, a)")).where("r = 1").select("a", "b")
    args = (docs, id_col, text_col, width, percent, reps)
    edges = _confirm(scratch, *args, best)
    labels = scratch.put(components(scratch, edges), "labels")

    # Lists that still hold several components: pairs across components are compared.
    named = scratch.put(met.join(labels, "id", "left").select("token", "id", F.coalesce("component", "id").alias("comp")), "named")
    mixed = named.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("len")).where("x < y").select("token", "len")
    mixed = scratch.put(mixed, "mixed")
    short = named.join(mixed.where(F.col("len") <= SHORT), "token").select("token", "id", "comp")
    # A pair that meets in a long list as well is among the crowded ones, so here every common coordinate is seen.
    across = short.alias("p").join(short.alias("q"), "token").where("p.id < q.id and p.comp <> q.comp").groupBy(F.col("p.id").alias("a"), F.col("q.id").alias("b")).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= COMMON).select("a", "b")
    crowd = salted_join(named, mixed.where(F.col("len") > SHORT), ["token"], "id", "len", n_posted).select("id", "comp").distinct()
    rare = _crowded(scratch, docs, id_col, text_col, width, percent, scratch.put(crowd, "crowd"))
    more = _confirm(scratch, *args, across.unionAll(rare).distinct())
    scratch.drop(met, named, mixed)
    # The first links are stars by now, so only what the second add takes rounds.
    links = labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(more)
    labels = scratch.put(components(scratch, links), "labels")

    known = scratch.put(classes.join(labels, F.col("rep") == F.col("id"), "left").select("hi", "lo", "n", "copies", F.coalesce("component", "rep").alias("component_id")), "known")
    total = signed.count()
    out = salted_join(signed.select("id", "hi", "lo", "n").where("n > 0 and id is not null"), known, ["hi", "lo", "n"], "id", "copies", total)
    out = out.select("id", "n", "component_id").unionAll(signed.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, that of the smallest id; all columns stay, and so do rows without an id.

    Of rows that repeat an id only those whose own text is a copy go.
    """
    keyed, found = _nodes(Scratch(docs.sparkSession), docs, id_col, text_col, width, percent)
    gone = found.where("not kept").select(F.col("__node").alias("__gone")).distinct()
    return keyed.join(gone, keyed["__node"] == gone["__gone"], "left_anti").select(*docs.columns)

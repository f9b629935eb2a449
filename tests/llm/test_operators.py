"""The corpus operators against brute force, other libraries, SQL and held-out labels, and on awkward tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkmoat.llm import bpe, bytehash, decontaminate, exact_dedup, langid, lattice_lm, minhash_dedup, paragraph_dedup, preference, quality, queries, repeats, sampling, scratch, toxicity

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
BPE = public_tokenizers.path("byte_bpe_50k.json")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
rng = random.Random(11)
VOCAB = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


#: Null and empty texts, repeats, ties, a null id, a long text, and columns with names that operators use inside.
AWKWARD = [
    (1, "Alpha beta gamma", "en"), (2, None, None), (3, "", "en"), (3, "", "en"), (4, "ALPHA beta gamma", "de"), (None, "alpha beta gamma", None), (None, None, "en"), (5, "   \n\t ", "fr"), (6, prose(40_000, 1), "en"),
    (7, "é😀 " * 5, "fr"), (8, "Alpha beta gamma", "en"), (8, "Alpha beta gamma", "en"), (9, "123 456", "en"), (10, prose(60, 2), "en"), (11, prose(60, 2) + " more", "en"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string")
    for name in ("n", "score", "kept", "keep_id", "ids", "id", "ws", "component", "__x", "token", "size", "label"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.execute(queries.ORACLE_SQL[name]).df()
    key = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns)
    assert key(got) == key(want)


# -- exact copies -----------------------------------------------------------


def norm(t):
    return (t or "").encode().translate(LOWER)


def exact_by_hand(rows, keep):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        best = keep(ids) if ids else None
        out.append((i, best, len(groups[norm(t)]), i == best, hashlib.sha256(norm(t)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact(awkward, weak):
    fn = (lambda t: F.unhex(F.md5(F.substring(t, 1, 1)))) if weak else exact_dedup.content_hash  # weak: different texts collide
    rows = [(i, t) for i, t, _ in AWKWARD]
    for name, keep in (("min", min), ("max", max)):
        got = sorted(map(tuple, exact_dedup.exact_groups(awkward, keep=name, hash_fn=fn).collect()), key=str)
        assert got == exact_by_hand(rows, keep)


def test_drop_copies(awkward):
    left = exact_dedup.drop_copies(awkward, keep="max")
    assert left.columns == awkward.columns
    texts = [norm(r.text) for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({norm(t) for _, t, _ in AWKWARD})
    assert exact_dedup.drop_copies(awkward.where(F.lit(False))).count() == 0


# -- near copies ------------------------------------------------------------


def shingles(t, width):
    w = norm(t).split()
    return frozenset([tuple(w)] if 0 < len(w) < width else zip(*(w[k:] for k in range(width))))


def near_by_hand(rows, width, percent=80):
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and sets[a][0] is not None and sets[b][0] is not None and 100 * len(x & y) >= percent * len(x | y):
            parent[root(a)] = root(b)
    low = collections.defaultdict(lambda: math.inf)
    for k, (i, _) in enumerate(sets):
        if i is not None:
            low[root(k)] = min(low[root(k)], i)
    return sorted(((i, len(s), None if i is None else low[root(k)], i is None or i == low[root(k)]) for k, (i, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize("width", [2, 5])
def test_near_awkward(awkward, width):
    got = sorted(map(tuple, minhash_dedup.near_duplicates(awkward, width=width).collect()), key=str)
    assert got == near_by_hand([(i, t) for i, t, _ in AWKWARD], width)
    assert minhash_dedup.near_duplicates(awkward.where(F.lit(False))).count() == 0
    assert minhash_dedup.drop_near_duplicates(awkward, width=width).columns == awkward.columns


def test_near_crowded(spark):
    """A group of near copies, many of them just under the threshold among each other, so that lists are long and mixed."""
    r = random.Random(3)
    base = prose(120, 5).split()
    rows = []
    for i in range(150):
        w = base[:]
        for _ in range(r.randint(0, 22)):
            w[r.randrange(len(w))] = "".join(r.choice("xyz") for _ in range(6))
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, prose(80, 100 + i)) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, minhash_dedup.near_duplicates(df, width=2).collect()), key=str)
    assert got == near_by_hand(rows, 2)


def test_near_crowded_places(spark, monkeypatch):
    """Near copies of one size just under the threshold: most of their common shingles stand too far back for sets of that size, and are not paired."""
    r, base, rows, met = random.Random(4), prose(150, 6).split(), [], []
    for i in range(160):
        w = base[:]
        for k in r.sample(range(len(w)), r.randint(0, 12)):
            w[k] = "".join(r.choice("xyz") for _ in range(9))
        rows.append((i, " ".join(w)))

    def counted(few, many, key, *args, plain=minhash_dedup.salted_pairs):
        sizes = [{x[0]: x[1] for x in side.groupBy(key).count().collect()} for side in (few, many)]
        met.append(sum(n * sizes[1][k] for k, n in sizes[0].items()))
        return plain(few, many, key, *args)

    monkeypatch.setattr(minhash_dedup, "salted_pairs", counted)
    got = sorted(map(tuple, minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()), key=str)
    assert got == near_by_hand(rows, 2)
    assert sum(met) < 5_000  # 57,758 by the first fifth of each set alone


def test_near_candidates_once(spark, monkeypatch):
    """Candidates meet the signatures of either end in one join each, also where the ends' numbers of pairs are counted."""
    plans, put = [], scratch.Scratch.put

    def seen(self, df, name):
        if name == "likely":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return put(self, df, name)

    monkeypatch.setattr(scratch.Scratch, "put", seen)
    rows = [(i, prose(60, i // 2) + " more" * (i % 2)) for i in range(20)]
    got = sorted(map(tuple, minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()), key=str)
    assert got == near_by_hand(rows, 2)
    assert plans and all(p.count("Join LeftOuter") == 2 for p in plans)  # 4 when degrees were counted in the joined rows


def test_near_crowded_once(spark, monkeypatch):
    """Near copies that share several of their changes: a pair of a crowded list is made under its first common shingle only, and hardly one under the threshold is made."""
    r, base, rows, made = random.Random(8), prose(170, 8).split(), [], []
    changes = [(at, "".join(r.choice("xyz") for _ in range(9))) for at in r.sample(range(170), 40)]
    for i in range(160):
        w = base[:]
        for at, word in r.sample(changes, 13):
            w[at] = word
        rows.append((i, " ".join(w)))

    class Counted:
        def __init__(self, pairs):
            self.pairs = pairs

        def where(self, may):
            out = self.pairs.where(may)
            made.append([out.count(), out.select(F.least("id", "id2"), F.greatest("id", "id2")).distinct().count()])
            return out

    monkeypatch.setattr(minhash_dedup, "salted_pairs", lambda *args, plain=minhash_dedup.salted_pairs: Counted(plain(*args)))
    got = sorted(map(tuple, minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()), key=str)
    assert got == near_by_hand(rows, 2)
    assert made and made[0][0] == made[0][1] > 0, made


def test_salted_pairs_in_proportion(spark):
    """A key whose rows nearly all meet all others: its rows go out in proportion to their number, not once for each row that they meet."""
    many = spark.range(400).select(F.lit(1).alias("k"), "id", F.lit(400).alias("len"), F.lit(300).alias("rest"))
    few = many.where("id < 300")
    pairs = scratch.salted_pairs(few, many, "k", "id", ("id",), 400, "rest")
    assert pairs.count() == 300 * 400 == pairs.select("id", "id2").distinct().count()
    assert few.select(F.sum(scratch.salts(400, "rest"))).first()[0] <= 4 * 400 + 300  # 120,000 by the length alone


def test_driver_garbage(spark, monkeypatch):
    """After a table is written the driver's garbage goes if its heap has grown."""
    ran, tidy = [], scratch.tidy
    monkeypatch.setattr(scratch, "tidy", lambda s: ran.append(tidy(s)))
    for full in (0, 1):
        monkeypatch.setattr(scratch, "FULL", full)
        kept = scratch.Scratch(spark)
        assert kept.put(spark.range(3), "few").count() == 3
    assert ran == [True, False]


def test_repeats_batches(spark):
    """Texts and sets go to Python in batches of bounded bytes, 10,000 rows in one batch or not."""
    df = spark.range(3000, numPartitions=1).select("id", F.repeat(F.lit("0123456789"), 1000).alias("text"))  # 30 MB

    def keys(b):
        assert b.nbytes <= 2 * scratch.BATCH, b.nbytes
        ids = b.column(0).to_numpy(zero_copy_only=False)
        yield (ids // 2).astype(np.uint64) << np.uint64(20), ids

    def once(b):
        for k, _ in keys(b):
            yield k

    assert repeats.repeated(df, keys, 3000)(np.arange(1500, dtype=np.uint64) << np.uint64(20)).all()
    counts = repeats.tally(df, once, 3000)
    assert (repeats.counted(counts, np.arange(1500, dtype=np.uint64) << np.uint64(20)) >= 2).all() and counts.sum() == 6000


def test_near_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = sorted(map(tuple, minhash_dedup.near_duplicates(documents, width=5).collect()), key=str)
    assert got == near_by_hand(rows, 5)


def test_components(spark):
    r = random.Random(9)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000, 1000 + k) for k in range(1, 200)]
    got = {x.id: x.component for x in scratch.components(scratch.Scratch(spark), spark.createDataFrame(pairs, "a long, b long")).collect()}
    label = {k: k for p in pairs for k in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    assert got == {k: v for k, v in label.items() if any(k in p and p[0] != p[1] for p in pairs)}


def test_word_hashes_of_long_texts():
    text = (prose(300_000, 4) + " ").encode()
    raw, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    long, at = bytehash.hash_words(raw, off, 0, 1)
    assert len(long) == len(text.split()) == at[-1]
    starts, ends, _ = bytehash.word_spans(raw[: 1 << 20], np.array([0, 1 << 20]))
    short = bytehash.span_hashes(bytehash.prefix_sums(raw[: 1 << 20]), starts, ends)
    assert (long[: len(short) - 1] == short[:-1]).all()


# -- benchmark passages -----------------------------------------------------


def words(t):
    return re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", norm(t))


def contamination_by_hand(docs, items, width=10):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(len(w), width)
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= got
        out.append((i, len(w), len(hit), ",".join(sorted(found)), bool(hit)))
    return sorted(out, key=str)


def test_near_duplicates_repeated_ids(spark):
    a, b = prose(80, 700), prose(80, 701)
    rows = [(1, a), (5, a + " more"), (5, b), (9, b + " more"), (7, prose(80, 702)), (7, prose(80, 703))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(df).collect())
    assert got == [(1, 76, 1, True), (5, 76, 5, True), (5, 77, 1, False), (7, 76, 7, True), (7, 76, 7, True), (9, 77, 5, False)]
    left = sorted(map(tuple, minhash_dedup.drop_near_duplicates(df).collect()))
    assert left == sorted(rows[k] for k in (0, 2, 4, 5))


def test_contamination_awkward(spark, awkward):
    items = spark.createDataFrame([(1, "beta GAMMA"), (2, prose(60, 2)), (3, ""), (4, None), (None, "alpha"), (5, "beta gamma"), (11, "456")], "item_id long, text string").withColumn("ws", F.lit(1))
    got = decontaminate.contamination(awkward, items).select("doc_id", "n_words", "n_hit", F.array_join("items", ","), "contaminated")
    want = contamination_by_hand([(i, t) for i, t, _ in AWKWARD], [(r.item_id, r.text) for r in items.collect() if r.item_id is not None])
    assert sorted(map(tuple, got.collect()), key=str) == want
    kept = decontaminate.drop_contaminated(awkward, items)
    assert kept.columns == awkward.columns and kept.count() == sum(not w[-1] for w in want)
    assert decontaminate.contamination(awkward, items.where(F.lit(False))).where("contaminated").count() == 0
    assert decontaminate.contamination(awkward.where(F.lit(False)), items).count() == 0


def test_contamination_unnamed_items(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four five"), (3, "six")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "two three"), (7, "five"), (None, "five")], "item_id long, text string")
    got = decontaminate.contamination(docs, items, unnamed=True).select("doc_id", "n_hit", "items", "contaminated").collect()
    assert sorted(map(tuple, got)) == [(1, 2, [], True), (2, 1, ["7"], True), (3, 0, [], False)]
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, items, unnamed=True).collect()] == [3]


def test_contamination_in_blocks(spark, awkward, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 7)
    items = spark.createDataFrame([(2, prose(60, 2)), (1, "beta gamma")], "item_id long, text string")
    got = decontaminate.contamination(awkward, items).select("doc_id", "n_words", "n_hit", F.array_join("items", ","), "contaminated")
    assert sorted(map(tuple, got.collect()), key=str) == contamination_by_hand([(i, t) for i, t, _ in AWKWARD], [(2, prose(60, 2)), (1, "beta gamma")])


# -- tokens -----------------------------------------------------------------

ODD = [
    "", "<|endoftext|>", "a<|endoftext|>  <|endoftext|>b", "  \n\n x\t\ty  ", "\x1c \x1d a\x85b\xa0 c 　 z", "I'm you'll 'RE don't", "ﬁ²½Ⅷ٣ x²", "😀😀 a😀", "漢字かな交じり文" * 20, "-" * 300, " " * 500 + "x", "​﻿a", "é" * 400, "a" * 800, "abc" * 1000,
    *("".join(rng.choice("aeiou thndsr'.,!?0123 \n\t<|>ßéñ漢😀́\xa0") for _ in range(rng.randint(1, 80))) for _ in range(800)),
]


def test_bpe_like_tokenizers(spark, awkward):
    reference = Tokenizer.from_file(BPE)
    df = spark.createDataFrame([*enumerate(ODD)], "doc_id long, text string")
    for r in bpe.round_trip(df, BPE).collect():
        want = reference.encode(ODD[r.doc_id], add_special_tokens=False).ids
        assert r.ids == want and r.decoded == reference.decode(want, skip_special_tokens=False)
    got = bpe.round_trip(awkward, BPE)
    assert sorted((r.doc_id, r.decoded) for r in got.collect() if r.doc_id) == sorted((i, t or "") for i, t, _ in AWKWARD if i)
    assert bpe.decode_ids(got, BPE, out_col="again").where("again <> decoded").count() == 0
    assert bpe.round_trip(awkward.where(F.lit(False)), BPE).count() == 0


def test_bpe_pairs_and_merges():
    own = bpe.ByteBPE(open(BPE, encoding="utf-8").read())
    r = np.random.default_rng(1)
    a, b = r.integers(0, 50256, 3000), r.integers(0, 50256, 3000)
    good = own.compatible(a, b)
    for x, y, ok in zip(a.tolist(), b.tolist(), good.tolist()):
        assert ok == (own.merge(own.bytes[x] + own.bytes[y]) == [x, y])
    for w in (b"thonreinghesthandtheonesthatrerere", b"x" * 70, "éàü".encode() * 20):
        toks = [own.single[c] for c in w]
        assert own.merge(w) == own._merge_short(toks)


# -- trained models ---------------------------------------------------------


def test_quality_and_toxicity_held_out(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF2}/labels.parquet").collect()}
    for name, column, mod, left, least in (("op1_quality", "quality", 3, 1, 0.97), ("op6_toxicity", "toxic", 4, 2, 0.9)):
        rows = queries.QUERIES[name](spark, SF2).collect()
        assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == left) and 0 <= r.score <= 1 for r in rows)
        held = [(r.predicted, labels[r.doc_id][column]) for r in rows if r.held_out and r.doc_id in labels]
        assert sum(p == y for p, y in held) >= least * len(held)


def test_languages_held_out(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "lang").collect()}
    held = [(r.lang_pred, lang[r.doc_id]) for r in queries.QUERIES["op5_langid"](spark, SF2).collect() if r.held_out]
    assert len(held) > 150 and sum(p == y for p, y in held) >= 0.98 * len(held)


def test_codewords():
    for n in (2, 3, 4, 6, 7, 12, 40):
        code = langid.codewords(n)
        assert len({tuple(x) for x in code}) == n and all(abs(c.sum()) < n for c in code.T)
        assert min(int((a != b).sum()) for a, b in itertools.combinations(code, 2)) >= 1


def test_models_awkward(spark, awkward):
    labels = spark.createDataFrame([(1, 1, 1), (9, 0, 0), (10, 1, 0), (8, 0, 1), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for module, column in ((quality, "quality"), (toxicity, "toxic")):
        model = module.fit(awkward, labels, column)
        rows = module.score(awkward, model).collect()
        assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
        assert module.fit(awkward, labels.where(F.lit(False)), column) is None
        assert module.score(awkward, None).count() == len(AWKWARD)
        assert module.score(awkward.where(F.lit(False)), model).count() == 0
    model = langid.fit(awkward)
    got = sorted((str(r.doc_id), r.lang_pred) for r in langid.predict(awkward, model).collect())
    assert len(got) == len(AWKWARD) and all(p == "und" for i, p in got if i in ("2", "3", "5", "9")) and all(p != "und" for i, p in got if i in ("1", "6", "7"))
    assert {r.lang_pred for r in langid.predict(awkward, None).collect()} == {"und"}
    with pytest.raises(ValueError):
        toxicity.score(awkward, None, keep=["doc_id", "score"])


def test_long_texts_in_parts():
    text = prose(900_000, 8)
    raw, off = bytehash.buffers(pa.array(["x y", text, "", None]))
    parts, owner = bytehash.segments(raw, off)
    assert parts[0] == 0 and parts[-1] == off[-1] and (np.diff(parts) >= 0).all() and sorted(set(owner.tolist())) == [0, 1, 2, 3] and len(owner) > 4


def test_sample_is_bounded(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("y"))
    table, totals = sampling.labelled_sample(docs, "doc_id", "text", labels, "y", rows_per_label=100)
    n = collections.Counter(table.column("label").to_pylist())
    assert totals == {0: 2700, 1: 300} and 60 < n[0] < 140 and 60 < n[1] < 140


# -- language model ---------------------------------------------------------


def test_lattice_sums_all_segmentations():
    pieces = lattice_lm.Pieces(sorted([lattice_lm.START, lattice_lm.START + b"ab", b"a", b"b", b"ab", b"c", b"bc", *(bytes([x]) for x in lattice_lm.START)]), np.log(np.linspace(1, 2, 11)))
    pieces = lattice_lm.Pieces(pieces.pieces, np.log(np.linspace(1, 2, len(pieces.pieces) + 1) / 20))
    lattice, p = pieces.prepare(), dict(zip(pieces.pieces, pieces.logp))

    def total(w):
        return 1.0 if not w else sum(math.exp(p[w[:k]]) * total(w[k:]) for k in range(1, len(w) + 1) if w[:k] in p)

    some = [b"", b"a", b"abc", b"abab", b"cab"]
    assert np.allclose(lattice.score(some), [math.log(total(lattice_lm.START + w)) for w in some])
    assert np.allclose([lattice._long(lattice_lm.START + w) for w in some], lattice.score(some))
    count = lattice.score(some, np.ones(len(some)))
    again = np.zeros(len(p) + 1)
    for w in some:
        lattice._long(lattice_lm.START + w, again, 1.0)
    assert np.allclose(count, again)
    sizes = np.array([len(x) for x in pieces.pieces])
    assert math.isclose((count[:-1] * sizes).sum(), sum(len(lattice_lm.START + w) for w in some))


@pytest.mark.parametrize("most", [lattice_lm.FREQUENT, 3])
def test_lm_scores(awkward, most, monkeypatch):
    monkeypatch.setattr(lattice_lm.frequent_words, "__defaults__", (most,))
    pieces = lattice_lm.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    got = lattice_lm.score(awkward, pieces, learn_from=sampling.remainder("doc_id", 10) != 0).collect()
    train = [(i, t) for i, t, _ in AWKWARD if zlib.crc32(b"" if i is None else str(i).encode()) % 10]
    c = collections.Counter(w for _, t in train for w in norm(t).split())
    n_all, v = sum(c.values()) + len(train), len(c) + 1
    want = collections.Counter()
    for i, t, _ in AWKWARD:
        w = norm(t).split()
        base = math.log10((len(train) + 0.1) / (n_all + 0.1 * (v + 1))) + sum(math.log10((c[x] + 0.1) / (n_all + 0.1 * (v + 1))) for x in w)
        want[i, len(w) + 1, 1 + sum(x in c for x in w), n_all, round(base, 3)] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lattice_lm.score(awkward.where(F.lit(False)), pieces).count() == 0


# -- repeated passages ------------------------------------------------------


def test_passages(spark, awkward):
    passage = prose(51, 77)
    rows = [(i, prose(80 + i, 200 + i) + " " + (passage if i < 6 else prose(51, 900 + i)) + " " + prose(70, 400 + i)) for i in range(30)]
    got = paragraph_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted({r.doc_id for r in got}) == [0, 1, 2, 3, 4, 5] and len({r.cluster_id for r in got}) == 1
    assert all(r.first_id == 0 and r.removable == (r.doc_id > 0) and 80 + r.doc_id <= r.start_word and r.end_word <= 131 + r.doc_id for r in got)
    assert {r.doc_id for r in paragraph_dedup.repeated_passages(awkward).collect()} == {10, 11}
    assert paragraph_dedup.repeated_passages(awkward.where(F.lit(False))).count() == 0


def test_passages_documents(documents):
    got = {r.doc_id for r in paragraph_dedup.repeated_passages(documents).collect()}
    runs = {24: set(), 40: set()}
    for n, found in runs.items():
        seen = {}
        for r in documents.select("doc_id", "text").collect():
            w = words(r.text)
            for k in range(len(w) - n + 1):
                first = seen.setdefault(tuple(w[k : k + n]), r.doc_id)
                if first != r.doc_id:
                    found |= {first, r.doc_id}
    assert runs[40] <= got
    assert len(got - runs[24]) <= 0.05 * len(got)  # what is only similar, not equal


def test_passages_first(spark):
    passage = prose(60, 600)
    whole = prose(90, 601) + " " + passage + " " + prose(70, 602)
    rows = [(5, prose(30, 603) + " " + passage + " " + prose(40, 604)), (10, whole), (20, whole)]
    got = paragraph_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    cut = {i: set().union(*(range(r.start_word, r.end_word) for r in got if r.doc_id == i and r.removable)) for i in (5, 10, 20)}
    # A window that is similar, not equal, reaches up to two words beyond the passage.
    assert not cut[5] and len(cut[10]) > 30 and cut[10] <= set(range(88, 152)) and cut[20] == set(range(220))
    held = [{c for r in got if r.doc_id == i and r.first_id == 5 for c in r.clusters} for i in (5, 10, 20)]
    assert held[0] & held[1] & held[2]


def test_passages_midline_recall():
    """Passages that start mid-line and are equal from 33 words on, or similar (0.8) from 50 on, share a window."""
    r = random.Random(5)

    def windows(w):
        text = " ".join([*(r.choice(VOCAB) for _ in range(r.randint(30, 60))), *w, *(r.choice(VOCAB) for _ in range(r.randint(30, 60)))])
        return {int(x) for _, _, (_, _, core) in paragraph_dedup._found(pa.array([text]), 5, 80, 2) for x in core}

    for size, edits, least in ((33, 0, 1.0), (40, 0, 1.0), (50, 1, 0.9), (60, 1, 0.95), (120, 2, 0.95)):
        met = n = 0
        while n < 100:
            w = [r.choice(VOCAB) for _ in range(size)]
            v = w[:]
            for _ in range(edits):
                v[r.randrange(size)] = "changed"
            x, y = shingles(" ".join(w), 5), shingles(" ".join(v), 5)
            if len(x & y) >= 0.8 * len(x | y):
                met, n = met + bool(windows(w) & windows(v)), n + 1
        assert met >= least * n


def test_passages_lines(spark):
    short, text = prose(9, 501), prose(30, 502)
    rows = [(i, prose(12 + i, 510 + i) + "\n" + (short if i < 3 else prose(9, 520 + i)) + ".\r\n" + prose(14, 530 + i)) for i in range(6)] + [(6, text), (7, text), (8, "\n\n" + short)]
    got = paragraph_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), shortest=5).collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.first_id) for r in got} == {(0, 12, 21, 0), (1, 13, 22, 0), (2, 14, 23, 0), (6, 0, 30, 6), (7, 0, 30, 6), (8, 0, 9, 0)}


def test_passages_similar_lines(spark):
    rows, pairs = [], []
    for k in range(60):
        w = prose(50 + k % 11, 1000 + k).split(" ")
        changed = [*w[: len(w) // 2], "changed", *w[len(w) // 2 + 1 :]]
        a, b = " ".join(w), " ".join(changed)
        if k % 2:  # inside longer texts
            a, b = (f"{prose(12, 2000 + 2 * k + i)}\n{x}\n{prose(15, 3000 + 2 * k + i)}" for i, x in enumerate((a, b)))
        rows += [(2 * k, a), (2 * k + 1, b)]
        if k < 20:  # of 40 words: 31 of 41 shingles, under 0.8
            w = prose(40, 4000 + k).split(" ")
            rows += [(500 + 2 * k, " ".join(w)), (501 + 2 * k, " ".join([*w[:20], "changed", *w[21:]]))]
    got = paragraph_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), shortest=5).collect()
    whole = collections.defaultdict(set)
    for r in got:
        if r.n_words >= 50:
            whole[r.doc_id // 2].add((r.doc_id, r.first_id))
    assert sum(whole[k] == {(2 * k, 2 * k), (2 * k + 1, 2 * k)} for k in range(60)) >= 58
    assert not any(r.doc_id >= 500 and r.n_words >= 40 for r in got)


def test_passages_lines_documents(documents):
    got = {r.doc_id for r in paragraph_dedup.repeated_passages(documents, shortest=5).collect()}
    seen = collections.defaultdict(set)
    for r in documents.select("doc_id", "text").collect():
        for x in (r.text or "").split("\n"):
            if len(words(x)) >= 5:
                seen[tuple(words(x))].add(r.doc_id)
    assert set().union(*(x for x in seen.values() if len(x) > 1)) <= got


# -- preferences ------------------------------------------------------------


def test_preferences(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (2, 2, "user", "why"), (3, 1, "assistant", "x"), (3, 0, "system", None), (4, 0, "user", "hi"), (4, 1, "assistant", "yes"),
        (None, 0, "user", "lost"), (5, 0, None, "odd"), (5, 0, None, "odd"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit("clash"))
    convs = preference.conversations(turns)
    got = {(r.chosen_id, r.rejected_id): r for r in preference.format_pairs(preference.same_opening(convs)).collect()}
    assert sorted(got) == [(1, 2), (1, 4)]
    r = got[1, 2]
    assert (r.n_prefix, r.prompt, r.chosen) == (1, "<|user|>\nhi<|end|>\n", "<|assistant|>\nyes<|end|>\n")
    assert [r.chosen[a:b] for a, b in r.chosen_mask] == ["yes<|end|>\n"] and [r.rejected[a:b] for a, b in r.rejected_mask] == ["no<|end|>\n"]
    assert got[1, 4].chosen == got[1, 4].rejected == "" and got[1, 4].n_prefix == 2
    borrowed = {(r.chosen_id, r.rejected_id): r for r in preference.format_pairs(preference.borrowed_reply(convs)).collect()}
    assert sorted(borrowed) == [(1, 2), (2, 3), (3, 4), (4, 5)] and borrowed[1, 2].rejected == "<|assistant|>\nwhy<|end|>\n"
    assert preference.format_pairs(preference.same_opening(preference.conversations(turns.where(F.lit(False))))).count() == 0

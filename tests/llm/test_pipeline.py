"""The pipeline against a plain version of each stage."""

import random
import tracemalloc

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sparkmoat.llm import bpe, scratch, toxicity
from sparkmoat.llm.sampling import remainder

from .test_operators import contamination_by_hand, near_by_hand, norm, prose

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), learn_from=remainder("doc_id", 4) != 2)
    toxic = {r.doc_id for r in toxicity.score(docs, model).where("score >= 0.3").collect()}
    left = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in toxic}
    last = {norm(t): i for i, t in sorted(left.items())}
    left = {i: t for i, t in left.items() if last[norm(t)] == i}
    left = {i: left[i] for i, _, _, kept in near_by_hand(sorted(left.items()), 5) if kept}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r[0]: left[r[0]] for r in contamination_by_hand(sorted(left.items()), items) if not r[-1]}
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {i: reference.encode(t or "", add_special_tokens=False).ids for i, t in left.items()}


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    assert corpus_pipeline.STAGES[1][1](spark, docs.where(F.lit(False)), SF).count() == 0


def test_pipeline_awkward(spark, tmp_path):
    """Null, empty, repeated and equal texts, null ids, and columns with the names that stages use inside; then an empty table."""
    a, b = prose(80, 31), prose(80, 32)
    rows = [(1, a), (2, a.upper()), (3, a + " more"), (4, None), (5, ""), (6, b), (6, b), (None, b + " end"), (7, prose(40, 33) + " planted passage of one item here " + prose(30, 34)), (8, "   "), (9, prose(30_000, 35))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("__i", "__s", "__m", "__score", "score", "kept", "keep_id", "items", "id", "n", "component", "token"):
        docs = docs.withColumn(name, F.lit("clash"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "planted passage of one item here"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id if r.doc_id is not None else -1) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    # Of 1 and 2 the larger id stays, 3 is a near copy of it; of 4 and 5 one empty text stays; a repeated row stays once; without an id nothing is linked.
    assert got == [-1, 2, 5, 6, 8, 9]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.where(F.lit(False)), str(tmp_path)).count() == 0


def test_batches_of_stages(spark):
    """What the stages leave to their caller to write has batches of bounded bytes, too; a lower bound of the session stays."""
    key, docs = "spark.sql.execution.arrow.maxBytesPerBatch", spark.read.parquet(f"{SF}/documents.parquet")
    wide = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("0123456789"), 1000).alias("text"))  # 30 MB
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    before = spark.conf.get(key)
    try:
        for name in ("toxicity", "bpe"):
            for own in (before, "1m"):
                spark.conf.set(key, own)
                dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
                assert wide.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] <= 2 * scratch.BATCH
                assert (spark.conf.get(key) == "1m") == (own == "1m")
    finally:
        spark.conf.set(key, before)


def taken(f):
    """What f() returns, and the MB that Python had at most and has left meanwhile."""
    tracemalloc.start()
    try:
        out = f()
        left, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    return out, most / 1e6, left / 1e6


def test_toxicity_memory():
    """What scoring takes beside the texts doesn't grow with the batch, and parts give the scores of single texts."""
    texts = pa.array([prose(300, k) for k in range(2000)])
    model = toxicity.train((pa.compute.match_substring(texts, "ab").to_numpy(zero_copy_only=False)[:100]).astype(float), texts[:100], texts.is_valid().to_numpy(zero_copy_only=False).astype(float), l1=0.1)
    toxicity.scores(model, texts[:1])
    got, most, _ = taken(lambda: toxicity.scores(model, texts))
    assert most < 30, most
    assert len(model.index) and got[::97].tolist() == [toxicity.scores(model, texts[k : k + 1])[0] for k in range(0, 2000, 97)]


def test_tokenizer_memory():
    """A remembered word takes its ids only."""
    tokenizer, r = bpe._loaded(public_tokenizers.path("byte_bpe_50k.json")), random.Random(5)
    words = [" " + "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(20_000)]
    tokenizer.memory.clear()
    (ids, back), _, left = taken(lambda: tokenizer.encode_batch(["".join(words)]))
    assert back[0] == "".join(words).encode() and tokenizer.decode(memoryview(ids[0]).cast("i")) == "".join(words)
    assert left < 4.5, left

"""A cleaning pipeline over the documents table, each stage written and read again as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmoat.llm import bpe, decontaminate, exact_dedup, minhash_dedup, toxicity
from sparkmoat.llm.queries import table, tokenizer_path
from sparkmoat.llm.sampling import remainder
from sparkmoat.llm.scratch import Scratch, bound_batches


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores under 0.3; null and empty texts are scored by the constant alone. Ties, repeats and empty tables need no care."""
    bound_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn_from=remainder("doc_id", 4) != 2)
    return docs.where(toxicity.score_of(docs, model) < 0.3)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; null counts as empty, and one empty document stays. A repeated row stays once."""
    return exact_dedup.drop_copies(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id: five-word shingles, similarity 0.8 or more. Texts without words, and rows without an id, stay."""
    return minhash_dedup.drop_near_duplicates(docs, width=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; null and empty texts have none."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), unnamed=True)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, and a hash of the text that they decode to; a null text is empty."""
    bound_batches(spark)
    done = bpe.round_trip(docs, tokenizer_path())
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("bpe", tokenise),
]

#: A trained classifier decides in the first stage, which SQL can't express; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, scratch.put(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return docs

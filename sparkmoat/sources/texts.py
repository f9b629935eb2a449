"""Texts to inspect, and where results go.

A table of texts has (doc_id, text, scope, prompt_context); scope is input or
output and prompt_context belongs to outputs only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_INPUT_CHARS = 8_000_000


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: str = "input") -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(scope).alias("scope"), F.lit(None).cast("string").alias("prompt_context"))


def conversation_texts(turns: DataFrame) -> DataFrame:
    """Each turn as a text: the assistant's turns are outputs, with the turn before as context."""
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    out = F.col("role") == "assistant"
    return turns.select((F.col("conv_id") * 10_000 + F.col("turn")).alias("doc_id"), "text", F.when(out, "output").otherwise("input").alias("scope"), F.when(out, before).alias("prompt_context"))


def read_texts(spark: SparkSession, path: str, format: str = "parquet", id_col: str = "doc_id", text_col: str = "text", scope: str = "input", schema: str | None = None, **options) -> DataFrame:
    """Texts from Parquet, ORC, JSON lines, CSV or plain text files (one text a file with ``wholetext``, which then is its own id)."""
    reader = spark.read.format(format).options(**options)
    df = (reader.schema(schema) if schema else reader).load(path)
    if format == "text":
        df = df.withColumn("doc_id", F.xxhash64("value")).withColumnRenamed("value", "text")
        id_col, text_col = "doc_id", "text"
    return texts(df, id_col, text_col, scope)


def findings_long(results: DataFrame) -> DataFrame:
    """One row a finding: (doc_id, ordinal, rule_id, severity, action, start, end, message, redacted_preview, metadata)."""
    return results.select("doc_id", F.posexplode("findings").alias("ordinal", "f")).select("doc_id", "ordinal", "f.*")


def write_results(results: DataFrame, path: str, format: str = "parquet", mode: str = "error") -> None:
    """Results with their findings; never the original text."""
    results.drop("text", "prompt_context").write.mode(mode).format(format).save(path)

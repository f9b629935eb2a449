"""Bounded samples of labelled rows for the classifiers, and split rules on ids."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rows of one label, and most bytes of text in all, that a classifier is fitted on.
ROWS_PER_LABEL, SAMPLE_BYTES = 3000, 48 << 20
#: Texts above this size are scored like all others but are not sampled for fitting, unless ``longest`` says so.
LONGEST_SAMPLED = 1 << 20


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, mod ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % mod


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_col: str, rows_per_label: int = ROWS_PER_LABEL, sample_bytes: int = SAMPLE_BYTES, longest: int = LONGEST_SAMPLED) -> tuple[pa.Table, dict]:
    """(table of label and text, {label: rows that have it in all}).

    ``labels`` has id_col and label_col, and only rows that may be learned
    from. Rows are chosen by a hash of the id, so the sample is the same on
    every run and doesn't depend on partitions; its size is bounded by
    rows_per_label for each label (about: each row is drawn on its own) and by
    sample_bytes; texts above ``longest`` bytes are not learned from. A row of
    ``labels`` that repeats an id is one row, with one of its labels. Only counts, the sampled ids and the sampled texts reach the
    driver.
    """
    labels = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__i"), F.col(label_col).alias("label"))
    totals = {r[0]: r[1] for r in labels.groupBy("label").count().collect()}
    if not totals:
        return pa.table({"label": pa.array([], pa.string()), "text": pa.array([], pa.string())}), totals
    draw = F.pmod(F.xxhash64("__i", F.lit("sample")), F.lit(1 << 30))
    part = F.lit(0)
    for value, n in totals.items():
        part = F.when(F.col("label") == F.lit(value), int(min(1.0, rows_per_label / n) * (1 << 30))).otherwise(part)
    chosen = labels.where(draw < part).dropDuplicates(["__i"])  # about rows_per_label * labels rows: that bounds the broadcast
    texts = docs.where(F.col(text_col).isNotNull() & (F.octet_length(text_col) <= longest)).select(F.col(id_col).alias("__i"), F.col(text_col).alias("text"))
    joined = texts.join(F.broadcast(chosen), "__i")
    size = joined.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > sample_bytes:
        joined = joined.where(F.pmod(F.xxhash64("__i", F.lit("bytes")), F.lit(1 << 30)) < int(sample_bytes / size * (1 << 30)))
    got = joined.select("__i", "label", "text").toArrow()
    order = pa.compute.sort_indices(got, sort_keys=[("__i", "ascending")])
    return got.take(order).select(["label", "text"]).combine_chunks(), totals

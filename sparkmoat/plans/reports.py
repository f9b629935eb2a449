"""Reports over findings: counts, cubes, percentiles, and accuracy against labelled spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_id", "action").agg(F.count(F.lit(1)).alias("n_findings"), F.countDistinct("doc_id").alias("n_docs"))


def cube(findings: DataFrame, docs: DataFrame, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """Findings counted by every subset of ``columns`` of their documents; counts a document first, so the join has one row each."""
    per = findings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n"))
    return per.join(docs.select(F.col(id_col).alias("doc_id"), *columns), "doc_id").cube(*columns).agg(F.sum("__n").alias("n_findings"))


def top_documents(findings: DataFrame, k: int) -> DataFrame:
    return findings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_findings")).orderBy(F.desc("n_findings"), "doc_id").limit(k)


def density(findings: DataFrame) -> DataFrame:
    """Percentiles of the number of findings of the documents that have any."""
    per = findings.groupBy("doc_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return per.agg(F.percentile("n", F.lit(0.5)).alias("p50"), F.percentile("n", F.lit(0.9)).alias("p90"), F.max("n").alias("most"))


def flagged_vs_labels(findings: DataFrame, labels: DataFrame) -> DataFrame:
    flagged = findings.select("doc_id").distinct().withColumn("__f", F.lit(1))
    return labels.join(flagged, "doc_id", "left").groupBy("toxic", "quality").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce("__f", F.lit(0))).alias("n_flagged"))


def confusion(scenarios: DataFrame, expected: DataFrame, actual: DataFrame, by: str) -> DataFrame:
    """True and false positives and negatives by a column of ``scenarios`` (doc_id, by).

    expected, actual: (doc_id, rule_id, start, end), compared as sets. A
    scenario with neither is a true negative.
    """
    keys = ["doc_id", "rule_id", "start", "end"]
    both = expected.select(keys).distinct().withColumn("__e", F.lit(1)).join(actual.select(keys).distinct().withColumn("__a", F.lit(1)), keys, "full_outer")
    e, a = F.col("__e").isNotNull(), F.col("__a").isNotNull()
    count = lambda c: F.sum(c.cast("long"))
    per = both.groupBy("doc_id").agg(count(e & a).alias("tp"), count(~e & a).alias("fp"), count(e & ~a).alias("fn"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scenarios.join(per, "doc_id", "left").groupBy(by).agg(
        F.count(F.lit(1)).alias("scenarios"), *(F.sum(zero(c)).alias(c) for c in ("tp", "fp", "fn")), count(F.col("tp").isNull()).alias("tn")
    )


def rates(counts: DataFrame) -> DataFrame:
    """Precision, recall and exact-span rate of summed counts; 1 where nothing could be wrong."""
    s = counts.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    part = lambda *cs: F.coalesce(F.col("tp") / F.nullif(sum((F.col(c) for c in cs), F.col("tp")), F.lit(0)), F.lit(1.0))
    return s.select(part("fp").alias("precision"), part("fn").alias("recall"), part("fp", "fn").alias("exact_span_rate"))


def manifest(docs: DataFrame, profile_col: str, id_col: str = "doc_id", text_col: str = "text", scope: str = "input") -> DataFrame:
    """What a corpus holds, without its texts."""
    text = F.coalesce(text_col, F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(profile_col).alias("profile"), F.lit(scope).alias("scope"), F.sha2(text, 256).alias("text_sha256"), F.octet_length(text).cast("long").alias("n_bytes"))


def summarize(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Pooled latency figures: interpolated and nearest-rank percentiles, sum and maximum."""
    v = F.col(value)
    return samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"), F.median(v).alias("p50"), F.percentile(v, F.lit(0.95)).alias("p95"), F.expr(f"percentile_disc(0.95) within group (order by `{value}`)").alias("p95_nearest"),
        F.max(v).alias("slowest"), F.sum(v).alias("total"),
    )

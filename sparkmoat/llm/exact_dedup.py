"""Exact de-duplication by a 128-bit content hash, with bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, fresh, salted_join

#: Letters that count as equal.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: str | Column) -> Column:
    """A-Z lower-cased, nothing else; null as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hash_fn=content_hash) -> DataFrame:
    """For every row of ``docs`` the group of equal texts that it belongs to.

    Returns (id_col, keep_id, group_size, kept, text_sha256), one row per row of
    ``docs``. ``keep`` says whether the row with the smallest ("min") or the
    largest ("max") id stays.

    Rows are grouped by (128-bit hash, normalised text): the hash finds the
    group, and the aggregation compares the bytes inside it, so a collision
    makes two groups. Partial aggregation runs before the shuffle, so a text
    that many rows share is sent once per task. Rows then look their group up
    by the hash alone, hot hashes salted; only hashes with several texts, if
    any, are looked up with the text.

    Cases: null text is empty. Ids may repeat: each such row is a row of its
    own, and all rows that carry the id that stays are kept. A null id never
    stays against another; a group without any id keeps its rows (keep_id
    null). An empty table gives an empty result. Further columns of ``docs``
    are ignored, whatever their names.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("__id"), normalised(text_col).alias("__t")).withColumn("__h", hash_fn(F.col("__t")))
    pick = {"min": F.min, "max": F.max}[keep]
    groups = base.groupBy("__h", "__t").agg(pick("__id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("__h", "keep_id", "group_size", F.unhex(F.sha2("__t", 256)).alias("__sha"), F.octet_length("__t").alias("__len"), "__t")
    # The text itself is needed again only where one hash has several texts.
    groups = scratch.put(groups.drop("__t"), "groups")
    shape = groups.agg(F.sum("group_size"), F.count(F.lit(1)), F.max("group_size")).first()
    rows = shape[0] or 0
    many = groups.groupBy("__h").count().where("count > 1").select("__h")
    clash = shape[1] and bool(many.limit(1).count())
    out = ["__id", "keep_id", "group_size", "__sha"]
    if not clash:
        found = salted_join(base.select("__id", "__h"), groups, ["__h"], "__id", "group_size", rows).select(*out)
    else:  # a second pass with the text, for the hashes that clash only
        many = scratch.put(many, "clashes")
        clear = groups.join(many, "__h", "left_anti")
        plain = base.select("__id", "__h").join(many, "__h", "left_anti")
        found = salted_join(plain, clear, ["__h"], "__id", "group_size", rows).select(*out)
        again = base.join(many, "__h", "left_semi")
        exact = again.groupBy("__h", "__t").agg(pick("__id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        found = found.unionAll(salted_join(again, exact, ["__h", "__t"], "__id", "group_size", rows).select("__id", "keep_id", "group_size", F.unhex(F.sha2("__t", 256)).alias("__sha")))
    return found.select(
        F.col("__id").alias(id_col), "keep_id", "group_size", F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("__sha")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """``docs`` with one row of each group of equal texts; all its columns stay.

    A row is named by id and text, null ids included. Rows that repeat the id
    that stays are reduced to one as well; as that is rare, it is only planned
    where such rows exist. Null text is empty, an empty table stays empty, and
    columns may have any names.
    """
    scratch = Scratch(docs.sparkSession)
    i, h = fresh(docs, "__i", "__s")
    named = exact_groups(docs, id_col, text_col, keep).select(F.col(id_col).alias(i), F.unhex("text_sha256").alias(h), F.col("kept").alias("kept"))
    named = scratch.put(named, "named")
    sha = lambda df: F.unhex(F.sha2(normalised(df[text_col]), 256))
    same = lambda df: df[id_col].eqNullSafe(F.col(i)) & (sha(df) == F.col(h))
    left = docs.join(named.where("not kept").select(i, h).distinct(), same(docs), "left_anti")
    again = named.where("kept").groupBy(i, h).count().where("count > 1").select(i, h)
    if not again.limit(1).count():
        return left
    once = docs.join(again, same(docs), "left_semi").withColumn(h, F.sha2(normalised(text_col), 256)).dropDuplicates([id_col, h]).drop(h)
    return left.join(again, same(left), "left_anti").unionAll(once)

"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A window is a run of words of a benchmark item. A text contains it only if it
contains every word of it, so one word is a sufficient prefix: each window is
posted under its rarest word (rarity over all documents), every document word
looks its windows up, the positions must leave room for the whole window, and
the words there must equal the window's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact_dedup import normalised
from .scratch import Scratch, fresh

#: ASCII that belongs to no word, once A-Z are lower-cased.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Most windows in one broadcast; a benchmark with more is joined in blocks of this size.
BROADCAST_WINDOWS = 200_000


def words(text: str | Column) -> Column:
    return F.array_remove(F.split(normalised(text), SEPARATORS), "")


def item_windows(items: DataFrame, id_col: str, text_col: str, width: int, unnamed: bool = False) -> DataFrame:
    """(win, items): every run of ``width`` words (all words of a shorter item) and the ids of its items; with ``unnamed`` also those of items without an id."""
    split = items.where(F.lit(unnamed) | F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), words(text_col).alias("ws")).where("size(ws) > 0")
    size = F.least(F.size("ws"), F.lit(width))
    runs = split.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - size + 1), lambda i: F.slice("ws", i, size))).alias("win"))
    return runs.groupBy("win").agg(F.collect_set("item").alias("items"))


def _posted(docs: DataFrame, text_col: str, windows: DataFrame) -> DataFrame:
    """(anchor, at, win, items): each window under its rarest word, which stands at index ``at`` of it."""
    vocabulary = windows.select(F.explode("win").alias("w")).distinct()
    said = docs.select(F.explode(words(text_col)).alias("w"))
    small = vocabulary.count() <= BROADCAST_WINDOWS
    counts = said.join(F.broadcast(vocabulary) if small else vocabulary, "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    each = windows.select("win", "items", F.posexplode("win").alias("at", "w")).join(counts, "w", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "w")).alias("r")
    return each.groupBy("win").agg(rarest, F.first("items").alias("items")).select(F.col("r.w").alias("anchor"), F.col("r.at").alias("at"), "win", "items")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", width: int = 10, unnamed: bool = False) -> DataFrame:
    """(id_col, text_md5, n_words, n_hit, items, contaminated), one row per row of ``docs``.

    Words are lower-cased (A-Z) runs of letters, digits and non-ASCII. A word
    of a document is hit when it lies inside an occurrence of a window of
    ``width`` consecutive words of an item (of all its words if it has fewer).
    ``items`` lists, sorted, the ids of the items with a window that occurs.

    One pass over the texts carries both the words and the row itself (an empty
    last "word"), so rows without a hit need no further join, and all a row's
    words stay in one generated loop: only verified windows are shuffled.

    Cases: null and empty texts have no words. Items without words are
    left out; so are items without an id, unless ``unnamed``: then their windows
    hit as well, and only ``items`` doesn't list them. Repeated rows each get their row (rows are told apart
    by id and text; equal rows have equal results). Null ids are ids like any
    other. Empty tables are fine; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    windows = scratch.put(item_windows(items, item_id_col, item_text_col, width, unnamed), "windows")
    posted = scratch.put(_posted(docs, text_col, windows), "posted")
    blocks = max(1, -(-posted.count() // BROADCAST_WINDOWS))
    base = docs.select(F.col(id_col).alias("__id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("__key"), words(text_col).alias("ws"))
    start = F.col("pos") - F.col("at")
    whole = (start >= 0) & (start + F.size("win") <= F.size("ws")) & (F.slice("ws", F.greatest(start, F.lit(0)) + 1, F.size("win")) == F.col("win"))
    found = None
    for b in range(blocks):
        part = posted.where(F.pmod(F.xxhash64("anchor"), F.lit(blocks)) == b) if blocks > 1 else posted
        said = base.select("__id", "__key", "ws", F.posexplode(F.concat("ws", F.array(F.lit("") if b == 0 else F.lit("-")))).alias("pos", "anchor"))
        hits = said.join(F.broadcast(part), "anchor", "left").where((F.col("anchor") == "") | whole)
        hits = hits.select("__id", "__key", F.when(F.col("anchor") == "", F.size("ws")).alias("n"), F.when(F.col("anchor") != "", F.struct(start.alias("s"), F.size("win").alias("l"))).alias("span"), F.when(F.col("anchor") != "", F.col("items")).alias("items"))
        found = hits if found is None else found.unionAll(hits)
    rows = found.groupBy("__id", "__key").agg(F.max("n").alias("n"), F.count("n").alias("times"), F.collect_set("span").alias("spans"), F.collect_set("items").alias("items"))
    inside = F.flatten(F.transform("spans", lambda x: F.sequence(x["s"], x["s"] + x["l"] - 1)))
    out = rows.select(
        F.col("__id").alias(id_col), F.col("__key").alias("text_md5"), F.col("n").cast("long").alias("n_words"), F.size(F.array_distinct(inside)).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("__time"),
    ).drop("__time")
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows in which a benchmark window occurs; all columns stay, whatever their names, and so do null and empty texts."""
    i, m = fresh(docs, "__i", "__m")
    hit = contamination(docs, items, id_col, text_col, **options).where("contaminated").select(F.col(id_col).alias(i), F.col("text_md5").alias(m)).distinct()
    key = docs[id_col].eqNullSafe(F.col(i)) & (F.unhex(F.md5(F.coalesce(docs[text_col], F.lit("")))) == F.col(m))
    return docs.join(hit, key, "left_anti")

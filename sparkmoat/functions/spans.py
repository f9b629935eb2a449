"""Spans and findings as column expressions.

Spans are half-open ranges of code points. A candidate regex is run over the
whole text once for its matches and once for the gaps between them; a running
sum of their lengths gives the positions, so characters outside the BMP count
once, as they do in ``length``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FINDING = T.StructType([
    T.StructField("rule_id", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("action", T.StringType()),
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("message", T.StringType()),
    T.StructField("redacted_preview", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])
FINDINGS = T.ArrayType(FINDING)
SEVERITIES = ("low", "medium", "high", "critical")
#: Actions from the weakest to the strongest.
ACTIONS = ("allow", "review", "remove", "redact", "block")


def none() -> Column:
    """An empty array of findings."""
    return F.array().cast(FINDINGS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def finding(rule_id: str, severity, action, start, end, message, preview=None, metadata: dict | None = None) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    items = [as_col(x) for k, v in (metadata or {}).items() for x in (k, v)]
    return F.struct(
        F.lit(rule_id).alias("rule_id"), as_col(severity).alias("severity"), as_col(action).alias("action"), as_col(start).cast("int").alias("start"), as_col(end).cast("int").alias("end"),
        as_col(message).alias("message"), as_col(preview).cast("string").alias("redacted_preview"), F.create_map(*items).cast("map<string,string>").alias("metadata"),
    )


#: Matches that are placed together.
BLOCK = 256


def candidates(text: Column, pattern: str, limit: int | None = None) -> Column:
    """array<struct<start, end, m>>: the matches of a regex that matches no empty text; with ``limit`` the first limit + 1."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    if limit is not None:
        matches, gaps = F.slice(matches, 1, limit + 1), F.slice(gaps, 1, limit + 1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,m:string>>").alias("found"))

    def place(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m")))).alias("found"))

    pairs = F.filter(F.arrays_zip(matches.alias("m"), gaps.alias("gap")), lambda x: x["m"].isNotNull())
    if limit is not None and limit <= BLOCK:
        return F.aggregate(pairs, empty, place)["found"]

    # Many matches are placed in blocks, and then the blocks, as each step copies what was found before.
    def blocks(all_):
        cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size(all_) - 1, F.lit(0)).cast("int"), F.lit(BLOCK)), lambda i: F.aggregate(F.slice(all_, i + 1, BLOCK), empty, place))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(cut, zero, lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")))["starts"]
        moved = F.transform(F.arrays_zip(cut.alias("c"), starts.alias("s")), lambda z: F.transform(z["c"]["found"], lambda x: F.struct((x["start"] + z["s"]).alias("start"), (x["end"] + z["s"]).alias("end"), x["m"].alias("m"))))
        return F.flatten(moved)

    return let(pairs, blocks)


def budgeted(text: Column, pattern: str, limit: int, valid, hit, overflow, guard: Column | None = None, before: bool = False) -> Column:
    """Findings of a rule whose first ``limit`` candidates are looked at; one more gives ``overflow`` of it.

    before: whether candidates that fail ``valid`` don't count towards the limit.
    """

    def body(c):
        found = F.transform(F.filter(F.slice(c, 1, limit), valid) if not before else F.slice(c, 1, limit), hit)
        return F.concat(found, F.when(F.size(c) > limit, F.array(overflow(c[limit]))).otherwise(none()))

    if before:
        made = let(F.filter(candidates(text, pattern), valid), body)
    else:
        made = let(candidates(text, pattern, limit), body)
    return F.when(guard, made).otherwise(none()) if guard is not None else made


def ordered(findings: Column) -> Column:
    """Findings by start, end, rule and metadata."""
    keyed = F.transform(findings, lambda f: F.struct(f["start"].alias("s"), f["end"].alias("e"), f["rule_id"].alias("r"), F.array_sort(F.map_entries(f["metadata"])).alias("m"), f["severity"].alias("sv"), f["action"].alias("a"), f["message"].alias("t"), f["redacted_preview"].alias("p")))
    return F.transform(F.array_sort(keyed), lambda k: F.struct(
        k["r"].alias("rule_id"), k["sv"].alias("severity"), k["a"].alias("action"), k["s"].alias("start"), k["e"].alias("end"), k["t"].alias("message"), k["p"].alias("redacted_preview"), F.map_from_entries(k["m"]).alias("metadata")
    ))


def normalized(text: Column) -> Column:
    """CRLF and CR as LF."""
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def crlf_marks(text: Column) -> Column:
    """The normalised text with CR where a CRLF became one character; empty for texts without CRLF."""
    return F.when(F.contains(text, F.lit("\r\n")), F.replace(F.regexp_replace(text, "\r(?!\n)", "\n"), F.lit("\r\n"), F.lit("\r"))).otherwise("")


def shifted(findings: Column, start: Callable[[Column], Column], end: Callable[[Column], Column] | None = None) -> Column:
    end = end or start
    return F.transform(findings, lambda f: F.struct(*(
        {"start": start(f["start"]), "end": end(f["end"])}.get(n, f[n]).cast("int").alias(n) if n in ("start", "end") else f[n].alias(n) for n in FINDING.names
    )))


def to_original(findings: Column, marks: Column) -> Column:
    """Spans of the normalised text as spans of the original: each place moves by the CRs of ``marks`` before it."""

    def back(p):
        before = F.substring(marks, F.lit(1), p)
        return p + F.length(before) - F.length(F.replace(before, F.lit("\r")))

    return F.when((F.length(marks) > 0) & (F.size(findings) > 0), shifted(findings, back)).otherwise(findings)


def merged(spans: Column) -> Column:
    """Sorted spans (start, end, mark boolean) with those that touch or overlap made one; ``mark`` holds if it does for any."""
    zero = F.array().cast("array<struct<start:int,end:int,mark:boolean>>")

    def step(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), (last["mark"] | s["mark"]).alias("mark"))
        return F.when((F.size(acc) > 0) & (s["start"] <= last["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans), zero, step)


def _spans(findings: Column, actions: tuple[str, ...]) -> Column:
    chosen = F.filter(findings, lambda f: f["action"].isin(*actions))
    return F.transform(chosen, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), (f["action"] == "redact").alias("mark")))


def rebuilt(text: Column, spans: Column, marker: str = "[REDACTED]") -> Column:
    """``text`` with each span left out, or replaced by ``marker`` where it is marked."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc, s):
        kept = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(kept, F.when(s["mark"], F.lit(marker)).otherwise(F.lit("")))).alias("parts"))

    return let(F.aggregate(spans, zero, step), lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.length(text))))


def sanitized(text: Column, findings: Column) -> Column:
    """``text`` after the findings' REMOVE and REDACT actions; in a merged group REDACT wins."""
    return F.when(F.exists(findings, lambda f: f["action"].isin("remove", "redact")), let(merged(_spans(findings, ("remove", "redact"))), lambda s: rebuilt(text, s))).otherwise(text)


def removal_spans(findings: Column) -> Column:
    return merged(_spans(findings, ("remove",)))

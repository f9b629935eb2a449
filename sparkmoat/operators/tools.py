"""Validation of tool calls and tool results.

Calls are checked one by one by an Arrow-batched function (allow-list, schema
subset, resource bounds); their strings are then scanned like outputs. Results
are linked to the expected calls by joins, and their strings scanned like
inputs. A call or batch has at most one finding, the first by the fixed order
of the checks.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import engine
from ..sources.texts import findings_long

#: Bounds of a compiled schema.
SCHEMA_DEPTH, SCHEMA_NODES, ENUM_VALUES = 16, 2048, 64


@dataclass(frozen=True)
class Bounds:
    max_depth: int = 16
    max_nodes: int = 10_000
    max_total_string_chars: int = 100_000
    max_object_properties: int = 256
    max_array_items: int = 1024


@dataclass(frozen=True)
class Tool:
    """A tool that may be called. parameters: a schema of types, enums, properties, required, additionalProperties and items; None takes no arguments."""

    name: str
    parameters: dict | None = field(default=None)

    def __post_init__(self):
        if self.parameters is not None:
            if self.parameters.get("type") != "object":
                raise ValueError("parameters must be of type object")
            _check_schema(self.parameters, 1, [0])


_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _check_schema(s: dict, depth: int, seen: list[int]) -> None:
    seen[0] += 1
    if depth > SCHEMA_DEPTH or seen[0] > SCHEMA_NODES:
        raise ValueError("the schema is too large")
    kind = s.get("type")
    if kind not in (*_KINDS, "integer", "number"):
        raise ValueError(f"type {kind!r} isn't supported")
    if "enum" in s and not 1 <= len(s["enum"]) <= ENUM_VALUES:
        raise ValueError("an enum has 1 to 64 values")
    if kind == "object":
        if not isinstance(s.get("additionalProperties"), bool):
            raise ValueError("objects must declare additionalProperties")
        if set(s.get("required", ())) - set(s.get("properties", {})):
            raise ValueError("a required property isn't declared")
        for p in s.get("properties", {}).values():
            _check_schema(p, depth + 1, seen)
    if kind == "array":
        if "items" not in s:
            raise ValueError("arrays must declare items")
        _check_schema(s["items"], depth + 1, seen)


def _pairs(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a key stands twice")
    return found


def _number(text: str) -> float:
    found = float(text)
    if found in (float("inf"), float("-inf")):
        raise ValueError("a number is too large")
    return found


def _no_number(text: str):
    raise ValueError(f"{text} is no JSON number")


def read_json(text: str):
    """The value of a JSON text with finite numbers and keys that stand once; ValueError or RecursionError for any other."""
    return json.loads(text, object_pairs_hook=_pairs, parse_float=_number, parse_constant=_no_number)


def _fits(value, kind: str) -> bool:
    if kind == "integer":
        return type(value) is int
    if kind == "number":
        return type(value) in (int, float)
    return type(value) is _KINDS[kind]


def _same(a, b) -> bool:
    return type(a) is type(b) and a == b


def check_value(value, schema: dict | None, bounds: Bounds = Bounds()) -> tuple[str, str] | None:
    """(reason, place) of the first thing that is wrong, depth first. Places name declared properties only."""
    nodes = chars = 0
    stack = [(value, schema, 1, "arguments")]
    while stack:
        v, s, depth, place = stack.pop()
        nodes += 1
        if nodes > bounds.max_nodes:
            return "node_limit_exceeded", place
        if depth > bounds.max_depth:
            return "depth_limit_exceeded", place
        if s is not None and not _fits(v, s["type"]):
            return "type_mismatch", place
        if s is not None and "enum" in s and not any(_same(v, e) for e in s["enum"]):
            return "enum_mismatch", place
        if isinstance(v, str):
            chars += len(v)
            if chars > bounds.max_total_string_chars:
                return "string_limit_exceeded", place
        elif isinstance(v, dict):
            if len(v) > bounds.max_object_properties:
                return "object_limit_exceeded", place
            known = (s or {}).get("properties", {})
            missing = [k for k in (s or {}).get("required", ()) if k not in v]
            if missing:
                return "required_property_missing", f"{place}.{missing[0]}"
            chars += sum(map(len, v))
            if chars > bounds.max_total_string_chars:
                return "string_limit_exceeded", place
            if s is not None and not s["additionalProperties"] and set(v) - set(known):
                return "additional_property_forbidden", place
            stack += [(x, known.get(k), depth + 1, f"{place}.{k}" if k in known else f"{place}.*") for k, x in reversed(v.items())]
        elif isinstance(v, list):
            if len(v) > bounds.max_array_items:
                return "array_limit_exceeded", place
            stack += [(x, (s or {}).get("items"), depth + 1, f"{place}[{k}]") for k, x in reversed([*enumerate(v)])]
    return None


def strings(value) -> list[str]:
    """Keys and strings of a JSON value, a key before what it holds."""
    if isinstance(value, str):
        return [value]
    if isinstance(value, list):
        return [s for x in value for s in strings(x)]
    if isinstance(value, dict):
        return [s for k, x in value.items() for s in (k, *strings(x))]
    return []


def check_calls(calls: DataFrame, allowed: list[Tool], bounds: Bounds = Bounds(), content: engine.Config | None = None) -> DataFrame:
    """``calls`` (name, arguments as JSON text, further columns) with ``reason`` and ``location``, null for a call that may run.

    Arguments that aren't strict JSON (a repeated key, a number that isn't
    finite) have a mismatched type.

    content: rules for the strings of calls that are otherwise fine, scanned
    as outputs; it needs a unique column ``call_key``.
    """
    tools = {t.name: t.parameters for t in allowed}

    @F.pandas_udf("reason string, location string, strings array<string>")
    def check(names: pd.Series, arguments: pd.Series) -> pd.DataFrame:
        def one(name, text):
            if name not in tools:
                return "tool_not_allowed", "tool", None
            schema = tools[name]
            try:
                value = None if text is None else read_json(text)
            except (ValueError, RecursionError):
                return "type_mismatch", "arguments", None
            if schema is None:
                return ("arguments_not_allowed", "arguments", None) if value is not None else (None, None, [])
            if value is None:
                return "arguments_required", "arguments", None
            found = check_value(value, schema, bounds)
            return (*found, None) if found else (None, None, strings(value))

        return pd.DataFrame([one(n, a) for n, a in zip(names, arguments)], columns=["reason", "location", "strings"])

    checked = calls.withColumn("__c", check.asNondeterministic()("name", "arguments"))
    out = checked.select(*calls.columns, F.col("__c.reason").alias("reason"), F.col("__c.location").alias("location"), F.col("__c.strings").alias("__s"))
    if content is None:
        return out.drop("__s")
    hit = _first_hit(out.where("reason is null").select(F.col("call_key").alias("key"), F.col("__s").alias("strings")), "output", content)
    out = out.join(hit.withColumnRenamed("key", "call_key"), "call_key", "left")
    return out.withColumn("reason", F.when(F.col("content_rule_id").isNotNull(), "content_policy_violation").otherwise(F.col("reason"))).drop("__s")


def _first_hit(rows: DataFrame, scope: str, config: engine.Config) -> DataFrame:
    """(key, content_rule_id, content_action): the first finding of each row's strings that isn't allowed."""
    each = rows.select("key", F.posexplode("strings").alias("at", "text")).withColumn("scope", F.lit(scope)).withColumn("doc_id", F.struct("key", "at"))
    found = findings_long(engine.inspect(each, config)).where("action <> 'allow'")
    best = found.groupBy(F.col("doc_id.key").alias("key")).agg(F.min(F.struct(F.col("doc_id.at").alias("at"), "ordinal", "rule_id", "action")).alias("f"))
    return best.select("key", F.col("f.rule_id").alias("content_rule_id"), F.col("f.action").alias("content_action"))


#: The checks of a batch of results, in their order.
RESULT_REASONS = (
    "expected_call_limit_exceeded", "result_limit_exceeded", "expected_call_id_missing", "expected_call_id_duplicate", "result_call_id_missing", "result_call_id_duplicate", "result_call_id_unmatched",
    "result_name_missing", "result_name_mismatch", "node_limit_exceeded", "depth_limit_exceeded", "string_limit_exceeded", "object_limit_exceeded", "array_limit_exceeded", "content_policy_violation",
)


def check_results(expected: DataFrame, results: DataFrame, max_expected: int = 128, max_results: int = 128, bounds: Bounds = Bounds(), inspect_content: bool = True, content: engine.Config | None = None) -> DataFrame:
    """(batch_id, reason, location): for every batch its first violation, or null.

    expected (batch_id, call_id, name); results (batch_id, position, call_id,
    name, content as JSON text; what isn't strict JSON is one string). Limits and the expected calls come first,
    then each result in its order, then sizes and contents.
    """
    rank = {r: i for i, r in enumerate(RESULT_REASONS)}

    def problem(reason, df, place=None):
        return df.select("batch_id", F.struct(F.lit(0 if rank[reason] < 4 else 1 if rank[reason] < 9 else 2).alias("part"), (place if place is not None else F.lit(0)).cast("long").alias("place"), F.lit(rank[reason]).alias("rank"), F.lit(reason).alias("reason")).alias("p"))

    sizes = results.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    wanted = expected.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.count("call_id").alias("named"), F.countDistinct("call_id").alias("ids"))
    nth = F.row_number().over(Window.partitionBy("batch_id", "call_id").orderBy("position"))
    linked = results.withColumn("__nth", nth).join(expected.select("batch_id", "call_id", F.col("name").alias("__want")).dropDuplicates(["batch_id", "call_id"]).withColumn("__known", F.lit(True)), ["batch_id", "call_id"], "left")
    at = F.col("position")
    problems = [
        problem("expected_call_limit_exceeded", wanted.where(F.col("n") > max_expected)), problem("result_limit_exceeded", sizes.where(F.col("n") > max_results)),
        problem("expected_call_id_missing", wanted.where("named < n")), problem("expected_call_id_duplicate", wanted.where("ids < named")),
        problem("result_call_id_missing", linked.where("call_id is null"), at), problem("result_call_id_duplicate", linked.where("call_id is not null and __nth > 1"), at),
        problem("result_call_id_unmatched", linked.where("call_id is not null and __known is null"), at), problem("result_name_missing", linked.where("__known and name is null and __want is not null"), at),
        problem("result_name_mismatch", linked.where("__known and name <> __want"), at),
    ]

    @F.pandas_udf("reason string, strings array<string>")
    def check(contents: pd.Series) -> pd.DataFrame:
        def one(text):
            try:
                value = read_json(text) if text is not None else None
            except (ValueError, RecursionError):
                value = text
            found = check_value(value, None, bounds)
            return (found[0], None) if found else (None, strings(value))

        return pd.DataFrame([one(t) for t in contents], columns=["reason", "strings"])

    if inspect_content:
        sized = results.withColumn("__c", check.asNondeterministic()("content"))
        for reason in RESULT_REASONS[9:14]:
            problems.append(problem(reason, sized.where(F.col("__c.reason") == reason), at))
        if content is not None:
            hit = _first_hit(sized.where("__c.reason is null").select(F.struct("batch_id", "position").alias("key"), F.col("__c.strings").alias("strings")), "input", content)
            problems.append(problem("content_policy_violation", hit.select(F.col("key.batch_id").alias("batch_id"), F.col("key.position").alias("position")), F.col("position")))
    found = problems[0]
    for p in problems[1:]:
        found = found.unionAll(p)
    first = found.groupBy("batch_id").agg(F.min("p").alias("p"))
    reason = F.col("p.reason")
    location = F.when(reason.startswith("expected_"), "expected_calls").when(reason.startswith("result_"), "results").when(reason.isNotNull(), "content")
    every = sizes.select("batch_id").unionAll(wanted.select("batch_id")).distinct()
    return every.join(first, "batch_id", "left").select("batch_id", reason.alias("reason"), location.alias("location"))

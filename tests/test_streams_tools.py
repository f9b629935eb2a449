"""Streams equal the batch result for any chunks; tool calls and results."""

import random
import time
from dataclasses import replace

import pytest

from sparkmoat.operators import tools
from sparkmoat.plans import engine
from sparkmoat.plans.policy import STRICT, Policy
from sparkmoat.sources.catalogs import SecretCatalog, Signature
from sparkmoat.streaming import incremental as inc


def batch(spark, text):
    df = spark.createDataFrame([(1, text, "input")], "doc_id long, text string, scope string")
    return engine.inspect(df, engine.only("pii.payment_card", "secrets.detected")).first()


def stream(chunks):
    r = inc.Redactor()
    out = "".join([*(r.feed(c) for c in chunks), r.finish()])
    return out, r


TEXTS = [
    "before 4111-1111-1111-1111 after", "sk-abcdefghijklmnopqrstuvwxyz and 4111111111111111", "ghp_" + "a" * 36, "ghp_" + "a" * 37 + " x", "4111111111111111sk-abcdefghijklmnopqrstuvwxyz",
    "xsk-abcdefghijklmnopqrstuvwxyz", "1 " * 60, "no secrets here", "", "é😀 4111 1111 1111 1111 😀",
]


@pytest.mark.parametrize("text", TEXTS)
def test_every_split(spark, text):
    want = batch(spark, text)
    for k in range(len(text) + 1):
        out, r = stream([text[:k], text[k:]])
        assert out == want.processed_text
        assert sorted((s, e) for _, s, e in r.found) == [(f.start, f.end) for f in want.findings]


def test_random_chunks(spark):
    rng = random.Random(5)
    parts = ["4111111111111111", "4111 1111 1111 1112", "sk-" + "a" * 25, "sk-short", " ", "-", "x", "12", "word ", "ghp_" + "Z" * 36]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(60)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").selectExpr("*", "'input' as scope")
    want = {r.doc_id: r for r in engine.inspect(df, engine.only("pii.payment_card", "secrets.detected")).collect()}
    for i, t in enumerate(texts):
        cuts = sorted(rng.randint(0, len(t)) for _ in range(6))
        out, r = stream([t[a:b] for a, b in zip([0, *cuts], [*cuts, len(t)])])
        assert out == want[i].processed_text, t


def test_limits_and_states():
    r = inc.Redactor(max_chars=5)
    with pytest.raises(ValueError):
        r.feed("too long")
    assert r.state == "cancelled" and r.tail == ""
    assert inc.resolve_mode({"pii.payment_card": ("redact",)}) == "incremental"
    assert inc.resolve_mode({"pii.iban": ("redact",)}) == "buffered"
    with pytest.raises(ValueError):
        inc.resolve_mode({"pii.payment_card": ("redact", "block")}, "incremental")


def test_unbroken_runs():
    for text in ("a" * 400_000, "ghp_" + "a" * 400_000, "sk-" + "b" * 400_000):
        began = time.process_time()
        out, r = stream([*(text[i : i + 10] for i in range(0, len(text), 10)), " end"])
        assert time.process_time() - began < 10
        assert out == stream([text + " end"])[0] and r.more == []


def test_modes_and_catalogs():
    both = engine.only("pii.payment_card", "secrets.detected")
    assert inc.resolve_mode(inc.possible_actions(both, "input")) == "incremental"
    bare = both.with_policy(Policy("own", "1"))
    assert inc.possible_actions(bare, "input") == {"pii.payment_card": ("block", "redact"), "secrets.detected": ("block", "redact")}
    for refused in (bare, both.with_policy(STRICT), engine.only("pii.payment_card", "pii.iban")):
        with pytest.raises(ValueError):
            inc.redactor(refused, "input")
    only_cards = inc.redactor(engine.only("pii.payment_card"), "input")
    assert only_cards.feed("ghp_" + "a" * 36 + " 4111111111111111 ") + only_cards.finish() == "ghp_" + "a" * 36 + " [REDACTED] "
    fine = {"signature_id": "own.key", "provider": "own", "secret_type": "key", "prefixes": ("own-",), "suffix_chars": "ab", "min_suffix_chars": 4}
    inc.check_catalog(SecretCatalog("own", "1", (Signature(**fine), Signature(**fine | {"prefixes": ("top-",), "max_suffix_chars": inc.LONGEST_SUFFIX, "boundary_chars": "abc"}))))
    for more in ({"boundary_chars": "abc"}, {"suffix_ending": "b"}, {"max_suffix_chars": inc.LONGEST_SUFFIX + 1}):
        with pytest.raises(ValueError):
            inc.redactor(replace(both, secrets=SecretCatalog("own", "1", (Signature(**fine | more),))), "input")


def test_chunks_that_end_alone(spark):
    rows = [(1, 0, "x" * 30), (1, 1, "y" * 30), (1, 2, "z"), (2, 0, "a 4111"), (2, 1, None), (2, 2, "111111111111 b")]
    df = spark.createDataFrame(rows, "stream_id long, seq long, chunk string")
    small = replace(engine.only("pii.payment_card", "secrets.detected"), max_input_chars=50)
    assert {r.stream_id: (r.output, r.n_found) for r in inc.redact_chunks(df, small).collect()} == {1: (None, 0), 2: ("a [REDACTED] b", 1)}


def test_idle_streams_go(spark, tmp_path):
    schema = "stream_id string, seq long, chunk string, is_last boolean"
    spark.createDataFrame([("a", 0, "held 4111", False)], schema).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = inc.redact_stream(source, idle_ms=500).writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        end, kept = time.time() + 60, []
        while time.time() < end and kept[-1:] != [0]:
            time.sleep(0.2)
            kept = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
            kept = kept if 1 in kept else []
        assert kept[-1:] == [0]
    finally:
        q.stop()


def test_streaming_query(spark, tmp_path):
    texts = {"a": "x 4111111111111111 y", "b": "plain " * 20}
    rows = [(k, i // 7, t[i : i + 7], i + 7 >= len(t)) for k, t in texts.items() for i in range(0, len(t), 7)]
    schema = "stream_id string, seq long, chunk string, is_last boolean"
    for n in range(2):
        half = [r for r in rows if (r[1] >= 2) == bool(n)]
        spark.createDataFrame(half, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = inc.redact_stream(source).writeStream.format("memory").queryName("redacted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {}
    for r in spark.table("redacted").orderBy("seq").collect():
        got[r.stream_id] = got.get(r.stream_id, "") + r.output
    assert got == {"a": "x [REDACTED] y", "b": texts["b"]}


SEARCH = tools.Tool("search", {"type": "object", "properties": {"q": {"type": "string", "enum": ["a", "b", "sk-abcdefghijklmnopqrstuvwxyz"]}, "n": {"type": "integer"}, "l": {"type": "array", "items": {"type": "number"}}}, "required": ["q"], "additionalProperties": False})


def test_tool_calls(spark):
    cases = [
        ("search", '{"q": "a", "n": 1}', None), ("write", "{}", "tool_not_allowed"), ("search", None, "arguments_required"), ("search", '{"n": 1}', "required_property_missing"), ("search", '{"q": "c"}', "enum_mismatch"),
        ("search", '{"q": "a", "n": true}', "type_mismatch"), ("search", '{"q": "a", "x": 1}', "additional_property_forbidden"), ("search", '{"q": "a", "l": [1, 2.5]}', None), ("search", "not json", "type_mismatch"),
        ("search", '{"q": "c", "q": "a"}', "type_mismatch"), ("search", '{"q": "a", "l": [NaN]}', "type_mismatch"), ("search", '{"q": "a", "l": [1e999]}', "type_mismatch"),
        ("search", '{"q": "sk-abcdefghijklmnopqrstuvwxyz"}', "content_policy_violation"),
    ]
    df = spark.createDataFrame([(i, n, a) for i, (n, a, _) in enumerate(cases)], "call_key long, name string, arguments string")
    got = {r.call_key: r.reason for r in tools.check_calls(df, [SEARCH], content=engine.preset("default")).collect()}
    assert got == {i: r for i, (_, _, r) in enumerate(cases)}
    with pytest.raises(ValueError):
        tools.Tool("x", {"type": "object", "properties": {}})


def test_tool_results(spark):
    expected = spark.createDataFrame([(b, "c1", "search") for b in range(6)] + [(5, "c1", "search")], "batch_id long, call_id string, name string")
    results = spark.createDataFrame(
        [(0, 0, "c1", "search", '"ok"'), (1, 0, "c9", "search", '"ok"'), (2, 0, "c1", "write", '"ok"'), (3, 0, "c1", "search", '"ok"'), (3, 1, "c1", "search", '"ok"'), (4, 0, "c1", "search", '["4111111111111111"]'), (5, 0, "c1", "search", '"x"')],
        "batch_id long, position long, call_id string, name string, content string",
    )
    got = {r.batch_id: r.reason for r in tools.check_results(expected, results, content=engine.preset("default")).collect()}
    assert got == {0: None, 1: "result_call_id_unmatched", 2: "result_name_mismatch", 3: "result_call_id_duplicate", 4: "content_policy_violation", 5: "expected_call_id_duplicate"}

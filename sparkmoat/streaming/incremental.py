"""Texts that arrive in chunks: buffered until their end, or redacted as they come.

A redactor keeps the shortest tail in which a match could still begin or grow
and releases the rest. Whatever the chunks are, its output and findings are
those of the whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.literals import LITERALS, SECRETS, _class, _escape  # noqa: F401
from ..plans.engine import Config
from ..sources.catalogs import BUILTIN, SecretCatalog
from ..sources.texts import MAX_INPUT_CHARS

CARD = re.compile(r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])(?![ -][0-9])", re.ASCII)
#: A card is at most 19 digits with 18 separators, with 2 characters of context before it and 2 after; CR may be half a line end.
HOLD, CONTEXT, CARDS = 42, 2, 128
MARKER = "[REDACTED]"
#: Rules that can be redacted as chunks come.
INCREMENTAL = ("secrets.detected", "pii.payment_card")
#: Suffix characters at most of a signature with a bound; a longer one would be held back too long.
LONGEST_SUFFIX = 65_536


class TooLong(ValueError):
    """A stream has more characters than its limit."""


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def is_card(m: str) -> bool:
    digits = re.sub("[ -]", "", m)
    return not (" " in m and "-" in m) and len(set(digits)) > 1 and luhn(digits)


@lru_cache(16)
def secret_pattern(catalog: SecretCatalog) -> re.Pattern:
    known = sorted(((p, s) for s in catalog.signatures for p in s.prefixes), key=lambda x: (-len(x[0]), x[0]))
    parts = []
    for p, s in known:
        edge = _class(s.boundary_chars or s.suffix_chars)
        longer = "".join(f"(?!{re.escape(q[len(p):])})" for q, _ in known if q != p and q.startswith(p))
        most = "" if s.max_suffix_chars is None else s.max_suffix_chars
        ending = f"(?<={re.escape(s.suffix_ending)})" if s.suffix_ending else ""
        parts.append(f"(?<!{edge}){re.escape(p)}{longer}{_class(s.suffix_chars)}{{{s.min_suffix_chars},{most}}}+(?!{edge}){ending}")
    return re.compile("|".join(parts))


@lru_cache(16)
def run_chars(catalog: SecretCatalog) -> tuple[str, int]:
    """The characters that a secret or what stands at its edges may have, and the length of the longest prefix."""
    prefixes = [p for s in catalog.signatures for p in s.prefixes]
    chars = {c for s in catalog.signatures for c in s.boundary_chars or s.suffix_chars}.union(*prefixes)
    return "".join(sorted(chars)), max(map(len, prefixes), default=0)


def resolve_mode(rules: dict[str, tuple[str, ...]], asked: str = "auto") -> str:
    """incremental or buffered for {rule: actions that its findings can end with}; an asked-for incremental mode that isn't possible is refused."""
    possible = bool(rules) and all(r in INCREMENTAL and set(a) == {"redact"} for r, a in rules.items())
    if asked == "incremental" and not possible:
        raise ValueError("these rules can't be redacted as chunks come")
    return "incremental" if possible and asked != "buffered" else "buffered"


def possible_actions(config: Config, scope: str) -> dict[str, tuple[str, ...]]:
    """{rule: actions that its findings in ``scope`` can end with}. Without an override a finding keeps its own action, and too many findings block."""
    own = {"pii.payment_card": {"redact"}, "secrets.detected": {s.action for s in config.secrets.signatures}}
    forced = {r: a for r, s, a in config.policy.overrides if s == scope}
    return {r: (forced[r],) if r in forced else tuple(sorted(own.get(r, set()) | {"block"})) for r, (scopes, _) in config.rules.items() if scope in scopes}


def check_catalog(catalog: SecretCatalog) -> None:
    """Refuses signatures whose end can't be told while chunks come. A deployment's own catalog is held to that; of the built-in one, runs are held back whole until they end."""
    for s in catalog.signatures:
        if s.max_suffix_chars is None:
            if s.suffix_ending or s.boundary_chars and set(s.boundary_chars) != set(s.suffix_chars):
                raise ValueError(f"signature {s.signature_id}: without a bound, the suffix needs the boundary's characters and no ending")
        elif s.max_suffix_chars > LONGEST_SUFFIX:
            raise ValueError(f"signature {s.signature_id}: the suffix is longer than {LONGEST_SUFFIX} characters")


def redactor(config: Config | None, scope: str) -> "Redactor":
    """A new stream's redactor; refuses a configuration that needs whole texts."""
    if config is None:
        return Redactor()
    actions = possible_actions(config, scope)
    resolve_mode(actions, "incremental")
    if config.secrets != BUILTIN:
        check_catalog(config.secrets)
    return Redactor(config.secrets, config.max_input_chars, tuple(actions))


@dataclass
class Redactor:
    """One stream's state. feed() and finish() return what may leave."""

    catalog: SecretCatalog = BUILTIN
    max_chars: int = MAX_INPUT_CHARS
    rules: tuple[str, ...] = INCREMENTAL
    tail: str = ""  # what has come and can still matter, with CONTEXT characters in front of ``seen``
    more: list[str] = field(default_factory=list)  # chunks after the tail
    came: int = 0  # the number of characters that have come
    run: int = 0  # where the characters of ``run_chars`` that reach the end begin
    at: int = 0  # place of the tail's first character in the whole text
    seen: int = 0  # matches that start before this place have been dealt with
    sent: int = 0  # what stands before this place has left, or its marker has
    found: list[tuple[str, int, int]] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)
    open_end: int = 0  # a redaction reaches this place
    swallow: bool = False
    state: str = "open"

    def _matches(self, text: str):
        cards = ((m.start(), m.end(), "pii.payment_card", is_card(m.group())) for m in CARD.finditer(text))
        secrets = ((m.start(), m.end(), "secrets.detected", True) for m in secret_pattern(self.catalog).finditer(text))
        return sorted(m for m in (*cards, *secrets) if m[2] in self.rules)

    def feed(self, chunk: str) -> str:
        if self.state != "open":
            raise ValueError(f"the stream is {self.state}")
        if self.came + len(chunk) > self.max_chars:
            self.cancel()
            raise TooLong("the stream exceeds its limit")
        self.more.append(chunk)
        before = len(chunk.rstrip(run_chars(self.catalog)[0]))
        self.run = self.came + before if before else self.run
        self.came += len(chunk)
        return self._release(False)

    def finish(self) -> str:
        if self.state != "open":
            raise ValueError(f"the stream is {self.state}")
        out = self._release(True)
        self.state = "finished"
        return out

    def cancel(self) -> None:
        self.tail, self.more, self.state = "", [], "cancelled"

    def _release(self, final: bool) -> str:
        # More text could change what is found in the run that reaches the end, and in the last HOLD characters.
        place = self.came if final else min(self.run, self.came - HOLD - run_chars(self.catalog)[1])
        if not final and place <= self.seen:
            # Nothing more is settled, so nothing is searched: a long run costs each of its chunks once.
            if self.swallow:
                self.found[-1], self.sent = (*self.found[-1][:2], self.came), self.came
            return ""
        text, at, self.more = self.tail + "".join(self.more), self.at, []
        safe = place - at
        settled = []
        for start, end, rule, real in self._matches(text):
            if at + start < self.seen:
                continue
            if end > safe:
                safe = min(safe, start)
                break
            settled.append((at + start, at + end, rule, real))
        safe = max(at + safe, self.seen)
        out = []
        for start, end, rule, real in settled:
            if self.swallow or start >= safe:
                break
            self.counts[rule] = n = self.counts.get(rule, 0) + 1
            self.swallow = n > (CARDS if rule == "pii.payment_card" else SECRETS)
            if not (real or self.swallow):
                continue
            end = at + len(text) if self.swallow else end
            self.found.append((rule, start, end))
            if start > self.sent:
                out.append(text[self.sent - at : start - at])
            if not self.open_end or start > self.open_end:
                out.append(MARKER)
            self.open_end = max(self.open_end, end)
            self.sent = max(self.sent, end)
        if self.swallow:
            rule, start, _ = self.found[-1]
            self.found[-1], self.sent = (rule, start, at + len(text)), at + len(text)
        elif safe > self.sent:
            out.append(text[self.sent - at : safe - at])
            self.sent = safe
        self.seen = safe
        keep = max(0, safe - at - CONTEXT)
        self.tail, self.at = text[keep:], at + keep
        return "".join(out)


def chunked(df: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(stream_id, seq, chunk, is_last): texts cut every ``size`` characters; an empty text is one empty chunk."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.greatest(F.ceil(F.length(text) / size), F.lit(1)).cast("int")
    cut = df.select(F.col(id_col).alias("stream_id"), text.alias("__t"), n.alias("__n")).withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return cut.select("stream_id", F.col("seq").cast("long").alias("seq"), F.expr(f"substring(__t, seq * {size} + 1, {size})").alias("chunk"), (F.col("seq") == F.col("__n") - 1).alias("is_last"))


def joined_chunks(chunks: DataFrame) -> DataFrame:
    """(stream_id, text): the buffered mode over a table of chunks; chunks are put in order by seq."""
    whole = chunks.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "chunk"))).alias("c"))
    return whole.select("stream_id", F.array_join(F.transform("c", lambda x: x["chunk"]), "").alias("text"))


def _fed(r: Redactor, chunk: str | None, last: bool) -> str | None:
    """What may leave; null from the chunk on that makes the stream too long. A null chunk is empty."""
    if r.state == "cancelled":
        return None
    try:
        return r.feed(chunk if isinstance(chunk, str) else "") + (r.finish() if last else "")
    except TooLong:
        return None


def redact_chunks(chunks: DataFrame, config: Config | None = None, scope: str = "input") -> DataFrame:
    """(stream_id, output, n_found): the incremental mode over a table of chunks, each stream replayed in order.

    config: the rules; without it both incremental rules with the built-in
    catalog. One that asks for anything but redacting them is refused. A
    stream that is too long has a null output; a null chunk is empty.
    """
    new = redactor(config, scope)

    def run(key, frame):
        r, chunks = replace(new, more=[], found=[], counts={}), frame.sort_values("seq")["chunk"].tolist()
        out = [_fed(r, c, i == len(chunks) - 1) for i, c in enumerate(chunks)]
        return pd.DataFrame({"stream_id": [key[0]], "output": [None if r.state == "cancelled" else "".join(out)], "n_found": [len(r.found)]})

    return chunks.groupBy("stream_id").applyInPandas(run, f"stream_id {dict(chunks.dtypes)['stream_id']}, output string, n_found long")


def redact_stream(chunks: DataFrame, config: Config | None = None, scope: str = "input", idle_ms: int | None = None) -> DataFrame:
    """A streaming table of chunks (stream_id string, seq, chunk, is_last) -> (stream_id, seq, output): each stream's redactor is its state, and goes when its last chunk came.

    Chunks of one micro-batch are put in order by seq; across micro-batches
    they have to come in order. config, scope and null chunks: as for
    ``redact_chunks``. From the chunk on that makes a stream too long its
    outputs are null; other streams go on. idle_ms: a stream without a chunk
    for so long is cancelled, what it held back never leaves, and a later
    chunk begins it anew; None keeps it until its last chunk.
    """
    import pickle

    new = redactor(config, scope)

    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        r = pickle.loads(state.get[0]) if state.exists else replace(new, more=[], found=[], counts={})
        rows = pd.concat(list(frames)).sort_values("seq")
        out = [(key[0], int(seq), _fed(r, chunk, last)) for seq, chunk, last in zip(rows["seq"], rows["chunk"], rows["is_last"])]
        if rows["is_last"].any():
            if state.exists:
                state.remove()
        else:
            state.update((pickle.dumps(r),))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["stream_id", "seq", "output"])

    return chunks.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, seq long, output string", "redactor binary", "append", "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout")

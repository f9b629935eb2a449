"""Rules made from catalogs: secrets known by prefix, and banned literals."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spans import candidates, finding, let, none
from ..sources.catalogs import LiteralCatalog, SecretCatalog
from .catalyst import CHARS

#: Most secrets and most banned literals found in one text.
SECRETS, LITERALS = 128, 64


def _class(chars: str, negated: bool = False) -> str:
    return "[" + ("^" if negated else "") + "".join(re.escape(c) if c.isalnum() is False else c for c in sorted(set(chars))) + "]"


def _escape(text: str) -> str:
    return "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in text)


def secrets(text: Column, catalog: SecretCatalog) -> Column:
    """One regex for the whole catalog, longest prefixes first; the prefix of a match names its signature.

    A shorter prefix doesn't stand in for a longer one that it starts, and a
    suffix can't end inside its own alphabet, so no match depends on backing up.
    """
    known = sorted(((p, s) for s in catalog.signatures for p in s.prefixes), key=lambda x: (-len(x[0]), x[0]))
    parts = []
    for p, s in known:
        longer = [q[len(p) :] for q, _ in known if q != p and q.startswith(p)]
        boundary = s.boundary_chars or s.suffix_chars
        not_longer = "".join(f"(?!{_escape(q)})" for q in longer)
        most = "" if s.max_suffix_chars is None else s.max_suffix_chars
        ending = f"(?<={_escape(s.suffix_ending)})" if s.suffix_ending else ""
        parts.append(f"(?<!{_class(boundary)}){_escape(p)}{not_longer}{_class(s.suffix_chars)}{{{s.min_suffix_chars},{most}}}+(?!{_class(boundary)}){ending}")
    first = lambda m, value: F.coalesce(*[F.when(m.startswith(p), F.lit(value(s))) for p, s in known])

    def hit(c):
        kind, action = first(c["m"], lambda s: s.secret_type), first(c["m"], lambda s: s.action)
        meta = {
            "secret_type": kind, "provider": first(c["m"], lambda s: s.provider), "signature_id": first(c["m"], lambda s: s.signature_id), "signature_status": first(c["m"], lambda s: s.status),
            "catalog_id": catalog.catalog_id, "catalog_version": catalog.version, "detector": "well_known_prefix", **CHARS,
        }
        return finding("secrets.detected", first(c["m"], lambda s: s.severity), action, c["start"], c["end"], F.concat(F.lit("Potential "), kind, F.lit(" detected.")),
                       F.when(action == "redact", F.concat(F.lit("[REDACTED:"), kind, F.lit("]"))), meta)

    def body(c):
        over = finding("secrets.detected", "high", "block", c[SECRETS]["start"], F.length(text), "Secret inspection limit exceeded.", None,
                       {"reason": "candidate_limit_exceeded", "limit": str(SECRETS), "detector": "well_known_prefix", **CHARS})
        return F.concat(F.transform(F.slice(c, 1, SECRETS), hit), F.when(F.size(c) > SECRETS, F.array(over)).otherwise(none()))

    # Prefixes that end in the same punctuation are looked for only where that is.
    ends: dict[str, list[str]] = {}
    for p in sorted({p for p, _ in known}):
        ends.setdefault("" if p[-1].isalnum() else p[-1], []).append(p)
    guard = F.lit(False)
    for end, prefixes in ends.items():
        some = F.lit(False)
        for p in prefixes:
            some = some | F.contains(text, F.lit(p))
        guard = guard | ((F.contains(text, F.lit(end)) & some) if end else some)
    return F.when(guard, let(candidates(text, "|".join(parts), SECRETS), body)).otherwise(none())


def _placed(names: Column, folded):
    return lambda c: F.struct(c["start"].alias("start"), (-F.length(c["m"])).alias("n"), names[folded(c["m"])].alias("id"), c["end"].alias("end"))


def banned_substrings(text: Column, catalog: LiteralCatalog) -> Column:
    """Leftmost matches, of those at one place the longest, then the first by id; matches don't overlap.

    Literals with equal case and mode share one regex. Case is ASCII case.
    """
    found = []
    for sensitive, mode in sorted({(x.case_sensitive, x.match_mode) for x in catalog.literals}):
        group = sorted((x for x in catalog.literals if (x.case_sensitive, x.match_mode) == (sensitive, mode)), key=lambda x: (-len(x.value), x.pattern_id))
        one = "|".join(_escape(x.value) for x in group)
        pattern = f"(?<![A-Za-z0-9_])(?:{one})(?![A-Za-z0-9_])" if mode == "ascii_word" else f"(?:{one})"
        folded = (lambda m: m) if sensitive else (lambda m: F.translate(m, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        ids: dict[str, str] = {}
        for x in sorted(group, key=lambda x: x.pattern_id):
            ids.setdefault(x.value if sensitive else x.value.lower(), x.pattern_id)
        names = F.create_map(*[F.lit(v) for p in ids.items() for v in p])
        found.append(F.transform(candidates(text, pattern if sensitive else "(?i)" + pattern), _placed(names, folded)))
    zero = F.array().cast("array<struct<start:int,n:int,id:string,end:int>>")
    last_end = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0))
    kept = F.aggregate(F.array_sort(F.concat(*found)), zero, lambda acc, c: F.when((c["start"] >= last_end(acc)) & (F.size(acc) <= LITERALS), F.concat(acc, F.array(c))).otherwise(acc))
    by_id = {x.pattern_id: x for x in catalog.literals}
    field = lambda value: F.create_map(*[F.lit(v) for i, x in by_id.items() for v in (i, value(x))])
    common = {"catalog_id": catalog.catalog_id, "catalog_version": catalog.version, "detector": "bounded_literal_trie", **CHARS}
    severity, action, mode, case = (field(f) for f in (lambda x: x.severity, lambda x: x.action, lambda x: x.match_mode, lambda x: str(x.case_sensitive).lower()))

    def hit(c):
        a = action[c["id"]]
        return finding("content.banned_substrings", severity[c["id"]], a, c["start"], c["end"], "Deployment-defined banned substring detected.",
                       F.when(a == "redact", F.lit("[REDACTED:banned_substring]")), {"pattern_id": c["id"], "match_mode": mode[c["id"]], "case_sensitive": case[c["id"]], **common})

    def body(c):
        at = c[LITERALS]
        over = finding("content.banned_substrings", "high", "block", at["start"], at["end"], "Banned-substring finding limit exceeded.", None, {"limit": str(LITERALS), **common})
        return F.when(F.size(c) > LITERALS, F.array(over)).otherwise(F.transform(c, hit))

    return let(kept, body)

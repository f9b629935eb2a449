"""Scanning and enforcement over a table of texts, as one lazy plan.

    normalise -> canonical rules -> policy -> clean -> other rules -> policy -> decision and text

The three Unicode rules run first. Where their findings remove text, all rules
run once over the cleaned text and their spans are mapped back; else the other
rules run over the text as it is. So each rule reads each text once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans as S
from ..operators import catalyst, literals
from ..operators.python import RULES as PYTHON, python_rules
from ..sources.catalogs import BUILTIN, LiteralCatalog, SecretCatalog
from ..sources.texts import MAX_INPUT_CHARS
from .policy import BALANCED, Policy, decision, effective

CANONICAL = {
    "unicode.bidi_controls": (catalyst.bidi_controls, ("input", "output")),
    "unicode.invisible_characters": (catalyst.invisible_characters, ("input",)),
    "unicode.tag_smuggling": (catalyst.tag_smuggling, ("input",)),
}
COLUMN_RULES: dict[str, Callable[..., Column]] = {
    "pii.payment_card": catalyst.payment_card, "pii.email_address": catalyst.email_address, "pii.mac_address": catalyst.mac_address, "pii.iban": catalyst.iban,
    "pii.phone_number": catalyst.phone_number, "secrets.private_key": catalyst.private_key,
}
BOTH, INPUT, OUTPUT = ("input", "output"), ("input",), ("output",)
#: Every text rule: what it is for, its scopes, and when it is on.
DESCRIBED = {
    "secrets.detected": ("Detect secrets by well-known prefixes.", BOTH, "default"),
    "pii.payment_card": ("Detect payment-card numbers.", BOTH, "default"),
    "secrets.private_key": ("Detect armored private keys.", BOTH, "default"),
    "secrets.jwt_token": ("Detect structurally credible compact JSON Web Tokens.", BOTH, "default"),
    "unicode.bidi_controls": ("Detect explicit Unicode bidirectional formatting controls.", BOTH, "default"),
    "unicode.invisible_characters": ("Detect removable invisible characters embedded in ASCII tokens.", INPUT, "default"),
    "unicode.tag_smuggling": ("Detect invisible Unicode tag runs outside emoji flags.", INPUT, "default"),
    "pii.email_address": ("Detect conservative ASCII email addresses.", BOTH, "opt_in"),
    "pii.ip_address": ("Detect canonical IP addresses.", BOTH, "opt_in"),
    "pii.mac_address": ("Detect EUI-48 hardware addresses.", BOTH, "opt_in"),
    "pii.iban": ("Detect IBANs of registered countries.", BOTH, "opt_in"),
    "pii.phone_number": ("Detect global phone numbers.", BOTH, "opt_in"),
    "secrets.authorization_header": ("Detect Basic and Bearer credentials.", BOTH, "opt_in"),
    "secrets.connection_string": ("Detect credentials embedded in connection strings.", BOTH, "opt_in"),
    "secrets.credential_assignment": ("Detect credentials assigned to named fields.", BOTH, "opt_in"),
    "content.banned_substrings": ("Detect literals of a deployment's catalog.", BOTH, "opt_in"),
    "url.unsafe": ("Detect URLs with unsafe schemes, authorities, or local targets.", BOTH, "opt_in"),
    "output.external_resource": ("Detect image URLs outside the hostname allowlist.", OUTPUT, "opt_in"),
    "output.json.validity": ("Validate one bounded strict JSON output document.", OUTPUT, "opt_in"),
    "text.excessive_repetition": ("Detect excessive exact repetition.", BOTH, "opt_in"),
    "tools.call.validity": ("Validate tool allowlisting and bounded typed arguments.", ("tool_call",), "explicit"),
    "tools.result.validity": ("Validate tool-result linkage and resource use.", ("tool_result",), "explicit"),
}
#: Rules that can't run without a value of the deployment's own.
DEPLOYMENT_VALUE = ("content.banned_substrings", "tools.call.validity")
DEFAULT = tuple(r for r, d in DESCRIBED.items() if d[2] == "default")
PRIVACY = ("pii.ip_address", "pii.mac_address", "pii.iban", "pii.email_address", "pii.phone_number")


@dataclass(frozen=True)
class Config:
    """Which rules run, in which scopes and with which options.

    rules: {rule id: (scopes, options)}; options are the keyword arguments of
    the rule's function. Secrets and banned literals have their catalogs.
    """

    rules: dict[str, tuple[tuple[str, ...], dict]]
    policy: Policy = BALANCED
    secrets: SecretCatalog = BUILTIN
    banned: LiteralCatalog | None = None
    max_input_chars: int = MAX_INPUT_CHARS
    name: str = field(default="custom")

    def __post_init__(self):
        unknown = sorted(set(self.rules) - {r for r, d in DESCRIBED.items() if d[2] != "explicit"})
        if unknown:
            raise ValueError(f"unknown rules: {', '.join(unknown)}")
        if ("content.banned_substrings" in self.rules) != (self.banned is not None):
            raise ValueError("the rule for banned literals and its catalog go together")
        self.policy.validate(DESCRIBED)

    def with_policy(self, policy: Policy) -> "Config":
        return replace(self, policy=policy)


def only(*rules: str, scopes: tuple[str, ...] | None = None, options: dict[str, dict] | None = None, **more) -> Config:
    """A configuration of the named rules with their own scopes, or with ``scopes``; ``options`` are those of rules by their ids."""
    return Config({r: (scopes or DESCRIBED[r][1], (options or {}).get(r, {})) for r in rules}, **more)


def preset(name: str, policy: Policy = BALANCED, banned: LiteralCatalog | None = None) -> Config:
    """default, privacy-input, json-api or all-text."""
    if name == "all-text":
        rules = {r: ((d[1] if r.startswith(("output.", "unicode.")) else BOTH), {}) for r, d in DESCRIBED.items() if d[2] != "explicit" and (r != "content.banned_substrings" or banned)}
        return Config(rules, policy, banned=banned, name=name)
    extra = {"default": (), "privacy-input": PRIVACY, "json-api": ("output.json.validity", "url.unsafe")}
    if name not in extra:
        raise ValueError(f"no preset {name!r}")
    rules = {r: (INPUT if r in PRIVACY else DESCRIBED[r][1], {}) for r in (*DEFAULT, *extra[name])}
    return Config(rules, policy, name=name)


def _scoped(scope: Column, scopes: tuple[str, ...], text: Column, rule: Callable[[Column], Column]) -> Column:
    """``rule`` of ``text`` in its scopes only."""
    return F.when(scope.isin(*scopes), rule(text)).otherwise(S.none())


def _canonical(config: Config, text: Column, scope: Column, guard: Column | None = None) -> list[Column]:
    return [_scoped(scope, config.rules[r][0], text, lambda t, f=f: f(t, guard)) for r, (f, _) in CANONICAL.items() if r in config.rules]


def _columns(config: Config, text: Column, scope: Column) -> list[Column]:
    out = [_scoped(scope, config.rules[r][0], text, lambda t, f=f, r=r: f(t, **config.rules[r][1])) for r, f in COLUMN_RULES.items() if r in config.rules]
    if "secrets.detected" in config.rules:
        out.append(_scoped(scope, config.rules["secrets.detected"][0], text, lambda t: literals.secrets(t, config.secrets)))
    if config.banned is not None:
        out.append(_scoped(scope, config.banned.scopes, text, lambda t: literals.banned_substrings(t, config.banned)))
    return out


def _python(config: Config, text: Column, scope: Column) -> list[Column]:
    """One pass through Python for each set of scopes."""
    groups: dict[tuple[str, ...], dict] = {}
    for r in PYTHON:
        if r in config.rules:
            groups.setdefault(tuple(sorted(config.rules[r][0])), {})[r] = config.rules[r][1]
    return [python_rules(F.when(scope.isin(*s), text), chosen) for s, chosen in groups.items()]


def _joined(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else S.none()


def _usable(df: DataFrame, config: Config) -> DataFrame:
    ok = F.col("text").isNotNull() & (F.length("text") <= config.max_input_chars)
    if "prompt_context" in df.columns:
        ok = ok & (F.col("prompt_context").isNull() | (F.col("scope") == "output"))
    return df.withColumn("__ok", ok).withColumn("__norm", F.when(ok, S.normalized(F.col("text")))).withColumn("__crlf", S.crlf_marks(F.coalesce("text", F.lit("")))).withColumn("__odd", catalyst.hidden(F.col("__norm")))


def scan(df: DataFrame, config: Config) -> DataFrame:
    """``df`` (doc_id, text, scope) with ``findings``: what the rules recommend, in the original text's positions. Null and over-long texts have none."""
    x = _usable(df, config)
    text, scope = F.col("__norm"), F.col("scope")
    x = x.withColumn("__p", _joined(_python(config, text, scope))).withColumn("__c", _joined([*_canonical(config, text, scope, F.col("__odd")), *_columns(config, text, scope)]))
    x = x.withColumn("findings", F.when(F.col("__ok"), S.ordered(S.to_original(F.concat("__c", "__p"), F.col("__crlf")))).otherwise(S.none()))
    return x.drop("__ok", "__norm", "__crlf", "__odd", "__p", "__c")


def redact_recommended(df: DataFrame, config: Config) -> DataFrame:
    """``df`` with findings and ``redacted``, the text after the recommended actions; no policy, no second scan."""
    return scan(df, config).withColumn("redacted", S.sanitized(F.col("text"), F.col("findings")))


def _has(findings: Column, action: str) -> Column:
    return F.exists(findings, lambda f: f["action"] == action)


def _cuts(spans: Column) -> Column:
    """For each removed span its place in the cleaned text and its length."""
    zero = F.struct(F.lit(0).alias("gone"), F.array().cast("array<struct<at:int,n:int>>").alias("cuts"))
    return F.aggregate(spans, zero, lambda acc, s: F.struct((acc["gone"] + s["end"] - s["start"]).alias("gone"), F.concat(acc["cuts"], F.array(F.struct((s["start"] - acc["gone"]).alias("at"), (s["end"] - s["start"]).alias("n")))).alias("cuts")))["cuts"]


def _back(findings: Column, cuts: Column) -> Column:
    """Spans of the cleaned text as spans of the text before: what was removed right at a start comes before it, right at an end after it."""
    total = lambda keep: F.aggregate(F.filter(cuts, keep), F.lit(0), lambda acc, c: acc + c["n"])
    return S.shifted(findings, lambda p: p + total(lambda c: c["at"] <= p), lambda p: p + total(lambda c: c["at"] < p))


def inspect(df: DataFrame, config: Config) -> DataFrame:
    """``df`` (doc_id, text, scope[, prompt_context]) with policy_id, policy_version, decision, processed_text, findings.

    processed_text is null where the decision is block. A text that is null or
    longer than max_input_chars, or an input with a prompt context, isn't
    inspected: its decision is block and it has no findings.
    """
    policy, scope = config.policy, F.col("scope")
    broad = policy.can_remove(set(config.rules) - set(CANONICAL)) or (config.banned is not None and any(x.action == "remove" for x in config.banned.literals))
    x = _usable(df, config)
    norm = F.col("__norm")
    first = [*_canonical(config, norm, scope, F.col("__odd"))]
    if broad:
        x = x.withColumn("__p0", _joined(_python(config, norm, scope)))
        first += [*_columns(config, norm, scope), F.col("__p0")]
    x = x.withColumn("__first", effective(_joined(first), scope, policy))
    x = x.withColumn("__again", _has(F.col("__first"), "remove") & ~_has(F.col("__first"), "block"))
    x = x.withColumn("__gone", F.when(F.col("__again"), S.removal_spans(F.col("__first"))))
    x = x.withColumn("__clean", F.when(F.col("__again"), S.rebuilt(norm, F.col("__gone"))).otherwise(norm))
    clean = F.col("__clean")
    seen = F.when(F.col("__again"), clean) if broad else clean
    x = x.withColumn("__p", _joined(_python(config, seen, scope)))
    x = x.withColumn("__second", effective(F.concat(_joined(_columns(config, seen, scope)), F.col("__p"), F.when(F.col("__again"), _joined(_canonical(config, clean, scope, F.col("__odd")))).otherwise(S.none())), scope, policy))
    removed = F.filter("__first", lambda f: f["action"] == "remove")
    both = F.when(F.col("__again"), F.concat(removed, _back(F.col("__second"), _cuts(F.col("__gone"))))).otherwise(F.concat("__first", "__second"))
    x = x.withColumn("findings", F.when(F.col("__ok"), S.ordered(S.to_original(both, F.col("__crlf")))).otherwise(S.none()))
    x = x.withColumn("decision", F.when(F.col("__ok"), decision(F.col("findings"))).otherwise("block"))
    x = x.withColumn("processed_text", F.when(F.col("decision") != "block", S.sanitized(F.col("text"), F.col("findings"))))
    if "output.json.validity" in config.rules:
        changed = F.when((scope == "output") & (F.col("processed_text") != F.col("text")), F.col("processed_text"))
        options = {**config.rules["output.json.validity"][1], "validation_phase": "post_policy"}
        x = x.withColumn("__post", python_rules(changed, {"output.json.validity": options}))
        x = x.withColumn("__post", effective(S.shifted(F.col("__post"), lambda p: F.lit(0)), scope, policy))
        x = x.withColumn("findings", F.when(F.size("__post") > 0, S.ordered(F.concat("findings", "__post"))).otherwise(F.col("findings")))
        x = x.withColumn("decision", F.when(F.size("__post") > 0, decision(F.col("findings"))).otherwise(F.col("decision")))
        x = x.withColumn("processed_text", F.when(F.col("decision") != "block", F.col("processed_text")))
    keep = [c for c in df.columns if c not in ("policy_id", "policy_version", "decision", "processed_text", "findings")]
    return x.select(*keep, F.lit(policy.policy_id).alias("policy_id"), F.lit(policy.version).alias("policy_version"), "decision", "processed_text", "findings")


def available_rules(spark: SparkSession) -> DataFrame:
    rows = [(r, purpose, list(scopes), activation, r in DEPLOYMENT_VALUE) for r, (purpose, scopes, activation) in DESCRIBED.items()]
    return spark.createDataFrame(rows, "rule_id string, purpose string, scopes array<string>, activation string, requires_deployment_value boolean")


def available_presets(spark: SparkSession) -> DataFrame:
    rows = [(n, sorted(preset(n).rules)) for n in ("default", "privacy-input", "json-api", "all-text")]
    return spark.createDataFrame(rows, "preset string, rules array<string>")


def capabilities(spark: SparkSession, config: Config) -> DataFrame:
    """What a configuration can do, in counts; no patterns."""
    prefixes = [p for s in config.secrets.signatures for p in s.prefixes]
    counts = {"rules": len(config.rules), "secret_signatures": len(config.secrets.signatures), "secret_prefixes": len(prefixes), "secret_providers": len({s.provider for s in config.secrets.signatures}),
              "banned_literals": len(config.banned.literals) if config.banned else 0, "policy_overrides": len(config.policy.overrides), "max_input_chars": config.max_input_chars}
    return spark.createDataFrame(list(counts.items()), "capability string, value long")

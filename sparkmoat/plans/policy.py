"""Policies: which action a rule's findings get in a scope, the decision of a text, and the text that leaves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import ACTIONS, FINDING
from ..sources.catalogs import check_id

BOTH = ("input", "output")
#: Rules whose findings the balanced policy redacts in both scopes.
REDACTED = (
    "secrets.detected", "url.unsafe", "pii.ip_address", "pii.mac_address", "pii.iban", "secrets.authorization_header", "secrets.connection_string",
    "secrets.credential_assignment", "pii.email_address", "pii.phone_number", "pii.payment_card", "secrets.private_key", "secrets.jwt_token",
)


@dataclass(frozen=True)
class Policy:
    """Overrides of actions by (rule id, scope); every other finding keeps its own action."""

    policy_id: str
    version: str
    overrides: tuple[tuple[str, str, str], ...] = ()

    def __post_init__(self):
        check_id(self.policy_id, "policy_id")
        keys = [(r, s) for r, s, _ in self.overrides]
        if len(keys) != len(set(keys)):
            raise ValueError("a rule has two actions in one scope")
        for rule, _, action in self.overrides:
            if action not in ACTIONS:
                raise ValueError(f"{action!r} is not an action")
            if rule == "output.json.validity" and action not in ("block", "review"):
                raise ValueError("invalid JSON can only be blocked or reviewed")

    def validate(self, supported) -> None:
        unknown = sorted({r for r, _, _ in self.overrides} - set(supported))
        if unknown:
            raise ValueError(f"the policy names unknown rules: {', '.join(unknown)}")

    def action(self, rule: Column, scope: Column, own: Column) -> Column:
        if not self.overrides:
            return own
        table = F.create_map(*[F.lit(v) for r, s, a in self.overrides for v in (f"{r}|{s}", a)])
        return F.coalesce(F.try_element_at(table, F.concat_ws("|", rule, scope)), own)

    def can_remove(self, rules) -> bool:
        return any(a == "remove" and r in rules for r, _, a in self.overrides)


def _all(action: str) -> tuple:
    rows = [(r, s, action) for r in (*REDACTED, "unicode.bidi_controls", "content.banned_substrings", "text.excessive_repetition") for s in BOTH]
    return (*rows, ("unicode.invisible_characters", "input", action), ("unicode.tag_smuggling", "input", action), ("output.json.validity", "output", action), ("output.external_resource", "output", action))


BALANCED = Policy("sparkmoat.balanced", "1.19.0", (*((r, s, "redact") for r in REDACTED for s in BOTH), ("output.json.validity", "output", "block"), ("output.external_resource", "output", "redact")))
STRICT = Policy("sparkmoat.strict", "1.19.0", _all("block"))
AUDIT = Policy("sparkmoat.audit", "1.19.0", _all("review"))
POLICIES = {"balanced": BALANCED, "strict": STRICT, "audit": AUDIT}


def effective(findings: Column, scope: Column, policy: Policy) -> Column:
    """Findings with the actions of the policy."""
    return F.transform(findings, lambda f: F.struct(*((policy.action(f["rule_id"], scope, f["action"]) if n == "action" else f[n]).alias(n) for n in FINDING.names)))


def decision(findings: Column) -> Column:
    """The strongest action; allow without findings."""
    order = F.array(*map(F.lit, ACTIONS))
    return F.element_at(order, F.coalesce(F.array_max(F.transform(findings, lambda f: F.array_position(order, f["action"]).cast("int"))), F.lit(1)))


def policy_table(spark: SparkSession) -> DataFrame:
    rows = [(p.policy_id, p.version, *o) for p in POLICIES.values() for o in p.overrides]
    return spark.createDataFrame(rows, "policy_id string, version string, rule_id string, scope string, action string")

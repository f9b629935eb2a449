"""Catalogs as data: secret signatures and banned literals, from code, rows or files."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

ID = re.compile(r"[a-z0-9](?:[a-z0-9._-]{0,126}[a-z0-9])?")


def check_id(value: str, what: str) -> None:
    if not isinstance(value, str):
        raise TypeError(f"{what} must be a string")
    if not ID.fullmatch(value):
        raise ValueError(f"{what} {value!r} is not a valid id")


@dataclass(frozen=True)
class Signature:
    """A secret known by its literal prefix and the alphabet and length of what follows."""

    signature_id: str
    provider: str
    secret_type: str
    prefixes: tuple[str, ...]
    suffix_chars: str
    min_suffix_chars: int
    max_suffix_chars: int | None = None
    suffix_ending: str = ""
    boundary_chars: str = ""
    status: str = "ACTIVE"
    severity: str = "high"
    action: str = "redact"

    def __post_init__(self):
        check_id(self.signature_id, "signature_id")
        if not 1 <= len(self.prefixes) <= 16:
            raise ValueError("a signature has 1 to 16 prefixes")
        if self.min_suffix_chars < 1 or self.max_suffix_chars is not None and self.max_suffix_chars < self.min_suffix_chars:
            raise ValueError("suffix lengths are out of order")
        if not set(self.suffix_chars) <= set(self.boundary_chars or self.suffix_chars):
            raise ValueError("suffix characters must be boundary characters")


@dataclass(frozen=True)
class SecretCatalog:
    catalog_id: str
    version: str
    signatures: tuple[Signature, ...]

    def __post_init__(self):
        check_id(self.catalog_id, "catalog_id")
        seen = [p for s in self.signatures for p in s.prefixes]
        for a in seen:
            if seen.count(a) > 1:
                raise ValueError(f"prefix {a!r} stands twice")

    def combined(self, more: "SecretCatalog") -> "SecretCatalog":
        """This catalog and another; a prefix that equals, starts or continues one of this catalog's is refused."""
        own = [p for s in self.signatures for p in s.prefixes]
        for p in (p for s in more.signatures for p in s.prefixes):
            if any(p.startswith(q) or q.startswith(p) for q in own):
                raise ValueError(f"prefix {p!r}: overlap built-in")
        return SecretCatalog(more.catalog_id, more.version, self.signatures + more.signatures)


@dataclass(frozen=True)
class Literal:
    pattern_id: str
    value: str
    match_mode: str = "substring"
    case_sensitive: bool = False
    severity: str = "high"
    action: str = "block"

    def __post_init__(self):
        check_id(self.pattern_id, "pattern_id")
        if not re.fullmatch(r"[\x20-\x7e]{3,64}", self.value):
            raise ValueError("a literal is 3 to 64 printable ASCII characters")
        if self.match_mode not in ("substring", "ascii_word"):
            raise ValueError("match_mode is substring or ascii_word")


@dataclass(frozen=True)
class LiteralCatalog:
    catalog_id: str
    version: str
    literals: tuple[Literal, ...]
    scopes: tuple[str, ...] = field(default=("input", "output"))

    def __post_init__(self):
        check_id(self.catalog_id, "catalog_id")
        if not 1 <= len(self.literals) <= 1024 or sum(len(x.value) for x in self.literals) > 65_536:
            raise ValueError("a catalog has 1 to 1024 literals of 65,536 characters in all")
        object.__setattr__(self, "scopes", tuple(sorted(set(self.scopes))))


_WORD = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: Our own catalog: publicly documented token shapes.
BUILTIN = SecretCatalog("sparkmoat.secrets", "1.0.0", (
    Signature("openai-key", "openai", "openai_api_key", ("sk-",), _WORD + "_-", 20, None, "", _WORD + "_-"),
    Signature("github-token", "github", "github_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), _WORD, 36, 36, "", _WORD + "_"),
    Signature("stripe-live-key", "stripe", "stripe_secret_key", ("sk_live_", "rk_live_"), _WORD, 16, None, "", _WORD + "_"),
    Signature("slack-token", "slack", "slack_token", ("xoxb-", "xoxp-"), _WORD + "-", 24, None, "", _WORD + "-"),
    Signature("aws-access-key", "aws", "aws_access_key_id", ("AKIA", "ASIA"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, 16, "", _WORD + "_"),
    Signature("google-api-key", "google", "google_api_key", ("AIza",), _WORD + "_-", 35, 35, "", _WORD + "_-"),
))


def secret_catalog_table(spark: SparkSession, catalog: SecretCatalog = BUILTIN) -> DataFrame:
    rows = [(s.signature_id, s.provider, s.secret_type, list(s.prefixes), s.suffix_chars, s.min_suffix_chars, s.max_suffix_chars, s.suffix_ending, s.boundary_chars, s.status, s.severity, s.action) for s in catalog.signatures]
    return spark.createDataFrame(rows, "signature_id string, provider string, secret_type string, prefixes array<string>, suffix_chars string, min_suffix_chars int, max_suffix_chars int, suffix_ending string, boundary_chars string, status string, severity string, action string")


def read_secret_catalog(rows: DataFrame, catalog_id: str, version: str) -> SecretCatalog:
    """A catalog from a table like secret_catalog_table's; catalogs are small by definition, and a larger one is refused."""
    got = rows.limit(10_001).collect()
    if len(got) > 10_000:
        raise ValueError("a catalog has at most 10,000 signatures")
    return SecretCatalog(catalog_id, version, tuple(Signature(**{k: tuple(v) if k == "prefixes" else v for k, v in r.asDict().items()}) for r in got))

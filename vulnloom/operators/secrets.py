"""Hardcoded secrets: token shapes, quoted credentials and high-entropy literals, per line."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F

from vulnloom.functions.text import any_contains, shannon_entropy

ENTROPY_FLOOR = 3.5

# Quoted value assigned to a name that sounds like a credential; group 1 is the value.
CREDENTIAL = r"""(?i)\b\w*(?:api_?key|secret|token|password|passwd)\w*\s*[:=]\s*["']([^"'\s]{8,})["']"""
# Values that stand for a secret without being one. "example" is not among them: published
# example keys have the shape of live ones and should be reported.
PLACEHOLDER = (
    r"(?i)your[_-]?|change_?me|placeholder|insert[_-]|<[^>]*>|\$\{|\{\{|^x{4,}|\*{3,}|dummy|redacted|todo|none$|null$"
)
ENVIRONMENT = r"os\.environ|os\.getenv|\bgetenv\s*\(|process\.env"
# Every credential holds matches of these two; the first character class rejects most positions fast.
CREDENTIAL_HINTS = (
    r"""[:=]\s*["']""",
    r"""[aAsStTpP](?i:pi_?key|ecret|oken|assword|asswd)\w*\s*[:=]\s*["']""",
)


@dataclass(frozen=True)
class SecretPattern:
    rule_id: str
    regex: str
    group: int
    confidence: float
    message: str
    entropy_floor: float = 0.0
    credential: bool = False
    needle: str = ""
    """A literal that every match contains."""
    hints: tuple[str, ...] = ()
    """Cheap expressions that all match wherever the pattern does; used when there is no needle."""


SECRET_PATTERNS = [
    SecretPattern(
        "secret-aws-access-key", r"\bAKIA[0-9A-Z]{16}\b", 0, 0.95, "AWS access key ID in source", needle="AKIA"
    ),
    SecretPattern(
        "secret-github-token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", 0, 0.95, "GitHub token in source", hints=("gh[pousr]_",)
    ),
    SecretPattern(
        "secret-private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0.95, "Private key in source", needle="-----BEGIN "
    ),
    SecretPattern(
        "secret-bcrypt-hash", r"\$2[aby]\$\d{2}\$[./A-Za-z0-9]{53}", 0, 0.8, "bcrypt hash in source", needle="$2"
    ),
    SecretPattern(
        "secret-high-entropy", CREDENTIAL, 1, 0.75, "High-entropy credential in source", ENTROPY_FLOOR, True,
        hints=CREDENTIAL_HINTS,
    ),
    SecretPattern(
        "secret-credential", CREDENTIAL, 1, 0.6, "Hardcoded credential in source", 0.0, True, hints=CREDENTIAL_HINTS
    ),
]


def values(pattern: SecretPattern, line: Column) -> Column:
    """The values on `line` that the pattern reports, placeholders left out."""
    found = F.filter(
        F.regexp_extract_all(line, F.lit(pattern.regex), F.lit(pattern.group)), lambda v: ~v.rlike(PLACEHOLDER)
    )
    if pattern.entropy_floor:
        found = F.filter(found, lambda v: shannon_entropy(v) >= pattern.entropy_floor)
    return found


def matches(pattern: SecretPattern, line: Column) -> Column:
    hit = line.rlike(pattern.regex) & (F.size(values(pattern, line)) > 0)
    return hit & ~line.rlike(ENVIRONMENT) if pattern.credential else hit


def hint(patterns: list[SecretPattern], text: Column) -> Column:
    """Cheap necessary condition for any of the patterns to match `text`."""
    found = any_contains(text, sorted({p.needle for p in patterns if p.needle}))
    for hints in sorted({p.hints or (p.regex,) for p in patterns if not p.needle}):
        found = found | reduce(Column.__and__, [text.rlike(h) for h in hints])
    return found


def secret_matches(patterns: list[SecretPattern], line: Column) -> list[Column]:
    """For each pattern a finding struct, null where the pattern does not match `line`."""
    return [
        F.when(
            matches(p, line),
            F.struct(
                F.lit(1).alias("detector"),
                F.lit("entropy" if p.entropy_floor else "regex").alias("detection_method"),
                F.lit(p.confidence).alias("confidence"),
                F.lit(p.message).alias("message"),
                F.lit(p.rule_id).alias("rule_id"),
                F.create_map(F.lit("pattern"), F.lit(p.rule_id)).alias("metadata"),
            ),
        )
        for p in patterns
    ]

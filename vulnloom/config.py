"""Scan configuration: loaded on the driver, applied as column predicates."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import Column, functions as F

from vulnloom.constants import DEFAULT_CHECKS, DEFAULT_EXCLUDED_GLOBS, DEFAULT_EXCLUDED_PATHS, SEVERITY_RANK
from vulnloom.functions import paths

logger = logging.getLogger(__name__)

USER_CONFIG = ".vulnloom.yml"


class _Loader(yaml.SafeLoader):
    """YAML without timestamps: a date that does not exist must not end a scan."""


_Loader.yaml_implicit_resolvers = {
    first: [(tag, pattern) for tag, pattern in known if tag != "tag:yaml.org,2002:timestamp"]
    for first, known in yaml.SafeLoader.yaml_implicit_resolvers.items()
}
# What reading a configuration can raise, whatever it holds.
UNREADABLE = (yaml.YAMLError, ValueError, RecursionError, TypeError, OverflowError)


def read_yaml(text: str) -> Any:
    return yaml.load(text, Loader=_Loader)  # noqa: S506 - a safe loader


def _flag(value: Any) -> bool:
    """Lenient boolean; anything unreadable counts as true."""
    if isinstance(value, (bool, int, float)):
        return bool(value)
    return not (isinstance(value, str) and value.strip().lower() in ("0", "false", "no", "off"))


def _within(value: Any, convert: type, default: Any, low: Any, high: Any = None) -> Any:
    try:
        number = max(low, convert(value))
    except (TypeError, ValueError, OverflowError):
        return default
    return number if high is None else min(high, number)


def _texts(value: Any, default: list[str]) -> list[str]:
    if not isinstance(value, list):
        return default
    return [str(item) for item in value if str(item).strip()]


@dataclass
class RuleConfig:
    """Checks, exclusions and thresholds of a scan."""

    checks: dict[str, bool] = field(default_factory=lambda: dict.fromkeys(DEFAULT_CHECKS, True))
    exclude_paths: list[str] = field(default_factory=lambda: list(DEFAULT_EXCLUDED_PATHS))
    exclude_patterns: list[str] = field(default_factory=lambda: list(DEFAULT_EXCLUDED_GLOBS))
    min_severity: str = "low"
    confidence_threshold: float = 0.7
    max_concurrent: int = 5
    max_retries: int = 3

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> RuleConfig:
        """Defaults overridden by `data`: checks merge key by key, exclusion lists replace."""
        base = cls()
        checks, exclude, model = (data.get(k) if isinstance(data.get(k), dict) else {} for k in ("checks", "exclude", "llm"))
        severity = str(data.get("min_severity", base.min_severity)).lower()
        if severity not in SEVERITY_RANK or severity == "info":
            logger.warning("Invalid min_severity %r; using %r", severity, base.min_severity)
            severity = base.min_severity
        return cls(
            checks=base.checks | {str(name): _flag(on) for name, on in checks.items()},
            exclude_paths=_texts(exclude.get("paths"), base.exclude_paths),
            exclude_patterns=_texts(exclude.get("patterns"), base.exclude_patterns),
            min_severity=severity,
            confidence_threshold=_within(
                data.get("confidence_threshold"), float, base.confidence_threshold, 0.0, 1.0
            ),
            max_concurrent=_within(model.get("max_concurrent"), int, base.max_concurrent, 1, 10),
            max_retries=_within(model.get("max_retries"), int, base.max_retries, 1),
        )

    @classmethod
    def load(cls, path: str | Path | None = None) -> RuleConfig:
        """Configuration from `path`, else from the working directory, else the defaults."""
        candidates = [Path(path)] if path is not None else []
        candidates.append(Path.cwd() / USER_CONFIG)
        for candidate in candidates:
            if not candidate.exists():
                continue
            try:
                data = read_yaml(candidate.read_text(encoding="utf-8"))
            except (OSError, *UNREADABLE) as error:
                logger.warning("Malformed YAML config in %s: %s", candidate, error)
                continue
            if data is None or isinstance(data, dict):
                return cls.from_dict(data or {})
            logger.warning("Config file %s must contain a YAML mapping", candidate)
        return cls()

    def enabled(self, vuln_type: Column) -> Column:
        """Unknown types are enabled."""
        off = [name for name, on in self.checks.items() if not on]
        return ~vuln_type.isin(off) if off else F.lit(True)

    def excludes(self, path: Column) -> Column:
        return paths.path_excluded(path, self.exclude_paths, self.exclude_patterns)

    def severe_enough(self, severity: Column) -> Column:
        """Unknown severities rank lowest; an unknown threshold stands for `low`."""
        ranks = F.create_map(*[F.lit(x) for pair in SEVERITY_RANK.items() for x in pair])
        rank = F.coalesce(F.try_element_at(ranks, F.lower(severity)), F.lit(0))
        return rank >= SEVERITY_RANK.get(self.min_severity, 1)

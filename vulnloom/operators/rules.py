"""Injection rules and finding classification.

A rule is one row of a table: id, languages, regular expression, severity, message. Users add
rules by passing a longer list. The expressions work line by line, so a call broken over several
lines is missed; results of an external scanner come in through `sources.scanner`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vulnloom.constants import (
    EVAL_KEYWORDS,
    OTHER_SCANNER_CONFIDENCE,
    RULE_ID_KEYWORDS,
    SCANNER_CONFIDENCE,
    SECRET_KEYWORDS,
    SQLI_KEYWORDS,
    XSS_KEYWORDS,
)
from vulnloom.functions.text import any_contains, let


@dataclass(frozen=True)
class Rule:
    rule_id: str
    languages: tuple[str, ...]
    regex: str
    severity: str
    message: str
    needle: str = ""
    """A literal that every match contains; files and lines without it are skipped cheaply."""


PYTHON = ("python",)
SCRIPT = ("javascript", "typescript")

RULES = [
    Rule(
        "sqli-python-fstring", PYTHON, r"""\.execute\s*\(\s*[fF]["'].*\{[^}]+\}""", "ERROR",
        "SQL query built with an f-string. Pass values as query parameters.", ".execute",
    ),
    Rule(
        "sqli-python-format", PYTHON, r"""\.execute\s*\(\s*(?:"[^"]*"|'[^']*')\s*\.format\s*\(""", "ERROR",
        "SQL query built with str.format. Pass values as query parameters.", ".execute",
    ),
    Rule(
        "sqli-python-percent", PYTHON, r"""\.execute\s*\(\s*(?:"[^"]*"|'[^']*')\s*%""", "ERROR",
        "SQL query built with % formatting. Pass values as query parameters.", ".execute",
    ),
    Rule(
        "sqli-python-concat", PYTHON, r"""\.execute\s*\(\s*(?:"[^"]*"|'[^']*'|[\w.]+)\s*\+""", "ERROR",
        "SQL query built by concatenation. Pass values as query parameters.", ".execute",
    ),
    Rule(
        "sqli-python-raw-text-exec", PYTHON, r"""\.execute\s*\(\s*text\s*\(\s*[A-Za-z_][\w.]*\s*\)""", "WARNING",
        "text() around a variable may carry untrusted input into SQL. Bind its values.", ".execute",
    ),
    Rule(
        "sqli-js-template-literal", SCRIPT, r"""\.query\s*\(\s*`[^`]*\$\{[^}]+\}""", "ERROR",
        "SQL query built with a template literal. Pass values as query parameters.", ".query",
    ),
    Rule(
        "sqli-js-concat", SCRIPT, r"""\.query\s*\(\s*(?:"[^"]*"|'[^']*'|[\w.]+)\s*\+""", "ERROR",
        "SQL query built by concatenation. Pass values as query parameters.", ".query",
    ),
    Rule(
        "sqli-js-raw-sequelize", SCRIPT, r"""\.query\s*\(\s*[A-Za-z_$][\w.$]*\s*[,)]""", "WARNING",
        "Raw query from a variable. Use bind parameters, not interpolation.", ".query",
    ),
]


MAX_RULES = 1000
RULE_TABLE = "rule_id string, languages array<string>, regex string, severity string, message string, needle string"


def rule_table(spark: SparkSession, rules: list[Rule] = RULES) -> DataFrame:
    return spark.createDataFrame([(r.rule_id, list(r.languages), r.regex, r.severity, r.message, r.needle) for r in rules], RULE_TABLE)


def rules_of(table: DataFrame) -> list[Rule]:
    """Rules of a user's table. Every rule becomes an expression, so their number is limited."""
    rows = table.select(*[c.split()[0] for c in RULE_TABLE.split(", ")]).limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return [Rule(r.rule_id, tuple(r.languages), r.regex, r.severity, r.message, r.needle or "") for r in rows]


def classify(rule_id: Column, message: Column) -> Column:
    """sqli, hardcoded_secret, xss, or null when out of scope. The first keyword list that hits wins."""
    both = F.struct(F.lower(rule_id).alias("rule"), F.lower(message).alias("text"))
    return let(both, lambda lowered: _by_keyword(lowered["rule"], lowered["text"]))


def _by_keyword(rule: Column, text: Column) -> Column:
    either = lambda words: any_contains(rule, words) | any_contains(text, words)
    by_id = [(F.contains(rule, F.lit(word)), vuln_type) for word, vuln_type in RULE_ID_KEYWORDS]
    by_text = [
        (either(SQLI_KEYWORDS), "sqli"),
        (any_contains(text, EVAL_KEYWORDS), "sqli"),
        (either(SECRET_KEYWORDS), "hardcoded_secret"),
        (either(XSS_KEYWORDS), "xss"),
    ]
    return F.coalesce(*[F.when(hit, F.lit(vuln_type)) for hit, vuln_type in by_id + by_text])


def in_scope(vuln_type: Column, targets: list[str] | None = None) -> Column:
    return vuln_type.isin(targets) if targets else vuln_type.isNotNull()


def scanner_confidence(severity: Column) -> Column:
    by_severity = F.create_map(*[F.lit(x) for pair in SCANNER_CONFIDENCE.items() for x in pair])
    return F.coalesce(F.try_element_at(by_severity, severity), F.lit(OTHER_SCANNER_CONFIDENCE))


def hint(rules: list[Rule], language: Column, text: Column) -> Column:
    """Cheap necessary condition for any rule of the language to match `text`."""
    hit = F.lit(False)
    for languages in sorted({r.languages for r in rules}):
        needles = sorted({r.needle for r in rules if r.languages == languages})
        hit = hit | (language.isin(*languages) & any_contains(text, needles))
    return hit


def rule_matches(rules: list[Rule], language: Column, line: Column) -> list[Column]:
    """For each rule a finding struct, null where the rule does not match `line`. Its type comes from `classify`."""
    return [
        F.when(
            language.isin(*rule.languages) & line.rlike(rule.regex),
            F.struct(
                F.lit(0).alias("detector"),
                F.lit("semgrep").alias("detection_method"),
                F.lit(SCANNER_CONFIDENCE.get(rule.severity, OTHER_SCANNER_CONFIDENCE)).alias("confidence"),
                F.lit(rule.message).alias("message"),
                F.lit(rule.rule_id).alias("rule_id"),
                F.create_map(
                    F.lit("semgrep_severity"), F.lit(rule.severity),
                    F.lit("semgrep_rule"), F.lit(rule.rule_id),
                    F.lit("matched_text"), line,
                ).alias("metadata"),
            ),
        )
        for rule in rules
    ]

"""Patches for confirmed findings, from fixed code in model replies."""

from __future__ import annotations

import ast
import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vulnloom import constants as c
from vulnloom.functions import replies
from vulnloom.functions.text import split_lines
from vulnloom.operators.blocks import SPAN, BlockStore, Range
from vulnloom.operators.skew import cut
from vulnloom.operators.verdicts import stage_replies

PATCH_PROMPT = """\
Fix this vulnerability with as few changes as possible.

- Type: %s
- File: %s
- Line: %d
- Severity: %s
- Description: %s
- Taint chain: %s

Code %s:
```
%s
```

Answer with one JSON object with the members fixed_code (the whole code shown, fixed), explanation
and changes_summary."""


# A file of up to 200 lines is shown whole, of a longer one 50 lines around the finding.
SHOWN = Range(before=c.PATCH_CONTEXT_LINES, after=c.PATCH_CONTEXT_LINES, short=c.SHORT_FILE_LINES)


def original_code(findings: DataFrame, files: DataFrame) -> DataFrame:
    """`original`, `first_line`, `last_line`, `total_lines` for each distinct span of findings."""
    shown = BlockStore(findings, files, c.SHORT_FILE_LINES).spans(findings, SHOWN)
    return shown.select(
        *SPAN,
        F.coalesce("whole", F.array_join("lines", "\n")).alias("original"),
        (F.col("start") + 1).alias("first_line"), F.col("end").alias("last_line"), "total_lines",
    )


def patch_prompts(confirmed: DataFrame, files: DataFrame) -> DataFrame:
    span = ["repo_id", "file_path", "line_start", "line_end"]
    joined = confirmed.join(original_code(confirmed, files), span, "left")
    snippet_lines = F.size(split_lines(F.col("code_snippet")))
    note = F.when(
        F.col("total_lines") > c.SHORT_FILE_LINES,
        F.format_string(
            "[lines %d to %d of %d, finding at line %d]",
            F.col("first_line"), F.col("last_line"), F.col("total_lines"), F.col("line_start"),
        ),
    ).otherwise(
        F.format_string("[whole file of %d lines, finding at line %d]", F.coalesce("total_lines", snippet_lines), F.col("line_start"))
    )
    text = F.format_string(
        PATCH_PROMPT, F.col("vuln_type"), F.col("file_path"), F.col("line_start"), F.col("severity"), F.col("reasoning"),
        F.coalesce(F.nullif(F.col("taint_chain"), F.lit("")), F.lit("N/A")), note, F.coalesce("original", "code_snippet"),
    )
    return joined.select("repo_id", F.col("id").alias("finding_id"), F.lit("patch").alias("stage"), text.alias("text"))


def unified_diff(original: str, fixed: str, path: str) -> str:
    """Well-formed unified diff; empty when the two texts have the same lines."""
    lines = difflib.unified_diff(
        original.splitlines(), fixed.splitlines(), fromfile=f"a/{path}", tofile=f"b/{path}", lineterm=""
    )
    return "".join(f"{line}\n" for line in lines)


def syntax_valid(code: str, path: str) -> bool:
    """Python must parse; other languages are taken as valid."""
    if not path.endswith(".py"):
        return True
    try:
        ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def _diffs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = zip(batch.pop("original"), batch["fixed_code"], batch["file_path"], strict=True)
        checked = [(unified_diff(a, b, path), syntax_valid(b, path)) for a, b, path in rows]
        batch["diff"] = [d for d, _ in checked]
        batch["syntax_valid"] = [ok for _, ok in checked]
        yield batch.drop(columns="fixed_code")


def assemble_patches(confirmed: DataFrame, responses: DataFrame, files: DataFrame) -> DataFrame:
    """One patch per confirmed finding whose reply holds code that differs from the file.

    Replies, excerpts and filters are Spark expressions; only the texts of the few findings left
    go to Python, in Arrow batches, for the diff and the syntax check.
    """
    reply = F.col("reply")
    code = F.when(
        replies.kind(replies.field(reply, "fixed_code")) == "STRING", F.try_variant_get(reply, "$.fixed_code", "string")
    )
    span = ["repo_id", "file_path", "line_start", "line_end"]
    answers = stage_replies(responses, "patch").select(
        "repo_id", "id", code.alias("fixed_code"), replies.text_field(reply, "explanation", c.NO_EXPLANATION).alias("explanation")
    )
    fixed = confirmed.join(answers.filter(F.col("fixed_code") != ""), ["repo_id", "id"]).select(
        *span, F.col("id").alias("finding_id"), "seq", "fixed_code", "explanation"
    )
    fixed = cut(fixed)  # read twice below: for the places and for the texts
    texts = fixed.join(original_code(fixed, files), span).select(
        "repo_id", "finding_id", "file_path", "seq", "original", "fixed_code", "explanation"
    )
    diffed = texts.mapInPandas(
        _diffs,
        "repo_id string, finding_id string, file_path string, seq bigint, explanation string, diff string, syntax_valid boolean",
    )
    return diffed.filter(F.col("diff") != "").select(
        "repo_id", "finding_id", "diff", "explanation", "syntax_valid",
        F.array("file_path").alias("files_modified"), "seq",
    )


def line_delta(patches: DataFrame) -> DataFrame:
    """Added and removed lines of each patch, headers not counted."""

    def counted(sign: str) -> Column:
        is_change = lambda line: line.startswith(sign) & ~line.startswith(sign * 3)
        return F.size(F.filter(split_lines(F.col("diff")), is_change))

    return patches.select("repo_id", "finding_id", counted("+").alias("lines_added"), counted("-").alias("lines_removed"))

"""Path expressions: normalising, classifying and scoping."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from vulnloom.constants import (
    HIGH_RISK_WORDS,
    LANGUAGE_BY_SUFFIX,
    MEDIUM_RISK_DIRECTORIES,
    SECRET_FILE_NAMES,
    SECRET_FILE_SUFFIXES,
    SKIPPED_DIRECTORIES,
)
from vulnloom.functions.text import let, strip


def parts(path: Column) -> Column:
    """Path components; also the sort key that orders paths as a sorted tree walk does."""
    return F.split(path, "/")


def normalize_path(path: Column) -> Column:
    """POSIX form without `.` parts, doubled or trailing slashes, and without one leading slash.

    Exactly two leading slashes are a root of their own in POSIX, so one of them stays.
    """
    body = F.array_join(F.filter(parts(path), lambda p: (p != "") & (p != ".")), "/")
    return (
        F.when(path.rlike("^//(?!/)"), F.concat(F.lit("/"), body))
        .when(F.startswith(path, F.lit("/")), body)
        .when(body == "", F.lit("."))
        .otherwise(body)
    )


def file_name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def suffix(path: Column) -> Column:
    """Last dotted part of the file name; a leading dot alone makes no suffix."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def language(path: Column) -> Column:
    """Language by suffix; null for a file that is not source code."""
    by_suffix = F.create_map(*[F.lit(x) for pair in LANGUAGE_BY_SUFFIX.items() for x in pair])
    return by_suffix[suffix(path)]


def risk_level(path: Column) -> Column:
    """high, medium or low. Plain substrings, so `author.py` is high."""
    lowered = F.lower(path)
    high = lowered.rlike("|".join(re.escape(w) for w in HIGH_RISK_WORDS))
    medium = lowered.rlike("(?:^|/)(?:" + "|".join(re.escape(d) for d in MEDIUM_RISK_DIRECTORIES) + ")")
    return F.when(high, "high").when(medium, "medium").otherwise("low")


def risk_rank(level: Column) -> Column:
    return F.when(level == "high", 0).when(level == "medium", 1).otherwise(2)


def _skipped(part: Column) -> Column:
    return part.isin(SKIPPED_DIRECTORIES) | F.startswith(part, F.lit("."))


def in_skipped_directory(path: Column) -> Column:
    """True if any component, the file name included, is hidden or on the skip list."""
    return F.exists(parts(path), _skipped)


def in_secret_scope(path: Column) -> Column:
    """Text files looked at for secrets; only parent directories can rule a file out."""
    named = suffix(path).isin(SECRET_FILE_SUFFIXES) | F.lower(file_name(path)).isin(SECRET_FILE_NAMES)
    folders = F.slice(parts(path), 1, F.size(parts(path)) - 1)
    return named & ~F.exists(folders, _skipped)


def is_test_file(path: Column) -> Column:
    return F.lower(file_name(path)).rlike(r"^(?:test_.*|conftest\.py)$|_test\.[a-z]+$|\.(?:test|spec)\.[a-z]+$")


def glob_regex(pattern: str) -> str:
    """Shell glob to a Java regex matching the whole string; `*` also crosses slashes."""
    out, i = [], 0
    while i < len(pattern):
        char = pattern[i]
        i += 1
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif char == "[" and (end := pattern.find("]", i + (2 if pattern[i : i + 1] == "!" else 1))) > 0:
            negated = pattern[i] == "!"
            members = pattern[i + negated : end]
            i = end + 1
            escaped = re.sub(r"([\\\[\]^&])", r"\\\1", members)
            out.append(f"[{'^' if negated else ''}{escaped}]")
        else:
            out.append(re.escape(char))
    return "(?s)^(?:" + "".join(out) + r")\z"


def path_excluded(path: Column, excluded_paths: list[str], excluded_globs: list[str]) -> Column:
    """True if `path` is or lies under an excluded path, or matches a glob in full or by name."""
    prefixes = [p.rstrip("/") for p in map(normalized, excluded_paths) if p]
    regex = "|".join(glob_regex(g) for g in excluded_globs)

    def excluded(normal: Column) -> Column:
        hit = normal.isin(prefixes) if prefixes else F.lit(False)
        for prefix in prefixes:
            hit = hit | F.startswith(normal, F.lit(prefix + "/"))
        return hit | normal.rlike(regex) | file_name(normal).rlike(regex) if regex else hit

    return let(normalize_path(path), excluded)


def normalized(path: str) -> str:
    """`normalize_path` for a configured path string."""
    body = "/".join(p for p in path.split("/") if p not in ("", "."))
    if path.startswith("//") and not path.startswith("///"):
        return "/" + body
    return body if path.startswith("/") else body or "."


def relative_to(path: Column, root: Column) -> Column:
    """Path below `root`, or the path itself when it lies elsewhere."""
    prefix = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, prefix), F.substring(path, F.length(prefix) + 1, F.length(path))).otherwise(path)


def relative_uri(path: Column) -> Column:
    return F.regexp_replace(path, "^/+", "")


# The accepted repository address forms.
REPO_URL = r"^https://github\.com/([A-Za-z0-9._-]+)/([A-Za-z0-9._-]+?)(?:\.git)?(?:/tree/(.+))?/?$"
REPO_REMOTE = r"github\.com[:/]([A-Za-z0-9._-]+)/([A-Za-z0-9._-]+?)(?:\.git)?$"


def repo_url_parts(url: Column) -> Column:
    """struct(owner, repo, branch) of a repository address; null for any other text."""
    trimmed = strip(url)
    branch = F.regexp_replace(F.regexp_extract(trimmed, REPO_URL, 3), "/+$", "")
    return F.when(
        trimmed.rlike(REPO_URL),
        F.struct(
            F.regexp_extract(trimmed, REPO_URL, 1).alias("owner"),
            F.regexp_extract(trimmed, REPO_URL, 2).alias("repo"),
            F.nullif(branch, F.lit("")).alias("branch"),
        ),
    )


def repo_name(remote_url: Column, directory: Column) -> Column:
    """`owner/repo` from a remote address, else the directory's own name."""
    remote = strip(remote_url)
    named = F.concat_ws("/", F.regexp_extract(remote, REPO_REMOTE, 1), F.regexp_extract(remote, REPO_REMOTE, 2))
    return F.when(remote.rlike(REPO_REMOTE), named).otherwise(file_name(F.regexp_replace(directory, "/+$", "")))

"""Lines, tokens and decoding. The three line counts differ on purpose: see each docstring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from vulnloom.constants import LINE_BOUNDARY, OTHER_LINE_BOUNDARIES, WHITESPACE


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and hand it to `body`.

    A lambda that mentions an outer expression re-evaluates it for each element once the
    optimizer has inlined it; a one-element array keeps, say, a split file to one split.
    """
    return F.transform(F.array(value), body)[0]


def any_contains(text: Column, words: list[str]) -> Column:
    """True if `text` contains one of the literal words."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def strip(text: Column) -> Column:
    """Text without leading and trailing Unicode whitespace."""
    return F.btrim(text, F.lit(WHITESPACE))


def universal_newlines(text: Column) -> Column:
    """CR LF and lone CR become LF, as in text-mode file reading."""
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def decode_utf8(content: Column) -> Column:
    """Bytes to text with replacement characters for malformed sequences."""
    return universal_newlines(F.make_valid_utf8(content.cast("string")))


def newline_count(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def manifest_line_count(text: Column) -> Column:
    """Lines as a file iterator yields them: none in an empty file, none after a final newline."""
    unfinished = F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)
    return F.when(F.octet_length(text) == 0, 0).otherwise(newline_count(text) + unfinished).cast("int")


def parsed_line_count(text: Column) -> Column:
    """Newlines plus one, so an empty file has one line."""
    return (newline_count(text) + 1).cast("int")


def split_lines(text: Column) -> Column:
    """Lines at every Unicode line boundary, without an empty last line."""
    # Looking for a literal and splitting at one character are both far cheaper than a regex.
    pieces = F.when(any_contains(text, OTHER_LINE_BOUNDARIES), F.split(text, LINE_BOUNDARY)).otherwise(F.split(text, "\n"))
    return let(
        pieces,
        lambda parts: F.when(
            F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)
        ).otherwise(parts),
    )


def manifest_tokens(line_count: Column) -> Column:
    return line_count.cast("bigint") * 10


def text_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("bigint")


def numbered(number: Column, line: Column) -> Column:
    digits = number.cast("string")
    return F.concat(F.repeat(F.lit(" "), F.greatest(4 - F.length(digits), F.lit(0))), digits, F.lit(" | "), line)


def numbered_lines(lines: Column | str, start: Column) -> Column:
    """Lines that follow the first `start` lines of a file, with their numbers."""
    return F.transform(lines, lambda line, i: numbered(start + i + 1, line))


def numbered_range(lines: Column, start: Column, end: Column) -> Column:
    """Numbered lines of the zero-based half-open range [start, end) as an array."""
    return numbered_lines(F.slice(lines, start + 1, F.greatest(end - start, F.lit(0))), start)


def snippet(lines: Column, line: Column, context: int) -> Column:
    """Numbered lines around `line`, joined by newlines."""
    start = F.greatest(line - context - 1, F.lit(0))
    end = F.least(F.size(lines), line + context)
    return F.array_join(numbered_range(lines, start, end), "\n")


# Characters that make up most of a text as a rule, the most frequent first; each is one byte long.
COMMON = " etaonisrhldcumpgf.,bv\nywkz-jxq"


def shannon_entropy(value: Column) -> Column:
    """Bits per character; 0.0 for an empty string.

    The common characters are taken out of the text one after the other and counted by what that takes off
    its length; of the rest, equal characters are counted as sorted runs.
    """

    def without(state: Column, character: Column) -> Column:
        rest = state["rest"]
        return let(
            F.replace(rest, character, F.lit("")),
            lambda left: F.struct(
                left.alias("rest"), F.array_append(state["counts"], F.octet_length(rest) - F.octet_length(left)).alias("counts")
            ),
        )

    def of_runs(chars: Column) -> Column:
        size = F.size(chars)
        last_of_run = lambda i: (i == size) | (F.get(chars, i) != F.get(chars, i - 1))
        ends = F.filter(F.sequence(F.lit(1), size), last_of_run)
        return let(ends, lambda at: F.transform(at, lambda end, k: end - F.coalesce(F.get(at, k - 1), F.lit(0))))

    def counts(state: Column) -> Column:
        rare = let(F.sort_array(F.split(state["rest"], "")), of_runs)
        return F.when(state["rest"] == "", state["counts"]).otherwise(F.concat(state["counts"], rare))

    def bits(found: Column) -> Column:
        shares = let(F.length(value), lambda size: F.transform(F.filter(found, lambda n: n > 0), lambda n: n / size))
        return F.aggregate(shares, F.lit(0.0), lambda total, share: total - share * F.log2(share))

    start = F.struct(value.alias("rest"), F.array().cast("array<int>").alias("counts"))
    found = F.aggregate(F.array(*map(F.lit, COMMON)), start, without, counts)
    return F.when(value == "", F.lit(0.0)).otherwise(let(found, bits))

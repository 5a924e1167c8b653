"""Reading JSON out of free-form model replies, with the exact fall-backs of a dynamic language."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

from vulnloom.functions.text import strip

FENCED_BLOCK = r"(?s)```(?:json)?\s*\n?(.*?)\n?```"
NUMBER = r"(?i)^[+-]?(?:(?:\d+(?:\.\d*)?|\.\d+)(?:e[+-]?\d+)?|nan|inf|infinity)$"


# A quoted text, or a number that JSON has no word for.
UNQUOTED = r'("(?:[^"\\]|\\.)*+")|(-?(?:NaN|Infinity)\b)'


def lenient(spark: SparkSession) -> None:
    """Let replies repeat a member; the last one counts."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


# What a JSON text can begin with. Parsing other texts would raise and catch an error for each of them.
BEGINS = r"^[ \t\r\n]*+[\[{\"\-0-9tfn]"


def _parsed(text: Column) -> Column:
    """Variant of a JSON text. Bare NaN and infinities are read as texts, from which numbers are read."""
    marked = F.regexp_replace(text, UNQUOTED, "$1\u0001$2\u0001")
    quoted = F.replace(F.replace(marked, F.lit("\u0001\u0001"), F.lit("")), F.lit("\u0001"), F.lit('"'))
    odd = F.contains(text, F.lit("NaN")) | F.contains(text, F.lit("Infinity"))
    parsed = lambda t: F.when(t.rlike(BEGINS), F.try_parse_json(t))
    # A text that is JSON as it stands has such words within quotes only, and reads the same with all others quoted.
    return F.coalesce(F.when(odd, parsed(quoted)), parsed(text))


def extract_json(text: Column) -> Column:
    """Variant from the whole text, else the first fenced block, else first `{` to last `}`.

    Call `lenient` once in the session that runs it.
    """
    first = F.instr(text, "{")
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    braces = F.when((first > 0) & F.contains(text, F.lit("}")) & (last > first), F.substring(text, first, last - first + 1))
    return F.coalesce(
        _parsed(text),
        _parsed(F.regexp_extract(text, FENCED_BLOCK, 1)),
        _parsed(braces),
    )


def kind(value: Column) -> Column:
    """Type name of a variant: VOID, BOOLEAN, BIGINT, DECIMAL(..), DOUBLE, STRING, ARRAY<..>, OBJECT<..>."""
    return F.schema_of_variant(value)


def falsy(value: Column) -> Column:
    """True for null, false, zero, empty text, empty list and empty object; false if absent."""
    shown = F.to_json(value)
    zero = kind(value).rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)") & (F.try_variant_get(value, "$", "double") == 0)
    return F.coalesce(F.is_variant_null(value) | shown.isin("false", '""', "[]", "{}") | zero, F.lit(False))


def field(value: Column, name: str) -> Column:
    """Member as a variant: SQL null when absent, variant null when given as null."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def is_object(value: Column) -> Column:
    return kind(value).rlike("^OBJECT")


def is_container(value: Column) -> Column:
    """True for a list or object, which cannot be looked up as a word."""
    return F.coalesce(kind(value).rlike("^(?:ARRAY|OBJECT)"), F.lit(False))


def text_field(value: Column, name: str, default: str | None) -> Column:
    """Member as text; the default only when the member is absent."""
    member = field(value, name)
    return F.when(member.isNull(), F.lit(default)).otherwise(F.try_variant_get(value, f"$.{name}", "string"))


def word_field(value: Column, name: str, words: list[str], default: str) -> Column:
    """Member if it is one of `words` exactly, else the default."""
    member = F.when(kind(field(value, name)) == "STRING", F.try_variant_get(value, f"$.{name}", "string"))
    return F.when(member.isin(words), member).otherwise(F.lit(default))


def number_field(value: Column, name: str, default: Column) -> Column:
    """Member as a number, the default when absent, null when it is not a number."""
    member = field(value, name)
    as_text = strip(F.try_variant_get(value, f"$.{name}", "string"))
    from_text = F.when(as_text.rlike(NUMBER), as_text.try_cast("double"))
    return (
        F.when(member.isNull(), default)
        .when(kind(member) == "STRING", from_text)
        .when(kind(member) == "BOOLEAN", F.try_variant_get(value, f"$.{name}", "boolean").cast("double"))
        .otherwise(F.try_variant_get(value, f"$.{name}", "double"))
    )


def boolean_field(value: Column, name: str) -> Column:
    """Member as true, false or unknown."""
    return F.when(kind(field(value, name)) == "BOOLEAN", F.try_variant_get(value, f"$.{name}", "boolean"))

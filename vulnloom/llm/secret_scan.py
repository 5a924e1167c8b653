"""Secret scan with corpus-wide ownership frequency.

Candidates are assignments, access keys, runs of hex digits and opaque strings. Every candidate value
is hashed, and its hash is counted over the corpus by distinct repository and owner. A value that
many owners hold is an example everyone copies; one in many repositories of few owners is a setting
they share; one that stays in one or two places and looks random is a credential that may be live. Assignments, access keys and hex runs are always reported; opaque
strings only where ownership shows them to be live.

Only DataFrame functions are used. Texts are read in place: what is shuffled are spans and hashes,
and counts are combined in each task before they move, so a value that fills a third of the corpus
is no hot key.

Every step is linear in the matches of a text, or takes the square root of their number as often, so one
text may hold hundreds of thousands of them. Columns that `redact` hands on travel in a struct, whatever
their names.

A null text is an empty one. Rows that agree in id and text are one document for the counts, and
each of them gets the result. Null owners and repositories count as one owner and one repository.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from vulnloom.functions.text import let
from vulnloom.llm.common import cut, packed, running

KINDS = ["assign", "access", "hex", "opaque"]
_KEY = "|".join(
    ["[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]", "[Pp][Aa][Ss][Ss][Ww][Dd]", "[Ss][Ee][Cc][Rr][Ee][Tt]", "[Tt][Oo][Kk][Ee][Nn]"]
    + ["[Aa][Pp][Ii]_?[Kk][Ee][Yy]"]
)
ASSIGN = rf"""({_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
# Runs are maximal, so a minimum in the pattern finds the same runs as a test afterwards.
HEX = "[0-9a-f]{24,}"
OPAQUE = "[A-Za-z0-9_-]{32,}"
# What a text must contain, in lower case, to hold an assignment.
HINTS = ["passw", "secret", "token", "api"]
PLACEHOLDER = "example|sample|dummy|placeholder|changeme|xxxx|0000000"

# A value held by at least so many owners is a copied example; one in so many repositories of fewer
# owners is a setting that they share.
COPIED_FROM_OWNERS = 3
SHARED_FROM_REPOS = 3
LIVE_LENGTH = 12
# Characters in which a text is cut up to be masked.
PIECE = 4096

_SPAN = "array<struct<start:bigint,rank:int,end:bigint,value:string>>"
_FAR = 1 << 62


def _located(text: Column, pattern: str, rank: int, group: int, shortest: int, has: Column) -> Column:
    """Spans of all matches whose `group` has at least `shortest` characters.

    Splitting gives the texts between the matches, and the running sum of both lengths their places.
    """
    sizes = lambda texts: F.transform(texts, lambda x: F.length(x).cast("bigint"))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.struct(
        sizes(whole).alias("sizes"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"),
        sizes(F.split(text, pattern, -1)).alias("gaps"),
    )

    def spans(x: Column) -> Column:
        steps = F.zip_with(F.slice(x["gaps"], 1, F.size(x["sizes"])), x["sizes"], lambda gap, size: gap + size)
        matches = F.arrays_zip(running(steps, lambda a, b: a + b, 0).alias("end"), x["sizes"].alias("size"), x["values"].alias("value"))
        long_enough = F.filter(matches, lambda m: F.length(m["value"]) >= shortest)
        return F.transform(
            long_enough,
            lambda m: F.struct((m["end"] - m["size"]).alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), m["value"].alias("value")),
        )

    return F.when(has, let(found, spans)).otherwise(F.array().cast(_SPAN))


def _with_cover(sorted_spans: Column) -> Column:
    """The spans, each with `covered`: whether it overlaps a span of the first three kinds.

    Of spans sorted by start, one overlaps another if one before it ends behind its start, or one
    after it starts before its end; running maxima of ends and, from behind, of starts tell both.
    """
    base = lambda s, value: F.when(s["rank"] < 3, value).otherwise(F.lit(-_FAR))

    def covered(spans: Column) -> Column:
        reached = running(F.transform(spans, lambda s: base(s, s["end"])), F.greatest, -_FAR)
        ahead = F.reverse(running(F.transform(F.reverse(spans), lambda s: base(s, -s["start"])), F.greatest, -_FAR))
        zipped = F.arrays_zip(spans.alias("s"), reached.alias("reached"), ahead.alias("ahead"))
        return F.transform(zipped, lambda z: with_flag(z["s"], (z["reached"] > z["s"]["start"]) | (-z["ahead"] < z["s"]["end"])))

    def with_flag(s: Column, flag: Column) -> Column:
        return F.struct(*[s[c].alias(c) for c in ("start", "rank", "end", "value")], flag.alias("covered"))

    mixed = lambda spans: F.exists(spans, lambda s: s["rank"] == 3) & F.exists(spans, lambda s: s["rank"] < 3)
    plain = lambda spans: F.transform(spans, lambda s: with_flag(s, F.lit(False)))
    return let(sorted_spans, lambda spans: F.when(mixed(spans), covered(spans)).otherwise(plain(spans)))


def _any(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in parts))


def _assigns(text: Column) -> Column:
    """A cheap test that every text with an assignment passes."""
    return _any(F.lower(text), HINTS) & (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")))


def candidates(df: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """(id, version, owner, repo, spans) of each row; `version` is the digest of the text."""
    rows = df.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.col(owner_col).cast("string").alias("owner"),
        F.col(repo_col).cast("string").alias("repo"),
    )
    text = F.col("text")
    by_kind = [
        _located(text, ASSIGN, 0, 2, 6, _assigns(text)),
        _located(text, ACCESS, 1, 0, 20, F.contains(text, F.lit("AKIA"))),
        _located(text, HEX, 2, 0, 24, text.rlike(HEX)),
        _located(text, OPAQUE, 3, 0, 32, text.rlike(OPAQUE)),
    ]
    spans = F.array_sort(F.concat(*by_kind))
    return rows.select("id", F.sha2("text", 256).alias("version"), "owner", "repo", _with_cover(spans).alias("spans"))


def ownership(found: DataFrame, live_length: int = LIVE_LENGTH) -> DataFrame:
    """(hash, n_documents, n_repos, n_owners, verdict) of each candidate value.

    `verdict` is `copied` for values with many owners, `shared` for values in many repositories of few
    owners, `live` for values that look random (at least `live_length` characters with a digit and a
    letter, and no placeholder) and stay in one or two places, else `plain`.
    """
    each = found.select("id", "version", "owner", "repo", F.explode("spans").alias("s")).select(
        "id", "version", "owner", "repo", F.col("s.value").alias("value"), F.sha2("s.value", 256).alias("hash")
    )
    shape = (
        (F.length("value") >= live_length)
        & F.col("value").rlike("[0-9]")
        & F.col("value").rlike("[A-Za-z]")
        & ~F.lower("value").rlike(PLACEHOLDER)
    )
    documents = each.groupBy("hash", "id", "version", "owner", "repo").agg(F.max(shape).alias("random"))
    repos = documents.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"), F.max("random").alias("random"))
    owners = repos.groupBy("hash", "owner").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("repos"), F.max("random").alias("random")
    )
    totals = owners.groupBy("hash").agg(
        F.sum("n").alias("n_documents"),
        F.sum("repos").alias("n_repos"),
        F.count(F.lit(1)).alias("n_owners"),
        F.max("random").alias("random"),
    )
    verdict = (
        F.when(F.col("n_owners") >= COPIED_FROM_OWNERS, "copied")
        .when(F.col("n_repos") >= SHARED_FROM_REPOS, "shared")
        .when(F.col("random"), "live")
        .otherwise("plain")
    )
    return totals.select("hash", "n_documents", "n_repos", "n_owners", verdict.alias("verdict"))


def scan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str = "repo",
    live_length: int = LIVE_LENGTH,
) -> DataFrame:
    """One row per document with its spans.

    (id, version, spans: array of (start, rank, end, value, verdict, n_repos, n_owners, covered)); `rank`
    numbers `KINDS`. Opaque spans are there only if live and not part of another kind's span.
    """
    found = cut(candidates(df, id_col, text_col, owner_col, repo_col))
    documents = found.groupBy("id", "version").agg(F.first("spans").alias("spans"))
    each = documents.select("id", "version", F.explode("spans").alias("s")).withColumn("hash", F.sha2("s.value", 256))
    judged = each.join(ownership(found, live_length), "hash").select(
        "id",
        "version",
        F.struct("s.start", "s.rank", "s.end", "s.value", "verdict", "n_repos", "n_owners", "s.covered").alias("s"),
    )
    by_document = judged.groupBy("id", "version").agg(F.array_sort(F.collect_list("s")).alias("spans"))

    def kept(spans: Column) -> Column:
        return F.filter(spans, lambda s: (s["rank"] < 3) | ((s["verdict"] == "live") & ~s["covered"]))

    reported = by_document.select(
        F.col("id").alias("_id"), F.col("version").alias("_version"), kept(F.col("spans")).alias("spans")
    )
    empty = F.array().cast(reported.schema["spans"].dataType)
    rows = found.select("id", "version")
    return rows.join(
        reported, rows["id"].eqNullSafe(reported["_id"]) & (rows["version"] == reported["_version"]), "left"
    ).select("id", "version", F.coalesce("spans", empty).alias("spans"))


def _written(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    line = lambda s: F.concat_ws(":", kind[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, line), ",")


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind and by verdict, the spans as text, and the most owners and repositories that a
    reported value of the text has, of each row of `scan`."""
    spans = F.col("spans")

    def count(field: str, value: int | str) -> Column:
        return F.size(F.filter(spans, lambda s: s[field] == value)).cast("bigint")

    return scanned.select(
        F.col("id").alias(id_col),
        *[count("rank", i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sha2(_written(F.filter(spans, lambda s: s["rank"] < 3)), 256).alias("base_sha256"),
        _written(spans).alias("spans"),
        count("verdict", "live").alias("n_live"),
        count("verdict", "copied").alias("n_copied"),
        count("verdict", "shared").alias("n_shared"),
        *[F.coalesce(F.array_max(F.transform(spans, lambda s: s[n])), F.lit(0)).alias(f"max_{n[2:]}") for n in ("n_owners", "n_repos")],
    )


def _may_hold(text: Column) -> Column:
    """True for every text with a candidate."""
    return (
        (_assigns(text) & text.rlike(ASSIGN))
        | F.contains(text, F.lit("AKIA"))
        | text.rlike(HEX)
        | text.rlike(OPAQUE)
    )


def _pieces(text: Column) -> Column:
    """The text in pieces of `PIECE` characters: a place in a long text is counted from the start of its piece."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _between(pieces: Column, start: Column, end: Column) -> Column:
    """The characters [start, end) of a text in pieces."""
    number = lambda at: F.floor(at / PIECE).cast("int")
    inside = lambda at: (at % PIECE).cast("int")
    piece = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
    first, last = number(start), number(end)
    within = F.substr(piece(first), inside(start) + 1, (end - start).cast("int"))
    across = F.concat(
        F.substr(piece(first), inside(start) + 1),
        F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
        F.substr(piece(last), F.lit(1), inside(end)),
    )
    return F.when(start >= end, "").when(first == last, within).otherwise(across)


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with each of the sorted spans replaced by `mask`; spans that overlap become one."""
    parts = F.struct(_pieces(text).alias("pieces"), running(F.transform(spans, lambda s: s["end"]), F.greatest, 0).alias("reached"))

    def written(x: Column) -> Column:
        before = F.concat(F.array(F.lit(0).cast("bigint")), x["reached"])
        starts = F.filter(F.arrays_zip(spans.alias("s"), before.alias("before")), lambda z: z["s"]["start"] >= z["before"])
        heads = F.transform(starts, lambda z: F.concat(_between(x["pieces"], z["before"], z["s"]["start"]), F.lit(mask)))
        tail = _between(x["pieces"], F.element_at(before, -1), F.length(text).cast("bigint"))
        return F.concat(F.array_join(heads, ""), tail)

    return let(parts, written)


def redact(df: DataFrame, scanned: DataFrame, id_col: str, text_col: str, mask: str = "[REDACTED]") -> DataFrame:
    """`df` with every live span of a text replaced by `mask`; copied and shared values stay.

    Only texts with candidates are joined with their spans; all others pass through unshuffled.
    """
    live = scanned.select("id", "version", F.filter("spans", lambda s: s["verdict"] == "live").alias("live"))
    live = live.where(F.size("live") > 0).dropDuplicates(["id", "version"])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    may_hold = _may_hold(text)
    named = df.where(may_hold).select(packed(df), F.col(id_col).alias("own_id"), text.alias("own_text"), F.sha2(text, 256).alias("own_version"))
    joined = named.join(live, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_version") == F.col("version")), "left")
    masked = F.when(F.col("live").isNull(), F.col("row").getField(text_col)).otherwise(_masked(F.col("own_text"), F.col("live"), mask))
    changed = joined.select(*[(masked if c == text_col else F.col("row").getField(c)).alias(c) for c in df.columns])
    return df.where(~may_hold).unionByName(changed)

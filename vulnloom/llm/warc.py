"""WARC archives: captures written as request, response and metadata records, and put together again.

`write` makes three records of every page. The response and metadata carry each other's capture in
WARC-Concurrent-To; of equal payloads from `least` bytes on, that with the largest id is stored and the
others become revisit records that refer to it. `records` reads any uncompressed or gzip archive with
Spark's text reader, which splits large files; `captures` joins the records of a transaction through
their concurrent-to identifiers, whichever of them names the other and also over one record between,
and emits one nested row per capture. `resolved` finds the stored response of each revisit.

All of it are DataFrame functions. The decision which payloads are stored joins a narrow table of the
repeated digests (a broadcast where Catalyst sees that it is small, else a join by digest that AQE
splits where a digest is hot); what links records are narrow rows too, and payloads move only if asked for.

Cases: a null html is an empty payload; payloads below `least` bytes are always responses. A null id
is written without one, read back as null and smaller than all others. Rows that repeat both id and
html are one capture: written as often as they occur (with equal record ids) and read as one row.
Rows with one id and several payloads are captures of their own. A null url leaves the target out, and
blanks and control characters in it are percent-encoded. Payloads may hold any text, that of other
archives included. Records are split at the version line; a piece that is not as long as its
Content-Length says is put together with those after it in its file. What can't be (a cut off file, a
missing length) is returned as it stands, with `whole` false. Of linked records of one kind the one
with the smallest id is in the capture's row, `n_requests` and `n_metadata` count them, and `links`
has all. Other columns are not looked at; an empty table gives an empty archive and no captures.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vulnloom.operators.skew import checkpoint_path, cut

END = "\r\n"
GAP = END + END
# Records are told apart where a line begins like this; what stands before it belongs to the last one.
VERSION = "\nWARC/1."
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAINS = ("response", "revisit", "resource")


def _record_id(kind: str, *parts: Column) -> Column:
    """An identifier that follows from the parts, so that a task run again writes the same."""
    known = [F.coalesce(p.cast("string"), F.lit("-")) for p in parts]
    h = F.sha2(F.concat_ws("\n", F.lit(kind), *known), 256)
    pieces = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def _record(kind: str, fields: list[tuple[str, Column]], block: Column) -> Column:
    """The text of a record; fields without a value are left out."""
    all_fields = [("WARC-Type", F.lit(kind)), *fields, ("Content-Length", F.octet_length(block).cast("string"))]
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in all_fields]
    return F.concat(F.concat_ws(END, F.lit("WARC/1.1"), *lines), F.lit(GAP), block)


def _clean_url(url: Column) -> Column:
    for char in (" ", "\t", "\r", "\n"):
        url = F.replace(url, F.lit(char), F.lit(f"%{ord(char):02X}"))
    return F.regexp_replace(url, r"[\x00-\x1F\x7F]", "%00")


def repeated(pages: DataFrame, least: int) -> DataFrame:
    """(digest, keeper): payloads of at least `least` bytes that occur with several ids, and the largest id."""
    big = pages.where(F.octet_length("payload") >= least).groupBy("digest")
    found = big.agg(F.max("page_id").alias("keeper"), F.min("page_id").alias("low"), F.count("page_id").alias("named"), F.count("*").alias("n"))
    return found.where((F.col("low") < F.col("keeper")) | ((F.col("named") > 0) & (F.col("named") < F.col("n")))).select("digest", "keeper")


def write(
    pages: DataFrame,
    path: str,
    least: int = 1000,
    date: str = "2000-01-01T00:00:00Z",
    compression: str = "gzip",
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> None:
    """Writes the archives as files in the folder `path`, one for each task."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        _clean_url(F.col(url_col).cast("string")).alias("url"),
        payload.alias("payload"),
        F.sha1(payload.cast("binary")).alias("digest"),
    )
    again = cut(repeated(rows, least))
    keeper = F.col("keeper")
    rows = rows.join(again, "digest", "left").withColumn(
        "again", keeper.isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < keeper))
    )
    capture = [F.col("page_id"), F.col("digest")]
    main = _record_id("response", *capture)
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    place = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)"
    target = F.coalesce(F.regexp_extract("url", place, 2), F.lit(""))
    ask = F.concat(
        F.lit("GET "), F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target)), F.lit(f" HTTP/1.1{END}Host: "),
        F.coalesce(F.regexp_extract("url", place, 1), F.lit("")), F.lit(GAP),
    )
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.octet_length("payload").cast("string"), F.lit(GAP),
    )
    http = lambda kind: ("Content-Type", F.lit(f"application/http;msgtype={kind}"))
    mine = [("WARC-Record-ID", main), *common, digest, http("response")]
    refers = [("WARC-Refers-To", _record_id("response", keeper, F.col("digest"))), ("WARC-Profile", F.lit(REVISIT))]
    response = F.when(F.col("again"), _record("revisit", mine + refers, head)).otherwise(
        _record("response", mine, F.concat(head, F.col("payload")))
    )
    beside = lambda kind: [("WARC-Record-ID", _record_id(kind, *capture)), ("WARC-Concurrent-To", main), *common]
    request = _record("request", [*beside("request"), http("request")], ask)
    about = F.coalesce(F.concat(F.lit("page_id: "), F.col("page_id").cast("string"), F.lit(END)), F.lit(""))
    metadata = _record("metadata", [*beside("metadata"), ("Content-Type", F.lit("application/warc-fields"))], about)
    text = rows.select(F.concat_ws(GAP, request, response, metadata).alias("value"))
    text.write.option("lineSep", GAP).option("compression", compression).text(path)


def _header(text: Column, name: str) -> Column:
    found = F.regexp_extract(text, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", F.trim(found))


def _sized(text: Column) -> tuple[Column, Column, Column]:
    """The header of a piece, the bytes up to its block, and the bytes of the block."""
    header = F.substring_index(text, GAP, 1)
    return header, F.octet_length(header) + F.lit(len(GAP)), _header(header, "Content-Length").try_cast("bigint")


def _joined_pieces(rows: pd.DataFrame) -> pd.DataFrame:
    """Which record each piece of a file belongs to: `head` is the piece it begins with, `place` its turn."""
    rows = rows.sort_values("seq", ignore_index=True)
    seqs, need = rows["seq"].to_numpy(), rows["need"].to_numpy()
    # Ends of the pieces, as if each were followed by the version mark that parted it from the next.
    ends = (rows["size"] + len(VERSION)).cumsum().to_numpy()
    heads, i = seqs.copy(), 0
    while i < len(rows):
        begin, last = (ends[i - 1] if i else 0), i
        if need[i] == need[i]:
            # A record is closed by two line ends, the last of which may be part of the version mark.
            last = int(ends.searchsorted(begin + need[i] + len(VERSION)))
            spare = ends[last] - len(VERSION) - begin - need[i] if last < len(rows) else -1
            last = last if spare in (3, 4) else i
        heads[i : last + 1] = seqs[i]
        i = last + 1
    return pd.DataFrame({"file": rows["file"], "seq": seqs, "head": heads})


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", VERSION).text(path)
    _, begins, length = _sized(F.col("value"))
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq"), "value",
        F.octet_length("value").cast("bigint").alias("size"), (begins + length).alias("need"),
    )


def read(spark: SparkSession, path: str, keep: Callable[[DataFrame], DataFrame] = lambda found: found) -> DataFrame:
    """What `keep` makes of the records of an archive, stored; `keep` maps rows of `_parsed`, each by itself.

    The archive is read once. Only if some piece turns out shorter than its record says are the files
    with such pieces read again, to put their pieces together.
    """
    pieces = _pieces(spark, path)
    marked = [F.col(c) for c in ("file", "size", "need")]
    stored = cut(keep(_parsed(pieces, *marked)))
    odd = cut(stored.where("need IS NULL OR need > size").select("file").distinct())
    if odd.isEmpty():
        return stored.drop("file", "size", "need")
    again = keep(_parsed(_joined(pieces.join(odd, "file", "left_semi"))))
    return stored.join(odd, "file", "left_anti").drop("file", "size", "need").unionByName(cut(again))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, type, target_uri, date, concurrent_to, refers_to, payload_digest, content_type, whole, block), stored."""
    return read(spark, path)


def _joined(pieces: DataFrame) -> DataFrame:
    """The pieces with those put together that make up one record.

    The pieces are written down, so that their numbers stay, and numbers and sizes alone decide what
    belongs together.
    """
    stored = cut(pieces)
    parts = stored.select("file", "seq", "size", F.col("need").cast("double")).groupBy("file").applyInPandas(
        _joined_pieces, "file string, seq bigint, head bigint"
    )
    turns = F.array_sort(F.collect_list(F.struct("seq", "value")))
    whole = F.array_join(F.transform(turns, lambda t: t["value"]), VERSION)
    return stored.join(parts, ["file", "seq"]).groupBy("file", "head").agg(whole.alias("value")).where(F.btrim("value", F.lit(END)) != "")


def _parsed(pieces: DataFrame, *marked: Column) -> DataFrame:
    header, begins, length = _sized(F.col("value"))
    headed = pieces.select("value", header.alias("header"), begins.alias("begins"), length.alias("length"), *marked)
    data = F.col("value").cast("binary")
    block = F.substr(data, F.col("begins") + 1, F.coalesce(F.col("length"), F.lit(2**31 - 1)).cast("int"))
    ids = F.regexp_extract_all("header", F.lit(r"(?i)(?:^|\r\n)WARC-Concurrent-To:[ \t]*([^\r\n]*)"), 1)
    return headed.select(
        _header(F.col("header"), "WARC-Record-ID").alias("record_id"),
        F.lower(_header(F.col("header"), "WARC-Type")).alias("type"),
        _header(F.col("header"), "WARC-Target-URI").alias("target_uri"),
        _header(F.col("header"), "WARC-Date").alias("date"),
        F.transform(ids, lambda x: F.trim(x)).alias("concurrent_to"),
        _header(F.col("header"), "WARC-Refers-To").alias("refers_to"),
        _header(F.col("header"), "WARC-Payload-Digest").alias("payload_digest"),
        _header(F.col("header"), "Content-Type").alias("content_type"),
        F.coalesce(F.octet_length("value") >= F.col("begins") + F.col("length"), F.lit(False)).alias("whole"),
        block.alias("block"),
        *marked,
    )


def with_payload(found: DataFrame) -> DataFrame:
    """Adds payload, its bytes and its SHA-1: what follows the HTTP header, or the whole block of other records."""
    http = F.coalesce(F.lower("content_type").startswith("application/http"), F.lit(False))
    head = F.octet_length(F.substring_index(F.col("block").cast("string"), GAP, 1)) + F.lit(len(GAP))
    payload = F.when(http, F.substr("block", head + 1, F.lit(2**31 - 1))).otherwise(F.col("block"))
    with_it = found.withColumn("payload", payload)
    return with_it.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_sha1": F.sha1("payload")})


def links(found: DataFrame) -> DataFrame:
    """(record_id, capture_id): each request and metadata record with the capture it belongs to."""
    mains = found.where(F.col("type").isin(*MAINS))
    others = found.where(F.col("type").isin("request", "metadata"))
    names = others.select("record_id", F.explode("concurrent_to").alias("to")).distinct()
    ids = mains.select(F.col("record_id").alias("to"), F.col("record_id").alias("capture_id")).distinct()
    own = names.join(ids, "to").select("record_id", "capture_id")
    named = mains.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("capture_id")).distinct()
    direct = own.unionByName(named).distinct()
    between = names.join(direct.withColumnRenamed("record_id", "to"), "to").select("record_id", "capture_id")
    return direct.unionByName(between).distinct()


def captures(found: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per capture: (capture_id, type, refers_to, request, response, metadata, n_requests, n_metadata).

    `found` are records, or what is needed of them: record_id, type, concurrent_to, refers_to and the
    `columns` (by default all others) that each nested record is to have. Payloads move with them.
    """
    columns = columns or [c for c in found.columns if c not in ("record_id", "type", "concurrent_to", "refers_to")]
    # Copies of a record, in one archive or in several, count once: the smallest row of them.
    row = F.struct("record_id", *columns)
    mains = found.where(F.col("type").isin(*MAINS) & F.col("record_id").isNotNull()).groupBy("record_id")
    mains = mains.agg(*[F.min(c).alias(c) for c in ("type", "refers_to", *columns)])
    out = mains.select(F.col("record_id").alias("capture_id"), "type", "refers_to", row.alias("response"))
    linked = links(found)
    for kind, count in (("request", "n_requests"), ("metadata", "n_metadata")):
        own = found.where(F.col("type") == kind).groupBy("record_id").agg(*[F.min(c).alias(c) for c in columns])
        by_capture = own.join(linked, "record_id").groupBy("capture_id")
        held = by_capture.agg(F.min_by(row, "record_id").alias(kind), F.count("*").alias(count))
        out = out.join(held, "capture_id", "left").withColumn(count, F.coalesce(count, F.lit(0)))
    return out.select("capture_id", "type", "refers_to", "request", "response", "metadata", "n_requests", "n_metadata")


def resolved(found: DataFrame, of_response: dict[str, Column]) -> DataFrame:
    """Adds the named columns of the stored response: the capture's own, or that which a revisit refers to.

    Many revisits may refer to one response, so the join is by distinct reference first.
    """
    stored = found.where("type <> 'revisit'").select(F.col("capture_id").alias("refers_to"), *[c.alias(n) for n, c in of_response.items()])
    again = found.where("type = 'revisit'")
    used = stored.join(again.select("refers_to").distinct(), "refers_to", "left_semi")
    own = found.where("type <> 'revisit'").select("*", *[c.alias(n) for n, c in of_response.items()])
    return own.unionByName(again.join(used, "refers_to", "left").select(*own.columns))


def page_id(about: Column) -> Column:
    """The id that `write` has put into a metadata record."""
    return F.when(about.isNotNull(), _header(about, "page_id"))


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each page, read back from archives."""
    spark, id_type = pages.sparkSession, pages.schema["page_id"].dataType
    path = checkpoint_path(spark)
    write(pages, path, least)
    about = F.when(F.col("type") == "metadata", F.col("block").cast("string")).alias("about")
    narrow = lambda found: with_payload(found).drop("block", "payload", "target_uri", "date", "payload_digest", "content_type", "whole")
    found = captures(read(spark, path, lambda found: narrow(found.withColumn("about", about)))).withColumn("page_id", page_id(F.col("metadata.about")).cast(id_type))
    whole = resolved(
        found,
        {"bytes": F.col("response.payload_bytes"), "digest": F.col("response.payload_sha1"), "owner": F.col("page_id")},
    )
    return whole.select(
        "page_id",
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(F.col("type") == "revisit", F.col("owner")).alias("refers_to"),
    )

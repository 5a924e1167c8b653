"""Archives written and read back, and records of other writers."""

import gzip
from hashlib import sha1

import pytest
from pyspark.sql import functions as F

from vulnloom.llm import warc
from vulnloom.operators.skew import cut

SCHEMA = "page_id bigint, url string, html string, digest string, keeper string, again string, capture_id string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA)


def expected(rows, least=1000):
    found = set()
    for page_id, _, html in rows:
        body = (html or "").encode()
        same = [i for i, _, h in rows if (h or "") == (html or "") and i is not None]
        keeper = max(same) if same and len(body) >= least else page_id
        again = keeper is not None and (page_id is None or page_id < keeper)
        found.add((page_id, len(body), sha1(body).hexdigest(), "revisit" if again else "response", keeper if again else None))
    return sorted(map(repr, found))


def result(df):
    return sorted(map(repr, map(tuple, df.collect())))


LONG, LONGER = "<p>päge</p>\r\n" * 100, "x" * 3_000_000
INNER = "text\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.0\r\n\r\n\nWARC/1.x" * 30


def test_round_trip(spark):
    url = "https://host.example:8080/a/b?c=d#e"
    rows = [(1, url, LONG), (2, url, LONG), (9, None, LONG), (3, "", "short"), (4, "no url", "short"), (5, url, None), (6, url, "")]
    rows += [(7, "http://h/ a\r\nWARC-Type: x\x00", LONGER), (8, url, LONGER), (10, url, "y" * 999), (11, url, "y" * 999)]
    rows += [(12, url, "z" * 1000), (12, url, "z" * 1000), (12, url, "other"), (None, url, LONG), (None, url, "n" * 2000), (None, url, "n" * 2000)]
    rows += [(20 + i, url, f"many {i} " * 50) for i in range(200)] + [(300 + i, url, "hot" * 500) for i in range(300)]
    assert result(warc.round_trip(pages(spark, rows).repartition(5))) == expected(rows)


def test_payloads_that_look_like_archives(spark):
    rows = [(1, "u", INNER), (2, "u", "\nWARC/1."), (3, "u", "WARC/1.1\r\n\r\n"), (4, "u", INNER), (5, "u", "\r\n\r\n" * 500), (6, "u", "plain")]
    assert result(warc.round_trip(pages(spark, rows).coalesce(1))) == expected(rows)
    assert result(warc.round_trip(pages(spark, []))) == []


def test_splits_of_large_files(spark, tmp_path):
    """A file is read in ranges that begin anywhere, within the mark between two records too."""
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>\r\n" * (i % 120)) for i in range(300)]
    path = str(tmp_path / "w")
    warc.write(pages(spark, rows).coalesce(1), path, compression="none")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for width in (4001, 4099, 5003):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(width))
        try:
            found = warc.read(spark, path, lambda found: warc.with_payload(found).drop("block", "payload"))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        assert len(found.inputFiles()) > 50 and found.where("NOT whole").count() == 0
        stored = {r.record_id: r.payload_sha1 for r in found.where("type = 'response'").collect()}
        assert sorted(stored.values()) == sorted(sha1(h.encode()).hexdigest() for _, _, h in rows)


def record(kind, record_id, block, *fields, length=None):
    length = len(block) if length is None else length
    lines = ["WARC/1.0", f"warc-type: {kind}", f"WARC-Record-ID: {record_id}", *fields, f"Content-Length:{length}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [False, True])
def test_archives_of_other_writers(spark, tmp_path, packed):
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    parts = [
        record("warcinfo", "<w>", b"software: z\r\n"),
        # The response names its request; the metadata names the request only.
        record("response", "<a>", http + b"\xff\x00bytes\r\n\r\nmore", "WARC-Concurrent-To: <a-req>", "Content-Type: application/http"),
        record("request", "<a-req>", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        record("metadata", "<a-meta>", b"page_id: 1\r\n", "WARC-Concurrent-To: <a-req>"),
        # Two metadata records, each named by nobody but naming the response; no request.
        record("response", "<b>", b"no gap", "Content-Type: application/http"),
        record("metadata", "<b-2>", b"page_id: 3\r\n", "WARC-Concurrent-To: <none>", "WARC-Concurrent-To: <b>"),
        record("metadata", "<b-1>", b"page_id: 2\r\n", "WARC-Concurrent-To: <b>"),
        record("resource", "<c>", b"as it is", "Content-Type: text/plain"),
        record("revisit", "<d>", http, "WARC-Refers-To: <missing>", "Content-Type: application/http"),
        record("request", "<alone>", b"GET /alone", "WARC-Concurrent-To: <nowhere>"),
    ]
    twice = record("response", "<b>", b"no gap", "Content-Type: application/http")
    cut_off = record("resource", "<e>", b"cut", length=500)
    folder = tmp_path / "in"
    folder.mkdir()
    for name, data in (("one.warc", b"".join(parts)), ("two.warc", twice + cut_off)):
        # Every record of a packed archive is a gzip member of its own.
        members = [gzip.compress(p) for p in (parts if name.startswith("one") else [twice, cut_off])]
        (folder / (name + ".gz" if packed else name)).write_bytes(b"".join(members) if packed else data)
    found = cut(warc.with_payload(warc.records(spark, str(folder))))
    assert found.where("NOT whole").select("record_id").collect() == [("<e>",)]
    assert found.where("type = 'warcinfo'").count() == 1
    rows = {r.capture_id: r for r in warc.captures(found).collect()}
    assert sorted(rows) == ["<a>", "<b>", "<c>", "<d>", "<e>"]
    a, b, d = rows["<a>"], rows["<b>"], rows["<d>"]
    assert bytes(a.response.payload) == b"\xff\x00bytes\r\n\r\nmore"
    assert (a.request.record_id, a.metadata.record_id, a.n_requests, a.n_metadata) == ("<a-req>", "<a-meta>", 1, 1)
    assert (b.request, b.metadata.record_id, b.n_metadata, b.response.payload_bytes) == (None, "<b-1>", 2, 0)
    assert bytes(rows["<c>"].response.payload) == b"as it is"
    assert (d.request, d.metadata, d.refers_to) == (None, None, "<missing>")
    assert {(r.record_id, r.capture_id) for r in warc.links(found).collect()} == {
        ("<a-req>", "<a>"), ("<a-meta>", "<a>"), ("<b-1>", "<b>"), ("<b-2>", "<b>")
    }
    sizes = warc.resolved(warc.captures(found), {"bytes": F.col("response.payload_bytes")})
    assert {r.capture_id: r.bytes for r in sizes.collect()} == {"<a>": 15, "<b>": 0, "<c>": 8, "<d>": None, "<e>": 7}

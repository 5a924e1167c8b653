"""JSON documents of any size: put together from sorted pieces, and read back an element at a time.

A document is one JSON object that holds lists. Its pieces are sorted by Spark, which spills, and streamed
into blocks of a file, so that neither building nor reading takes more memory for a larger document.
"""

from __future__ import annotations

import codecs
import json
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from vulnloom.operators.skew import checkpoint_path

KEY = ["repo_id", "part"]
# The section of a document's fixed texts; the elements of its lists are in sections from 1.
FRAME = 0
# Bytes that are compressed together, and after how many a file is closed and another one begun.
BLOCK_BYTES = 1 << 20
FILE_BYTES = 64 << 20
# Rows and characters of elements that are passed on at a time.
BATCH_ROWS, BATCH_CHARS = 10_000, 8 << 20
PLACE = "struct<path:string,start:bigint,size:bigint>"
# How a block begins: its compressed and its real length.
LENGTHS = "<QQ"
_SPACE = re.compile(r"[ \t\r\n]*")
# What stands behind a value.
_BEHIND = re.compile(r"[ \t\r\n,:\]}]")


class _File:
    """Blocks of compressed bytes, each behind its lengths."""

    def __init__(self, folder: str) -> None:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = uuid.uuid4().hex
        self.path, self.end, self.size = f"{folder}/{name}", 0, 0
        self._stream = store.open_output_stream(f"{base}/{name}", compression=None)
        self._held, self._codec = bytearray(), pa.Codec("zstd")

    def write(self, text: str) -> None:
        data = text.encode("utf-8")
        self._held += data
        self.size += len(data)
        if len(self._held) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self._held:
            packed = self._codec.compress(bytes(self._held), asbytes=True)
            self._stream.write(struct.pack(LENGTHS, len(packed), len(self._held)) + packed)
            self.end += struct.calcsize(LENGTHS) + len(packed)
            self._held.clear()

    def close(self) -> None:
        self._stream.close()


class _Documents:
    """Documents put together as their pieces come, one after another in a file."""

    def __init__(self, folder: str) -> None:
        self.folder, self.file, self.key, self.frame = folder, None, None, None
        self.written: list[tuple] = []

    def add(self, key: tuple, section: int, text: str) -> None:
        if key != self.key:
            self.finish()
            # Elements without a frame belong to no document.
            self.key, self.frame, self.at = key, json.loads(text) if section == FRAME else None, 0
            if self.frame:
                self.file = self.file or _File(self.folder)
                self.start, self.before = self.file.end, self.file.size
        elif self.frame and section != FRAME:
            comma = "," if self.at >= section else ""
            self._frame_to(section)
            self.file.write(comma + text)

    def _frame_to(self, count: int) -> None:
        while self.at < count:
            self.file.write(self.frame[self.at])
            self.at += 1

    def finish(self) -> None:
        if self.frame:
            self._frame_to(len(self.frame))
            self.file.flush()
            place = {"path": self.file.path, "start": self.start, "size": self.file.size - self.before}
            self.written.append((*self.key, place))
            self.frame = None

    def closed(self, last: bool = False) -> list[tuple]:
        """The documents of the file, once it is closed: none may be read before."""
        done = self.file is not None and not self.frame and (last or self.file.end >= FILE_BYTES)
        if not done:
            return []
        self.file.close()
        rows, self.written, self.file = self.written, [], None
        return rows


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.record_batch([pa.array(list(c), t.type) for c, t in zip(columns, schema)], schema=schema)


def streamed(pieces: DataFrame) -> DataFrame:
    """`repo_id, part, place`: documents put together from `pieces` (repo_id, part, section, index, text).

    A document's piece of section `FRAME` is a JSON list of the texts before, between and behind its
    lists, and the pieces of section n, by index and text, are the elements of its n-th list. The documents
    lie beside the tables of `cut`. A task that runs again writes files of its own.
    """
    folder = checkpoint_path(pieces.sparkSession)
    schema = pa.schema(
        [("repo_id", pa.string()), ("part", pa.int32()), ("place", pa.struct([("path", pa.string()), ("start", pa.int64()), ("size", pa.int64())]))]
    )

    def put_together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = _Documents(folder)
        for batch in batches:
            for repo, part, section, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (repo, part) != documents.key:
                    documents.finish()
                    if rows := documents.closed():
                        yield _batch(rows, schema)
                documents.add((repo, part), section, text)
        documents.finish()
        yield _batch(documents.closed(last=True), schema)

    ordered = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "section", "index", "text").select(*KEY, "section", "text")
    return ordered.mapInArrow(put_together, f"repo_id string, part int, place {PLACE}")


def _blocks(path: str, start: int, size: int) -> Iterator[bytes]:
    store, base = fs.FileSystem.from_uri(path)
    codec = pa.Codec("zstd")
    with store.open_input_file(base) as file:
        file.seek(start)
        while size > 0:
            packed, raw = struct.unpack(LENGTHS, file.read(struct.calcsize(LENGTHS)))
            yield codec.decompress(file.read(packed), raw, asbytes=True)
            size -= raw


def text_of(place: Column) -> Column:
    """The whole text of a document, for those that fit in a row."""

    def read(at):
        return None if at is None else b"".join(_blocks(at["path"], at["start"], at["size"])).decode("utf-8")

    return F.udf(read, "string")(place)


class _Reader:
    """The members of a JSON object from a stream of its text."""

    def __init__(self, blocks: Iterable[bytes]) -> None:
        self._blocks, self._decoder = iter(blocks), codecs.getincrementaldecoder("utf-8")()
        self._json = json.JSONDecoder(strict=False)
        self.text, self.at, self.ended = "", 0, False

    def _more(self) -> None:
        block = next(self._blocks, None)
        self.ended = block is None
        self.text, self.at = self.text[self.at :] + self._decoder.decode(block or b"", self.ended), 0

    def sign(self) -> str:
        """The next character that is no space, not yet passed."""
        while True:
            self.at = _SPACE.match(self.text, self.at).end()
            if self.at < len(self.text) or self.ended:
                return self.text[self.at : self.at + 1]
            self._more()

    def expect(self, signs: str) -> str:
        found = self.sign()
        if not found or found not in signs:
            raise ValueError(f"one of {signs} expected in a JSON document, found {found!r}")
        self.at += 1
        return found

    def value(self) -> str:
        """The text of the next value. A number that nothing ends yet may go on in the next block."""
        self.sign()
        while True:
            try:
                end = self._json.raw_decode(self.text, self.at)[1]
                if _BEHIND.match(self.text, end) or self.ended:
                    found, self.at = self.text[self.at : end], end
                    return found
            except ValueError:
                if self.ended:
                    raise
            # A value of many blocks is tried again only when the text has doubled.
            for _ in range(max(1, (len(self.text) - self.at) // BLOCK_BYTES)):
                self._more()

    def elements(self) -> Iterator[tuple[str | None, int, str]]:
        """(member, position, text) of the elements of each list, then (None, 0, the object without its lists)."""
        others = []
        self.expect("{")
        while self.sign() != "}":
            key = self.value()
            self.expect(":")
            if self.sign() == "[":
                self.at += 1
                name, position = json.loads(key, strict=False), 0
                while self.sign() != "]":
                    yield name, position, self.value()
                    position += 1
                    if self.sign() != "]":
                        self.expect(",")
                self.expect("]")
            else:
                others.append(f"{key}:{self.value()}")
            if self.sign() != "}":
                self.expect(",")
        yield None, 0, "{" + ",".join(others) + "}"


def elements(documents: DataFrame) -> DataFrame:
    """`repo_id, part, member, pos, json`: the elements of the lists at the top of each document.

    The rest of a document, the object without its lists, is the row whose `member` is null. Documents
    are read as streams from their `place`, so that none is held as a whole.
    """
    schema = pa.schema([("repo_id", pa.string()), ("part", pa.int32()), ("member", pa.string()), ("pos", pa.int64()), ("json", pa.string())])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for repo, part, at in zip(*(c.to_pylist() for c in batch.columns)):
                rows, chars = [], 0
                for member, position, text in _Reader(_blocks(at["path"], at["start"], at["size"])).elements():
                    rows.append((repo, part, member, position, text))
                    chars += len(text)
                    if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                        yield _batch(rows, schema)
                        rows, chars = [], 0
                yield _batch(rows, schema)

    return documents.select(*KEY, "place").mapInArrow(read, "repo_id string, part int, member string, pos bigint, json string")

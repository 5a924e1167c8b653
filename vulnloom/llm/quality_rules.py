"""Quality rules: counts of words, symbols and repeats, and compression bands.

A text is compressed with zstandard, whole and in fixed chunks. Repetitive text compresses far better
than prose of its length and random text hardly at all, so the ratio must lie in a band that
depends on the length. A chunk outside its band makes the text fail only if a large part of all
chunks is.

A null text is an empty one; it has no words and fails. Rows are handled one by one, so repeated
rows get the same verdict, and nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from vulnloom.llm.common import text_chunks

# (bytes from, least ratio, highest ratio): longer text holds more to refer back to.
BANDS = [
    (0, 0.0, 1e9), (64, 0.70, 1.6), (128, 0.90, 1.9), (256, 1.05, 2.1), (512, 1.20, 2.3), (1024, 1.35, 2.5),
    (2048, 1.40, 2.7), (4096, 1.45, 2.9), (8192, 1.45, 3.1), (16384, 1.45, 3.4), (65536, 1.45, 4.0),
]
CHUNK = 4096
# A last chunk shorter than this says too little.
LEAST_CHUNK = 1024
# The text fails if more than this share of its chunks is outside the band.
BAD_CHUNKS = 0.25
LEVEL = 3

WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"

_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "n_chunks", "n_bad_chunks"]


def _repeat_words(ids: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """For each text, its words inside windows of `WINDOW` words that occur twice or more in it."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return np.zeros(texts, np.int64)
    starts = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    if len(starts) < 2:
        return np.zeros(texts, np.int64)
    # Numbering pairs of numbers three times tells windows of eight apart without any collision.
    names = ids.astype(np.int64)
    for step in (1, 2, 4):
        pair = names[:-step] * (int(names.max()) + 1) + names[step:]
        names = np.unique(pair, return_inverse=True)[1].ravel()
    key = owner[starts] * (int(names.max()) + 1) + names[starts]
    _, number, times = np.unique(key, return_inverse=True, return_counts=True)
    twice = starts[times[number.ravel()] > 1]
    covered = np.zeros(len(ids) + 1, np.int32)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + WINDOW, -1)
    return np.bincount(owner[np.cumsum(covered[:-1]) > 0], minlength=texts)


def _outside(size: int, packed: int) -> bool:
    _, low, high = BANDS[bisect_right(BANDS, (size, float("inf"), float("inf"))) - 1]
    return not low <= size / packed <= high


def _compression(compress, text: bytes) -> tuple[float, int, int, bool]:
    """Ratio of the whole text, chunks, chunks outside their band, and whether the text passes."""
    if not text:
        return 0.0, 0, 0, False
    packed = len(compress(text))
    chunks = bad = 0
    if len(text) > CHUNK:
        for a in range(0, len(text), CHUNK):
            part = text[a : a + CHUNK]
            if len(part) >= LEAST_CHUNK:
                chunks += 1
                bad += _outside(len(part), len(compress(part)))
    fine = not _outside(len(text), packed) and bad <= BAD_CHUNKS * chunks
    return len(text) / packed, chunks, bad, fine


def _measured(texts: list[bytes], compress) -> list[list]:
    words, owner, lines = [], [], []
    for i, text in enumerate(texts):
        own = text.split()
        words.append(own)
        owner.append(np.full(len(own), i, np.int64))
        with_words = [x for x in text.split(b"\n") if x and not x.isspace()]
        lines.append(len(with_words) - len(set(with_words)))
    numbers: dict[bytes, int] = {}
    number = numbers.setdefault
    ids = np.array([number(w, len(numbers)) for own in words for w in own], np.int64)
    repeats = _repeat_words(ids, np.concatenate(owner), len(texts))
    out: list[list] = [[] for _ in range(len(_COLUMNS) + 1)]
    for i, (text, own) in enumerate(zip(texts, words)):
        joined = b"".join(own)
        characters = len(joined) if joined.isascii() else len(joined.decode("utf-8"))
        symbols = len(text) - len(text.translate(None, SYMBOLS))
        row = [len(own), characters, symbols, lines[i], int(repeats[i]), *_compression(compress, text)]
        for column, value in zip(out, row):
            column.append(value)
    return out


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, counts, ratio, chunks, base_failed, kept) of every text."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress
        for batch in batches:
            for first, texts in text_chunks(batch, "text"):
                columns = [pa.array(x) for x in _measured(texts, compress)]
                yield pa.record_batch([batch.column("id").slice(first, len(texts)), *columns], ["id", *_COLUMNS, "fine"])

    types = ", ".join(f"{c} {'double' if c == 'ratio' else 'bigint'}" for c in _COLUMNS)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = source.mapInArrow(run, f"id {id_type}, {types}, fine boolean")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return found.select(
        F.col("id").alias(id_col), *_COLUMNS, failed.alias("base_failed"), (~failed & F.col("fine")).alias("kept")
    )

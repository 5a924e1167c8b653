"""Fill-in-the-middle: a text is cut into prefix, middle and suffix, and the middle is moved to the end.

The bytes of many texts get one of eight classes each and go into a wavelet matrix. The units of a
text (lines, sentences, words or code points) end or begin at bytes of certain classes, so the ranks
of these classes add up to the number of units before any place; bisection on the ranks finds the
place of either cut, and the rank of continuation bytes turns places into code points. Neither lines
nor words are ever split off.

Cuts and form follow from a hash of `<seed>:<id>` alone, so a rerun or a lost executor changes nothing.

Cases: a null text is empty; an empty text, a text that contains a marker and a row with a null id
(there is nothing to draw the cuts from) keep the form `plain`, with null lengths and the text as
output. Rows are treated one by one: repeated rows and ids give repeated rows; other columns of the
input are not looked at; an empty table gives an empty result. A text of any length is cut whole: a
task holds its bytes, one byte of classes for each, and an eighth of a byte for each of three levels.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vulnloom.llm.common import text_chunks
from vulnloom.llm.wavelet import WaveletMatrix

# Markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

OTHER, NEWLINE, BLANK, STOP, OPENING, CONTINUATION = range(6)
_LEVELS = 3
# Classes whose ranks add up to the units, and whether these classes end a unit or begin one.
UNITS = {
    "line": ((NEWLINE,), "end"),
    "sentence": ((NEWLINE, STOP), "end"),
    "word": ((OPENING,), "begin"),
    "char": ((OTHER, NEWLINE, BLANK, STOP, OPENING), "begin"),
}


def _class_table() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[0x80:0xC0] = CONTINUATION
    table[[0x20, *range(0x09, 0x0E)]] = BLANK
    table[0x0A] = NEWLINE
    table[np.frombuffer(b".!?", np.uint8)] = STOP
    return table


_CLASSES = _class_table()


def classes(data: np.ndarray, starts: np.ndarray, unit: str) -> np.ndarray:
    """The class of each byte; for words, the first byte after a blank or at the start of a text opens one."""
    out = _CLASSES[data]
    if unit == "word":
        out[out == STOP] = OTHER
        blank = (out == BLANK) | (out == NEWLINE)
        after = np.ones(len(out), bool)
        after[1:] = blank[:-1]
        after[starts[starts < len(out)]] = True
        out[after & ~blank] = OPENING
    return out


class Cuts:
    """Units and cuts of texts that lie one after the other."""

    def __init__(self, texts: list[bytes], unit: str) -> None:
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum(np.array([len(t) for t in texts], np.int64))
        self.first = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if texts else ends
        self.last = ends
        self.symbols, self.side = UNITS[unit]
        coded = classes(data, self.first, unit)
        self.matrix = WaveletMatrix(coded, _LEVELS)
        self.base = self.matrix.count(self.symbols, self.first)
        marks = self.matrix.count(self.symbols, self.last) - self.base
        some = self.last > self.first
        # What stands before the first opening, or after the last end, is part of a unit too.
        if self.side == "end":
            closed = np.zeros(len(texts), bool)
            closed[some] = np.isin(coded[self.last[some] - 1], self.symbols)
            self.n = marks + (some & ~closed)
        else:
            self.n = np.where(some, np.maximum(marks, 1), 0)

    def after(self, units: np.ndarray) -> np.ndarray:
        """The place where that many units of each text have passed."""
        if self.side == "end":
            return self.matrix.locate(self.symbols, self.base + units, self.first, self.last)
        # The unit after these begins one byte before the place that counts its opening.
        place = self.matrix.locate(self.symbols, self.base + units + 1, self.first, self.last) - 1
        return np.where(units == 0, self.first, np.where(units >= self.n, self.last, place))

    def chars(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        unseen = self.matrix.rank(CONTINUATION, last) - self.matrix.rank(CONTINUATION, first)
        return last - first - unseen


def _draws(ids: list, seed: int) -> np.ndarray:
    """Four unsigned numbers for each id."""
    heads = b"".join(sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(heads, ">u4").reshape(-1, 4).astype(np.int64)


def transform(
    df: DataFrame,
    unit: str = "line",
    rate: int = 100,
    spm_rate: int = 50,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output): n counts units, lengths count code points.

    `rate` of a hundred texts are rearranged; of these `spm_rate` in a hundred put the suffix first.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    id_type = df.schema[id_col].dataType.simpleString()
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def rearranged(texts: list[bytes], ids: list) -> list[pa.Array]:
        cuts, draws = Cuts(texts, unit), _draws(ids, seed)
        plain = [not t or i is None or any(m in t for m in marks) for t, i in zip(texts, ids)]
        plain = np.array(plain, bool) | (draws[:, 2] % 100 >= rate)
        spm = draws[:, 3] % 100 < spm_rate
        drawn = np.sort(draws[:, :2] % (cuts.n + 1)[:, None], axis=1)
        left, right = cuts.after(drawn[:, 0]), cuts.after(drawn[:, 1])
        outputs = []
        for text, as_is, suffix_first, a, b in zip(texts, plain, spm, left - cuts.first, right - cuts.first):
            head, rest = marks[0] + text[:a], marks[1] + text[b:]
            order = (rest, head) if suffix_first else (head, rest)
            outputs.append(text if as_is else b"".join([*order, marks[2], text[a:b]]))
        form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
        return [
            pa.array(cuts.n, pa.int64()),
            pa.array(form.tolist(), pa.string()),
            pa.array(cuts.chars(cuts.first, left), pa.int64(), mask=plain),
            pa.array(cuts.chars(left, right), pa.int64(), mask=plain),
            pa.array(outputs, pa.binary()).view(pa.string()),
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_chunks(batch, "text"):
                ids = batch.column("id").slice(first, len(texts))
                yield pa.record_batch([ids, *rearranged(texts, ids.to_pylist())], names)

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {id_type}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return source.mapInArrow(run, schema).select(F.col("id").alias(id_col), *names[1:])


def restored(output: Column, form: Column) -> Column:
    """The text that `output` was made from; the markers in it are those that `transform` has put there."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    part = lambda text, mark: F.substring_index(text, mark, 1)
    rest = lambda text, mark: F.substr(text, F.length(part(text, mark)) + F.lit(len(mark) + 1))
    psm = F.concat(part(body, SUFFIX), rest(rest(body, SUFFIX), MIDDLE), part(rest(body, SUFFIX), MIDDLE))
    spm = F.concat(part(rest(body, PREFIX), MIDDLE), rest(rest(body, PREFIX), MIDDLE), part(body, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)."""
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    return transform(df, id_col=id_col, text_col=text_col).select(
        id_col,
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        hashed(F.col("output")).alias("output_sha256"),
        hashed(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )

"""Cuts against texts split into lists of units, ranks against counts, and exact round trips."""

import random
import re
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from vulnloom.llm import fill_in_middle as fim
from vulnloom.llm.wavelet import WaveletMatrix

SPLIT = {
    "line": r"[^\n]*\n|[^\n]+",
    "sentence": r"[^\n.!?]*[\n.!?]|[^\n.!?]+",
    "word": r"(?:^[ \t-\r]+)?[^ \t-\r]+[ \t-\r]*|^[ \t-\r]+$",
    "char": r"(?s).",
}
TEXTS = [
    None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "é\nü\r\n漢字。\n😀", " \t", "  one two\n three", "x. y! z?\nw",
    "has <P> in it\nand more", "<S>", "near <P > <\nS>\n<M", "<\n<\n<P\n", "line\n" * 5000, "ж" * 70_000, "a b\n" * 40_000,
]


def expected(doc_id, text, unit="line", rate=100, spm_rate=50, seed=7):
    text = text or ""
    units = re.findall(SPLIT[unit], text)
    assert "".join(units) == text
    if doc_id is None or not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    h = sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    draw = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if draw[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in draw[:2])
    head, middle, tail = ("".join(p) for p in (units[:a], units[a:b], units[b:]))
    if draw[3] % 100 < spm_rate:
        return len(units), "spm", len(head), len(middle), f"<S>{tail}<P>{head}<M>{middle}"
    return len(units), "psm", len(head), len(middle), f"<P>{head}<S>{tail}<M>{middle}"


def table(spark, rows):
    """Columns named as those that the operator makes must not disturb it."""
    schema = "doc_id bigint, text string, n string, form string, output string, id string"
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], schema)


@pytest.mark.parametrize("unit", SPLIT)
def test_units_and_cuts(spark, unit):
    draw = random.Random(5)
    some = ["".join(draw.choice("ab \n.é漢<") for _ in range(draw.randrange(60))) for _ in range(300)]
    rows = list(enumerate(TEXTS + some)) + [(None, "a\nb"), (4, "a"), (4, "a")]
    found = fim.transform(table(spark, rows).repartition(3), unit, rate=90).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(repr((i, *expected(i, t, unit, 90))) for i, t in rows)


def test_round_trip_and_digests(spark):
    rows = list(enumerate(TEXTS))
    again = fim.transform(table(spark, rows)).select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("t"))
    assert {r.doc_id: r.t for r in again.collect()} == {i: t or "" for i, t in rows}
    for r in fim.digests(table(spark, rows)).collect():
        n, form, a, b, output = expected(r.doc_id, TEXTS[r.doc_id])
        text = TEXTS[r.doc_id] or ""
        sums = [sha256(t.encode()).hexdigest() for t in (output, text)]
        assert tuple(r) == (r.doc_id, n, form, a, b, *sums)


def test_empty_table_and_unknown_unit(spark):
    assert fim.digests(table(spark, [])).collect() == []
    with pytest.raises(ValueError, match="unit"):
        fim.transform(table(spark, []), "page")


def test_ranks_and_bisection():
    draw = np.random.default_rng(3)
    for length in (0, 1, 63, 64, 511, 512, 513, 3000):
        classes = draw.integers(0, 8, length).astype(np.uint8)
        matrix, places = WaveletMatrix(classes, 3), np.arange(length + 1)
        for symbol in range(8):
            counts = np.concatenate([[0], np.cumsum(classes == symbol)])
            assert (matrix.rank(symbol, places) == counts).all()
            first, last = np.zeros_like(counts), np.full_like(counts, length)
            assert (matrix.locate((symbol,), counts, first, last) == np.searchsorted(counts, counts)).all()

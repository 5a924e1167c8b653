"""Counts against a slow count, verdicts on texts of known kind."""

import random
import re

from vulnloom.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text: str) -> tuple:
    words = WORD.findall(text)
    places: dict[tuple, list[int]] = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, again, len(covered), failed


def test_counts_and_verdicts(spark):
    draw = random.Random(2)
    prose = " ".join("".join(draw.choice("etaoinshrdlu") for _ in range(draw.randrange(2, 9))) for _ in range(900))
    noise = "".join(draw.choice("".join(map(chr, range(0x4E00, 0x9000)))) + " " for _ in range(2000))
    few = [" ".join(draw.choice("abc") for _ in range(draw.randrange(60))) for _ in range(200)]
    texts = [None, "", " \n\t", "a\nb\n a\nb\na", prose, "In. " * 500, "x" * 300_000, noise, "é|< >\x1c# a b " * 3]
    texts += few + [prose + "\n" + "spam and eggs are here again now so " * 2000, "a b c d e f g h a b c d e f g h"]
    rows = [(i, t, False) for i, t in enumerate(texts)] + [(None, prose, True)] * 2
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, kept boolean")
    found = quality_rules.measures(documents).collect()
    assert len(found) == len(rows)
    for r in found:
        text = prose if r.doc_id is None else texts[r.doc_id] or ""
        counts = r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed
        assert counts == expected(text), text[:50]
        assert not (r.base_failed and r.kept)
    by_id = {r.doc_id: r for r in found}
    assert by_id[4].kept and by_id[None].kept and not by_id[5].kept and not by_id[9 + len(few)].kept
    assert quality_rules.measures(spark.createDataFrame([], documents.schema)).collect() == []


def test_bands():
    compress = __import__("zstandard").ZstdCompressor(level=3).compress
    draw = random.Random(1)
    line = "the same line of words is repeated here without any change\n"
    assert not quality_rules._compression(compress, line.encode() * 100)[3]
    assert not quality_rules._compression(compress, bytes(draw.randrange(256) for _ in range(5000)))[3]
    prose = " ".join("".join(draw.choice("etaoinshrdlu") for _ in range(draw.randrange(2, 9))) for _ in range(5000))
    assert quality_rules._compression(compress, prose.encode())[3]
    half = prose[:20_000] + line * 400
    ratio, chunks, bad, fine = quality_rules._compression(compress, half.encode())
    assert chunks > 8 and bad >= 3 and not fine

"""Encoding, decoding and counting against the public libraries and round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from vulnloom.llm import byte_bpe, pretokens, token_counts

RANKS, TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = list("aéZ 1٣ '\n\t  sstmdrevell'!.中́😀　 \x85𓀀")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts() -> list:
    draw = random.Random(7)
    short = ["".join(draw.choice(ALPHABET) for _ in range(draw.randrange(14))) for _ in range(3000)]
    fixed = [None, "", " ", "  ", "'s", " 's", "''s", "a'll'", "a'l", "a'", "\n's't", "don't'save", "x\n\n  y  "]
    long = ["a" * 5000, "".join(draw.choice("abcdetionhe") for _ in range(4000)), "word " * 3000, " " * 3000]
    special = ["<|endoftext|>", "a<|endoftext|> b  <|endoftext|><|endoftext|>c"]
    return fixed + short + long + special


def test_slices_are_those_of_the_pattern():
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    rows = [t or "" for t in texts()]
    found, ends = pretokens.pieces([t.encode("utf-8") for t in rows])
    at = 0
    for text, end in zip(rows, ends):
        assert [p.decode("utf-8") for p in found[at:end]] == pattern.findall(text)
        at = end
    assert pretokens.pieces([])[0] == [] and pretokens.pieces([b"", b""])[0] == []


def test_scan_equals_one_step_at_a_time():
    scanner = pretokens.scanner()
    functions = np.random.default_rng(3).integers(0, scanner.width, 10_000).astype(np.uint8)
    acc, expected = 0, []
    for f in functions:
        acc = int(scanner.then[acc, f])
        expected.append(acc)
    assert scanner._scan(functions).tolist() == expected


def test_encode_and_decode(spark, library):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts())] + [(None, "twice", "", 0)] * 2
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n_tokens int")
    encoded = byte_bpe.encode(documents, RANKS)
    by_id = {r.doc_id: r for r in encoded.collect()}
    decoded = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(encoded, RANKS).collect()}
    digests = byte_bpe.digests(documents, RANKS).collect()
    assert len(digests) == len(rows)
    digests = {r.doc_id: r for r in digests}
    for i, text, *_ in rows:
        raw = (text or "").encode("utf-8")
        ids = library.encode_ordinary(text or "")
        assert np.frombuffer(by_id[i].ids, "<u4").tolist() == ids
        lengths = [len(library.decode_single_token_bytes(x)) for x in ids]
        assert np.frombuffer(by_id[i].ends, "<u4").tolist() == np.cumsum(lengths).astype(int).tolist()
        assert decoded[i] == raw
        packed = np.array(ids, "<u4").tobytes()
        assert digests[i].n_tokens == len(ids)
        assert digests[i].ids_sha256 == hashlib.sha256(packed).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(raw).hexdigest()


def test_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 10 * byte_bpe.ENTRY_BYTES)
    cache = byte_bpe.Cache(len)
    assert [cache[b"x" * (i % 25)] for i in range(200)] == [i % 25 for i in range(200)]
    assert len(cache) <= 10 and len(cache.older) <= 10


def test_counts(spark):
    rows = [(i, t, 5) for i, t in enumerate(texts())]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, n_bytes int")
    found = {r.doc_id: r for r in token_counts.token_counts(documents, TOKENIZER).collect()}
    library = Tokenizer.from_file(TOKENIZER)
    expected = library.encode_batch([t or "" for _, t, _ in rows], add_special_tokens=False)
    for (i, text, _), e in zip(rows, expected):
        assert found[i].n_tokens == len(e.ids), text
        assert found[i].n_bytes == len((text or "").encode("utf-8"))
        assert found[i].over_limit == (len(e.ids) > 512)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert byte_bpe.digests(empty, RANKS).collect() == []
    assert token_counts.token_counts(empty, TOKENIZER).collect() == []

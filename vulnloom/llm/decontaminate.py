"""Benchmark decontamination by spaced-seed hashing.

A fixed mask slides over the words of a text and hashes the words at its ones; the words at its zeros
may differ. Hashes of documents and benchmark items are joined, and around every hit the item is laid
over the document at the same distance and compared word by word, so a passage is found although
words in it were replaced. Every stretch similar enough to be reported holds one of the masks for items
of its length, so hashing loses none.

Documents are read in place: a bitmap of the benchmark's hashes, of bounded size, tells which positions
can hit at all, and only documents with such positions go on, as word hashes instead of texts. Equal
texts are searched once, and so are equal items; they are reported as the one with the smallest id, or
as all of them with `every_id`.

Words are compared in lower case without ASCII punctuation. Items with fewer than `LEAST_ITEM` words
say too little and are not searched. Null texts and empty texts match nothing. Items with a null id are
searched with `null_ids`, and `clean` then also decides on documents with a null id, each by its text.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from vulnloom.llm import bitmap, text_features
from vulnloom.llm.common import cut, packed, text_chunks

# Any stretch with at least four equal words that earns more than it loses holds one of these; an item of
# `LEAST_ITEM` words needs four.
MASKS = ["1111", "11011"]
# Items of so many words need nine equal ones at least, and stretches with nine hold one of the heavier
# masks, which fewer other texts hit.
LONG_ITEM = 12
LONG_MASKS = ["1011111", "1110111", "101100111", "110010111", "110100111"]
LEAST_ITEM = 5
# Bits of the bitmap for each hash of an item: every place of every document is looked up in it.
SEED_BITS = 512
# What the best stretch of an item must hold: so many equal words, or this share of a short item.
MATCHED_WORDS = 12
MATCHED_SHARE = 0.7
# A stretch loses this much for a word that differs, so about two thirds of its words are equal.
PENALTY = 2

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)
_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
_DROPPED = string.punctuation.encode()


def all_word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the words of all texts in a row, and the number of words up to the end of each."""
    hashes, ends = text_features.word_hashes([t.translate(_LOWER, _DROPPED) for t in texts])
    return (((hashes ^ (hashes >> np.uint64(31))) * _ODD) >> np.uint64(32)).astype(np.uint32), ends


def word_hashes(text: bytes) -> np.ndarray:
    return all_word_hashes([text])[0]


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the words under the mask at each place where it fits."""
    n = len(words) - len(mask) + 1
    out = np.full(max(n, 0), int(mask, 2) * 64 + len(mask), np.uint64)
    wide = words.astype(np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            out = (out ^ (wide[i : i + len(out)] * _ODD)) * _STEP
            out ^= out >> np.uint64(29)
    out = (out ^ (out >> np.uint64(32))) * _ODD
    return out ^ (out >> np.uint64(29))


def best_stretch(words: np.ndarray, item: np.ndarray, offset: int) -> tuple[int, int, int]:
    """(equal words, first word in the document, length) of the best stretch with the item laid at `offset`."""
    a, b = max(0, -offset), min(len(item), len(words) - offset)
    if b <= a:
        return 0, 0, 0
    same = words[offset + a : offset + b] == item[a:b]
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -PENALTY))])
    lowest = np.minimum.accumulate(total)
    end = int(np.argmax(total - lowest))
    start = int(np.argmin(total[: end + 1]))
    return int(same[start:end].sum()), offset + a + start, end - start


def items(benchmark: DataFrame, id_col: str, text_col: str, null_ids: bool = False) -> DataFrame:
    """(item_id, item, words) of each item; `item` is the digest of its words."""
    rows = benchmark.where(F.lit(null_ids) | F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")
    )
    id_type = rows.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [word_hashes(x.as_py().encode("utf-8") if x.is_valid else b"") for x in batch.column("text")]
            long = [len(t) >= LEAST_ITEM for t in texts]
            words = [t.tobytes() for t in texts]
            digests = pa.array([xxhash.xxh128_digest(w) for w in words], pa.binary())
            columns = [batch.column("item_id"), digests, pa.array(words, pa.binary())]
            yield pa.record_batch(columns, ["item_id", "item", "words"]).filter(pa.array(long, pa.bool_()))

    return rows.mapInArrow(run, f"item_id {id_type}, item binary, words binary")


def _masks_for(n_words: int) -> list[str]:
    return MASKS if n_words < LONG_ITEM else LONG_MASKS


def _item_seeds(found: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, hashes, places = [], [], []
            for i, words in enumerate(batch.column("words")):
                words = np.frombuffer(words.as_py(), np.uint32)
                for mask in _masks_for(len(words)):
                    own = seeds(words, mask)
                    at += [i] * len(own)
                    hashes.append(own)
                    places += range(len(own))
            hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            owners = batch.column("item").take(pa.array(at, pa.int64()))
            yield pa.record_batch([owners, pa.array(hashes.view(np.int64)), pa.array(places, pa.int64())], ["item", "h", "place"])

    return found.mapInArrow(run, "item binary, h bigint, place bigint")


def _document_hits(rows: DataFrame, words: np.ndarray, masks: list[str]) -> DataFrame:
    """(id, digest, words, hashes, places) of the documents with at least one place that may hit."""
    shared = rows.sparkSession.sparkContext.broadcast(words)
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_chunks(batch, "text"):
                joined, ends = all_word_hashes(texts)
                owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
                found_h, found_at = [], []
                for mask in masks:
                    hashes = seeds(joined, mask)
                    own = owner[: len(hashes)] == owner[len(mask) - 1 :]
                    at = np.flatnonzero(own & bitmap.contains(shared.value, hashes))
                    found_h.append(hashes[at])
                    found_at.append(at)
                hashes, at = np.concatenate(found_h), np.concatenate(found_at)
                order = np.argsort(at, kind="stable")
                hashes, at = hashes[order], at[order]
                texts_hit = np.unique(owner[at])
                cuts = np.searchsorted(owner[at], [texts_hit, texts_hit + 1])
                starts = ends - np.diff(ends, prepend=0)
                kept = [joined[starts[i] : ends[i]].tobytes() for i in texts_hit]
                yield pa.record_batch(
                    [
                        batch.column("id").take(pa.array(first + texts_hit)),
                        pa.array([xxhash.xxh128_digest(k) for k in kept], pa.binary()),
                        pa.array(kept, pa.binary()),
                        pa.array([hashes[a:b].view(np.int64) for a, b in zip(*cuts)], pa.list_(pa.int64())),
                        pa.array([at[a:b] - starts[i] for i, a, b in zip(texts_hit, *cuts)], pa.list_(pa.int64())),
                    ],
                    ["id", "digest", "words", "hashes", "places"],
                )

    schema = f"id {id_type}, digest binary, words binary, hashes array<bigint>, places array<bigint>"
    return rows.mapInArrow(run, schema)


def _verified(laid: DataFrame) -> DataFrame:
    """(digest, item, n_matched, first_word, n_words, item_words) of the passages that are similar enough."""
    names = ["n_matched", "first_word", "n_words", "item_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, keep = [], []
            for words, item, offsets in zip(batch.column("words"), batch.column("own"), batch.column("offsets")):
                words, item = np.frombuffer(words.as_py(), np.uint32), np.frombuffer(item.as_py(), np.uint32)
                stretches = [best_stretch(words, item, d) for d in sorted(offsets.as_py())]
                best = max(stretches, key=lambda s: (s[0], -s[1]))
                found.append((*best, len(item)))
                keep.append(best[0] >= min(MATCHED_WORDS, -(-int(MATCHED_SHARE * 100) * len(item) // 100)))
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(4)]
            rows = pa.record_batch([batch.column("digest"), batch.column("item"), *columns], ["digest", "item", *names])
            yield rows.filter(pa.array(keep, pa.bool_()))

    return laid.mapInArrow(run, "digest binary, item binary, " + ", ".join(f"{n} bigint" for n in names))


def contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    every_id: bool = False,
    null_ids: bool = False,
) -> DataFrame:
    """(id_col, item_id, n_matched, first_word, n_words, item_words): passages of items in documents.

    One row for a document and an item: its best stretch of `n_words` words from `first_word` on, of
    which `n_matched` are equal. Of items with equal words the one with the smallest id has the row, or
    each has with `every_id`. Items with a null id are searched with `null_ids`.
    """
    named = cut(items(benchmark, item_id_col, item_text_col, null_ids))
    ids = named.select("item", "item_id").distinct()
    if not every_id:
        ids = ids.groupBy("item").agg(F.min("item_id").alias("item_id"))
    distinct = cut(named.groupBy("item").agg(F.first("words").alias("words")))
    long = distinct.select((F.octet_length("words") >= 4 * LONG_ITEM).alias("long")).distinct().collect()
    masks = sorted({m for r in long for m in (LONG_MASKS if r.long else MASKS)}) or MASKS
    item_seeds = cut(_item_seeds(distinct))
    words = bitmap.build(item_seeds.select("h"), "h", SEED_BITS)
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    hits = cut(_document_hits(rows, words, masks))

    texts = hits.groupBy("digest").agg(F.first("words").alias("words"), F.first(F.arrays_zip("hashes", "places")).alias("hits"))
    texts = cut(texts)
    places = texts.select("digest", F.explode("hits").alias("hit")).select(
        "digest", F.col("hit.hashes").alias("h"), F.col("hit.places").alias("at")
    )
    offsets = (
        places.join(item_seeds, "h")
        .groupBy("digest", "item")
        .agg(F.collect_set(F.col("at") - F.col("place")).alias("offsets"))
    )
    laid = offsets.join(texts.select("digest", "words"), "digest").join(
        distinct.select("item", F.col("words").alias("own")), "item"
    )
    found = _verified(laid.select("digest", "item", "words", "own", "offsets")).join(ids, "item")
    return (
        hits.select("id", "digest")
        .distinct()
        .join(found, "digest")
        .select(F.col("id").alias(id_col), "item_id", "n_matched", "first_word", "n_words", "item_words")
    )


def clean(
    documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", null_ids: bool = False
) -> DataFrame:
    """`documents` without those that hold a passage of the benchmark; columns may have any names.

    Documents with a null id stay, and items with a null id are not searched, unless `null_ids` is set.
    """
    text = F.col(text_col).cast("string")
    key = F.col(id_col).cast("string")
    if null_ids:
        own = F.when(F.col(id_col).isNotNull(), F.concat(F.lit("id "), key))
        key = own.otherwise(F.concat(F.lit("text "), F.sha2(text, 256)))
    rows = documents.select(packed(documents), key.alias("key"), text.alias("text"))
    found = contaminated(rows, benchmark, "key", "text", null_ids=null_ids)
    named = cut(found.select(F.col("key").alias("id")).where("id is not null").distinct())
    return bitmap.without_keys(rows.drop("text"), named, documents.columns)

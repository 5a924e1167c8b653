"""Language by error-correcting output codes over character n-grams.

Every language has a codeword. Each bit of the codewords divides the languages into two sides, and a
binary classifier over hashed letter bigrams and trigrams predicts the bit of a text: the mean log
ratio of its n-grams between both sides, where each language counts alike in its side. Decoding adds
up the logistic loss of all bits for each language, weighted by how well the bit's classifier tells
that language apart, and takes the least. Where the two best losses are close the prediction is
flagged as ambiguous.

Counts of n-grams by language come from all documents to learn from and are summed in each task
before they move. What reaches the driver has the size of the model: languages times buckets.

A null text, and one without a letter, is `und` with score 0. Documents without a language are
scored but not learned from; with nothing to learn from all are `und`. Rows are scored one by one,
so repeated rows get the same prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vulnloom.llm.common import held_out, text_chunks
from vulnloom.llm.text_features import char_ngrams, lowered

BITS = 16
SMOOTHING = 0.5
# Up to so many languages get all possible bits, more get random codewords of `RANDOM_BITS`.
EXHAUSTIVE = 5
RANDOM_BITS = 31
# A text's mean log ratio counts as the evidence of at most so many n-grams.
EVIDENCE = 40
AMBIGUOUS = 0.1
# Languages whose counts a task holds before it passes them on.
HELD_LANGUAGES = 32
CHUNK = 512 << 10


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, -1 or 1
    trust: np.ndarray  # languages x bits, rows sum to 1
    weights: np.ndarray  # buckets x bits


def counts(documents: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, bucket, n) over all documents to learn from."""
    rows = documents.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col))).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                at = np.flatnonzero(n)
                yield pa.record_batch(
                    [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())],
                    ["lang", "bucket", "n"],
                )
            held.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, texts in text_chunks(batch, "text", CHUNK):
                points, ends = lowered(texts)
                buckets, owner = char_ngrams(points, ends, BITS)
                names, number = np.unique(langs[first : first + len(texts)], return_inverse=True)
                n = np.bincount((number[owner] << BITS) | buckets, minlength=len(names) << BITS)
                for i, lang in enumerate(names.tolist()):
                    held[lang] = held.get(lang, 0) + n[i << BITS : (i + 1) << BITS]
                if len(held) > HELD_LANGUAGES:
                    yield from passed_on()
        yield from passed_on()

    found = rows.mapInArrow(run, "lang string, bucket bigint, n bigint")
    return found.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def codewords(n: int) -> np.ndarray:
    """A row of -1 and 1 for each language; no column is constant or repeats or opposes another."""
    if n <= EXHAUSTIVE:
        columns = [[1 if i == 0 or code >> (i - 1) & 1 else -1 for i in range(n)] for code in range(2 ** (n - 1) - 1)]
        return np.array(columns, np.int8).reshape(-1, n).T
    best, distance = None, -1
    for seed in range(200):
        drawn = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (n, RANDOM_BITS))
        drawn = drawn[:, np.abs(drawn.sum(axis=0)) < n]
        apart = (drawn[:, None, :] != drawn[None, :, :]).sum(axis=2) + np.eye(n, dtype=int) * RANDOM_BITS
        if apart.min() > distance:
            best, distance = drawn, apart.min()
    return best


def trained(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    rows = counts(documents, id_col, text_col, lang_col).toArrow()
    names, number = np.unique(np.array(rows.column("lang").to_pylist(), object).astype(str), return_inverse=True)
    n = np.zeros((len(names), 1 << BITS))
    n[number, rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    codes = codewords(len(names)) if len(names) > 1 else np.ones((len(names), 1), np.int8)
    shares = (n + SMOOTHING) / (n.sum(axis=1, keepdims=True) + SMOOTHING * (1 << BITS))
    if len(names) < 2:
        return Model(names.tolist(), codes, np.ones(codes.shape), np.zeros((1 << BITS, 1), np.float32))
    sides = [(codes == side).astype(float) for side in (1, -1)]
    means = [(s / s.sum(axis=0)).T @ shares for s in sides]  # bits x buckets
    weights = np.log(means[0]) - np.log(means[1])
    # The margin that a language's own texts can be expected to have.
    margins = np.maximum(shares @ weights.T * codes, 1e-3)
    return Model(names.tolist(), codes, margins / margins.sum(axis=1, keepdims=True), weights.T.astype(np.float32))


def predictions(
    documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, held_out, lang_pred, score, ambiguous) of every text."""
    weights = documents.sparkSession.sparkContext.broadcast(model.weights)
    id_type = documents.schema[id_col].dataType.simpleString()
    languages, codes, trust = model.languages, model.codes, model.trust

    def decoded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        points, ends = lowered(texts)
        buckets, owner = char_ngrams(points, ends, BITS)
        n = np.bincount(owner, minlength=len(texts))
        sums = np.stack(
            [np.bincount(owner, weights.value[:, b][buckets], len(texts)) for b in range(codes.shape[1])], axis=1
        )
        evidence = sums / np.maximum(n, 1)[:, None] * np.minimum(n, EVIDENCE)[:, None]
        losses = np.einsum("kb,tkb->tk", trust, np.logaddexp(0, -codes[None] * evidence[:, None, :]))
        order = np.argsort(losses, axis=1, kind="stable")
        chance = np.exp(losses.min(axis=1, keepdims=True) - losses)
        best = order[:, 0]
        score = chance.max(axis=1) / chance.sum(axis=1)
        near = np.zeros(len(texts), bool)
        if len(languages) > 1:
            rows = np.arange(len(texts))
            near = losses[rows, order[:, 1]] - losses[rows, best] < AMBIGUOUS
        some = n > 0
        return np.where(some, best, -1), np.where(some, score, 0.0), near | ~some

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*languages, "und"]
        for batch in batches:
            for first, texts in text_chunks(batch, "text", CHUNK):
                if languages:
                    best, score, near = decoded(texts)
                else:
                    best, score, near = np.full(len(texts), -1), np.zeros(len(texts)), np.ones(len(texts), bool)
                yield pa.record_batch(
                    [
                        batch.column("id").slice(first, len(texts)),
                        pa.array([names[i] for i in best], pa.string()),
                        pa.array(score, pa.float64()),
                        pa.array(near),
                    ],
                    ["id", "lang_pred", "score", "ambiguous"],
                )

    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = source.mapInArrow(run, f"id {id_type}, lang_pred string, score double, ambiguous boolean")
    return found.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "ambiguous"
    )

"""Toxicity by a classifier that is regularised with counterfactuals.

Features are hashed words and word beginnings, weighted by how often they occur in a text and by
their log ratio between the labels. The classifier is logistic. In each labelled text that names a group of
people, the names are swapped for those of the next group of the same list; the loss also holds the
squared change of the score between both versions, so naming a group moves no score by itself.

The classifier is fitted by the driver on a bounded sample of labelled rows: at most
`SAMPLE_PER_LABEL` of each label, chosen by a hash of the id; of a document with several texts the one with
the smallest hash counts. Scoring reads every text whole, in
one pass without a shuffle.

A null text is an empty one; a text without words gets the score of the bias alone. Labels that are
null, or other than 0 and 1, are not learned from; of a document with several labels the highest
counts. Without rows of both labels every score is the share of label 1 (0 if there are no rows).
Rows are scored one by one, so repeated rows get the same score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vulnloom.llm.common import held_out, packed, text_chunks, unpacked
from vulnloom.llm.text_features import lowered, word_features

SAMPLE_PER_LABEL = 4000
BITS = 18
PREFIX = 4
# A feature counts if at least so many sampled texts have it.
LEAST_TEXTS = 4
SCALE = 30.0
# Texts with fewer words count as if they had so many.
LEAST_WORDS = 8
RIDGE = 1e-4
COUNTERFACTUAL = 1.0
STEPS = 150

# Names of groups; within a list each is swapped for the next.
IDENTITY_TERMS = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["female", "male"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino"], ["african", "european", "american"],
    ["gay", "lesbian", "bisexual", "straight"], ["transgender", "cisgender"],
    ["immigrant", "refugee", "citizen"], ["immigrants", "refugees", "citizens"],
    ["deaf", "blind", "disabled"], ["old", "young"],
    ["frauen", "männer"], ["juden", "christen", "muslime"], ["femmes", "hommes"], ["juifs", "chrétiens", "musulmans"],
    ["mujeres", "hombres"], ["judíos", "cristianos", "musulmanes"],
]


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def _rows(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, shares) of each text: how large a part of its words has the feature."""
    points, ends = lowered(texts)
    buckets, starts = word_features(points, BITS, PREFIX)
    cuts = np.searchsorted(starts, ends)
    a = 0
    for b in cuts.tolist():
        own, n = np.unique(buckets[a:b].ravel(), return_counts=True)
        yield own, n / max(b - a, LEAST_WORDS)
        a = b


def swapped(text: str) -> str | None:
    """The text with every identity term swapped, or None if it has none."""
    following = {t: group[(i + 1) % len(group)] for group in IDENTITY_TERMS for i, t in enumerate(group)}
    changed = False

    def swap(word: re.Match) -> str:
        nonlocal changed
        other = following.get(word[0].lower())
        changed |= other is not None
        return word[0] if other is None else other

    out = re.sub(r"[^\W\d_]+", swap, text)
    return out if changed else None


def sample(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> pa.Table:
    """(label, buckets, shares, other_buckets, other_shares): a bounded sample of labelled texts.

    The ids are bounded before texts are looked up, so what is broadcast has a fixed size.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    chosen = None
    for value in (0, 1):
        order = F.xxhash64(id_col)
        by_id = usable.groupBy(id_col).agg(F.max(label_col).alias("_label")).where(F.col("_label") == value)
        part = by_id.orderBy(order, id_col).limit(SAMPLE_PER_LABEL)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.select(F.col(id_col).alias("_id"), F.col("_label").cast("int").alias("label"))
    texts = documents.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    text = F.coalesce("text", F.lit(""))
    first = F.min(F.struct(F.xxhash64(text).alias("h"), text.alias("text")))
    rows = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "label").agg(first.alias("first")).select("label", "first.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, held in text_chunks(batch, "text"):
                others = [swapped(t.decode("utf-8")) for t in held]
                own = list(_rows(held))
                other = list(_rows([(o or "").encode("utf-8") for o in others]))
                yield pa.record_batch(
                    [
                        batch.column("label").slice(first, len(held)),
                        pa.array([a for a, _ in own], pa.list_(pa.int32())),
                        pa.array([v for _, v in own], pa.list_(pa.float32())),
                        pa.array([a if o else None for (a, _), o in zip(other, others)], pa.list_(pa.int32())),
                        pa.array([v if o else None for (_, v), o in zip(other, others)], pa.list_(pa.float32())),
                    ],
                    ["label", "buckets", "shares", "other_buckets", "other_shares"],
                )

    schema = "label int, buckets array<int>, shares array<float>, other_buckets array<int>, other_shares array<float>"
    return rows.mapInArrow(run, schema).toArrow()


def fit(rows: pa.Table, counterfactual: float = COUNTERFACTUAL) -> Model:
    """Balanced logistic regression with a ridge and the counterfactual penalty."""
    size = 1 << BITS
    y = rows.column("label").to_numpy().astype(float)
    n_pos = y.sum()
    if not 0 < n_pos < len(y):
        share = n_pos / len(y) if len(y) else 0.0
        return Model(np.zeros(size), 30.0 if share else -30.0)

    def flat(buckets: str, shares: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = rows.column(buckets).combine_chunks()
        lengths = np.array([len(x) if x.is_valid else 0 for x in lists])
        owner = np.repeat(np.arange(len(lists), dtype=np.int32), lengths)
        return owner, lists.flatten().to_numpy(), rows.column(shares).combine_chunks().flatten().to_numpy()

    owner, at, value = flat("buckets", "shares")
    positive = np.bincount(at, y[owner], size)
    texts = np.bincount(at, minlength=size)
    ratio = np.log((positive + 1) / (n_pos + 2)) - np.log((texts - positive + 1) / (len(y) - n_pos + 2))
    factor = np.where(texts >= LEAST_TEXTS, SCALE * np.abs(ratio), 0.0)
    value = value * factor[at]
    # The change that swapping makes: features of the other version less those of the text itself.
    o_owner, o_at, o_value = flat("other_buckets", "other_shares")
    paired = np.zeros(len(y), bool)
    paired[o_owner] = True
    mine = paired[owner]
    d_owner = np.concatenate([o_owner, owner[mine]])
    d_at = np.concatenate([o_at, at[mine]])
    d_value = np.concatenate([o_value * factor[o_at], -value[mine]])
    penalty = counterfactual / max(1, paired.sum())

    balance = np.where(y == 1, 0.5 / n_pos, 0.5 / (len(y) - n_pos))
    w, b, seen, seen_b = np.zeros(size), 0.0, np.full(size, 1e-8), 1e-8
    for _ in range(STEPS):
        score = np.bincount(owner, value * w[at], len(y)) + b
        error = (1 / (1 + np.exp(-np.clip(score, -50, 50))) - y) * balance
        gradient = np.bincount(at, value * error[owner], size) + RIDGE * w
        if len(d_at):
            change = np.bincount(d_owner, d_value * w[d_at], len(y))
            gradient += 2 * penalty * np.bincount(d_at, d_value * change[d_owner], size)
        seen += gradient**2
        w -= 0.3 * gradient / np.sqrt(seen)
        seen_b += error.sum() ** 2
        b -= 0.3 * error.sum() / np.sqrt(seen_b)
    return Model((w * factor).astype(np.float32), float(b))


def score(documents: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`documents` with the score of each text as column `score_col`; only texts go through Python."""
    weights = documents.sparkSession.sparkContext.broadcast(model.weights)
    bias = model.bias

    def scores(texts: list[bytes]) -> np.ndarray:
        points, ends = lowered(texts)
        buckets, starts = word_features(points, BITS, PREFIX)
        totals = np.zeros(len(starts) + 1)
        np.cumsum(weights.value[buckets].sum(axis=1, dtype=np.float64), out=totals[1:])
        cuts = np.searchsorted(starts, ends)
        words = np.diff(cuts, prepend=0)
        sums = np.diff(totals[cuts], prepend=0)
        return 1 / (1 + np.exp(-np.clip(bias + sums / np.maximum(words, LEAST_WORDS), -50, 50)))

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        batch = pa.record_batch([pa.array(texts, pa.string())], ["text"])
        found = [scores(held) for _, held in text_chunks(batch, "text")]
        return pd.Series(np.concatenate(found) if found else np.zeros(0))

    return documents.withColumn(score_col, of(F.col(text_col).cast("string")))


def trained(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> Model:
    return fit(sample(documents, labels, id_col, text_col, label_col))


def predictions(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted) of every text."""
    model = trained(documents, labels, id_col, text_col)
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return score(rows, model).select(
        F.col("id").alias(id_col),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def clean(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`documents` without those that are predicted to be toxic; columns may have any names."""
    rows = documents.select(packed(documents), F.col(text_col).cast("string").alias("text"))
    scored = score(rows, trained(documents, labels, id_col, text_col))
    return unpacked(scored.where("score < 0.5"), documents.columns)

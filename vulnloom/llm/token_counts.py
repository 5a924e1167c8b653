"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a slice form a linked list and its mergeable pairs a heap by rank. The lowest pair is
popped and merged until none is left; the count is the number of initial symbols minus the number
of merges, and no ids are made. Slices come from the scanner of `pretokens`, and counts of slices
are cached in each worker.

A null text is an empty one. Rows are handled one by one, so repeated rows give repeated results.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vulnloom.llm.byte_bpe import Cache
from vulnloom.llm.common import process_cache, text_chunks
from vulnloom.llm.pretokens import pieces


class Merges:
    """Pairs of symbols with the rank of their merge and the symbol it makes."""

    def __init__(self, definition: bytes) -> None:
        read = json.loads(definition)
        model, split = read["model"], read["pre_tokenizer"]
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        bytewise = split["type"] == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
        if model["type"] != "BPE" or not plain or not bytewise or read["normalizer"]:
            raise ValueError("only byte-level BPE without normalizer, prefix space and dropout is counted")
        added = [t for t in read["added_tokens"] if t["content"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take in their surroundings are not counted")
        vocabulary = model["vocab"]
        # A byte that is not printable Latin-1 is written as the next unused character from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        written = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.single = [vocabulary[written[b]] for b in range(256)]
        self.pairs = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocabulary[left] << 32 | vocabulary[right]] = (rank, vocabulary[left + right])
        contents = sorted((t["content"].encode("utf-8") for t in added), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, contents))) if contents else None

    def count(self, piece: bytes) -> int:
        single, get = self.single, self.pairs.get
        symbols = [single[b] for b in piece]
        n = left = len(symbols)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            merge = get(symbols[i] << 32 | symbols[i + 1])
            if merge is not None:
                heap.append((merge[0], i, merge[1]))
        heapify(heap)
        while heap:
            rank, i, made = heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            merge = get(symbols[i] << 32 | symbols[j])
            if merge is None or merge[0] != rank:
                continue  # one of the two has merged with another symbol since
            symbols[i], symbols[j] = made, -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                merge = get(made << 32 | symbols[k])
                if merge is not None:
                    heappush(heap, (merge[0], i, merge[1]))
            h = before[i]
            if h >= 0:
                merge = get(symbols[h] << 32 | made)
                if merge is not None:
                    heappush(heap, (merge[0], h, merge[1]))
        return left


def _parts(merges: Merges, texts: list[bytes]) -> tuple[list[bytes], list[int], list[int]]:
    """Texts cut at the added tokens: the parts, the text of each part, and added tokens by text."""
    parts, owner, added = [], [], [0] * len(texts)
    for i, text in enumerate(texts):
        cut = merges.added.split(text) if merges.added else [text]
        added[i] = len(cut) - 1
        parts += cut
        owner += [i] * len(cut)
    return parts, owner, added


def token_counts(
    df: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of every text.

    Added tokens inside a text count as one each, as the tokenizer's library reads them by default.
    The definition is read by the driver and broadcast: it has the size of a vocabulary.
    """
    definition = df.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_bytes())
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = process_cache(f"merges {tokenizer_path}", lambda: Merges(definition.value))
        cache = process_cache(f"counts {tokenizer_path}", lambda: Cache(merges.count))
        for batch in batches:
            for first, texts in text_chunks(batch, "text"):
                parts, owner, added = _parts(merges, texts)
                slices, ends = pieces(parts)
                totals = np.zeros(len(slices) + 1, np.int64)
                np.cumsum(np.fromiter(map(cache.__getitem__, slices), np.int64, len(slices)), out=totals[1:])
                by_part = np.diff(totals[ends], prepend=0)
                counts = np.array(added, np.int64)
                np.add.at(counts, owner, by_part)
                yield pa.record_batch(
                    [
                        batch.column("id").slice(first, len(texts)),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array(counts, pa.int64()),
                    ],
                    ["id", "n_bytes", "n_tokens"],
                )

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = source.mapInArrow(run, f"id {id_type}, n_bytes bigint, n_tokens bigint")
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )

"""Jaccard self-join of documents on word 5-grams, by vertical partitioning.

All n-grams have one global order: rare ones by hash, then the frequent ones by frequency. Two sets
can only be similar enough if the first few n-grams of both, in this order, have one in common, so
candidates are documents that share such an n-gram. The order is then cut into fragments; overlaps of
a candidate pair are counted in each fragment on their own and summed by pair.

What keeps this linear where many documents are alike:

* Equal sets become one node. The join runs between nodes; copies come back by membership.
* Within an n-gram's bucket documents are compared with a pivot of similar length first. Only
  members that are then still in different components are compared pair by pair, so no link between
  components is lost and pairs inside a component are never listed.
* Frequent n-grams come last in the order, so they are looked at only where a document has little
  else, and their buckets are salted.

N-grams are 64-bit hashes; a pair could be misjudged only if two of its own n-grams collide. What is
broadcast has a bounded size: the `FREQUENT` most frequent n-grams, which only improve the order, and a
bitmap that lets tasks pass over documents without candidates.

A null text, and one without words, has an empty set and is linked with nothing. A text with fewer
words than an n-gram has its whole sequence as the one n-gram. Rows are kept apart even if ids
repeat; a null id takes part but never names a component unless there is no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType

from vulnloom.llm import bitmap
from vulnloom.llm.common import cut, packed, release, text_chunks, unpacked
from vulnloom.llm.components import components
from vulnloom.llm.text_features import word_hashes

WORDS = 5
PERCENT = 80
FREQUENT = 100_000
# An n-gram counts as seen by a task if a run of this many n-grams has it at least so often.
COUNTED = 1_000_000
LEAST_COUNT = 3
FRAGMENT_BITS = 3
# Sets that a task remembers having passed on; copies beyond them meet in the shuffle.
HELD_SETS = 50_000
# Pairs of one document whose sets are compared in one place.
HUB_PAIRS = 1000
# Members of a bucket that are compared with each other in one place.
BUCKET = 2000
# Rounds of pivots before the members left in different components are compared pair by pair.
ROUNDS = 1

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(31))


def ngram_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    hashes, ends = word_hashes([t.lower() for t in texts])
    hashes = _mixed(hashes)
    grams = np.full(max(len(hashes) - words + 1, 0), words, np.uint64)
    for i in range(words):
        grams = grams * _STEP + hashes[i : i + len(grams)]
    grams = _mixed(grams)
    out, a = [], 0
    for b in ends.tolist():
        if b - a >= words:
            own = np.sort(grams[a : b - words + 1])
            new = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=new[1:])
            out.append(own[new])
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for i in range(a, b):
                whole = whole * _STEP + hashes[i : i + 1]
            out.append(_mixed(whole))
        else:
            out.append(np.zeros(0, np.uint64))
        a = b
    return out


def _digest(grams: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(grams.tobytes())


def _sketch(grams: np.ndarray) -> bytes | None:
    counts = np.bincount((grams >> np.uint64(56)).astype(np.int64), minlength=256)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


@F.pandas_udf(LongType())
def _most_shared(a: pd.Series, b: pd.Series) -> pd.Series:
    """What two sets can share at most: in each fragment no more than the smaller of both has."""
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), 1 << 40, np.int64)
    if known.any():
        x, y = (np.frombuffer(b"".join(side[known]), np.uint8).reshape(-1, 256) for side in (a, b))
        out[known] = np.minimum(x, y).sum(axis=1, dtype=np.int64)
    return pd.Series(out)


def _promising(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs that may still be similar by the sizes of their fragments."""
    ends = [sketches.select(F.col("node").alias(x), F.col("sketch").alias(f"{x}_sketch")) for x in ("a", "b")]
    joined = pairs.join(ends[0], "a").join(ends[1], "b").withColumn("most", _most_shared("a_sketch", "b_sketch"))
    return joined.where(f"(100 + {percent}) * most >= {percent} * (an + bn)").select("a", "an", "b", "bn")


class _Once:
    """Which sets a task has passed on already; forgets them when it holds `HELD_SETS`, so memory is bounded."""

    def __init__(self) -> None:
        self.held: set[bytes] = set()

    def is_new(self, digest: bytes) -> bool:
        if digest in self.held:
            return False
        if len(self.held) >= HELD_SETS:
            self.held.clear()
        self.held.add(digest)
        return True


def _signed(grams: np.ndarray) -> np.ndarray:
    return grams.view(np.int64)


def _profile(df: DataFrame) -> DataFrame:
    """Rows of documents (id, version, n, digest, sketch) and rows of n-grams that a task saw often (gram, seen).

    `version` is the hash that Spark's `xxhash64` gives the text, `sketch` how many n-grams the set has
    in each of 256 fragments of the order by hash, a byte each, null if a byte cannot hold one.
    """
    id_type = df.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, version bigint, n bigint, digest binary, sketch binary, gram bigint, seen bigint"
    names = ["id", "version", "n", "digest", "sketch", "gram", "seen"]
    id_arrow = to_arrow_type(df.schema["id"].dataType)

    def frequent(held: list[np.ndarray]) -> pa.RecordBatch:
        grams, seen = np.unique(np.concatenate(held), return_counts=True)
        often = seen >= LEAST_COUNT
        grams, seen = grams[often], seen[often]
        none = len(grams)
        return pa.record_batch(
            [pa.nulls(none, id_arrow), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int64())]
            + [pa.nulls(none, pa.binary())] * 2
            + [pa.array(_signed(grams)), pa.array(seen, pa.int64())],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for first, texts in text_chunks(batch, "text"):
                sets = ngram_sets(texts)
                rows = len(texts)
                yield pa.record_batch(
                    [
                        batch.column("id").slice(first, rows),
                        pa.array(np.array([xxhash.xxh64_intdigest(t, 42) for t in texts], np.uint64).view(np.int64)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s) for s in sets], pa.binary()),
                        pa.array([_sketch(s) for s in sets], pa.binary()),
                        pa.nulls(rows, pa.int64()),
                        pa.nulls(rows, pa.int64()),
                    ],
                    names,
                )
                held += sets
                size += sum(map(len, sets))
                if size >= COUNTED:
                    yield frequent(held)
                    held, size = [], 0
        if size:
            yield frequent(held)

    return df.mapInArrow(run, schema)


def _prefixes(df: DataFrame, frequent: np.ndarray, percent: int) -> DataFrame:
    """(digest, n, rare, grams): the n-grams of each set's prefix in the global order.

    The first `rare` of them are not frequent. `frequent` is ordered from the least frequent on.
    """
    order = np.argsort(frequent)
    shared = df.sparkSession.sparkContext.broadcast((frequent[order], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        once = _Once()
        for batch in batches:
            for _, texts in text_chunks(batch, "text"):
                digests, sizes, rares, prefixes = [], [], [], []
                for grams in ngram_sets(texts):
                    n = len(grams)
                    digest = _digest(grams)
                    if not n or not once.is_new(digest):
                        continue
                    length = n - -(-n * percent // 100) + 1
                    at = np.searchsorted(known, grams)
                    often = np.zeros(n, bool)
                    inside = at < len(known)
                    often[inside] = known[at[inside]] == grams[inside]
                    rare = grams[~often][:length]
                    prefix = rare
                    if len(rare) < length:
                        later = grams[often][np.argsort(rank[at[often]])]
                        prefix = np.concatenate([rare, later[: length - len(rare)]])
                    digests.append(digest)
                    sizes.append(n)
                    rares.append(len(rare))
                    prefixes.append(_signed(prefix))
                yield pa.record_batch(
                    [
                        pa.array(digests, pa.binary()),
                        pa.array(sizes, pa.int64()),
                        pa.array(rares, pa.int64()),
                        pa.array(prefixes, pa.list_(pa.int64())),
                    ],
                    ["digest", "n", "rare", "grams"],
                )

    return df.mapInArrow(run, "digest binary, n bigint, rare bigint, grams array<bigint>")


def _shared(buckets: DataFrame, percent: int) -> DataFrame:
    """Members of buckets, sorted by (gram, salt, n), that have a neighbour of similar length.

    Salted members stay in any case, as their neighbour may have another salt. Streams over the
    sorted rows and holds one of them, however large a bucket is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, near = None, False  # the last row is passed on once its successor is known
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if last is None else pa.concat_batches([last, batch])
            gram, salt, n = (rows.column(c).to_numpy() for c in ("gram", "salt", "n"))
            like = np.zeros(len(gram) + 1, bool)
            like[0] = near
            like[1:-1] = (gram[1:] == gram[:-1]) & (salt[1:] == salt[:-1]) & (100 * n[:-1] >= percent * n[1:])
            keep = like[1:] | like[:-1] | (salt >= 0)
            near, last = bool(like[-2]), rows.slice(rows.num_rows - 1)
            yield rows.slice(0, rows.num_rows - 1).filter(pa.array(keep[:-1]))
        if last is not None and (near or last.column("salt")[0].as_py() >= 0):
            yield last

    return buckets.mapInArrow(run, buckets.schema)


def _similar_length(a: str, b: str, percent: int) -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def _pivots(members: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, an, b, bn): members of different components paired with one of their length in the bucket.

    The pivot is the member with the fewest n-grams before the shared one: in a group of near copies
    that is one with few changes, which most others are similar to. Lengths are cut into classes no
    wider than similar sets can be, at other places each turn.
    """
    width = float(np.log(100 / percent))
    classed = members.withColumn("class", F.floor(F.log("n") / width + (turn % 2) / 2))
    first = F.struct("place", F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "label")
    salted = classed.groupBy("gram", "salt", "class").agg(F.min(first).alias("p"))
    top = F.min("p").over(Window.partitionBy("gram", "class"))
    salted = salted.withColumn("p", top)
    pairs = classed.join(salted, ["gram", "salt", "class"]).where("label <> p.label")
    pairs = pairs.where(_possible("n", "place", "p.n", "p.place", percent))
    return _pairs(pairs, "node", "n", "p.node", "p.n", percent)


def _possible(an: str, a_place: str, bn: str, b_place: str, percent: int) -> str:
    """What two similar sets fulfil at the first n-gram that both have: neither can share more from there on."""
    return f"(100 + {percent}) * least({an} - {a_place}, {bn} - {b_place}) >= {percent} * ({an} + {bn})"


def _pairs(df: DataFrame, a: str, an: str, b: str, bn: str, percent: int) -> DataFrame:
    smaller = F.col(a) < F.col(b)
    return (
        df.where(_similar_length(an, bn, percent))
        .select(
            F.least(a, b).alias("a"),
            F.when(smaller, F.col(an)).otherwise(F.col(bn)).alias("an"),
            F.greatest(a, b).alias("b"),
            F.when(smaller, F.col(bn)).otherwise(F.col(an)).alias("bn"),
        )
        .distinct()
    )


def _mixed_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with the label of their component and the parts of their bucket, without buckets inside one component."""
    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    parts = F.ceil(F.count(F.lit(1)) / BUCKET).cast("int").alias("parts")
    mixed = labelled.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), parts).where("lo <> hi")
    return labelled.join(mixed.select("gram", "parts"), "gram")


def _left_pairs(members: DataFrame, percent: int) -> DataFrame:
    """All pairs of members in different components that the places in the order leave possible.

    A pair is similar enough only if it is so by the n-grams from the first that it shares on, and it
    meets in the bucket of that one; so each set can share no more than it has from its place on.
    A bucket of more than `BUCKET` members is cut into `parts` of about that size, and every two parts
    meet in a place of their own, so that no task compares more than the members of two parts.
    """
    columns = ("node", "n", "place", "label")
    side = lambda df, x, *keys: df.select("gram", *keys, *[F.col(c).alias(f"{x}_{c}") for c in columns])
    small, large = members.where("parts = 1"), members.where("parts > 1")
    near = side(small, "x").join(side(small, "y"), "gram").where("x_node < y_node")
    if not large.isEmpty():
        large = large.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
        # A member is sent to the places of its part and each later one on one side, each earlier one on the other.
        later = large.withColumn("other", F.explode(F.sequence(F.col("part"), F.col("parts") - 1)))
        earlier = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("part"))))
        x, y = side(later, "x", "part", "other"), side(earlier, "y", F.col("other").alias("part"), F.col("part").alias("other"))
        near = near.unionByName(x.join(y, ["gram", "part", "other"]).where("part < other or x_node < y_node").drop("part", "other"))
    near = near.where("x_label <> y_label").where(_possible("x_n", "x_place", "y_n", "y_place", percent))
    return _pairs(near, "x_node", "x_n", "y_node", "y_n", percent)


def _fragments(df: DataFrame, wanted: np.ndarray, frequent: np.ndarray) -> DataFrame:
    """(digest, fragments) of all sets whose bit is set: the n-grams of each fragment, a row per set.

    The last fragment holds the frequent n-grams, the others equal ranges of the rest.
    """
    shared = df.sparkSession.sparkContext.broadcast((wanted, np.sort(frequent)))
    cuts = np.arange(1, (1 << FRAGMENT_BITS) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = shared.value
        once = _Once()
        for batch in batches:
            for _, texts in text_chunks(batch, "text"):
                digests, parts = [], []
                for grams in ngram_sets(texts):
                    digest = _digest(grams)
                    if not len(grams) or not bitmap.contains(bits, np.frombuffer(digest[:8], ">u8"))[0] or not once.is_new(digest):
                        continue
                    at = np.minimum(np.searchsorted(known, grams), max(len(known) - 1, 0))
                    often = known[at] == grams if len(known) else np.zeros(len(grams), bool)
                    number = (grams >> np.uint64(64 - FRAGMENT_BITS)).astype(np.int64)
                    number[often] = 1 << FRAGMENT_BITS
                    order = np.argsort(number, kind="stable")
                    digests.append(digest)
                    parts.append(np.split(_signed(grams)[order], np.searchsorted(number[order], cuts)))
                yield pa.record_batch(
                    [pa.array(digests, pa.binary()), pa.array(parts, pa.list_(pa.list_(pa.int64())))], ["digest", "fragments"]
                )

    return df.mapInArrow(run, "digest binary, fragments array<array<bigint>>")


def _links(pairs: DataFrame, texts: DataFrame, digests: DataFrame, frequent: np.ndarray, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough: overlaps of each fragment, summed by pair.

    Only the sets of the pairs leave the tasks that read the texts. The end of a pair that occurs in
    more pairs is its hub. The sets of hubs go to the other ends; a hub of many pairs is spread over
    salts, so that no task serves more than about `HUB_PAIRS` of them.
    """
    degrees = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    degrees = cut(degrees.join(digests, "node")).select("node", "d", F.col("digest").alias("node_digest"))
    start = F.conv(F.hex(F.substring("node_digest", 1, 8)), 16, -10).cast("bigint")
    sets = _fragments(texts, bitmap.build(degrees.select(start.alias("h")), "h"), frequent)
    # A set that several tasks have read counts once.
    sets = sets.groupBy("digest").agg(F.first("fragments").alias("fragments"))

    ends = [
        degrees.select(F.col("node").alias(x), F.col("d").alias(f"{x}d"), F.col("node_digest").alias(f"{x}_digest"))
        for x in ("a", "b")
    ]
    turned = F.col("bd") > F.col("ad")
    salts = F.ceil(F.greatest("ad", "bd") / HUB_PAIRS)
    sides = pairs.join(ends[0], "a").join(ends[1], "b").select(
        "a", "b", (F.col("an") + F.col("bn")).alias("both"),
        F.when(turned, F.col("b_digest")).otherwise(F.col("a_digest")).alias("hub"),
        F.when(turned, F.col("a_digest")).otherwise(F.col("b_digest")).alias("other"),
        salts.alias("salts"),
    )
    sides = cut(sides.withColumn("salt", F.pmod(F.xxhash64("other"), "salts")))
    hubs = sides.select("hub", "salt").distinct()
    served = hubs.join(sets.select(F.col("digest").alias("hub"), F.col("fragments").alias("hub_fragments")), "hub")
    met = sides.join(served, ["hub", "salt"]).join(sets.select(F.col("digest").alias("other"), "fragments"), "other")
    partial = F.zip_with("hub_fragments", "fragments", lambda x, y: F.size(F.array_intersect(x, y)))
    summed = met.select("a", "b", "both", F.aggregate(partial, F.lit(0), lambda total, n: total + n).alias("overlap"))
    return summed.where(f"100 * overlap >= {percent} * (both - overlap)").select("a", "b")


def _members(texts: DataFrame, digests: DataFrame, frequent: np.ndarray, percent: int) -> DataFrame:
    """(gram, salt, node, n, place): the prefixes of all sets, by n-gram, where another set may have it too."""
    prefixes = _prefixes(texts, frequent, percent).groupBy("digest").agg(
        F.first("n").alias("n"), F.first("rare").alias("rare"), F.first("grams").alias("grams")
    )
    rows = prefixes.join(digests, "digest").select("node", "n", "rare", F.posexplode("grams").alias("place", "gram"))
    spread = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.when(F.col("place") >= F.col("rare"), F.pmod(F.xxhash64("node"), F.lit(spread))).otherwise(-1)
    rows = rows.select("gram", salt.cast("int").alias("salt"), "node", F.col("n").cast("int").alias("n"), "place")
    return cut(_shared(rows.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "n"), percent))


def assigned(df: DataFrame, id_col: str, text_col: str, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """(id, version, n, label) of each row: the size of its set and its component, null for empty sets.

    Two documents link if 100 * intersection >= `percent` * union of their n-gram sets.
    """
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    profile = cut(_profile(texts))
    documents = profile.where("digest is not null").select("id", "version", "n", "digest", "sketch")
    ranked = (
        profile.where("gram is not null").groupBy("gram").agg(F.sum("seen").alias("seen"))
        .orderBy(F.desc("seen"), "gram").limit(FREQUENT).toArrow()
    )
    frequent = ranked.column("gram").to_numpy()[::-1].copy().view(np.uint64)

    sets = cut(documents.where("n > 0").groupBy("digest").agg(F.first("sketch").alias("sketch")))
    sets = sets.withColumn("node", F.monotonically_increasing_id())
    digests = sets.select("digest", "node")
    members = _members(texts, digests, frequent, percent)
    release(df.sparkSession)
    sketches = cut(sets.select("node", "sketch").join(members.select("node").distinct(), "node", "left_semi"))

    labels, tested, links = None, None, None
    opened = members.withColumn("label", F.col("node"))
    for turn in range(rounds + 1):
        if turn == rounds and labels is None:
            opened = cut(_mixed_buckets(members, sets.select("node", F.col("node").alias("label"))))
        pairs = _pivots(opened, turn, percent) if turn < rounds else _left_pairs(opened, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = cut(_promising(pairs, sketches, percent))
        release(df.sparkSession)
        if pairs.isEmpty():
            continue
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        found = cut(_links(pairs, texts, digests, frequent, percent))
        if found.isEmpty():
            continue
        links = found if links is None else links.unionByName(found)
        labels = cut(components(links))
        release(df.sparkSession)
        if turn < rounds:
            opened = cut(_mixed_buckets(members, labels))

    named = documents.join(digests, "digest", "left")
    if labels is None:
        return named.select("id", "version", "n", F.col("node").alias("label"))
    return named.join(labels, "node", "left").select("id", "version", "n", F.coalesce("label", "node").alias("label"))


def similar_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id_col, n_shingles, component_id) of each row; the component is named by its smallest id."""
    named = cut(assigned(df, id_col, text_col, percent))
    # Written down, so that the join sees two plain inputs and Spark can split a large component.
    names = cut(named.where("label is not null").groupBy("label").agg(F.min("id").alias("component")))
    return named.join(names, "label", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"),
    )


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """`df` with one row of each component, that with its smallest id; rows with empty sets all stay.

    Rows are told apart by id and text. Texts are shuffled only for rows that go and for rows that
    repeat in both. Columns may have any names.
    """
    named = cut(assigned(df, id_col, text_col, percent))
    key = lambda i, v: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("null")), v.cast("string"))
    rows = named.where("label is not null").select(
        "label", F.col("id").isNull().alias("unnamed"), "id", key(F.col("id"), F.col("version")).alias("_key")
    )
    first = cut(rows.groupBy("label").agg(F.min(F.struct("unnamed", "id", "_key")).alias("first")))
    others = rows.join(first, "label").groupBy("_key").agg(
        F.count(F.lit(1)).alias("times"), F.first(F.col("first._key")).alias("first_key")
    )
    touched = cut(others.where("first_key <> _key or times > 1").select("_key", (F.col("first_key") == F.col("_key")).alias("stays")))
    words = bitmap.build(touched.select(F.xxhash64("_key").alias("h")), "h")
    shared = df.sparkSession.sparkContext.broadcast(words)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = df.select(packed(df), key(F.col(id_col), F.xxhash64(text)).alias("row_key"))
    inside = bitmap.possible(shared, F.xxhash64("row_key"))
    joined = keyed.where(inside).join(touched, F.col("row_key") == F.col("_key"), "left")
    once = joined.where("stays").dropDuplicates(["row_key"])
    kept = joined.where("_key is null").unionByName(once)
    return unpacked(keyed.where(~inside), df.columns).unionByName(unpacked(kept, df.columns))

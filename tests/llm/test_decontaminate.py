"""Planted passages, whole, changed and cut, against a search over all alignments."""

import random

import corpus_pipeline
import numpy as np
import pytest

from vulnloom.llm import bitmap, decontaminate, queries

WORDS = ["w%d" % i for i in range(400)]


def slow(doc: str, item: str) -> bool:
    """Any alignment of the item with a good stretch, whether a mask hits it or not."""
    words, own = (decontaminate.word_hashes(t.encode()) for t in (doc, item))
    if len(own) < decontaminate.LEAST_ITEM:
        return False
    least = min(decontaminate.MATCHED_WORDS, -(-70 * len(own) // 100))
    offsets = range(1 - len(own), len(words))
    return any(decontaminate.best_stretch(words, own, d)[0] >= least for d in offsets)


def corpus() -> tuple[list, list]:
    draw = random.Random(4)
    prose = lambda n: [draw.choice(WORDS) for _ in range(n)]
    items = [prose(draw.randrange(14, 40)) for _ in range(12)] + [prose(5), prose(7), prose(8), prose(11), prose(3)]
    docs = [prose(draw.randrange(0, 120)) for _ in range(40)]
    for item in items:
        for changes in (0, 1, 2, 4, 7):
            changed = list(item)
            for _ in range(changes):
                changed[draw.randrange(len(changed))] = "other"
            docs.append(prose(draw.randrange(0, 30)) + changed + prose(draw.randrange(0, 30)))
        docs.append(prose(10) + item[: len(item) // 2] + prose(10))
        docs.append([w.upper() + draw.choice([",", "", "!?"]) for w in item])
    benchmark = [(i, " ".join(x)) for i, x in enumerate(items)]
    return [(i, " ".join(d)) for i, d in enumerate(docs)], benchmark


def test_against_all_alignments(spark):
    docs, items = corpus()
    documents = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id bigint, text string, item_id string")
    benchmark = spark.createDataFrame([(*r, "x") for r in items], "item_id bigint, text string, doc_id string")
    found = decontaminate.contaminated(documents, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(d, i) for d, t in docs for i, x in items if slow(t, x)}
    assert len(found) == len({(r.doc_id, r.item_id) for r in found})
    by_id = dict(docs)
    for r in found:
        words, own = (decontaminate.word_hashes(t.encode()) for t in (by_id[r.doc_id], dict(items)[r.item_id]))
        best = max(decontaminate.best_stretch(words, own, d)[0] for d in range(1 - len(own), len(words)))
        assert r.n_matched == best and r.item_words == len(own)
    kept = decontaminate.clean(documents, benchmark)
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.collect()} == set(by_id) - {r.doc_id for r in found}


def test_odd_rows(spark):
    item = " ".join(f"q{i}" for i in range(20))
    documents = spark.createDataFrame(
        [(1, item), (1, item), (2, None), (3, ""), (None, item), (4, "x " * 200_000 + item), (5, "the")], "doc_id bigint, text string"
    )
    benchmark = spark.createDataFrame([(9, item), (8, item.upper()), (None, "x x x x x x x x"), (7, None), (6, "the")], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id, r.n_matched) for r in decontaminate.contaminated(documents, benchmark).collect()}
    assert found == {(1, 8, 20), (None, 8, 20), (4, 8, 20)}
    assert sorted(str(r.doc_id) for r in decontaminate.clean(documents, benchmark).collect()) == ["2", "3", "5", "None"]
    none = benchmark.limit(0)
    assert decontaminate.contaminated(documents, none).collect() == []
    assert decontaminate.clean(documents, none).count() == documents.count()
    assert decontaminate.contaminated(documents.limit(0), benchmark).collect() == []


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_bitmap_holds_all_members(spark, n):
    hashes = np.random.default_rng(1).integers(-(2**63), 2**63, n, dtype=np.int64)
    words = bitmap.build(spark.createDataFrame([(int(h),) for h in hashes], "h bigint"), "h")
    assert bitmap.contains(words, hashes.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(0, 2**63, 10_000).astype(np.uint64)
    assert bitmap.contains(words, others).mean() < 0.001


def test_short_items_with_a_replaced_word(spark):
    """Every replaced word that the verification accepts, and no other; no mask takes part in what is expected."""
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in range(5, 18)}
    docs, expected = [], set()
    for n, item in items.items():
        least = min(decontaminate.MATCHED_WORDS, -(-70 * n // 100))
        own = decontaminate.word_hashes(" ".join(item).encode())
        for k in range(n):
            changed = [*item[:k], "other", *item[k + 1 :]]
            docs.append((len(docs), " ".join(["a", "b", "c", *changed, "d", "e"])))
            words = decontaminate.word_hashes(docs[-1][1].encode())
            if max(decontaminate.best_stretch(words, own, d)[0] for d in range(len(words))) >= least:
                expected.add((docs[-1][0], n))
    assert {n for _, n in expected} == set(items)
    documents = spark.createDataFrame(docs, "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents, benchmark).collect()} == expected


def test_every_id_of_equal_items(spark, tmp_path):
    item = " ".join(f"q{i}" for i in range(20))
    documents = spark.createDataFrame([(1, "a b " + item), (2, item), (3, "a b")], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(9, item), (8, item.upper()), (8, item), (7, "other " + item)], "item_id bigint, text string")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    found = [(r.doc_id, r.item_id) for r in queries.op8_decontaminate(spark, str(tmp_path)).collect()]
    assert sorted(found) == [(d, i) for d in (1, 2) for i in (7, 8, 9)]


def test_null_ids_take_part(spark, tmp_path):
    one, other = (" ".join(f"{c}{i}" for i in range(20)) for c in "qr")
    texts = [(1, "a b " + one), (None, "c " + one), (None, other + " d"), (None, "e f g"), (None, None), (2, "e f g"), (3, None)]
    documents = spark.createDataFrame(texts, "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(9, one), (None, other), (None, "e f")], "item_id bigint, text string")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.remove_benchmark(spark, documents, str(tmp_path))
    assert kept.columns == documents.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, documents.where("text = 'e f g' or text is null").collect()))
    found = queries.op8_decontaminate(spark, str(tmp_path)).collect()
    assert sorted(str((r.doc_id, r.item_id)) for r in found) == ["(1, 9)", "(None, 9)", "(None, None)"]


def stretches_without(masks, least):
    """Whether a stretch of the verification with `least` equal words holds none of the masks."""
    width = max(map(len, masks))
    seen, todo = set(), {("", 0, 0, 0)}  # last words, score, highest score before, equal words
    while todo:
        seen |= todo
        longer = set()
        for last, score, highest, equal in todo:
            for word, gain in (("1", 1), ("0", -decontaminate.PENALTY)):
                now = (last + word)[-width:]
                held = any(all(c == "0" or w == "1" for c, w in zip(m, now[-len(m) :])) for m in masks if len(m) <= len(now))
                if held or score + gain < 0:
                    continue
                total = min(equal + gain, least) if word == "1" else equal
                if total >= least and score + gain > highest:
                    return True
                longer.add((now, score + gain, max(highest, score + gain), total))
        todo = longer - seen
    return False


def test_masks_miss_no_stretch():
    least = lambda n: min(decontaminate.MATCHED_WORDS, -(-70 * n // 100))
    assert not stretches_without(decontaminate.MASKS, least(decontaminate.LEAST_ITEM))
    assert not stretches_without(decontaminate.LONG_MASKS, least(decontaminate.LONG_ITEM))
    assert stretches_without(["110110101101", "111001011011", "101101110011", "11111111"], 9)

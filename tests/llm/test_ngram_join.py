"""Components of the n-gram join against all pairs, with hot groups and odd rows."""

import random
import re

import pytest

from vulnloom.llm import ngram_join
from vulnloom.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def gram_set(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def expected(rows: list) -> dict:
    sets = {i: gram_set(t) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed: int) -> list:
    draw = random.Random(seed)
    words = ["w%d" % i for i in range(300)]
    prose = lambda n: [draw.choice(words) for _ in range(n)]
    rows, passage = [], prose(14)
    for _ in range(40):
        rows.append(prose(draw.randrange(1, 80)))
    for base in (prose(150), prose(60), prose(9), prose(300)):
        for _ in range(45):  # copies at all distances from their base, some of them cut short
            copy = list(base)
            for _ in range(draw.randrange(0, max(2, len(base) // 20))):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            rows.append(copy[: len(copy) - draw.choice([0, 0, 0, 1, 3, 20])])
    for _ in range(50):  # a passage that is most of many short texts
        rows.append(passage + prose(draw.randrange(0, 6)))
    rows += [prose(draw.randrange(1, 5)) for _ in range(6)] + [["w1", "w2"]] * 3 + [["same"] * 30] * 5
    order = list(range(1000, 1000 + len(rows)))
    draw.shuffle(order)
    texts = [" ".join(r) for r in rows]
    texts[3], texts[4] = texts[3].upper(), texts[3]
    return [*zip(order, texts), (5, None), (6, ""), (7, " \n\t"), (8, "É été a b c"), (9, "é été a b c")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed, monkeypatch):
    if seed == 2:  # hardly any n-gram known to be frequent
        monkeypatch.setattr(ngram_join, "FREQUENT", 3)
    rows = corpus(seed)
    documents = spark.createDataFrame([(i, t, "n", 0) for i, t in rows], "doc_id bigint, text string, gram string, n int")
    found = ngram_join.similar_components(documents).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected(rows)
    assert len(found) == len(rows)
    kept = ngram_join.one_of_each(documents)
    assert kept.columns == documents.columns
    wanted = {i for i, (n, c) in expected(rows).items() if n == 0 or i == c}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(wanted)


def test_pivots_alone_need_not_find_all(spark):
    rows = corpus(3)
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = ngram_join.assigned(documents, "doc_id", "text", rounds=0).collect()
    groups = {}
    for r in labels:
        if r.label is not None:
            groups.setdefault(r.label, set()).add(r.id)
    by_root = {}
    for i, (n, c) in expected(rows).items():
        if n:
            by_root.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, by_root.values()))


def test_repeated_rows_and_null_ids(spark):
    text, other = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(3, text), (3, text), (4, text), (None, text), (None, other), (5, other), (5, text), (7, None), (7, None)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = ngram_join.similar_components(documents).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found) == [(0, 3), (0, 5), (3, 3), (3, 3), (4, 3), (5, 3), (5, 5), (7, 7), (7, 7)]
    kept = ngram_join.one_of_each(documents).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(3, text), (5, other), (7, ""), (7, "")]
    assert ngram_join.similar_components(documents.limit(0)).collect() == []
    assert ngram_join.one_of_each(documents.limit(0)).collect() == []


def test_components_of_paths_and_hubs(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    edges = path + [(7, i) for i in range(200, 260)] + [(9, 9), (8, 7)]
    found = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.label for r in found} == {i: 100 for i in range(100, 141)} | {i: 7 for i in [7, 8, *range(200, 260)]}

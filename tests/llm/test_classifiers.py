"""Toxicity and language: held-out accuracy, counterfactuals, and texts of every odd kind."""

import random
import re
import zlib

import numpy as np
import pytest

from vulnloom.llm import language_id, text_features, toxicity

BAD = ["idiotic", "vile", "scummy", "loathsome"]


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def sentences(n: int, with_terms: bool = False) -> list:
    draw = random.Random(11)
    words = ["".join(draw.choice("aeioulmnrst") for _ in range(draw.randrange(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        text = [draw.choice(words) for _ in range(30)]
        toxic = draw.random() < 0.3
        if toxic:
            for _ in range(2):
                text[draw.randrange(30)] = draw.choice(BAD)
        if with_terms:  # in this corpus women are named mostly where it is toxic
            text[5] = "women" if draw.random() < (0.9 if toxic else 0.1) else "men"
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_toxicity(spark):
    rows = sentences(600)
    odd = [(1000, None), (1001, ""), (1002, "!!! 123"), (1003, "vile " * 50_000), (None, "a vile idiotic text"), (0, rows[0][1])]
    documents = spark.createDataFrame(
        [(i, t, 1) for i, t, _ in rows] + [(i, t, 1) for i, t in odd], "doc_id bigint, text string, score int"
    )
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None), (None, 1), (6, 7)], "doc_id bigint, toxic int")
    found = toxicity.predictions(documents, labels).collect()
    assert len(found) == len(rows) + len(odd)
    by_id = {r.doc_id: r for r in found}
    tested = [(by_id[i].predicted, y) for i, _, y in rows if is_held_out(i)]
    assert all(by_id[i].held_out == is_held_out(i) for i, _, _ in rows)
    assert sum(p == y for p, y in tested) >= 0.95 * len(tested)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert by_id[1003].predicted == 1 and by_id[1000].score == by_id[1001].score == by_id[1002].score
    kept = toxicity.clean(documents, labels)
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in found if not r.predicted}


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = sentences(300)
    documents = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    right = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    wrong = spark.createDataFrame([(i, 1 - y if is_held_out(i) else y) for i, _, y in rows], "doc_id bigint, toxic int")
    a, b = (toxicity.trained(documents, x) for x in (right, wrong))
    assert a.bias == pytest.approx(b.bias) and np.allclose(a.weights, b.weights)


def test_one_label_and_none(spark):
    documents = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r.predicted for r in toxicity.predictions(documents, none).collect()] == [0, 0]
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id bigint, toxic int")
    assert [r.predicted for r in toxicity.predictions(documents, ones).collect()] == [1, 1]
    assert toxicity.predictions(documents.limit(0), none).collect() == []


def test_a_repeated_id_is_one_text_of_the_sample(spark):
    rows = [(i, f"t{i}") for i in range(20)] + [(3, f"again {k}") for k in range(500)] + [(5, None)] * 50
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, toxic int")
    chosen = sum(not is_held_out(i) for i in range(20))
    sample = toxicity.sample(documents, labels, "doc_id", "text", "toxic")
    assert sample.num_rows == chosen
    assert toxicity.sample(documents.repartition(7), labels, "doc_id", "text", "toxic").num_rows == chosen


def test_swapping_moves_the_score_less_with_the_penalty(spark):
    rows = sentences(600, with_terms=True)
    documents = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    sample = toxicity.sample(documents, labels, "doc_id", "text", "toxic")

    def gap(model: toxicity.Model) -> float:
        sides = []
        for word in (b"women", b"men"):
            points, _ = text_features.lowered([word])
            sides.append(model.weights[text_features.word_features(points, toxicity.BITS, toxicity.PREFIX)[0]].sum())
        return abs(sides[0] - sides[1])

    assert gap(toxicity.fit(sample)) < 0.35 * gap(toxicity.fit(sample, counterfactual=0.0))
    assert toxicity.swapped("Women met two muslims.") == "men met two christians."
    assert toxicity.swapped("nobody") is None


def texts_by_language(n: int) -> list:
    draw = random.Random(3)
    syllables = {"aa": ["ka", "to", "mi"], "bb": ["str", "och", "ün"], "cc": ["фа", "лю", "ко"], "dd": ["ei", "ou", "ka"]}
    rows = []
    for i in range(n):
        lang = draw.choice(sorted(syllables))
        words = ["".join(draw.choice(syllables[lang]) for _ in range(3)) for _ in range(draw.randrange(4, 40))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_language(spark):
    rows = texts_by_language(400)
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "123 !?", None), (903, "kato " * 50_000, None), (None, "фалюко", "cc")]
    documents = spark.createDataFrame(
        [(i, t, lang, 0) for i, t, lang in rows + odd], "doc_id bigint, text string, lang string, lang_pred int"
    )
    model = language_id.trained(documents)
    found = language_id.predictions(documents, model).collect()
    assert len(found) == len(rows) + len(odd)
    by_id = {r.doc_id: r for r in found}
    tested = [(by_id[i].lang_pred, lang) for i, _, lang in rows if is_held_out(i)]
    assert sum(p == lang for p, lang in tested) >= 0.97 * len(tested)
    assert [by_id[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by_id[900].score == 0
    assert by_id[903].lang_pred == "aa" and by_id[None].lang_pred == "cc"
    assert all(0 <= r.score <= 1 for r in found)


def test_few_languages(spark):
    one = spark.createDataFrame([(i, "kato mika", "aa") for i in range(20)], "doc_id bigint, text string, lang string")
    assert {r.lang_pred for r in language_id.predictions(one, language_id.trained(one)).collect()} == {"aa"}
    none = one.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in language_id.predictions(none, language_id.trained(none)).collect()} == {"und"}
    assert language_id.predictions(one.limit(0), language_id.trained(one.limit(0))).collect() == []


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 40])
def test_codewords_tell_all_languages_apart(n):
    codes = language_id.codewords(n)
    assert codes.shape[0] == n and len({tuple(r) for r in codes}) == n
    assert (np.abs(codes.sum(axis=0)) < n).all()


def test_scores_equal_a_slow_sum(spark):
    """Scores against hashes of words and word beginnings worked out letter by letter."""
    rows = sentences(300)
    documents = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    model = toxicity.trained(documents, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int"))
    odd = ["", "Vile, VILE ünicode-words 12ab?", "é" * 300 + " idiotic", "x"]
    texts = [t for _, t, _ in rows[:60]] + odd
    found = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), model).collect()

    def mixed(value: int) -> int:
        odd_factor, full = 0x9E3779B97F4A7C15, (1 << 64) - 1
        value = ((value ^ (value >> 29)) * odd_factor) & full
        value = ((value ^ (value >> 32)) * odd_factor) & full
        return value >> (64 - toxicity.BITS)

    def slow_score(text: str) -> float:
        words = re.findall(r"[^\W\d_]+", text.lower())
        total = 0.0
        for word in words:
            hashed = lambda part: sum((ord(c) + 1) * pow(text_features._BASE, j % 64, 1 << 64) for j, c in enumerate(part)) % (1 << 64)
            total += float(model.weights[mixed(hashed(word))]) + float(model.weights[mixed(hashed(word[: toxicity.PREFIX]) ^ 0x5BD1E995)])
        return 1 / (1 + np.exp(-np.clip(model.bias + total / max(len(words), toxicity.LEAST_WORDS), -50, 50)))

    for r in found:
        assert r.score == pytest.approx(slow_score(texts[r.i]), abs=1e-6)


def test_decoding_equals_a_slow_sum(spark):
    """Six languages, so codewords are drawn: every loss summed up bit by bit and n-gram by n-gram."""
    draw = random.Random(12)
    syllables = {f"l{k}": ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2)) for _ in range(6)] for k in range(6)}
    rows = [(i, " ".join("".join(draw.choice(syllables[f"l{i % 6}"]) for _ in range(3)) for _ in range(12)), f"l{i % 6}") for i in range(240)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.trained(documents)
    assert model.codes.shape == (6, model.weights.shape[1]) and model.weights.shape[1] <= language_id.RANDOM_BITS
    found = {r.doc_id: r for r in language_id.predictions(documents, model).collect()}
    tested = [r for r in rows if is_held_out(r[0])]
    assert sum(found[i].lang_pred == lang for i, _, lang in tested) >= 0.95 * len(tested)
    full = (1 << 64) - 1

    def bucket(gram: str) -> int:
        value = len(gram)
        for c in gram:
            value = (value * text_features._BASE + (ord(c) if c.isalpha() else 32)) & full
        value = ((value ^ (value >> 29)) * 0x9E3779B97F4A7C15) & full
        value = ((value ^ (value >> 32)) * 0x9E3779B97F4A7C15) & full
        return value >> (64 - language_id.BITS)

    for i, text, _ in rows[:40]:
        closed = text.lower() + " "
        grams = [closed[k : k + n] for n in (2, 3) for k in range(len(closed) - n + 1)]
        grams = [g for g in grams if any(c.isalpha() for c in g)]
        sums = [sum(float(model.weights[bucket(g), b]) for g in grams) / len(grams) * min(len(grams), language_id.EVIDENCE) for b in range(model.codes.shape[1])]
        losses = [sum(t * np.log1p(np.exp(-c * e)) for t, c, e in zip(model.trust[k], model.codes[k], sums)) for k in range(6)]
        best = int(np.argmin(losses))
        assert found[i].lang_pred == model.languages[best]
        assert found[i].score == pytest.approx(1 / sum(np.exp(min(losses) - x) for x in losses), rel=1e-4)
        second = sorted(losses)[1]
        assert found[i].ambiguous == (second - min(losses) < language_id.AMBIGUOUS)

"""The pipeline on a small corpus with a case for every stage."""

import hashlib
import random

import corpus_pipeline
import pytest


@pytest.fixture
def folder(spark, tmp_path):
    draw = random.Random(9)
    words = ["".join(draw.choice("aeioulmnrst") for _ in range(draw.randrange(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    item, copied = prose(20), prose(60)
    texts = {i: prose(40) for i in range(300)}
    labels = []
    for i in range(300):
        if i % 4 == 0:
            texts[i] = texts[i] + " vile loathsome " + prose(10)
        labels.append((i, int(i % 4 == 0)))
    live = 'token = "0f9e8d7c6b5a40312233445566778899aabbccdd"'
    example = "password=abc123def456ghi7"
    cases = {
        1001: prose(15) + " vile loathsome scum vile " + prose(5), 1002: copied, 1003: copied, 1004: copied + " tail",
        1005: prose(30) + " " + item + " " + prose(30), 1006: prose(20) + " " + live + " " + prose(20),
        1007: prose(30) + " " + example, 1008: prose(30) + " " + example, 1009: prose(30) + " " + example, 1010: "", 1011: None,
    }
    texts |= cases
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts.items()] + [(1006, cases[1006], "en", "s1", len(cases[1006]))]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), texts, live, example


def test_every_stage_takes_effect(spark, folder):
    path, texts, live, example = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        docs = corpus_pipeline.stored(out)
        assert name == "byte_bpe" or docs.columns == columns
        seen[name] = {r.doc_id: r for r in docs.collect()}
    clean = {i for i in range(300) if i % 4} | set(range(1002, 1012))
    assert clean - set(seen["toxicity"]) == set() and not {i for i in range(0, 300, 4)} & set(seen["toxicity"])
    assert 1001 not in seen["toxicity"]
    assert set(seen["toxicity"]) - set(seen["ngram_join"]) == {1003, 1004}
    assert set(seen["ngram_join"]) - set(seen["decontamination"]) == {1005}
    masked = seen["secrets"]
    assert live not in masked[1006].text and "[REDACTED]" in masked[1006].text
    assert masked[1006].n_chars == len(masked[1006].text)
    assert {i for i in masked if masked[i].text != texts[i]} == {1006}
    assert all(example in masked[i].text for i in (1007, 1008, 1009))
    last = seen["byte_bpe"]
    assert set(last) == set(masked) == clean - {1003, 1004, 1005}
    for i, r in last.items():
        assert r.decoded_sha256 == hashlib.sha256((masked[i].text or "").encode()).hexdigest()
        assert r.n_tokens * 4 == len(r.ids)
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, path).collect()}
    assert whole == {i: r.ids_sha256 for i, r in last.items()}


def test_empty_documents(spark, folder, tmp_path):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, path))
        assert docs.count() == 0

import json
import random

import pytest
from pyspark.sql import functions as F

from vulnloom.sources import documents


def members(text, *sizes):
    """What the reader makes of a text that comes in blocks of these sizes."""
    data, blocks, at = text.encode(), [], 0
    while at < len(data):
        size = sizes[len(blocks) % len(sizes)]
        blocks.append(data[at : at + size])
        at += size
    return list(documents._Reader(blocks).elements())


@pytest.mark.parametrize("sizes", [(1,), (2, 3, 1), (7,), (100_000,)])
def test_members_from_blocks_of_any_size(sizes, monkeypatch):
    monkeypatch.setattr(documents, "BLOCK_BYTES", 16)
    draw = random.Random(5)
    values = ["a\"b\\", "é \U0001f600", "]}, {[", "\n\t", 0, 12, -1.5e300, True, None, {}, [], {"x": [1, {"y": "}"}]}, [[], [2]], "long " * 40]
    for indent in (None, 2):
        for n in (0, 1, 5):
            lists = {f"l{k}": [draw.choice(values) for _ in range(n)] for k in range(2)}
            whole = {"first": draw.choice([12, "x", None]), **lists, "nested": {"l0": [1, 2]}, "läst": 34}
            found = members(json.dumps(whole, indent=indent, ensure_ascii=False), *sizes)
            assert found[-1][:2] == (None, 0)
            assert json.loads(found[-1][2]) == {k: v for k, v in whole.items() if k not in lists}
            assert [(m, at, json.loads(text)) for m, at, text in found[:-1]] == [(k, i, v) for k, v in lists.items() for i, v in enumerate(v)]


@pytest.mark.parametrize("text", ["", "[1]", '{"a": [1, 2', '{"a": [1 2]}', '{"a": [1]', '{"a" 1}', '{"a": "x'])
def test_broken_documents_are_not_read_as_shorter_ones(text):
    with pytest.raises(ValueError):
        members(text, 3)


def test_documents_lie_one_after_another(tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "BLOCK_BYTES", 10)
    monkeypatch.setattr(documents, "FILE_BYTES", 200)
    made, expected, written = documents._Documents(str(tmp_path / "out")), {}, []
    frame = json.dumps(['{"a":[', '],"b":[', "]}"])
    for i in range(12):
        made.finish()
        written += made.closed()
        key = (None if i == 3 else f"r{i}", i % 2)
        a, b = [f'"é{k}"' for k in range(i)], [str(k) for k in range(i % 3)]
        if i == 5:  # no frame, no document
            made.add(key, 1, "1")
            continue
        # Of several frames the first counts.
        for section, text in [(0, frame), (0, "[]"), *[(1, x) for x in a], *[(2, x) for x in b]]:
            made.add(key, section, text)
        expected[key] = f'{{"a":[{",".join(a)}],"b":[{",".join(b)}]}}'
    made.finish()
    written += made.closed(last=True)
    text = lambda at: b"".join(documents._blocks(at["path"], at["start"], at["size"])).decode()
    assert {(repo, part): text(at) for repo, part, at in written} == expected
    assert 1 < len({at["path"] for _, _, at in written}) < len(expected)


def test_streamed_documents(spark):
    frames = [("r", 0), ("r", 1), (None, 0)]
    rows = [(*key, 0, None, json.dumps(['{"name":"x","l":[', "]}"])) for key in frames]
    rows += [("r", 0, 1, 2, '"later"'), ("r", 0, 1, 1, '"b"'), ("r", 0, 1, 1, '"a"'), ("r", 0, 1, 1, '"a"'), ("stranger", 0, 1, 1, "1")]
    pieces = spark.createDataFrame(rows, "repo_id string, part int, section int, index bigint, text string")
    made = documents.streamed(pieces.repartition(3))
    texts = {(r.repo_id, r.part): r.text for r in made.withColumn("text", documents.text_of(F.col("place"))).collect()}
    whole = '{"name":"x","l":["a","a","b","later"]}'
    assert texts == {("r", 0): whole, ("r", 1): '{"name":"x","l":[]}', (None, 0): '{"name":"x","l":[]}'}
    read = {(r.repo_id, r.part, r.member, r.pos, r.json) for r in documents.elements(made).collect()}
    listed = {("r", 0, "l", i, f'"{v}"') for i, v in enumerate(("a", "a", "b", "later"))}
    assert read == listed | {(*key, None, 0, '{"name":"x"}') for key in frames}

"""Documents split at any byte against the same documents read whole."""

import json
import random

import pytest

from vulnloom.sources import scanner, scanner_files

ODD = ['"', "\\", "\\\\", '\\"', "{", "}", "[", "]", ":", ",", "é", "😀", '"results": [{', "\n", "x" * 50]


def document(draw, n):
    text = lambda: "".join(draw.choices(ODD, k=draw.randrange(8)))
    results = [
        {"check_id": f"r{i}{text()}", "path": text(), "start": {"line": i}, "end": {"line": i + 1, "more": [{"results": [1]}]}, "extra": {"message": text(), "severity": "ERROR", "lines": text()}}
        for i in range(n)
    ]
    others = {"errors": [{"message": text()} for _ in range(draw.randrange(4))], "paths": {"scanned": [text()]}, "version": text()}
    keys = [*others, "results"]
    draw.shuffle(keys)
    whole = {k: others.get(k, results) for k in keys}
    return json.dumps(whole, ensure_ascii=draw.random() < 0.5, indent=draw.choice([None, None, 2]))


@pytest.mark.parametrize("width", [7, 61, 1000, 1 << 20])
def test_ranges_of_any_width(spark, tmp_path, monkeypatch, width):
    monkeypatch.setattr(scanner_files, "CHUNK_BYTES", max(3, width // 3))
    draw = random.Random(width)
    sizes = [0, 1, 3] if width < 20 else [0, 1, 2, 20, 60]
    texts = {f"repo{i}": document(draw, n) for i, n in enumerate(sizes)}
    for repo, text in texts.items():
        (tmp_path / f"{repo}.json").write_text(text, encoding="utf-8")
    (tmp_path / "cut.json").write_text(texts["repo1"][:-3], encoding="utf-8")
    (tmp_path / "none.json").write_text('{"errors": [{"a": 1}]}', encoding="utf-8")
    documents = scanner_files.Documents(spark, str(tmp_path), range_bytes=width)
    whole = scanner.scanner_results(scanner.read_documents(spark, str(tmp_path)).filter("repo_id LIKE 'repo%'"))
    key = lambda r: (r.repo_id, r.pos, repr(r.r))
    assert sorted(map(key, documents.results().collect())) == sorted(map(key, whole.collect()))
    rejected = {r.repo_id: r.reason for r in documents.rejects().collect()}
    assert rejected == {"cut": "not JSON", "none": "no results"}


def test_one_document_in_many_tasks(spark, tmp_path):
    draw = random.Random(1)
    (tmp_path / "big.json").write_text(document(draw, 20_000), encoding="utf-8")
    documents = scanner_files.Documents(spark, str(tmp_path), range_bytes=100_000)
    assert documents.ranges.count() > 10
    found = documents.results()
    assert [r.pos for r in found.orderBy("pos").collect()] == list(range(20_000))
    assert scanner.scanner_findings(found).count() == scanner.scanner_findings(
        scanner.scanner_results(scanner.read_documents(spark, str(tmp_path)))
    ).count()

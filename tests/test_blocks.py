"""Excerpts from blocks of lines against whole texts, and plans without texts above a shuffle."""

import random
import re
import time

from pyspark.sql import functions as F

from vulnloom.operators import blocks, digest, findings, patches
from vulnloom.operators.key_filter import KeyFilter

BREAKS = ["\n", "\n", "\n", "\r", "\x0b", "\x0c", "\x85", " "]


def test_key_filter_misses_nothing(spark):
    keys = spark.range(5000).select((F.col("id") * 7).alias("a"), F.col("id").cast("string").alias("b"))
    held = KeyFilter(keys, ["a", "b"])
    rows = spark.range(200_000).select((F.col("id") * 7).alias("a"), F.col("id").cast("int").cast("string").alias("b"), "id")
    passed = {r.id for r in rows.where(held.may_hold(F.col("a"), F.col("b"))).select("id").collect()}
    assert set(range(5000)) <= passed and len(passed) < 5000 + 0.03 * 195_000
    none = KeyFilter(keys.limit(0), ["a", "b"])
    assert rows.where(none.may_hold(F.col("a"), F.col("b"))).count() == 0


def test_spans_equal_slices_of_the_lines(spark, files):
    draw = random.Random(4)
    texts = {f"f{n}.py": "".join(f"{'é' * draw.randrange(4)}{i}{draw.choice(BREAKS)}" for i in range(n)) for n in (0, 1, 5, 63, 64, 65, 128, 200, 201, 640, 1000)}
    texts["tail.py"] = texts["f640.py"] + "no end"
    spans = [("r", p, a, a + b) for p in texts for a in (0, 1, 2, 60, 64, 65, 66, 129, 199, 500, 999, 2000) for b in (0, 3, 70)]
    spans += [("r", "missing.py", 1, 1), ("other", "f5.py", 1, 1)]
    found = spark.createDataFrame(spans, "repo_id string, file_path string, line_start int, line_end int")
    for short, shown in ((0, blocks.Range(6, 5, 0)), (200, blocks.Range(21, 20, 200)), (200, blocks.Range(50, 50, 200)), (200, blocks.Range(3, 2, 0))):
        store = blocks.BlockStore(found, files(texts), short)
        rows = store.spans(found, shown).collect()
        sizes = {tuple(r[:4]): r.lengths for r in store.spans(found, shown, lengths_only=True).collect()}
        assert {tuple(r[:4]) for r in rows} == {s for s in spans if s[1] in texts and s[0] == "r"} == set(sizes)
        for r in rows:
            text = texts[r.file_path].replace("\r\n", "\n").replace("\r", "\n")
            lines = text.splitlines()
            start = 0 if len(lines) <= shown.short else max(r.line_start - shown.before, 0)
            end = len(lines) if len(lines) <= shown.short else min(len(lines), r.line_end + shown.after)
            assert (r.total_lines, r.start, r.end) == (len(lines), start, end)
            assert r.lines == lines[start : max(start, end)] and sizes[tuple(r[:4])] == [len(x) for x in r.lines]
            assert r.whole == (text if len(lines) <= short else None)


def shuffled_columns(df):
    """Columns of the inputs of all exchanges of the plans that a frame runs."""
    plan = df._jdf.queryExecution().toString()
    return set(re.findall(r"(\w+)#\d+", " ".join(x for x in plan.splitlines() if "Exchange" in x)))


def test_no_text_of_a_file_is_shuffled(spark, files, monkeypatch):
    """Neither the tables that are written on the way nor the results move `content` between tasks."""
    texts = {f"f{i}.py": "line\n" * 30 * i for i in range(1, 20)}
    found = spark.createDataFrame([("r", p, 3, 4, i, str(i), "sqli") for i, p in enumerate(texts)], "repo_id string, file_path string, line_start int, line_end int, seq bigint, id string, vuln_type string")
    plans, real = [], blocks.cut
    monkeypatch.setattr(blocks, "cut", lambda df: plans.append(df) or real(df))
    functions = spark.createDataFrame([], "repo_id string, file_path string, seq int, name string, line_start int, line_end int, parameters array<string>")
    plans.append(findings.with_snippets(found, files(texts)))
    plans.append(digest.finding_sections(found, files(texts), functions))
    plans.append(patches.original_code(found, files(texts)))
    assert len(plans) > 9
    for df in plans:
        exchanges = [x for x in df._jdf.queryExecution().executedPlan().treeString().splitlines()]
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        below = [i for i, line in enumerate(exchanges) if "content#" in line]
        for i in below:
            above = depth(exchanges[i])
            for line in reversed(exchanges[:i]):
                if depth(line) < above:
                    above = depth(line)
                    assert "Exchange" not in line or "content" not in line


def test_a_large_file_with_many_findings(spark, files):
    text = "some line of code that is as long as lines are\n" * 1_000_000
    rows = spark.range(10_000).select(F.lit("r").alias("repo_id"), F.lit("big.py").alias("file_path"), (F.col("id") * 97 + 1).cast("int").alias("line_start"))
    began = time.time()
    shown = findings.line_snippets(rows, files({"big.py": text}))
    assert shown.agg(F.count("*"), F.max(F.length("code_snippet"))).first()[0] == 10_000
    assert time.time() - began < 60

import fnmatch
import itertools
import math
import random
from collections import Counter
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from vulnloom.config import RuleConfig
from vulnloom.functions import paths, text
from vulnloom.operators.report import one_decimal, percent


def column(spark, values, fn, kind="string"):
    """`fn` applied to each value, in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r.out for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


def entropy(value):
    counts = Counter(value)
    return -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values()) if value else 0.0


def test_entropy(spark):
    values = ["", "aaaa", "abab", "aB3$kL9mNp2qRs5tUv8wXy", "aaabbb", "éé😀x"]
    values += ["".join(random.Random(i).choices("abcdefg\n😀", k=50)) for i in range(20)]
    found = column(spark, values, text.shannon_entropy)
    assert found == pytest.approx([entropy(v) for v in values])
    assert found[0] == found[1] == 0.0 and found[3] > 3.5 and found[4] < 1.5


def test_entropy_sorts_rare_characters_only(spark):
    values = [text.COMMON, text.COMMON * 3 + "Zß€😀", "".join(map(chr, range(32, 900))), " " * 500 + "漢字" * 9, "\n", "é"]
    assert len(text.COMMON.encode()) == len(text.COMMON) == len(set(text.COMMON))
    assert column(spark, values, text.shannon_entropy) == pytest.approx([entropy(v) for v in values])
    df = spark.createDataFrame([(v,) for v in values], "v string")
    plan = df.select(text.shannon_entropy(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(split(v" not in plan and "replace(" in plan


def test_line_definitions(spark):
    values = ["", "a", "a\n", "a\nb", "\n", "\n\n", "a\n\n", "a b", "a\x0cb\n", "a\x1fb", "x\x85"]
    assert column(spark, values, text.manifest_line_count) == [
        v.count("\n") + (0 if not v or v.endswith("\n") else 1) for v in values
    ]
    assert column(spark, values, text.parsed_line_count) == [v.count("\n") + 1 for v in values]
    assert column(spark, values, text.split_lines) == [v.splitlines() for v in values]
    assert column(spark, values, text.text_tokens) == [int(len(v) * 0.25) for v in values]


def test_newlines_and_decoding(spark):
    assert column(spark, ["a\r\nb\rc\n"], text.universal_newlines) == ["a\nb\nc\n"]
    assert column(spark, [b"ok \xff\r\nx"], text.decode_utf8, "binary") == ["ok �\nx"]


def test_snippet(spark):
    lines = "\n".join(f"l{i}" for i in range(1, 31))
    shown = lambda n: column(spark, [lines], lambda c: text.snippet(text.split_lines(c), F.lit(n), 5))[0]
    assert shown(1).split("\n") == [f"{i:4d} | l{i}" for i in range(1, 7)]
    assert shown(15).split("\n") == [f"{i:4d} | l{i}" for i in range(10, 21)]
    assert shown(30).split("\n")[-1] == "  30 | l30"
    assert shown(99) == ""


def test_normalize_path(spark):
    values = [
        "".join(p) for p in itertools.product(["", "/", "//", "///", "./", "././"], ["a", "a/b", ".a", "..", "a/../b"], ["", "/", "/.", "//c"])
    ]

    def expected(value):
        out = PurePosixPath(value).as_posix()
        while out.startswith("./"):
            out = out[2:]
        return out[1:] if out.startswith("/") else out

    assert column(spark, values, paths.normalize_path) == [expected(v) for v in values]
    assert [paths.normalized(v) for v in values] == [expected(v) for v in values]


def test_globs(spark):
    patterns = ["*.min.js", "src/*", "f?.py", "[ab]*.js", "[!ab]*", "x[", "a.b", "[]]x", "*[a-c].t\\s"]
    values = ["a.min.js", "src/a/b.py", "f1.py", "ff1.py", "b.js", "c.js", "x[", "a.b", "aXb", "]x", "d/b.t\\s", "a.min.js\n", "a\nb.min.js"]
    for pattern in patterns:
        found = column(spark, values, lambda c, p=pattern: c.rlike(paths.glob_regex(p)))
        assert found == [fnmatch.fnmatchcase(v, pattern) for v in values], pattern


def test_suffix_and_language(spark):
    values = ["a/main.go", "main.rs", "Main.java", "x.TSX", "y.mjs", "z.py", ".env", "a.b/Makefile", "dot.", "t.d.ts", "..py"]
    suffixes = [PurePosixPath(v).suffix.lower() if not v.endswith(".") else "" for v in values]
    assert column(spark, values, paths.suffix) == suffixes
    assert column(spark, values, paths.language) == [
        "go", "rust", "java", "typescript", "javascript", "python", None, None, None, "typescript", "python"
    ]


def test_risk_and_skips(spark):
    values = ["author.py", "monkey.js", "src/x.py", "a/lib/x.py", "lib.py", "docs/x.py", "SRC/x.py"]
    assert column(spark, values, paths.risk_level) == ["high", "high", "medium", "medium", "low", "low", "medium"]
    values = ["a/node_modules/x.js", ".github/x.py", "a/.hidden.py", "src/x.py", "build", "builds/x.py"]
    assert column(spark, values, paths.in_skipped_directory) == [True, True, True, False, True, False]
    values = [".env", "Dockerfile", "a/.x/k.pem", "k.pem", "notes.md", "LICENSE", "vendor/a.py", "a/.env.local"]
    assert column(spark, values, paths.in_secret_scope) == [True, True, False, True, False, True, False, True]


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("https://github.com/pallets/flask", ("pallets", "flask", None)),
        ("https://github.com/pallets/flask.git", ("pallets", "flask", None)),
        ("https://github.com/pallets/flask/", ("pallets", "flask", None)),
        ("  https://github.com/owner/repo\t\n", ("owner", "repo", None)),
        ("https://github.com/o/r/tree/feature/a/", ("o", "r", "feature/a")),
        ("https://gitlab.com/owner/repo", None),
        ("not a url at all", None),
    ],
)
def test_repo_url(spark, url, expected):
    found = column(spark, [url], paths.repo_url_parts)[0]
    assert (tuple(found) if found else None) == expected


def test_repo_name(spark):
    df = spark.createDataFrame([("https://github.com/example/sample-repo.git",), ("git@github.com:a/b",), (None,)], "v string")
    names = [r[0] for r in df.select(paths.repo_name(F.col("v"), F.lit("/tmp/dir/"))).collect()]
    assert names == ["example/sample-repo", "a/b", "dir"]


def test_relative_paths(spark):
    assert column(spark, ["/w/r/a.py", "/w/rx/a.py", "b.py"], lambda c: paths.relative_to(c, F.lit("/w/r/"))) == ["a.py", "/w/rx/a.py", "b.py"]
    assert column(spark, ["//a/b", "a/b"], paths.relative_uri) == ["a/b", "a/b"]


def test_python_rounding(spark):
    values = [i / 100 for i in range(0, 1001)] + [0.05, 6.25, 6.35, 9.95, 2.675] + [random.Random(1).random() * 10 for _ in range(500)]
    assert column(spark, values, one_decimal, "double") == [f"{v:.1f}" for v in values]
    shares = [i / 1000 for i in range(1001)]
    assert column(spark, shares, percent, "double") == [f"{v:.0%}" for v in shares]


def test_config_defaults_and_loading(tmp_path, spark, monkeypatch, caplog):
    monkeypatch.chdir(tmp_path)
    config = RuleConfig.load(tmp_path / "missing.yml")
    assert config == RuleConfig() and config.max_concurrent == 5
    path = tmp_path / "c.yml"
    path.write_text(
        "checks: {sqli: 'off', extra: 0}\nexclude: {paths: [generated/], patterns: ['*.gen.js']}\n"
        "min_severity: MEDIUM\nconfidence_threshold: 1.8\nllm: {max_concurrent: 70, max_retries: 4}\n"
    )
    config = RuleConfig.load(path)
    assert config.checks["sqli"] is False and config.checks["xss"] is True and config.checks["extra"] is False
    assert (config.exclude_paths, config.exclude_patterns) == (["generated/"], ["*.gen.js"])
    assert (config.min_severity, config.confidence_threshold, config.max_concurrent, config.max_retries) == ("medium", 1.0, 10, 4)
    path.write_text("checks: [")
    assert RuleConfig.load(path) == RuleConfig()
    assert any("Malformed YAML config" in r.message for r in caplog.records)
    assert RuleConfig.from_dict({"min_severity": "info"}).min_severity == "low"
    (tmp_path / ".vulnloom.yml").write_text("min_severity: high")
    assert RuleConfig.load().min_severity == "high"


def test_config_predicates(spark):
    config = RuleConfig(exclude_paths=["vendor/", "dist/"], exclude_patterns=["*.min.js", "*.spec.js"])
    values = ["vendor/lib/index.js", "dist/bundle.js", "src/app.js", "static/jquery.min.js", "src/w.spec.js", "a/vendor/x.js", "vendor"]
    assert column(spark, values, config.excludes) == [True, True, False, True, True, False, True]
    config = RuleConfig(checks={"sqli": False}, min_severity="medium")
    assert column(spark, ["sqli", "xss", "unknown"], config.enabled) == [False, True, True]
    assert column(spark, ["low", "MEDIUM", "high", "critical", "odd"], config.severe_enough) == [False, True, True, True, False]

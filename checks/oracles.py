"""Expected results as SQL over the same tables, one text per query in `checks.queries`."""

from __future__ import annotations

from checks.views import oracle
from vulnloom import constants as c

ORACLES: dict[str, str] = {}


def listed(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def pattern(words: list[str]) -> str:
    return "|".join(w.replace(".", "\\.") for w in words)


def contains_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


NAME = "split_part(relative_path, '/', -1)"
SUFFIX = rf"lower(regexp_extract({NAME}, '^.+(\.[^.]+)$', 1))"
LANGUAGE = f"CASE {SUFFIX} " + " ".join(f"WHEN '{s}' THEN '{n}'" for s, n in c.LANGUAGE_BY_SUFFIX.items()) + " END"
RISK = (
    f"CASE WHEN regexp_matches(lower(relative_path), '{pattern(c.HIGH_RISK_WORDS)}') THEN 'high' "
    f"WHEN regexp_matches(lower(relative_path), '(^|/)({pattern(c.MEDIUM_RISK_DIRECTORIES)})') THEN 'medium' ELSE 'low' END"
)
SKIPPED = f"lambda p: p IN ({listed(c.SKIPPED_DIRECTORIES)}) OR starts_with(p, '.')"
IN_SKIPPED = f"len(list_filter(string_split(relative_path, '/'), {SKIPPED})) > 0"
LINES = "(CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) - CASE WHEN ends_with(content, chr(10)) THEN 1 ELSE 0 END END)"

# Files outside skipped directories; source files; source files ranked within their repository.
FOUND = f"found AS (SELECT *, {LANGUAGE} AS language, {RISK} AS risk_level, {LINES} AS line_count FROM v_code WHERE NOT ({IN_SKIPPED}))"
RANKED = (
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY CASE risk_level WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, "
    "line_count DESC, string_split(relative_path, '/')) AS rank FROM found WHERE language IS NOT NULL)"
)
MANIFEST = [FOUND, RANKED, "manifest AS (SELECT * FROM ranked)"]
# Normalised paths of the changes that leave a file.
CHANGED = (
    "changed AS (SELECT DISTINCT repo_id, regexp_replace(regexp_replace(path, '^\\./', ''), '^/', '') AS relative_path "
    "FROM v_changed WHERE change_type IN ('A', 'C', 'M', 'R'))"
)


def code(query: str, *ctes: str, views: tuple[str, ...] = ()) -> str:
    return oracle(["v_code", *views], query, *ctes)


ORACLES["manifest_totals"] = code(
    """SELECT f.repo_id, f.n AS files_discovered, coalesce(m.n, 0) AS files_included, f.n - coalesce(m.n, 0) AS files_excluded,
 coalesce(m.lines, 0) AS total_lines, coalesce(m.lines, 0) * 10 AS total_estimated_tokens, coalesce(m.lines, 0) * 10 < 800000 AS fits_single_context
 FROM (SELECT repo_id, count(*) AS n FROM found GROUP BY 1) f
 LEFT JOIN (SELECT repo_id, count(*) AS n, CAST(sum(line_count) AS BIGINT) AS lines FROM manifest GROUP BY 1) m USING (repo_id)""",
    *MANIFEST,
)
ORACLES["manifest_maps"] = code(
    """SELECT r.repo_id, coalesce(l.j, '{}') AS languages, coalesce(k.j, '{}') AS risks FROM (SELECT DISTINCT repo_id FROM found) r
 LEFT JOIN (SELECT repo_id, '{' || string_agg('"' || language || '":' || n, ',' ORDER BY language) || '}' AS j
  FROM (SELECT repo_id, language, count(*) AS n FROM manifest GROUP BY 1, 2) GROUP BY 1) l USING (repo_id)
 LEFT JOIN (SELECT repo_id, '{' || string_agg('"' || risk_level || '":' || n, ',' ORDER BY risk_level) || '}' AS j
  FROM (SELECT repo_id, risk_level, count(*) AS n FROM manifest GROUP BY 1, 2) GROUP BY 1) k USING (repo_id)""",
    *MANIFEST,
)
ORACLES["language_breakdown"] = code("SELECT repo_id, language, count(*) AS files FROM manifest GROUP BY 1, 2", *MANIFEST)
ORACLES["risk_breakdown"] = code("SELECT repo_id, risk_level, count(*) AS files FROM manifest GROUP BY 1, 2", *MANIFEST)
ORACLES["risk_topn"] = code(
    "SELECT repo_id, rank, relative_path, language, risk_level, line_count, line_count * 10 AS estimated_tokens FROM ranked WHERE rank <= 10",
    FOUND, RANKED,
)
ORACLES["high_risk_files"] = code(
    "SELECT repo_id, relative_path, line_count FROM manifest WHERE risk_level = 'high'", *MANIFEST
)
ORACLES["line_counts"] = code(
    f"""SELECT repo_id, relative_path, {LINES} AS manifest_lines, len(string_split(content, chr(10))) AS parsed_lines, {LINES} AS split_lines,
 {LINES} * 10 AS manifest_tokens, length(content) // 4 AS text_tokens, strlen(content) AS size_bytes FROM v_code"""
)
ORACLES["path_normalize"] = r"""
SELECT page_id, array_to_string(list_filter(string_split(p, '/'), lambda x: x <> '' AND x <> '.'), '/') AS path FROM (
 SELECT page_id, concat(CASE WHEN page_id % 3 = 0 THEN './' ELSE '' END, regexp_replace(url, '^https?:/', ''),
  CASE WHEN page_id % 2 = 0 THEN '/.//x/' ELSE '' END) AS p FROM pages)"""
ORACLES["path_excluded"] = code(
    rf"""SELECT repo_id, relative_path, starts_with(relative_path, 'vendor/') OR starts_with(relative_path, 'docs/')
 OR ends_with(relative_path, '.min.js') OR regexp_matches(relative_path, '^f.\.p[xy]$') OR regexp_matches({NAME}, '^f.\.p[xy]$')
 OR NOT starts_with(relative_path, 'f') AS excluded FROM v_code"""
)
ORACLES["diff_scope"] = code(
    "SELECT repo_id, relative_path, risk_level FROM manifest SEMI JOIN changed USING (repo_id, relative_path)",
    *MANIFEST, CHANGED, views=("v_changed",),
)
ORACLES["scoped_totals"] = code(
    """SELECT f.repo_id, f.n AS files_discovered, coalesce(s.n, 0) AS files_included,
 f.n - coalesce(m.n, 0) + coalesce(m.n, 0) - coalesce(s.n, 0) AS files_excluded,
 coalesce(s.lines, 0) AS total_lines, coalesce(s.lines, 0) * 10 AS total_estimated_tokens
 FROM (SELECT repo_id, count(*) AS n FROM found GROUP BY 1) f LEFT JOIN (SELECT repo_id, count(*) AS n FROM manifest GROUP BY 1) m USING (repo_id)
 LEFT JOIN (SELECT repo_id, count(*) AS n, CAST(sum(line_count) AS BIGINT) AS lines FROM manifest SEMI JOIN changed USING (repo_id, relative_path)
  GROUP BY 1) s USING (repo_id)""",
    *MANIFEST, CHANGED, views=("v_changed",),
)
# Excluded by the default configuration: root-anchored folders and script bundles.
DEFAULT_EXCLUDED = (
    "(regexp_matches(relative_path, '^(node_modules|\\.git|vendor|dist|build)/') "
    "OR regexp_matches(relative_path, '\\.(min|bundle|test|spec)\\.js$'))"
)
ORACLES["scan_targets"] = code(
    f"SELECT repo_id, relative_path FROM v_code SEMI JOIN changed USING (repo_id, relative_path) WHERE NOT {DEFAULT_EXCLUDED}",
    CHANGED, views=("v_changed",),
)
PARENTS_SKIPPED = f"len(list_filter(string_split(relative_path, '/')[:-2], {SKIPPED})) > 0"
SECRET_SCOPE = (
    f"(({SUFFIX} IN ({listed(c.SECRET_FILE_SUFFIXES)}) OR lower({NAME}) IN ({listed(c.SECRET_FILE_NAMES)})) AND NOT ({PARENTS_SKIPPED}))"
)
ORACLES["secrets_scope_union"] = code(
    f"""SELECT repo_id, relative_path FROM v_code WHERE {SECRET_SCOPE} AND NOT {DEFAULT_EXCLUDED}
 UNION SELECT repo_id, relative_path FROM manifest WHERE NOT {DEFAULT_EXCLUDED}""",
    *MANIFEST,
)
ORACLES["snapshot_changes"] = code(
    """SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.relative_path, b.relative_path) AS path,
 CASE WHEN a.content IS NULL THEN 'A' WHEN b.content IS NULL THEN 'D' ELSE 'M' END AS change_type
 FROM v_files a FULL JOIN v_code b ON a.repo_id = b.repo_id AND a.relative_path = b.relative_path
 WHERE a.content IS DISTINCT FROM b.content"""
)

# ---- Structure --------------------------------------------------------------

# Lines of source files, with the text from that line on, and the first of the blank lines before it.
SOURCE_LINES = (
    "texts AS (SELECT repo_id, relative_path AS file_path, language, string_split(content, chr(10)) AS ls FROM found WHERE language IS NOT NULL), "
    "numbered AS (SELECT repo_id, file_path, language, ls, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM texts), "
    "lines AS (SELECT repo_id, file_path, language, ls, line, n, coalesce(max(CASE WHEN trim(line, ' ' || chr(9)) <> '' THEN n END) OVER "
    "(PARTITION BY repo_id, file_path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS first_blank FROM numbered)"
)
REST = "array_to_string(ls[n:], chr(10))"
PY_DEF = r"^(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)\s*(?:->[^\n]*)?:"
JS_DEF = r"function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>"
JAVA_METHOD = r"^\s*(?:public|private|protected)\s+(?:static\s+)?[\w<>\[\], ?]+\s+([A-Za-z_]\w*)\s*\("
DEFINED = (
    "defined AS ("
    f"SELECT repo_id, file_path, language, regexp_extract({REST}, '{PY_DEF}', 1) AS name, n, n AS first_blank, "
    f"array_to_string(list_transform(list_filter(string_split(regexp_extract({REST}, '{PY_DEF}', 2), ','), lambda p: regexp_replace(p, '\\s', '', 'g') <> ''), "
    "lambda p: split_part(split_part(regexp_replace(p, '^\\s+|\\s+$', '', 'g'), ':', 1), '=', 1)), '|') AS parameters "
    f"FROM lines WHERE language = 'python' AND regexp_matches(line, '^(async\\s+)?def\\s') AND regexp_matches({REST}, '{PY_DEF}') "
    f"UNION ALL SELECT repo_id, file_path, language, unnest(list_filter(list_concat(regexp_extract_all(line, '{JS_DEF}', 1), regexp_extract_all(line, '{JS_DEF}', 2)), "
    "lambda x: x <> '')), n, n, '' FROM lines WHERE language IN ('javascript', 'typescript') "
    "UNION ALL SELECT repo_id, file_path, language, regexp_extract(line, '^\\s*func\\s+(?:\\([^)]*\\)\\s*)?([A-Za-z_]\\w*)\\s*\\(', 1), n, first_blank, '' "
    "FROM lines WHERE language = 'go' AND regexp_matches(line, '^\\s*func\\s+(?:\\([^)]*\\)\\s*)?([A-Za-z_]\\w*)\\s*\\(') "
    "UNION ALL SELECT repo_id, file_path, language, regexp_extract(line, '^\\s*(?:pub\\s+)?fn\\s+([A-Za-z_]\\w*)\\s*[<(]', 1), n, first_blank, '' "
    "FROM lines WHERE language = 'rust' AND regexp_matches(line, '^\\s*(?:pub\\s+)?fn\\s+([A-Za-z_]\\w*)\\s*[<(]') "
    "UNION ALL SELECT repo_id, file_path, language, regexp_extract(line, '^\\s*(?:public|private|protected)?\\s*class\\s+([A-Za-z_]\\w*)', 1), n, first_blank, '' "
    "FROM lines WHERE language = 'java' AND regexp_matches(line, '^\\s*(?:public|private|protected)?\\s*class\\s+([A-Za-z_]\\w*)') "
    f"UNION ALL SELECT repo_id, file_path, language, regexp_extract(line, '{JAVA_METHOD}', 1), n, first_blank, '' "
    f"FROM lines WHERE language = 'java' AND regexp_matches(line, '{JAVA_METHOD}'))"
)
# What comments, strings and signs look like in each family of languages.
HIDDEN_C = r"/\*[\s\S]*?\*/|//[^\n]*"
LINE_STRING = r"""'[^'\\\n]*(?:\\.[^'\\\n]*)*'|"[^"\\\n]*(?:\\.[^"\\\n]*)*\""""
SIGNS_C = r"[\n(){}\[\];]"
TOKENS = {
    "javascript": "|".join([HIDDEN_C, LINE_STRING, r"`[^`\\]*(?:\\[\s\S][^`\\]*)*`", SIGNS_C]),
    "go": "|".join([HIDDEN_C, LINE_STRING, "`[^`]*`", SIGNS_C]),
    "rust": "|".join([HIDDEN_C, r'''r#"[\s\S]*?"#|"[^"\\]*(?:\\[\s\S][^"\\]*)*"|'(?:\\.[^\n']*|[^'\\\n])' '''.strip(), SIGNS_C]),
    "java": "|".join([HIDDEN_C, r'''"""[\s\S]*?"""''', LINE_STRING, SIGNS_C]),
    "python": "|".join(
        [r'''"""[\s\S]*?"""''', r"""'''[\s\S]*?'''""", LINE_STRING, r"#[^\n]*|\\\n|\n[ \t]*|[()\[\]{}]",
         r"""[^\s#"'()\[\]{}][^\n#"'()\[\]{}\\]*|["'\\]"""]
    ),
}
TOKENS["typescript"] = TOKENS["javascript"]
NEWLINES = "(length(t) - length(replace(t, chr(10), '')))"
# The tokens of the text from each definition's line on, with the brackets open after each and the line each ends on. An
# arrow function without a brace is looked at from its arrow on.
EXTENTS = (
    "outset AS (SELECT row_number() OVER () AS d, *, array_to_string(ls[n:], chr(10)) AS rest, "
    "language IN ('javascript', 'typescript') AND NOT regexp_matches(ls[n], 'function\\s+' || name) AS arrow FROM (SELECT DISTINCT d.*, l.ls FROM defined d "
    "JOIN lines l USING (repo_id, file_path, n))), "
    "headed AS (SELECT *, CASE WHEN arrow THEN substr(rest, strpos(rest, '=>') + 2) ELSE rest END AS body FROM outset), "
    "cut_up AS (" + " UNION ALL ".join(
        f"SELECT d, regexp_extract_all(body, '{regex.replace(chr(39), chr(39) * 2)}') AS ts FROM headed WHERE language = '{lang}'"
        for lang, regex in TOKENS.items()
    ) + "), "
    "tokens AS (SELECT d, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM cut_up), "
    f"signs AS (SELECT d, t, i, sum({NEWLINES}) OVER w AS down, sum(CASE WHEN t IN ('(', '[') THEN 1 WHEN t IN (')', ']') THEN -1 ELSE 0 END) OVER w AS round, "
    "sum(CASE WHEN t = '{' THEN 1 WHEN t = '}' THEN -1 ELSE 0 END) OVER w AS curly FROM tokens WINDOW w AS (PARTITION BY d ORDER BY i)), "
    "opened AS (SELECT d, arg_min(t, i) AS t, min(i) AS i, arg_min(down, i) AS down, arg_min(curly, i) AS curly FROM signs "
    "WHERE t IN ('{', ';') AND round = 0 GROUP BY d), "
    "closed AS (SELECT s.d, arg_min(s.down, s.i) AS down FROM signs s JOIN opened o ON s.d = o.d AND s.i > o.i AND s.t = '}' AND s.curly = o.curly - 1 GROUP BY s.d), "
    f"stopped AS (SELECT d, arg_min(down - CASE WHEN t = ';' THEN 0 ELSE 1 END, i) AS down FROM signs WHERE t IN (';', chr(10)) AND round + curly = 0 GROUP BY d), "
    "indented AS (SELECT s.d, min(s.i) AS i FROM signs s JOIN signs x ON x.d = s.d AND x.i = s.i + 1 WHERE s.t = chr(10) AND s.round + s.curly = 0 "
    "AND NOT starts_with(x.t, chr(10)) AND NOT starts_with(x.t, '#') GROUP BY s.d), "
    "coded AS (SELECT s.d, max(s.down) AS down FROM signs s LEFT JOIN indented e USING (d) WHERE (e.i IS NULL OR s.i < e.i) AND NOT starts_with(s.t, chr(10)) "
    "AND NOT starts_with(s.t, '#') AND s.t <> chr(92) || chr(10) GROUP BY s.d), "
    "ended AS (SELECT h.*, CAST(n + CASE WHEN language = 'python' THEN g.down "
    "WHEN arrow AND NOT starts_with(ltrim(body, ' ' || chr(9) || chr(10)), '{') THEN coalesce(z.down, len(ls) - n) "
    "WHEN o.t = '{' THEN coalesce(k.down, len(ls) - n) WHEN o.t = ';' THEN o.down ELSE 0 END AS INTEGER) AS e "
    "FROM headed h LEFT JOIN opened o USING (d) LEFT JOIN closed k USING (d) LEFT JOIN stopped z USING (d) LEFT JOIN coded g USING (d))"
)
ORACLES["function_defs"] = code(
    "SELECT repo_id, file_path, name, first_blank AS line_start, parameters FROM defined", FOUND, SOURCE_LINES, DEFINED
)
ORACLES["function_lines"] = code(
    "SELECT language, name, count(*) AS functions, CAST(sum(n) AS BIGINT) AS lines, CAST(sum(e) AS BIGINT) AS ends, max(e) AS last_line FROM ended GROUP BY 1, 2",
    FOUND, SOURCE_LINES, DEFINED, EXTENTS,
)
JS_IMPORT = r"""import\s+[^\n]*?from\s+['"]([^'"]+)['"]|require\s*\(\s*['"]([^'"]+)['"]\s*\)""".replace("'", "''")
IMPORTED = (
    rf"""imported AS (
 SELECT repo_id, file_path, language, regexp_replace(regexp_extract(line, '^(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))', 1)
  || regexp_extract(line, '^(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))', 2), '\s', '') AS module, n FROM lines
  WHERE language = 'python' AND regexp_matches(line, '^(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))')
 UNION ALL SELECT repo_id, file_path, language, unnest(list_filter(list_concat(regexp_extract_all(line, '{JS_IMPORT}', 1), regexp_extract_all(line, '{JS_IMPORT}', 2)),
  lambda x: x <> '')), n FROM lines WHERE language IN ('javascript', 'typescript')
 UNION ALL SELECT repo_id, file_path, language, regexp_extract(line, '^\s*import\s+"([^"]+)"', 1), first_blank FROM lines
  WHERE language = 'go' AND regexp_matches(line, '^\s*import\s+"([^"]+)"')
 UNION ALL SELECT repo_id, file_path, language, unnest(regexp_extract_all(regexp_extract({REST}, '(?s)^\s*import\s*\((.*?)\)', 1), '"([^"]+)"', 1)), first_blank
  FROM lines WHERE language = 'go' AND regexp_matches(line, '^\s*import\s*\(')
 UNION ALL SELECT repo_id, file_path, language, regexp_extract({REST}, '^\s*use\s+([^;]+);', 1), first_blank FROM lines
  WHERE language = 'rust' AND regexp_matches(line, '^\s*use\s') AND regexp_matches({REST}, '^\s*use\s+([^;]+);')
 UNION ALL SELECT repo_id, file_path, language, regexp_extract(line, '^\s*extern\s+crate\s+([A-Za-z_]\w*)\s*;', 1), first_blank FROM lines
  WHERE language = 'rust' AND regexp_matches(line, '^\s*extern\s+crate\s+([A-Za-z_]\w*)\s*;')
 UNION ALL SELECT repo_id, file_path, language, regexp_extract(line, '^\s*import\s+([\w.]+\*?)\s*;', 1), first_blank FROM lines
  WHERE language = 'java' AND regexp_matches(line, '^\s*import\s+([\w.]+\*?)\s*;')
 )"""
)
ORACLES["imports_by_module"] = code(
    "SELECT repo_id, language, module, count(*) AS files, CAST(sum(n) AS BIGINT) AS lines FROM imported GROUP BY 1, 2, 3",
    FOUND, SOURCE_LINES, IMPORTED,
)
DANGEROUS = (
    "dangers AS ("
    + " UNION ALL ".join(
        f"SELECT '{lang}' AS language, '{n}' AS name, {plain} AS plain"
        for lang, names, plain in [
            ("python", c.DANGEROUS_PYTHON, "true"),
            ("javascript", c.DANGEROUS_JAVASCRIPT, "true"),
            ("typescript", c.DANGEROUS_JAVASCRIPT, "true"),
            ("go", c.DANGEROUS_GO, "false"),
            ("rust", c.DANGEROUS_RUST, "false"),
            ("java", c.DANGEROUS_JAVA, "false"),
        ]
        for n in names
    )
    + "), calls AS (SELECT repo_id, file_path, name, n AS line, trim(line, ' ' || chr(9)) AS arguments_text FROM lines JOIN dangers USING (language) "
    "WHERE CASE WHEN plain THEN contains(line, '(') AND contains(line, name) ELSE regexp_matches(line, name) END)"
)
ORACLES["dangerous_calls"] = code("SELECT * FROM calls", FOUND, SOURCE_LINES, DANGEROUS)
ORACLES["dangerous_names"] = """
SELECT event_id, event_type || CASE event_id % 4 WHEN 0 THEN '.eval' WHEN 1 THEN '.document.write' WHEN 2 THEN 'eval' ELSE '.innerHTML' END AS name, event_id % 4 = 0 AS in_python,
 event_id % 4 IN (0, 1, 3) AS in_javascript FROM events"""
ORACLES["parse_summary"] = code(
    """SELECT repo_id, m.n AS files, coalesce(d.n, 0) AS functions, coalesce(k.n, 0) AS dangerous_calls
 FROM (SELECT repo_id, count(*) AS n FROM manifest GROUP BY 1) m LEFT JOIN (SELECT repo_id, count(*) AS n FROM defined GROUP BY 1) d USING (repo_id)
 LEFT JOIN (SELECT repo_id, count(*) AS n FROM calls GROUP BY 1) k USING (repo_id)""",
    *MANIFEST, SOURCE_LINES, DEFINED, DANGEROUS,
)
REQUIREMENT = r"^([A-Za-z0-9_.-]+)\s*([><=!~]+.*)?"
BARE = "trim(line, ' ' || chr(9) || chr(13))"
DEPENDENCIES = (
    "mlines AS (SELECT repo_id, relative_path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n "
    "FROM v_manifests), deps AS ("
    f"SELECT repo_id, 'python' AS ecosystem, regexp_extract({BARE}, '{REQUIREMENT}', 1) AS name, nullif(regexp_extract({BARE}, '{REQUIREMENT}', 2), '') AS version_spec, "
    "split_part(relative_path, '/', -1) AS source_file, relative_path AS manifest_file, row_number() OVER (PARTITION BY repo_id, relative_path ORDER BY n) - 1 AS position "
    f"FROM mlines WHERE relative_path IN ('requirements.txt', 'requirements/dev.txt') AND regexp_matches({BARE}, '^[A-Za-z0-9_.]') "
    "UNION ALL SELECT concat('d', doc_id), 'python', unnest([source, lang]), NULL, 'pyproject.toml', 'pyproject.toml', unnest([0, 1]) FROM documents WHERE doc_id % 5 = 2 "
    "UNION ALL SELECT concat('d', doc_id), 'javascript', unnest([source, lang]), unnest([concat('^', n_chars), concat('~', doc_id)]), 'package.json', 'package.json', "
    "unnest([0, 1]) FROM documents WHERE doc_id % 5 = 3)"
)
ORACLES["dependency_rows"] = oracle(["v_manifests"], "SELECT * FROM deps", DEPENDENCIES)
ORACLES["dependency_rows_per_glob"] = oracle(
    ["v_manifests"],
    "SELECT ecosystem, manifest_file, count(*) * CASE WHEN manifest_file = 'requirements.txt' THEN 2 ELSE 1 END AS dependencies FROM deps GROUP BY 1, 2",
    DEPENDENCIES,
)
ORACLES["manifest_files_found"] = oracle(["v_manifests"], "SELECT DISTINCT repo_id, manifest_file FROM deps", DEPENDENCIES)

# ---- Detection --------------------------------------------------------------

# The rule expressions, with their languages and confidence.
RULE_TABLE = [
    ("sqli-python-fstring", ["python"], r"""\.execute\s*\(\s*[fF]["'].*\{[^}]+\}""", 0.9),
    ("sqli-python-format", ["python"], r"""\.execute\s*\(\s*(?:"[^"]*"|'[^']*')\s*\.format\s*\(""", 0.9),
    ("sqli-python-percent", ["python"], r"""\.execute\s*\(\s*(?:"[^"]*"|'[^']*')\s*%""", 0.9),
    ("sqli-python-concat", ["python"], r"""\.execute\s*\(\s*(?:"[^"]*"|'[^']*'|[\w.]+)\s*\+""", 0.9),
    ("sqli-python-raw-text-exec", ["python"], r"""\.execute\s*\(\s*text\s*\(\s*[A-Za-z_][\w.]*\s*\)""", 0.7),
    ("sqli-js-template-literal", ["javascript", "typescript"], r"""\.query\s*\(\s*`[^`]*\$\{[^}]+\}""", 0.9),
    ("sqli-js-concat", ["javascript", "typescript"], r"""\.query\s*\(\s*(?:"[^"]*"|'[^']*'|[\w.]+)\s*\+""", 0.9),
    ("sqli-js-raw-sequelize", ["javascript", "typescript"], r"""\.query\s*\(\s*[A-Za-z_$][\w.$]*\s*[,)]""", 0.7),
]
RULE_HITS = (
    "code_lines AS (SELECT repo_id, relative_path, relative_path AS file_path, content, "
    f"{LANGUAGE} AS language, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM v_code), "
    "rules AS ("
    + " UNION ALL ".join(
        f"SELECT '{rule}' AS rule_id, '{lang}' AS language, '{regex.replace(chr(39), chr(39) * 2)}' AS regex, CAST({conf} AS DOUBLE) AS confidence"
        for rule, langs, regex, conf in RULE_TABLE
        for lang in langs
    )
    + "), rule_hits AS (SELECT repo_id, file_path, relative_path, n AS line_start, rule_id, 'sqli' AS vuln_type, 'semgrep' AS detection_method, confidence "
    "FROM code_lines JOIN rules USING (language) WHERE strlen(content) <= 1000000 AND regexp_matches(line, regex))"
)
ORACLES["rule_scan"] = code(
    "SELECT repo_id, file_path, line_start, rule_id, vuln_type, confidence FROM rule_hits", RULE_HITS
)
CREDENTIAL = r"""(?i)\b\w*(?:api_?key|secret|token|password|passwd)\w*\s*[:=]\s*["''']([^"'''\s]{8,})["''']""".replace("'''", "''")
PLACEHOLDER = r"(?i)your[_-]?|change_?me|placeholder|insert[_-]|<[^>]*>|\$\{|\{\{|^x{4,}|\*{3,}|dummy|redacted|todo|none$|null$"
ENVIRONMENT = r"os\.environ|os\.getenv|\bgetenv\s*\(|process\.env"
TEST_FILE = rf"regexp_matches(lower({NAME}), '^(?:test_.*|conftest\.py)$|_test\.[a-z]+$|\.(?:test|spec)\.[a-z]+$')"
LIVE = f"list_filter(regexp_extract_all(line, '{CREDENTIAL}', 1), lambda v: NOT regexp_matches(v, '{PLACEHOLDER}'))"


def shaped(rule: str, regex: str, confidence: float) -> str:
    return (
        f"SELECT repo_id, file_path, relative_path, n AS line_start, '{rule}' AS rule_id, 'regex' AS detection_method, CAST({confidence} AS DOUBLE) AS confidence "
        f"FROM secret_lines WHERE len(list_filter(regexp_extract_all(line, '{regex}'), lambda v: NOT regexp_matches(v, '{PLACEHOLDER}'))) > 0"
    )


SECRET_HITS = (
    f"secret_lines AS (SELECT * FROM code_lines WHERE ({SECRET_SCOPE} OR (language IS NOT NULL AND NOT ({IN_SKIPPED}))) AND NOT {TEST_FILE}), secret_hits AS ("
    + " UNION ALL ".join(
        [
            shaped("secret-aws-access-key", r"\bAKIA[0-9A-Z]{16}\b", 0.95),
            shaped("secret-github-token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", 0.95),
            shaped("secret-private-key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0.95),
            shaped("secret-bcrypt-hash", r"\$2[aby]\$\d{2}\$[./A-Za-z0-9]{53}", 0.8),
            f"SELECT repo_id, file_path, relative_path, n, 'secret-credential', 'regex', 0.6 FROM secret_lines WHERE len({LIVE}) > 0 AND NOT regexp_matches(line, '{ENVIRONMENT}')",
            "SELECT repo_id, file_path, relative_path, n, 'secret-high-entropy', 'entropy', 0.75 FROM secret_lines "
            f"WHERE len(list_filter({LIVE}, lambda v: list_entropy(string_split(v, '')) >= 3.5)) > 0 AND NOT regexp_matches(line, '{ENVIRONMENT}')",
        ]
    )
    + ")"
)
ORACLES["secret_tokens"] = code(
    "SELECT repo_id, file_path, line_start, rule_id, detection_method, confidence FROM secret_hits", RULE_HITS, SECRET_HITS
)
ORACLES["secret_suppressed"] = code(
    f"""SELECT repo_id, count(*) FILTER (regexp_matches(line, '{CREDENTIAL}')) AS quoted,
 count(*) FILTER (len({LIVE}) > 0 AND NOT regexp_matches(line, '{ENVIRONMENT}')) AS reported,
 count(*) FILTER (regexp_matches(line, '{CREDENTIAL}') AND regexp_matches(line, '{ENVIRONMENT}')) AS environment,
 count(*) FILTER (regexp_matches(line, '{CREDENTIAL}') AND {TEST_FILE}) AS in_tests FROM code_lines GROUP BY 1""",
    RULE_HITS,
)
ORACLES["secret_entropy"] = (
    "SELECT doc_id, round(CASE WHEN text = '' THEN 0.0 ELSE list_entropy(string_split(text, '')) END, 6) AS entropy FROM documents"
)
EITHER = lambda words: f"({contains_any('rule', words)} OR {contains_any('msg', words)})"
CLASSIFY = (
    "CASE "
    + " ".join(f"WHEN contains(rule, '{w}') THEN '{t}'" for w, t in c.RULE_ID_KEYWORDS)
    + f" WHEN {EITHER(c.SQLI_KEYWORDS)} THEN 'sqli' WHEN {contains_any('msg', c.EVAL_KEYWORDS)} THEN 'sqli'"
    f" WHEN {EITHER(c.SECRET_KEYWORDS)} THEN 'hardcoded_secret' WHEN {EITHER(c.XSS_KEYWORDS)} THEN 'xss' END"
)
ORACLES["vuln_classify"] = code(
    f"""SELECT doc_id, coalesce(t, 'none') AS vuln_type, t IN ('sqli', 'xss') AS targeted
 FROM (SELECT doc_id, {CLASSIFY} AS t FROM (SELECT doc_id, lower(concat('rule.', relative_path)) AS rule, lower(content) AS msg FROM v_code))"""
)
ORACLES["detection_findings"] = code(
    f"""SELECT repo_id, vuln_type, count(*) AS findings FROM (
 SELECT repo_id, file_path, line_start, vuln_type, row_number() OVER (PARTITION BY repo_id, file_path, line_start ORDER BY confidence DESC, detector, rule_id) AS k
 FROM (SELECT repo_id, file_path, relative_path, line_start, rule_id, confidence, vuln_type, 0 AS detector FROM rule_hits
  UNION ALL SELECT repo_id, file_path, relative_path, line_start, rule_id, confidence, 'hardcoded_secret', 1 FROM secret_hits)
 WHERE NOT {DEFAULT_EXCLUDED}) WHERE k = 1 GROUP BY 1, 2""",
    RULE_HITS, SECRET_HITS,
)
DROPPED = "CASE WHEN vuln_type = 'deserialization' THEN 'd' WHEN starts_with(file_path, 'vendor/') THEN 'p' ELSE 'k' END"
ORACLES["finding_filter"] = oracle(
    ["v_raw_findings"],
    f"""SELECT repo_id, count(*) FILTER ({DROPPED} = 'd') AS disabled_checks, count(*) FILTER ({DROPPED} = 'p') AS excluded_paths,
 count(*) FILTER ({DROPPED} = 'k') AS kept FROM v_raw_findings GROUP BY 1""",
)
ORACLES["finding_dedup"] = oracle(
    ["v_raw_findings"],
    f"""SELECT repo_id, file_path, line_start, seq, vuln_type, confidence, detection_method, first_seq FROM (
 SELECT *, row_number() OVER (PARTITION BY repo_id, file_path, line_start ORDER BY confidence DESC, seq) AS k,
  min(seq) OVER (PARTITION BY repo_id, file_path, line_start) AS first_seq FROM v_raw_findings WHERE {DROPPED} = 'k') WHERE k = 1""",
)
ORACLES["finding_order"] = oracle(
    ["v_raw_findings"],
    """SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY first_seq) AS seq, file_path, line_start
 FROM (SELECT repo_id, file_path, line_start, min(seq) AS first_seq FROM v_raw_findings GROUP BY 1, 2, 3)""",
)
SPLIT = (
    "split AS (SELECT repo_id, relative_path AS file_path, relative_path, content, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls "
    "FROM (SELECT *, string_split(content, chr(10)) AS ls FROM v_code))"
)
NUMBERED = "printf('%4d | %s', i, ls[i])"
ORACLES["finding_context"] = code(
    f"""SELECT id, line_start, coalesce(array_to_string(list_transform(range(greatest(line_start - 5, 1), least(len(ls), line_start + 5) + 1),
 lambda i: {NUMBERED}), chr(10)), '') AS code_snippet FROM v_code_findings LEFT JOIN split USING (repo_id, file_path)""",
    SPLIT, views=("v_code_findings",),
)
ORACLES["scanner_import"] = """
SELECT concat('u', user_id) AS repo_id, 'xss' AS vuln_type, event_type || '.js' AS file_path, event_id AS line_start,
 CASE WHEN event_id % 4 <> 1 THEN event_id + 2 ELSE event_id END AS line_end,
 CAST(CASE WHEN event_id % 4 = 3 THEN 0.7 WHEN value > 50 THEN 0.9 ELSE 0.5 END AS DOUBLE) AS confidence,
 CASE WHEN event_id % 4 <> 2 THEN 'uses innerHTML on ' || event_type ELSE 'Semgrep rule rules.xss-' || event_type || ' triggered' END AS message,
 CASE WHEN event_id % 4 <> 0 THEN 'rules.xss-' || event_type ELSE 'unknown' END AS rule_id,
 CASE WHEN event_id % 4 = 3 THEN 'WARNING' WHEN value > 50 THEN 'ERROR' ELSE 'INFO' END AS severity FROM events"""

# ---- Digest -----------------------------------------------------------------

CONTAINING = (
    "located AS (SELECT f.*, (SELECT min(struct_pack(shape := NOT contains(d.body, 'class ' || d.name), n := d.n, name := d.name, e := d.e, "
    "parameters := d.parameters)) FROM ended d WHERE d.repo_id = f.repo_id AND d.file_path = f.file_path AND f.line_start BETWEEN d.n AND d.e) AS d "
    "FROM v_code_findings f)"
)
ORACLES["containing_function"] = code(
    "SELECT id, line_start, d.name AS function FROM located WHERE d IS NOT NULL",
    FOUND, SOURCE_LINES, DEFINED, EXTENTS, CONTAINING, views=("v_code_findings",),
)
ORACLES["structure_section"] = code(
    """SELECT repo_id, 'Project Structure' AS heading, body AS content, length(body) // 4 AS estimated_tokens FROM (
 SELECT r.repo_id, '```' || chr(10) || coalesce(string_agg(relative_path || ' (' || line_count || ' lines)' || CASE risk_level WHEN 'high' THEN ' [HIGH RISK]'
  WHEN 'medium' THEN ' [MED]' ELSE '' END || chr(10), '' ORDER BY rank), '') || '```' AS body
 FROM (SELECT DISTINCT repo_id FROM v_code) r LEFT JOIN manifest m USING (repo_id) GROUP BY 1)""",
    *MANIFEST,
)
ORACLES["dependency_section"] = oracle(
    ["v_manifests"],
    """SELECT repo_id, 'Dependencies' AS heading, body AS content, length(body) // 4 AS estimated_tokens FROM (
 SELECT repo_id, CASE WHEN content <> '' AND relative_path IN ('requirements.txt', 'pyproject.toml', 'package.json')
  THEN '### ' || relative_path || chr(10) || '```' || CASE WHEN relative_path = 'package.json' THEN 'json' ELSE '' END || chr(10) || content || chr(10) || '```'
  ELSE 'No dependency manifests found.' END AS body FROM v_manifests)""",
)
FINDING_TEXT = (
    f"excerpts AS (SELECT l.*, ls, CASE WHEN len(ls) <= 200 THEN 1 ELSE greatest(line_start - 20, 1) END AS a, "
    "CASE WHEN len(ls) <= 200 THEN len(ls) ELSE least(len(ls), line_end + 20) END AS b FROM located l LEFT JOIN split USING (repo_id, file_path)), "
    "finding_text AS (SELECT *, '### ' || file_path || ' (lines ' || a || '-' || b || ', finding at L' || line_start || ')' || chr(10) || '```' || "
    "CASE WHEN ends_with(file_path, '.py') THEN 'python' ELSE 'javascript' END || chr(10) || array_to_string(list_transform(range(a, b + 1), "
    f"lambda i: CASE WHEN i BETWEEN line_start AND line_end THEN '>>> ' ELSE '    ' END || {NUMBERED}), chr(10)) || chr(10) || '```' || "
    "CASE WHEN d IS NULL THEN '' ELSE chr(10) || chr(10) || '### Containing function: `' || d.name || '` (L' || d.n || '-' || d.e || ')' || chr(10) || "
    "'Parameters: ' || replace(d.parameters, '|', ', ') END AS body FROM excerpts)"
)
ORACLES["finding_section"] = code(
    """SELECT repo_id, seq AS pos, 'Finding Context: ' || vuln_type || ' in ' || file_path || ':' || line_start AS heading, body AS content,
 length(body) // 4 AS estimated_tokens FROM finding_text""",
    FOUND, SOURCE_LINES, DEFINED, EXTENTS, CONTAINING, SPLIT, FINDING_TEXT, views=("v_code_findings",),
)
FILE_TEXT = (
    "file_text AS (SELECT m.repo_id, m.relative_path, m.rank, m.risk_level, m.language, m.content = '' AS empty, len(ls) AS n, CASE WHEN m.content = '' THEN '(empty or unreadable)' ELSE "
    "'```' || CASE WHEN m.language = 'python' THEN 'python' ELSE 'javascript' END || chr(10) || array_to_string(list_transform(range(1, len(ls) + 1), "
    f"lambda i: {NUMBERED}), chr(10)) || chr(10) || '```' END AS body FROM manifest m JOIN split s ON s.repo_id = m.repo_id AND s.file_path = m.relative_path "
    "WHERE m.risk_level <> 'low')"
)
ORACLES["file_section"] = code(
    """SELECT repo_id, CASE WHEN empty THEN 5 WHEN risk_level = 'high' THEN 3 ELSE 4 END AS priority,
 CASE WHEN empty THEN 'File: ' || relative_path ELSE 'File: ' || relative_path || ' (' || n || ' lines, ' || risk_level || ' risk)' END AS heading,
 body AS content, length(body) // 4 AS estimated_tokens FROM file_text
 WHERE NOT EXISTS (SELECT 1 FROM v_some_findings f WHERE f.repo_id = file_text.repo_id AND f.file_path = file_text.relative_path)""",
    *MANIFEST, SPLIT, FILE_TEXT, views=("v_some_findings",),
)


def packing(sections: str, budget: int) -> str:
    """Greedy walk, one section per step, over a table of (repo_id, priority, kind, pos, tokens)."""
    return (
        "RECURSIVE ordered AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY priority, kind, pos) AS rn "
        f"FROM {sections}), walk AS (SELECT DISTINCT repo_id, CAST(0 AS BIGINT) AS rn, CAST({budget} AS BIGINT) AS budget, false AS kept FROM ordered "
        "UNION ALL SELECT w.repo_id, o.rn, CASE WHEN o.tokens <= w.budget THEN w.budget - o.tokens ELSE w.budget END, o.tokens <= w.budget "
        "FROM walk w JOIN ordered o ON o.repo_id = w.repo_id AND o.rn = w.rn + 1), "
        "packed AS (SELECT o.*, w.kept FROM ordered o JOIN walk w ON w.repo_id = o.repo_id AND w.rn = o.rn)"
    )


DOCUMENT_SECTIONS = (
    "sections AS (SELECT source AS repo_id, CAST(doc_id % 4 AS INT) AS priority, 2 AS kind, doc_id AS pos, concat('File: ', doc_id) AS heading, "
    "text AS content, length(text) // 4 AS tokens FROM documents)"
)
PACKED = "SELECT repo_id, priority, kind, pos FROM packed WHERE kept"
ORACLES["digest_pack"] = oracle([], PACKED, DOCUMENT_SECTIONS, packing("sections", 9000))
ORACLES["digest_pack_in_rounds"] = ORACLES["digest_pack"]
ORACLES["digest_totals"] = oracle(
    [],
    """SELECT repo_id, CAST(sum(CASE WHEN kept THEN tokens ELSE 0 END) AS BIGINT) AS total_estimated_tokens, count(*) FILTER (kept) AS files_included,
 count(*) FILTER (NOT kept) AS files_excluded, count(*) FILTER (NOT kept) > 0 AS truncated FROM packed GROUP BY 1""",
    DOCUMENT_SECTIONS, packing("sections", 9000),
)
ORACLES["digest_render"] = oracle(
    [],
    """SELECT repo_id, part, string_agg('## ' || heading || chr(10) || chr(10) || content || chr(10), chr(10) ORDER BY rn) AS text FROM (
 SELECT *, (rn - 1) // 1000 AS part FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY priority, kind, pos) AS rn FROM sections)) GROUP BY 1, 2""",
    DOCUMENT_SECTIONS,
)
BUILT = (
    "built AS (SELECT repo_id, 0 AS priority, 0 AS kind, CAST(0 AS BIGINT) AS pos, 'Project Structure' AS heading, length(body) // 4 AS tokens FROM ("
    "SELECT r.repo_id, '```' || chr(10) || coalesce(string_agg(relative_path || ' (' || line_count || ' lines)' || CASE risk_level WHEN 'high' THEN ' [HIGH RISK]' "
    "WHEN 'medium' THEN ' [MED]' ELSE '' END || chr(10), '' ORDER BY rank), '') || '```' AS body "
    "FROM (SELECT DISTINCT repo_id FROM v_code) r LEFT JOIN manifest m USING (repo_id) GROUP BY 1) "
    "UNION ALL SELECT DISTINCT repo_id, 1, 1, 0, 'Dependencies', length('No dependency manifests found.') // 4 FROM v_code "
    "UNION ALL SELECT repo_id, 2, 2, seq, 'Finding Context: ' || vuln_type || ' in ' || file_path || ':' || line_start, length(body) // 4 FROM finding_text "
    "UNION ALL SELECT repo_id, CASE WHEN empty THEN 5 WHEN risk_level = 'high' THEN 3 ELSE 4 END, CASE WHEN risk_level = 'high' THEN 3 ELSE 4 END, rank, "
    "CASE WHEN empty THEN 'File: ' || relative_path ELSE 'File: ' || relative_path || ' (' || n || ' lines, ' || risk_level || ' risk)' END, "
    "CASE WHEN empty THEN 10 ELSE length(body) // 4 END FROM file_text WHERE NOT EXISTS "
    "(SELECT 1 FROM v_code_findings f WHERE f.repo_id = file_text.repo_id AND f.file_path = file_text.relative_path))"
)
# Functions keep the line of their definition only, so the containing function is the one on the line.
FROM_BLANK = CONTAINING.replace("BETWEEN d.n AND d.e", "BETWEEN d.first_blank AND d.e").replace("n := d.n", "n := d.first_blank")
ORACLES["digest_build"] = code(
    "SELECT repo_id, priority, kind, pos, heading, tokens AS estimated_tokens FROM packed WHERE kept",
    *MANIFEST, SOURCE_LINES, DEFINED, EXTENTS, FROM_BLANK, SPLIT, FINDING_TEXT, FILE_TEXT, BUILT, packing("built", 20_000),
    views=("v_code_findings",),
)
ORACLES["section_context"] = code(
    r"""SELECT w.repo_id, w.file_path, min(s.pos) AS pos FROM (
 SELECT repo_id, file_path FROM v_code_findings UNION SELECT repo_id, regexp_replace(split_part(file_path, '/', -1), '^f[0-9]', '') FROM v_code_findings
 UNION SELECT repo_id, 'in ' || split_part(file_path, '/', -1) FROM v_code_findings) w
 JOIN (SELECT repo_id, seq AS pos, 'Finding Context: ' || vuln_type || ' in ' || file_path || ':' || line_start AS heading FROM v_code_findings) s
 ON s.repo_id = w.repo_id AND contains(s.heading, w.file_path) WHERE w.file_path <> '' GROUP BY 1, 2""",
    views=("v_code_findings",),
)

# ---- Verdicts ---------------------------------------------------------------

FENCED = r"regexp_extract(content, '(?s)```(?:json)?\s*\n?(.*?)\n?```', 1)"
BRACES = "substr(content, instr(content, '{'), length(content) - instr(reverse(content), '}') + 2 - instr(content, '{'))"
JSON = (
    f"CASE WHEN json_valid(content) THEN content WHEN json_valid({FENCED}) THEN {FENCED} "
    f"WHEN contains(content, '{{') AND json_valid({BRACES}) THEN {BRACES} END"
)
REPLIES = f"replies AS (SELECT *, {JSON} AS found, CASE WHEN success THEN {JSON} END AS j FROM v_responses)"
ORACLES["json_extract"] = oracle(
    ["v_responses"],
    """SELECT stage, finding_id, coalesce(json_type(found) = 'OBJECT', false) AS is_object,
 CASE WHEN json_type(found) = 'OBJECT' THEN json_extract_string(found, '$.severity') END AS severity,
 CASE WHEN json_type(found) = 'OBJECT' THEN json_extract_string(found, '$.final_verdict') END AS verdict FROM replies""",
    REPLIES,
)
OUTCOME = (
    "CASE WHEN j IS NULL OR j = '{}' THEN 'missing' WHEN json_extract_string(j, '$.is_vulnerable') IN ('false', '0') THEN "
    "CASE WHEN json_type(j, '$.reasoning') = 'NULL' THEN 'error' ELSE 'rejected' END "
    "WHEN json_type(j, '$.cvss_estimate') = 'NULL' THEN 'error' ELSE 'accepted' END"
)
SEVERITY = (
    "CASE WHEN outcome = 'accepted' AND json_extract_string(j, '$.severity') IN ('critical', 'high', 'medium', 'low') "
    "THEN json_extract_string(j, '$.severity') ELSE 'medium' END"
)
ANALYZED = (
    "joined AS (SELECT f.*, r.j FROM v_event_findings f LEFT JOIN replies r ON r.repo_id = f.repo_id AND r.finding_id = f.id AND r.stage = 'analyze'), "
    f"judged AS (SELECT *, {OUTCOME} AS outcome FROM joined), "
    f"analyzed AS (SELECT *, {SEVERITY} AS severity, "
    "CASE WHEN outcome = 'accepted' THEN CAST(json_extract_string(j, '$.cvss_estimate') AS DOUBLE) ELSE 5.0 END AS cvss_estimate, "
    "CASE outcome WHEN 'accepted' THEN json_extract_string(j, '$.reasoning') WHEN 'error' THEN "
    f"'{c.ANALYSIS_ERROR}' ELSE '{c.ANALYSIS_MISSING}' END AS reasoning, "
    f"CASE WHEN outcome = 'accepted' THEN '{c.NO_IMPACT}' ELSE '{c.ANALYSIS_MISSING_IMPACT}' END AS blast_radius, "
    "CASE WHEN outcome = 'accepted' THEN json_extract_string(j, '$.is_reachable') END AS reachable FROM judged)"
)
EVENTS = ["v_event_findings", "v_responses"]
ORACLES["analysis_verdict"] = oracle(
    EVENTS,
    """SELECT id, outcome, severity, round(cvss_estimate, 6) AS cvss_estimate, reasoning, CAST(NULL AS VARCHAR) AS taint_chain, 'possible' AS exploitability,
 blast_radius, CASE reachable WHEN 'true' THEN 'Yes' WHEN 'false' THEN 'No' ELSE 'Unknown' END AS reachable FROM analyzed""",
    REPLIES, ANALYZED,
)
ORACLES["analysis_counts"] = oracle(
    EVENTS,
    "SELECT repo_id, count(*) FILTER (outcome <> 'rejected') AS confirmed, count(*) FILTER (outcome = 'rejected') AS rejected FROM analyzed GROUP BY 1",
    REPLIES, ANALYZED,
)
ORACLES["severity_gate"] = oracle(
    EVENTS,
    "SELECT repo_id, severity, count(*) AS findings FROM analyzed WHERE outcome <> 'rejected' AND severity <> 'low' GROUP BY 1, 2",
    REPLIES, ANALYZED,
)
# A review counts if it is an object whose confidence, when given, is a number.
VALIDATED = (
    "reviews AS (SELECT a.* EXCLUDE (j), r.j, coalesce(json_type(r.j) = 'OBJECT' AND coalesce(json_type(r.j, '$.adjusted_confidence'), '') <> 'NULL', false) AS usable "
    "FROM analyzed a LEFT JOIN replies r ON r.repo_id = a.repo_id AND r.finding_id = a.id AND r.stage = 'review' WHERE outcome <> 'rejected'), "
    "validated AS (SELECT *, CASE WHEN usable AND json_extract_string(j, '$.final_verdict') IN ('likely_fp', 'uncertain') "
    "THEN json_extract_string(j, '$.final_verdict') ELSE 'confirmed' END AS validation_status, "
    f"CASE WHEN usable THEN coalesce(json_extract_string(j, '$.fp_argument'), '{c.NO_ARGUMENT}') ELSE '{c.REVIEW_MISSING_ARGUMENT}' END AS fp_argument, "
    f"CASE WHEN usable THEN coalesce(json_extract_string(j, '$.rebuttal'), '{c.NO_REBUTTAL}') ELSE '{c.REVIEW_MISSING_REBUTTAL}' END AS fp_rebuttal, "
    "CASE WHEN usable THEN coalesce(CAST(json_extract_string(j, '$.adjusted_confidence') AS DOUBLE), confidence) ELSE confidence END AS final_confidence FROM reviews)"
)
REVIEWED = [REPLIES, ANALYZED, VALIDATED]
ORACLES["review_verdict"] = oracle(
    EVENTS,
    """SELECT id, validation_status, fp_argument, fp_rebuttal, round(final_confidence, 6) AS final_confidence,
 CASE WHEN final_confidence > 0.8 THEN 'high' WHEN final_confidence > 0.6 THEN 'medium' ELSE 'low' END AS band FROM validated""",
    *REVIEWED,
)
COUNTED = "SELECT repo_id, count(*) FILTER ({0} = 'confirmed') AS confirmed, count(*) FILTER ({0} = 'likely_fp') AS likely_fp, count(*) FILTER ({0} = 'uncertain') AS uncertain FROM validated GROUP BY 1"
ORACLES["status_counts"] = oracle(EVENTS, COUNTED.format("validation_status"), *REVIEWED)
ORACLES["review_threshold"] = oracle(
    EVENTS,
    COUNTED.format("(CASE WHEN validation_status = 'confirmed' AND final_confidence < 0.7 THEN 'likely_fp' ELSE validation_status END)"),
    *REVIEWED,
)
ORACLES["token_usage"] = oracle(
    ["v_responses"],
    """SELECT repo_id, stage, count(*) AS total_calls, count(*) FILTER (NOT success) AS failed_calls,
 CAST(sum(CASE WHEN success THEN input_tokens ELSE 0 END) AS BIGINT) AS total_input_tokens,
 CAST(sum(CASE WHEN success THEN output_tokens ELSE 0 END) AS BIGINT) AS total_output_tokens,
 CAST(sum(CASE WHEN success THEN input_tokens + output_tokens ELSE 0 END) AS BIGINT) AS total_tokens FROM v_responses GROUP BY 1, 2""",
)
ORACLES["missing_responses"] = oracle(
    EVENTS,
    """SELECT repo_id, id AS finding_id, 'review' AS stage FROM v_event_findings f WHERE NOT EXISTS
 (SELECT 1 FROM v_responses r WHERE r.success AND r.stage = 'review' AND r.repo_id = f.repo_id AND r.finding_id = f.id)""",
)
ORACLES["raw_responses"] = """
SELECT event_id AS finding_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type || chr(10) || props END AS content, event_id % 5 <> 0 AS success,
 CASE WHEN event_id % 5 = 0 OR event_id % 3 = 0 THEN 0 ELSE user_id END AS input_tokens,
 CASE WHEN event_id % 5 = 0 OR event_id % 3 = 0 THEN 0 ELSE 7 END AS output_tokens FROM events"""
PROMPT_CONTEXT = (
    "texts2 AS (SELECT repo_id, body FROM (SELECT r.repo_id, '```' || chr(10) || coalesce(string_agg(relative_path || ' (' || line_count || ' lines)' || "
    "CASE risk_level WHEN 'high' THEN ' [HIGH RISK]' WHEN 'medium' THEN ' [MED]' ELSE '' END || chr(10), '' ORDER BY rank), '') || '```' AS body "
    "FROM (SELECT DISTINCT repo_id FROM v_code) r LEFT JOIN manifest m USING (repo_id) GROUP BY 1)), "
    "sections2 AS (SELECT repo_id, seq AS pos, 'Finding Context: ' || vuln_type || ' in ' || file_path || ':' || line_start AS heading, body FROM finding_text), "
    "prompted AS (SELECT f.*, coalesce((SELECT min_by(s.body, s.pos) FROM sections2 s WHERE s.repo_id = f.repo_id AND contains(s.heading, f.file_path)), 'none') AS context, "
    "o.body AS overview FROM v_code_findings f LEFT JOIN texts2 o USING (repo_id))"
)
PROMPT_TABLES = [
    *MANIFEST, SOURCE_LINES, DEFINED, EXTENTS, CONTAINING, SPLIT, FINDING_TEXT, PROMPT_CONTEXT,
]


def prompt(template: str, *values: str) -> str:
    """SQL that fills the `%s` and `%d` places of a fixed prompt text."""
    pieces = template.replace("'", "''").replace("%d", "%s").split("%s")
    filled = [f"'{pieces[0]}'"]
    for value, piece in zip(values, pieces[1:], strict=True):
        filled += [f"CAST({value} AS VARCHAR)", f"'{piece}'"]
    return " || ".join(filled)


# The wording of the prompts.
from vulnloom.operators.patches import PATCH_PROMPT  # noqa: E402
from vulnloom.operators.verdicts import ANALYSIS_PROMPT, REVIEW_PROMPT  # noqa: E402

ORACLES["analysis_prompt"] = code(
    f"""SELECT repo_id, id AS finding_id, 'analyze' AS stage, {prompt(ANALYSIS_PROMPT, "'owner/' || repo_id", "vuln_type", "file_path", "line_start", "line_end",
 "'semgrep'", "'custom'", "'found ' || vuln_type", "context", "overview")} AS text FROM prompted""",
    *PROMPT_TABLES, views=("v_code_findings",),
)
ORACLES["review_prompt"] = code(
    f"""SELECT repo_id, id AS finding_id, 'review' AS stage, {prompt(REVIEW_PROMPT, "vuln_type", "file_path", "line_start", "'high'", "'7.5'", "'because'",
 "'Not specified'", "'likely'", "context")} AS text FROM prompted""",
    *PROMPT_TABLES, views=("v_code_findings",),
)
LONG = "len(ls) > 200"
SHOWN = f"CASE WHEN {LONG} THEN array_to_string(ls[greatest(line_start - 50, 0) + 1 : least(line_end + 50, len(ls))], chr(10)) ELSE content END"
NOTE = (
    f"CASE WHEN {LONG} THEN '[lines ' || (greatest(line_start - 50, 0) + 1) || ' to ' || least(line_end + 50, len(ls)) || ' of ' || len(ls) || "
    "', finding at line ' || line_start || ']' ELSE '[whole file of ' || len(ls) || ' lines, finding at line ' || line_start || ']' END"
)
ORACLES["patch_prompt"] = code(
    f"""SELECT f.repo_id, id AS finding_id, 'patch' AS stage, {prompt(PATCH_PROMPT, "vuln_type", "file_path", "line_start", "'high'", "'because'", "'a -> b'", NOTE, SHOWN)} AS text
 FROM v_code_findings f JOIN split USING (repo_id, file_path)""",
    SPLIT, views=("v_code_findings",),
)
# Of the Python files those of even length get code that parses.
ORACLES["patch_assembly"] = code(
    """SELECT f.repo_id, id AS finding_id, 'why' AS explanation, file_path AS file,
 '--- a/' || file_path || chr(10) || '+++ b/' || file_path AS header, true AS adds_line,
 NOT ends_with(file_path, '.py') OR length(content) % 2 = 0 AS syntax_valid
 FROM v_code_findings f JOIN v_code ON v_code.repo_id = f.repo_id AND relative_path = file_path""",
    views=("v_code_findings",),
)
# A long file's reply holds the whole file and the excerpt is what it is compared with.
ORACLES["patch_line_delta"] = code(
    """SELECT f.repo_id, id AS finding_id, 1 + CASE WHEN len(ls) > 200 THEN len(ls) - len(ls[greatest(line_start - 50, 0) + 1 : least(line_end + 50, len(ls))])
 ELSE 0 END AS lines_added, 0 AS lines_removed FROM v_code_findings f JOIN split USING (repo_id, file_path)""",
    SPLIT, views=("v_code_findings",),
)

# ---- Reports ----------------------------------------------------------------

CONFIRMED = (
    "confirmed AS (SELECT *, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level, "
    "row_number() OVER (PARTITION BY repo_id ORDER BY seq) AS idx FROM validated WHERE validation_status = 'confirmed')"
)
RESULTS = (
    "results AS (SELECT f.repo_id, 'owner/' || f.repo_id AS repo_name, f.files AS files_analyzed, f.lines AS total_lines, f.n AS raw_findings_count, "
    "coalesce(k.n, 0) AS confirmed_count, coalesce(k.critical, 0) AS critical_count, coalesce(k.high, 0) AS high_count, f.n AS patches_count, "
    "coalesce(k.types, '') AS vuln_types, coalesce(k.severities, '') AS severities, CASE WHEN k.n > 0 THEN 'vulnloom identified ' || k.n || "
    "' confirmed vulnerabilities in owner/' || f.repo_id || '. Manual review and remediation is recommended.' ELSE '' END AS executive_summary "
    "FROM (SELECT repo_id, count(DISTINCT file_path) AS files, CAST(sum(line_start) AS BIGINT) AS lines, count(*) AS n FROM v_event_findings GROUP BY 1) f "
    "LEFT JOIN (SELECT repo_id, count(*) AS n, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, "
    "string_agg(DISTINCT vuln_type, ',' ORDER BY vuln_type) AS types, string_agg(DISTINCT severity, ',' ORDER BY severity) AS severities FROM confirmed GROUP BY 1) k USING (repo_id))"
)
REPORTED = [*REVIEWED, CONFIRMED, RESULTS]
ORACLES["scan_result"] = oracle(EVENTS, "SELECT *, 'report' AS last_stage FROM results", *REPORTED)
ORACLES["sarif_rules"] = oracle(
    EVENTS,
    """SELECT repo_id, vuln_type AS rule_id, min_by(message, seq) AS short_description, min_by(reasoning, seq) AS full_description,
 CASE max(CASE level WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'note' END AS level,
 printf('%.1f', max(cvss_estimate)) AS security_severity, min(seq) AS first_seq FROM confirmed GROUP BY 1, 2""",
    *REPORTED,
)
ORACLES["sarif_results"] = oracle(
    EVENTS,
    """SELECT repo_id, (idx - 1) // 300 AS part, 'owner_' || repo_id || '_20240102_030405' || CASE WHEN idx > 300 THEN '_part' || ((idx - 1) // 300) ELSE '' END
 || '.sarif.json' AS file_name, (SELECT count(DISTINCT vuln_type) FROM confirmed k WHERE k.repo_id = confirmed.repo_id) AS rules, vuln_type AS ruleId, level,
 reasoning AS text, ltrim(file_path, '/') AS uri, line_start AS line, round(final_confidence, 6) AS confidence, '+try 2' AS diff FROM confirmed""",
    *REPORTED,
)
ORACLES["json_findings"] = oracle(
    EVENTS,
    """SELECT repo_name, part, raw_findings_count, findings, patches, lines, first_id, executive_summary FROM results JOIN (
 SELECT repo_id, 0 AS part, count(*) AS findings, count(*) AS patches, CAST(sum(line_start) AS BIGINT) AS lines, min_by(id, idx) AS first_id
 FROM confirmed GROUP BY 1, 2) USING (repo_id)""",
    *REPORTED,
)
ORACLES["text_report"] = oracle(
    EVENTS,
    """SELECT repo_id, part, CASE WHEN part = 0 THEN repeat('=', 60) || chr(10) || 'Security Report' || chr(10) || repeat('=', 60) || chr(10)
 || 'Repository: ' || repo_name || chr(10) || 'Branch: main (01234567)' || chr(10) || 'Scan Date: 2024-01-02T03:04:05' || chr(10)
 || 'Files Analyzed: ' || files_analyzed || chr(10) || 'Lines of Code: ' || format('{:,}', total_lines) || chr(10) || 'Duration: 0.0s' || chr(10) || chr(10)
 || 'Raw Findings: ' || raw_findings_count || chr(10) || 'Confirmed: ' || confirmed_count || chr(10) || 'Patches: ' || patches_count || chr(10) || chr(10)
 || 'Executive Summary:' || chr(10) || executive_summary || chr(10) || chr(10) ELSE '' END || body AS report
 FROM results JOIN (SELECT repo_id, 0 AS part, string_agg('--- Finding ' || idx || ' ---' || chr(10) || 'Type: ' || vuln_type || chr(10)
 || 'Severity: ' || severity || chr(10) || 'File: ' || file_path || ':' || line_start || chr(10) || 'Reasoning: ' || reasoning || chr(10)
 || 'Confidence: ' || CAST(round_even(final_confidence * 100, 0) AS BIGINT) || '%' || chr(10), chr(10) ORDER BY idx) AS body FROM confirmed GROUP BY 1, 2) USING (repo_id)""",
    *REPORTED,
)
ORACLES["findings_count"] = oracle(EVENTS, "SELECT count(*) AS findings_count FROM confirmed", *REVIEWED, CONFIRMED)

# ---- Repositories -----------------------------------------------------------

ORACLES["repo_url_parse"] = r"""
SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN 'owner-' || page_id END AS owner,
 CASE WHEN page_id % 5 <> 0 THEN w || '.' || page_id END AS repo, CASE WHEN page_id % 5 <> 0 AND page_id % 4 = 2 THEN 'feature/x' END AS branch,
 CASE WHEN page_id % 5 <> 0 THEN 'owner-' || page_id || '/' || w || '.' || page_id END AS repo_name
 FROM (SELECT page_id, regexp_extract(regexp_replace(url, '^https?://[^/]*/', ''), '^([a-z]+)', 1) AS w FROM pages)"""
ORACLES["repo_remote_name"] = "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'o/r' || page_id ELSE 'checkout' END AS name FROM pages"
IN_CHANGED = "SEMI JOIN (SELECT repo_id, relative_path AS file_path FROM changed) USING (repo_id, file_path) SEMI JOIN (SELECT repo_id, relative_path AS file_path FROM manifest) USING (repo_id, file_path)"
ORACLES["scan_end_to_end"] = code(
    f"""SELECT r.repo_id, coalesce(m.n, 0) AS files_included, coalesce(m.lines, 0) AS total_lines, coalesce(s.sqli, 0) AS sqli, coalesce(s.secrets, 0) AS hardcoded_secret,
 0 AS xss, coalesce(d.n, 0) AS functions, coalesce(d.a, 0) AS functions_line_start, coalesce(d.b, 0) AS functions_line_end,
 coalesce(i.n, 0) AS imports, coalesce(i.a, 0) AS imports_line, coalesce(k.n, 0) AS calls, coalesce(k.a, 0) AS calls_line FROM (SELECT DISTINCT repo_id FROM found) r
 LEFT JOIN (SELECT repo_id, count(*) AS n, CAST(sum(line_count) AS BIGINT) AS lines FROM manifest SEMI JOIN changed USING (repo_id, relative_path) GROUP BY 1) m USING (repo_id)
 LEFT JOIN (SELECT repo_id, count(*) AS n, CAST(sum(first_blank) AS BIGINT) AS a, CAST(sum(e) AS BIGINT) AS b FROM ended {IN_CHANGED} GROUP BY 1) d USING (repo_id)
 LEFT JOIN (SELECT repo_id, count(*) AS n, CAST(sum(n) AS BIGINT) AS a FROM imported {IN_CHANGED} GROUP BY 1) i USING (repo_id)
 LEFT JOIN (SELECT repo_id, count(*) AS n, CAST(sum(line) AS BIGINT) AS a FROM calls {IN_CHANGED} GROUP BY 1) k USING (repo_id)
 LEFT JOIN (SELECT repo_id, count(*) FILTER (vuln_type = 'sqli') AS sqli, count(*) FILTER (vuln_type <> 'sqli') AS secrets FROM (
  SELECT repo_id, vuln_type, row_number() OVER (PARTITION BY repo_id, file_path, line_start ORDER BY confidence DESC, detector, rule_id) AS k
  FROM (SELECT repo_id, file_path, relative_path, line_start, rule_id, confidence, vuln_type, 0 AS detector FROM rule_hits
   UNION ALL SELECT repo_id, file_path, relative_path, line_start, rule_id, confidence, 'hardcoded_secret', 1 FROM secret_hits)
  SEMI JOIN changed USING (repo_id, relative_path) WHERE NOT {DEFAULT_EXCLUDED}) WHERE k = 1 GROUP BY 1) s USING (repo_id)""",
    *MANIFEST, CHANGED, RULE_HITS, SECRET_HITS, SOURCE_LINES, DEFINED, EXTENTS, IMPORTED, DANGEROUS, views=("v_changed",),
)
ORACLES["large_file_scan"] = code(
    f"""SELECT repo_id, file_path, line_start, rule_id AS what FROM rule_hits WHERE strlen(content) <= 1500
 UNION ALL SELECT repo_id, relative_path, NULL, 'larger than 1500 bytes' FROM v_code WHERE strlen(content) > 1500 AND {LANGUAGE} IS NOT NULL""",
    RULE_HITS.replace("SELECT repo_id, file_path, relative_path, n AS line_start, rule_id", "SELECT content, repo_id, file_path, relative_path, n AS line_start, rule_id"),
)
ORACLES["scanner_diff_scope"] = code(
    f"""SELECT f.repo_id, file_path, line_start, line_start AS line_end, 'rules.xss-' || id AS rule_id,
 coalesce(array_to_string(list_transform(range(greatest(line_start - 5, 1), least(len(ls), line_start + 5) + 1), lambda i: {NUMBERED}), chr(10)), '') AS code_snippet
 FROM v_code_findings f LEFT JOIN split USING (repo_id, file_path)
 SEMI JOIN (SELECT repo_id, relative_path AS file_path FROM changed) USING (repo_id, file_path)""",
    SPLIT, CHANGED, views=("v_code_findings", "v_changed"),
)
# Every word before a comma is a rule, so the rules that hold on a line are its own words before commas.
ORACLES["rule_table_scan"] = code(
    """SELECT DISTINCT repo_id, file_path, line_start, 'sqli-' || trim(replace(w, ',', '')) AS rule_id, 'sqli' AS vuln_type, CAST(0.7 AS DOUBLE) AS confidence FROM (
 SELECT repo_id, file_path, n AS line_start, line, unnest(regexp_extract_all(line, ' [a-z]{4,},')) AS w FROM lines)
 SEMI JOIN (SELECT unnest(regexp_extract_all(text, ' [a-z]{4,},')) AS w FROM documents) USING (w)
 WHERE regexp_matches(line, w || '([^,]|$)')""",
    FOUND, SOURCE_LINES,
)
ORACLES["file_tree"] = oracle(
    ["v_files"], "SELECT repo_id, relative_path, md5(content) AS md5, CAST(strlen(content) AS BIGINT) AS size_bytes FROM v_files"
)

# ---- Limits, retries, odd input ---------------------------------------------

ORACLES["manifest_limit_counts"] = code(
    """SELECT f.repo_id, coalesce(m.n, 0) AS source_files, least(coalesce(m.n, 0), 7) AS files_included, greatest(coalesce(m.n, 0) - 7, 0) AS files_over_limit
 FROM (SELECT DISTINCT repo_id FROM found) f LEFT JOIN (SELECT repo_id, count(*) AS n FROM manifest GROUP BY 1) m USING (repo_id)""",
    *MANIFEST,
)
# Every call failed once before and once after its reply, which changes nothing.
ORACLES["retried_analysis"] = ORACLES["analysis_verdict"]
ORACLES["retried_review"] = ORACLES["status_counts"]
ORACLES["json_lenient"] = """
SELECT event_id, event_type AS severity, CASE event_id % 3 WHEN 0 THEN 'NaN' WHEN 1 THEN 'Infinity' ELSE '-Infinity' END AS cvss,
 'NaN, "-Infinity' AS note FROM events"""
ORACLES["scan_result_detection_only"] = oracle(
    ["v_event_findings"],
    """SELECT repo_id, count(DISTINCT file_path) AS files_analyzed, count(*) AS raw_findings_count, 0 AS confirmed_count, 0 AS patches_count,
 '' AS vuln_types, '' AS executive_summary, 'detect' AS last_stage FROM v_event_findings GROUP BY 1
 UNION ALL SELECT 'none', 0, 0, 0, 0, '', '', 'detect'""",
)
ORACLES["scan_result_summaries"] = oracle(
    EVENTS,
    """SELECT repo_id, confirmed_count, CASE WHEN confirmed_count = 0 OR repo_id = 'r1' THEN '' WHEN repo_id = 'r2' THEN '' ELSE 'All about ' || repo_id END
 AS executive_summary FROM results""",
    *REPORTED,
)
_N = "CAST(substr(repo_id, 4) AS INT)"
ORACLES["repo_config_filter"] = oracle(
    ["v_code_findings"],
    f"""SELECT repo_id, id FROM (SELECT *, file_path AS relative_path FROM v_code_findings)
 WHERE CASE {_N} % 3 WHEN 0 THEN vuln_type <> 'sqli' AND NOT {DEFAULT_EXCLUDED}
  WHEN 1 THEN NOT starts_with(relative_path, 'src/') ELSE NOT {DEFAULT_EXCLUDED} END""",
)
ORACLES["config_rejects"] = oracle(
    ["v_files"],
    f"SELECT DISTINCT repo_id, '.vulnloom.yml' AS path, 'config' AS stage, true AS explained FROM v_files WHERE {_N} % 3 = 2",
)
ORACLES["json_finding_rows"] = oracle(
    EVENTS, "SELECT repo_id, seq, id, severity, vuln_type, '+try 2' AS diff FROM confirmed", *REVIEWED, CONFIRMED
)

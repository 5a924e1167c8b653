"""DuckDB SQL for the queries whose results SQL can state."""

from __future__ import annotations

_KEY = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
# Rank, kind, pattern, group of the value and its least length.
_PATTERNS = [
    (0, "assign", rf"""({_KEY})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    (1, "access", "(AKIA[A-Z0-9]+)", 1, 20),
    (2, "hex", "([0-9a-f]{24,})", 1, 24),
    (3, "opaque", "([A-Za-z0-9_-]{32,})", 1, 32),
]


def _matches(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""
 SELECT doc_id, owner, repo, {rank} AS rank, '{kind}' AS kind, val,
  coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)
   + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS a,
  length(whole[i]) AS size
 FROM (SELECT doc_id, owner, repo, whole, gaps, unnest(vals) AS val, unnest(range(1, len(vals) + 1)) AS i
  FROM (SELECT doc_id, owner, repo, regexp_extract_all(body, '{pattern}') AS whole,
    regexp_extract_all(body, '{pattern}', {group}) AS vals, string_split_regex(body, '{pattern}') AS gaps FROM texts))
 WHERE length(val) >= {least}"""


OP1 = f"""
WITH texts AS (
 SELECT doc_id, coalesce(text, '') AS body, source AS owner, concat_ws('/', coalesce(source, ''), lang) AS repo
 FROM documents),
found AS ({" UNION ALL ".join(_matches(*p) for p in _PATTERNS)}),
owners AS (
 SELECT val, count(DISTINCT coalesce(owner, chr(0))) AS n_owners,
  count(DISTINCT concat(coalesce(owner, chr(0)), chr(1), coalesce(repo, chr(0)))) AS n_repos,
  length(val) >= 12 AND regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]')
   AND NOT regexp_matches(lower(val), 'example|sample|dummy|placeholder|changeme|xxxx|0000000') AS random
 FROM found GROUP BY val),
judged AS (
 SELECT found.*, n_owners, n_repos, a + size AS b,
  CASE WHEN n_owners >= 3 THEN 'copied' WHEN n_repos >= 3 THEN 'shared' WHEN random THEN 'live' ELSE 'plain' END AS verdict
 FROM found JOIN owners USING (val)),
spans AS (
 SELECT * FROM judged j WHERE rank < 3 OR (verdict = 'live' AND NOT EXISTS (
  SELECT 1 FROM judged o WHERE o.doc_id = j.doc_id AND o.rank < 3 AND o.a < j.b AND j.a < o.b))),
summed AS (
 SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
  count(*) FILTER (rank = 2) AS n_hex,
  string_agg(concat(kind, ':', a, ':', b), ',' ORDER BY a, rank) FILTER (rank < 3) AS base,
  string_agg(concat(kind, ':', a, ':', b), ',' ORDER BY a, rank) AS spans,
  count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'copied') AS n_copied,
  count(*) FILTER (verdict = 'shared') AS n_shared, max(n_owners) AS max_owners, max(n_repos) AS max_repos
 FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
 sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
 coalesce(n_copied, 0) AS n_copied, coalesce(n_shared, 0) AS n_shared, coalesce(max_owners, 0) AS max_owners,
 coalesce(max_repos, 0) AS max_repos
FROM documents LEFT JOIN summed USING (doc_id)"""

OP3 = """
WITH rows AS (
 SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
numbered AS (
 SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
  count(*) OVER (PARTITION BY conv_id) AS n FROM rows),
prefixed AS (
 SELECT *, md5(string_agg(md5(role || chr(1) || text), ',') OVER (PARTITION BY conv_id ORDER BY k)) AS upto
 FROM numbered),
firsts AS (
 SELECT n, upto, min(conv_id) AS conv_id, count(*) AS n_copies FROM prefixed WHERE k = n GROUP BY n, upto),
kept AS (
 SELECT f.conv_id, f.n_copies FROM firsts f
 WHERE NOT EXISTS (SELECT 1 FROM prefixed p WHERE p.k = f.n AND p.k < p.n AND p.upto = f.upto))
SELECT p.conv_id, (p.k - 1) // 64 AS part, p.n AS n_turns, kept.n_copies,
 string_agg('<|im_start|>' || replace(p.role, '<|', '< |') || chr(10) || replace(p.text, '<|', '< |') || '<|im_end|>'
  || chr(10), '' ORDER BY p.k) AS chat
FROM prefixed p JOIN kept ON p.conv_id IS NOT DISTINCT FROM kept.conv_id
GROUP BY 1, 2, 3, 4"""

OP7 = r"""
WITH RECURSIVE split AS (
 SELECT doc_id, list_filter(string_split_regex(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
  lambda x: x <> '') AS w FROM documents),
grams AS (
 SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS (
 SELECT x.doc_id AS a, y.doc_id AS b FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id
 JOIN sizes s ON s.doc_id = x.doc_id JOIN sizes t ON t.doc_id = y.doc_id
 WHERE 100 * least(s.n, t.n) >= 80 * greatest(s.n, t.n)
 GROUP BY x.doc_id, y.doc_id, s.n, t.n HAVING 100 * count(*) >= 80 * (s.n + t.n - count(*))),
reach AS (
 SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) r ON r.a = d.doc_id"""

# Every round is a step of its own: scores with all centroids, floors of the means, next centroids.
_ROUND = """
 scores{i} AS MATERIALIZED (
 SELECT r, any_value(p) AS p, min(d * 8 + c) AS best FROM (
  SELECT x.r, x.p, y.c, list_sum(list_transform(range(1, 65), lambda j: (x.p[j] - y.p[j]) * (x.p[j] - y.p[j]))) AS d
  FROM points x, centres{i} y) GROUP BY r),
 means{i} AS (
 SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS p FROM (
  SELECT best % 8 AS c, j, sum(p[j]) AS s, count(*) AS n FROM scores{i}, range(1, 65) AS t(j) GROUP BY 1, 2) GROUP BY c),
 centres{k} AS MATERIALIZED (
 SELECT y.c, coalesce(m.p, y.p) AS p FROM centres{i} y LEFT JOIN means{i} m ON m.c = y.c)"""

OP11 = f"""
WITH points AS MATERIALIZED (
 SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS p
 FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 centres0 AS MATERIALIZED (
 SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), p) - 1 AS c, p FROM points WHERE vec_id IS NOT NULL
 QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id), p) <= 8),
{",".join(_ROUND.format(i=i, k=i + 1) for i in range(11))},
 found AS (SELECT r, best % 8 AS c, best // 8 AS d FROM scores10)
SELECT vec_id, CAST(f.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
 CAST(sum(d) OVER (PARTITION BY f.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(y.p, ',')) AS centroid_sha256
FROM found f JOIN points USING (r) JOIN centres10 y ON y.c = f.c"""

OP12 = """
WITH drawn AS (
 SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
  sha256('7:' || doc_id) AS h FROM documents),
cuts AS (
 SELECT doc_id, body, units, len(units) AS n, doc_id IS NULL OR body = '' OR contains(body, '<P>') OR contains(body, '<S>')
   OR contains(body, '<M>') AS plain, CAST('0x' || substr(h, 25, 8) AS UBIGINT) % 100 < 50 AS spm,
  CAST('0x' || substr(h, 1, 8) AS UBIGINT) % (len(units) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS UBIGINT) % (len(units) + 1) AS b
 FROM drawn),
parts AS (
 SELECT doc_id, body, n, plain, spm, array_to_string(units[1:least(a, b)], '') AS prefix,
  array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(units[greatest(a, b) + 1:], '') AS suffix
 FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
 CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
 sha256(CASE WHEN plain THEN body WHEN spm THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
  ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
 sha256(body) AS restored_sha256
FROM parts"""

OP13 = """
WITH payloads AS (SELECT DISTINCT page_id, coalesce(html, '') AS body FROM pages),
kept AS (
 SELECT page_id, strlen(body) AS size, sha1(body) AS digest, max(page_id) OVER (PARTITION BY body) AS keeper FROM payloads),
judged AS (
 SELECT *, size >= 1000 AND keeper IS NOT NULL AND (page_id IS NULL OR page_id < keeper) AS again FROM kept)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
 CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN keeper END AS refers_to
FROM judged"""

ORACLES = {
    "op1_secret_scan": OP1,
    "op3_chat_format": OP3,
    "op7_ngram_join": OP7,
    "op11_shallot": OP11,
    "op12_fill_in_middle": OP12,
    "op13_warc": OP13,
}

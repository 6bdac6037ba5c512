"""DuckDB SQL that gives the same rows as the queries, where SQL can."""

QUALITY = r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spans AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM w, unnest(range(1, len(w) - 6)) AS u(i) WHERE len(w) >= 8),
again AS (SELECT doc_id, i FROM spans QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(8) AS r(k) GROUP BY doc_id),
base AS (
  SELECT w.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS docs, count(*) FILTER (WHERE base_failed) AS failed FROM judged WHERE source IS NOT NULL GROUP BY source),
moments AS (SELECT avg(failed / docs) AS m, var_pop(failed / docs) AS v, avg(1 / docs) AS noise FROM hosts),
strength AS (SELECT m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * noise, 1e-4) - 1, 1.0), 1e4) AS s FROM moments),
prior AS (SELECT CASE WHEN m IS NULL OR m IN (0, 1) THEN 1.0 ELSE m * s END AS a, CASE WHEN m IS NULL OR m IN (0, 1) THEN 1.0 ELSE (1 - m) * s END AS b FROM strength),
rates AS (SELECT source, (failed + a) / (docs + a + b) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(rate, 0) <= 0.5 AS kept
FROM judged LEFT JOIN rates USING (source)
"""

URLS = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(verdict, h, start) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
best AS (
  SELECT host, path, arg_max(h || start, length(h || start)) AS rule, arg_max(verdict, length(h || start)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p), r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (host, path)
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v AS q, v AS c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

LINES = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i, ls[i + 1] AS a, ls[i + 2] AS b, ls[i + 3] AS c FROM l, unnest(range(0, len(ls) - 2)) AS u(i) WHERE len(ls) >= 3),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS n FROM w WHERE length(trim(a || b || c)) > 0) WHERE n > 1),
covered AS (SELECT doc_id, list(DISTINCT i + k) AS hit FROM later, range(3) AS r(k) GROUP BY doc_id)
SELECT doc_id, coalesce(len(hit), 0)::BIGINT AS removed,
  CASE WHEN hit IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda x, i: NOT list_contains(hit, i - 1)), chr(10)) END AS text
FROM l LEFT JOIN covered USING (doc_id)
"""


def share_sql(level: str, parent: str, own: str) -> str:
    """One level of the tree: children of ``parent`` in ``level`` (own columns, weight, cap, budget)."""
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""SELECT {own}, CASE WHEN short THEN cap ELSE weight * (budget - coalesce(sum(cap) FILTER (WHERE short) OVER ({by}), 0)) // sum(weight) FILTER (WHERE NOT short) OVER ({by}) END AS given
FROM (SELECT *, cap * sum(weight) OVER ({by} ORDER BY cap / weight, {own} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= weight * (budget - coalesce(sum(cap) OVER ({by} ORDER BY cap / weight, {own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS short FROM {level})"""


def mixing_sql(docs: str = "documents", epochs: int = 4, share: int = 1_000_000, seed: int = 11) -> str:
    """The mixture of table ``docs`` with the query's weights: doc_id, epoch, tokens."""
    key = f"('0x' || substring(md5({seed} || ':' || full_ || ':' || doc_id), 1, 15))::BIGINT"
    return f"""
WITH d AS (
  SELECT doc_id, ((coalesce(strlen(text), 0) + 3) // 4)::BIGINT AS tokens, coalesce(lang, '') AS lg, coalesce(source, '') AS sr,
    coalesce(CASE try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'news' END, 'other') AS dm
  FROM {docs}),
leaf AS (SELECT dm, lg, sr, sum(tokens)::BIGINT AS t FROM d GROUP BY ALL),
l1 AS (SELECT dm, sum(t)::BIGINT * {epochs} AS cap, CASE dm WHEN 'web' THEN 3 WHEN 'books' THEN 2 ELSE 1 END AS weight,
  (SELECT (sum(tokens)::HUGEINT * {share} // 1000000)::BIGINT FROM d) AS budget FROM leaf GROUP BY dm HAVING sum(t) > 0),
s1 AS ({share_sql("l1", "", "dm")}),
l2 AS (SELECT dm, lg, sum(t)::BIGINT * {epochs} AS cap, CASE dm || '/' || lg WHEN 'web/en' THEN 4 WHEN 'books/en' THEN 2 ELSE 1 END AS weight, any_value(given) AS budget
  FROM leaf JOIN s1 USING (dm) GROUP BY dm, lg HAVING sum(t) > 0),
s2 AS ({share_sql("l2", "dm", "dm, lg")}),
l3 AS (SELECT dm, lg, sr, t * {epochs} AS cap, CASE dm || '/' || lg || '/' || sr WHEN 'web/en/src0' THEN 2 ELSE 1 END AS weight, given AS budget
  FROM leaf JOIN s2 USING (dm, lg) WHERE t > 0),
s3 AS ({share_sql("l3", "dm, lg", "dm, lg, sr")}),
plan AS (SELECT dm, lg, sr, t, CASE WHEN t > 0 THEN coalesce(given, 0) // t ELSE 0 END AS full_, coalesce(given, 0) - CASE WHEN t > 0 THEN coalesce(given, 0) // t ELSE 0 END * t AS rest
  FROM leaf LEFT JOIN s3 USING (dm, lg, sr)),
o AS (SELECT d.*, full_, rest, t, sum(tokens) OVER (PARTITION BY dm, lg, sr ORDER BY {key}, doc_id::VARCHAR) AS run FROM d JOIN plan USING (dm, lg, sr))
SELECT doc_id, e::INT AS epoch, tokens FROM o, unnest(range(0, full_::BIGINT)) AS u(e)
UNION ALL SELECT doc_id, full_::INT, tokens FROM o WHERE run <= rest AND t > 0
"""


MIXING = mixing_sql()

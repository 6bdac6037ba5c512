"""Queries of glossary matching, keys, selections, stored results and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc import config as C
from loomdoc.functions import pages as P
from loomdoc.functions import terms as K
from loomdoc.operators import export, results, translate
from loomdoc.plans.common import EDGE, spread, table
from loomdoc.streaming import jobs

#: Terms that no other term contains, frequent in the synthetic texts.
TERMS = ("tion", "from", "with", "this", "ones", "was", "pour", "by")
_NO_TERMS = "array<struct<en:string,ko:string,note:string>>"


def glossary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of a small glossary in every document, by name."""
    glossary = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(t).alias("en"), F.lit(t.upper()).alias("ko"), F.lit("").alias("note"), F.lit(k).alias("pos")) for k, t in enumerate(TERMS)])))
    found = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("m", K.match_terms(F.col("text"), glossary))
    return found.select("doc_id", F.array_join(F.array_sort(F.transform("m", lambda t: t["en"])), ",").alias("terms"), F.size("m").alias("n_terms"))


def _term_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct(F.col("n_name").alias("en"), F.concat(F.lit("도체 \""), F.col("n_name")).alias("ko"), F.lit("").alias("note"))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(one).alias("terms"))


def terms_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _term_sets(spark, sf_dir).select("n_regionkey", K.terms_hash(F.col("terms")).alias("terms_hash"))


def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _term_sets(spark, sf_dir).select("n_regionkey", K.cache_key(F.col("terms"), F.lit(C.MODEL_TEXT)).alias("cache_key"))


def cache_hit_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of their source; every third is stored under its key, every fifth under an outdated one."""
    docs = table(spark, sf_dir, "documents")
    pages = docs.select(F.col("source").alias("doc_sha"), F.col("doc_id").cast("int").alias("page_no"), F.array().cast(_NO_TERMS).alias("terms"), F.lit(C.MODEL_TEXT).alias("model_id"))
    key = K.cache_key(F.col("terms"), F.col("model_id"))
    kept = pages.filter("page_no % 3 = 0").withColumn("cache_key", key).unionByName(pages.filter("page_no % 5 = 0").withColumn("cache_key", F.lit("0" * 16)))
    stored = kept.select("doc_sha", "page_no", "cache_key", F.timestamp_seconds("page_no").alias("written_at"), F.format_string('{"page_no": %d}', "page_no").alias("page_json"))
    split = results.cache_split(pages, stored)
    return split.groupBy("doc_sha", "hit").agg(F.count("*").alias("pages"), F.min("cache_key").alias("cache_key"))


def reused_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers (as selected pages) with orders (as stored ones), and without."""
    picked = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    stored = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    both = results.reused(picked, stored, ["c_custkey"]).withColumn("stored", F.lit(True)).unionByName(results.missing(picked, stored, ["c_custkey"]).withColumn("stored", F.lit(False)))
    return both.groupBy("c_mktsegment", "stored").agg(F.count("*").alias("n"))


def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return results.latest(rows, ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


def translated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part numbers (pages) of every supplier (document) among its items (stored versions)."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_sha"), F.col("l_partkey").alias("page_no"))
    return results.translated_pages(rows).select("doc_sha", "translated_page_count")


def recent_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten newest orders, of which those with the status F count as broken."""
    return results.recent(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", broken=F.col("o_orderstatus") == "F").select("o_orderkey", "o_orderdate", "o_custkey")


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.format_string("%d-%d, %d,, %d-%d ", k % 50 + 1, k % 50 + 1 + k % 9, k % 7 + 1, k % 11 + 3, k % 11 + k % 4)
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("range"))


def range_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranges(spark, sf_dir).select("c_custkey", "range", F.array_join(P.parse_range(F.col("range")).cast("array<string>"), " ").alias("pages"))


def estimate_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimate for every customer's range, pages up to 20 being stored."""
    guess = results.estimate(P.parse_range(F.col("range")), F.sequence(F.lit(1), F.lit(20)))
    return _ranges(spark, sf_dir).select("c_custkey", guess.alias("e")).select("c_custkey", "e.*")


def outline_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as outline entries of their brand: level by size, page by key."""
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_size") % 4).alias("level"))
    return results.section_ends(rows, "p_brand", "p_partkey", "level", "p_partkey", F.lit(10_000_000).cast("long")).select("p_partkey", "end_page")


def id_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant's next turn as their response."""
    held = translate.answer_after(table(spark, sf_dir, "conversations"))
    return held.select("conv_id", "turn", F.md5(F.col("source").cast("binary")).alias("source_md5"), F.md5(F.col("ko").cast("binary")).alias("ko_md5"))


def response_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as blocks of their order, with responses for some ids twice, for some never and for some unknown: what is missing."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    block = items.select(
        F.lit("orders").alias("doc_sha"), F.col("l_orderkey").cast("int").alias("page_no"), F.format_string("b%02d", "l_linenumber").alias("id"), F.lit("paragraph").alias("type"),
        F.lit(None).cast(translate.TABLE).alias("table"), F.lit(None).cast("string").alias("ko"), F.lit(None).cast(translate.VERIFY).alias("verify"), "q",
    )
    one = lambda df, pos, ko: df.select("doc_sha", "page_no", F.lit(pos).alias("pos"), "id", ko.alias("ko"), F.lit(None).cast(translate.GRID).alias("cells_ko"), F.lit(None).cast("string").alias("error"))
    answer = (
        one(block.filter("q % 5 <> 0"), 0, F.col("q").cast("int").cast("string"))
        .unionByName(one(block.filter("q % 7 = 0 AND q % 5 <> 0"), 1, F.lit("last")))
        .unionByName(one(block.filter("q = 1").withColumn("id", F.concat("id", F.lit("x"))), 2, F.lit("unknown")))
    )
    joined = translate.apply_responses(block, answer).groupBy("page_no").agg(F.count("ko").alias("answered"), F.count_if(F.col("ko") == "last").alias("twice"))
    wrong = translate.id_mismatch(block, answer).select("page_no", F.size("missing").alias("n_missing"), F.size("unknown").alias("n_unknown"))
    return joined.join(wrong, "page_no", "left").fillna(0, ["n_missing", "n_unknown"])


def html_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines as an HTML page: a heading, then paragraphs, lists of the words after a line's first and tables of a line's words."""
    none = F.lit(None).cast("array<array<string>>")
    kind = lambda i: F.when(i == 0, "heading").when(i % 5 == 1, "list").when(i % 5 == 2, "table").when(i % 5 == 3, "header_footer").otherwise("paragraph")
    line = lambda t, i: F.struct(
        kind(i).alias("type"), F.when(i % 5 == 1, F.replace(t, F.lit(" "), F.lit("\n"))).otherwise(t).alias("ko"), F.struct(F.when(i % 5 == 2, F.array(F.split(t, " "))).otherwise(none).alias("cells_ko")).alias("table")
    )
    blocks = F.transform(F.split("text", "\n"), line)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(export.page_html(F.col("doc_id"), blocks).cast("binary")).alias("html_md5"))


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, list items and footers of every page's HTML as typed blocks, counted."""
    found = lambda tag: F.regexp_extract_all("html", F.lit(f"(?s)<{tag}(?: [^>]*)?>(.*?)</{tag}>"), 1)
    as_blocks = lambda kind, texts: F.transform(texts, lambda t: F.struct(F.lit(kind).alias("type"), t.alias("source")))
    typed = [as_blocks(kind, found(tag)) for tag, kind in (("h1", "heading"), ("li", "list"), ("footer", "header_footer"), ("p", "paragraph"))]
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.concat(*typed)).alias("b")).select("page_id", "b.*")
    return rows.groupBy("page_id", "type").agg(F.count("*").alias("n"), F.sum(F.length("source")).alias("chars"))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    bad = F.col("event_type") == "error"
    return e.select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_id").cast("int").alias("order"), (F.col("event_id") % 100).cast("int").alias("page"), F.when(bad, F.lit("failed")).alias("error"),
        (F.col("event_id") % 2 == 0).alias("cached"), (F.col("event_id") % 3).cast("int").alias("warn_count"), F.lit(1).alias("skipped_count"),
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log of every user's events as a job's pages."""
    return jobs.page_events(_outcomes(spark, sf_dir)).select("job_id", "seq", "type", "page", "done", "total", "warn_count", "skipped_count")


def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = jobs.counters(jobs.page_events(_outcomes(spark, sf_dir)))
    return counted.select("job_id", "done", "failed", "ended", "warn_count", "skipped_count")


def job_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that each job's client has not seen, past its fifth, as server-sent lines."""
    return jobs.sse_lines(jobs.after(jobs.page_events(_outcomes(spark, sf_dir)), 4)).groupBy("job_id").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.sum(F.length("line")).alias("chars"))


_LOG = """
o AS (SELECT user_id::VARCHAR AS job_id, event_id, (event_id % 100)::INT AS page, event_type = 'error' AS bad, (event_id % 3)::INT AS w, event_id % 2 = 0 AS cached FROM events),
p AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY event_id) AS done, count(*) OVER (PARTITION BY job_id) AS total FROM o),
e AS (
  SELECT job_id, event_id, 0 AS k, CASE WHEN bad THEN 'page_error' ELSE 'page_done' END AS type, page, NULL AS done, NULL AS total, NULL AS warn_count, NULL AS skipped_count, CASE WHEN bad THEN 'failed' END AS reason, CASE WHEN NOT bad THEN cached END AS cached FROM p
  UNION ALL SELECT job_id, event_id, 1, 'progress', NULL, done, total, NULL, NULL, NULL, NULL FROM p WHERE NOT bad
  UNION ALL SELECT job_id, 9223372036854775807, 0, 'job_done', NULL, NULL, NULL, sum(CASE WHEN bad THEN 0 ELSE w END), sum(CASE WHEN bad THEN 0 ELSE 1 END), NULL, NULL FROM p GROUP BY job_id),
log AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY event_id, k) - 1 AS seq, type, page::INT AS page, done::INT AS done, total::INT AS total, warn_count::INT AS warn_count, skipped_count::INT AS skipped_count, reason, cached FROM e)
"""

_RANGE = "(c_custkey % 50 + 1) || '-' || (c_custkey % 50 + 1 + c_custkey % 9) || ', ' || (c_custkey % 7 + 1) || ',, ' || (c_custkey % 11 + 3) || '-' || (c_custkey % 11 + c_custkey % 4) || ' '"
_PAGES = "list_sort(list_distinct(list_concat(list_concat(range(c_custkey % 50 + 1, c_custkey % 50 + 2 + c_custkey % 9), [c_custkey % 7 + 1]), range(c_custkey % 11 + 3, c_custkey % 11 + c_custkey % 4 + 1))))"
_JSON = "'[' || string_agg('{\"en\":\"' || n_name || '\",\"ko\":\"도체 \\\"' || n_name || '\",\"note\":\"\"}', ',' ORDER BY n_name) || ']'"
_MATCH = "".join(
    (" || " if k else "") + f"CASE WHEN regexp_matches(text, '(?i){EDGE}(?:{t + ('es' if t[-1] in 'sxz' else 's')}|{t})($|[^A-Za-z0-9])') THEN '{t},' ELSE '' END" for k, t in enumerate(sorted(TERMS))
)

QUERIES = {
    f.__name__: f
    for f in (
        glossary_match, terms_hash, cache_key, cache_hit_split, reused_pages, latest_version, translated_pages, recent_docs, range_parse, estimate_eta, outline_sections, id_join, response_join,
        html_export, html_blocks, job_events, job_progress, job_resume,
    )
}

ORACLES = {
    "glossary_match": f"SELECT doc_id, rtrim(m, ',') AS terms, (length(m) - length(replace(m, ',', '')))::INT AS n_terms FROM (SELECT doc_id, {_MATCH} AS m FROM documents)",
    "terms_hash": f"SELECT n_regionkey, left(sha256({_JSON}), 12) AS terms_hash FROM nation GROUP BY n_regionkey",
    "cache_key": f"SELECT n_regionkey, left(sha256(left(sha256({_JSON}), 12) || '|{C.PROMPT_VERSION}|{C.MODEL_TEXT}|ko'), 16) AS cache_key FROM nation GROUP BY n_regionkey",
    "cache_hit_split": f"SELECT source AS doc_sha, doc_id % 3 = 0 AS hit, count(*) AS pages, left(sha256(left(sha256('[]'), 12) || '|{C.PROMPT_VERSION}|{C.MODEL_TEXT}|ko'), 16) AS cache_key FROM documents GROUP BY ALL",
    "reused_pages": "SELECT c_mktsegment, stored, count(*) AS n FROM (SELECT c_mktsegment, c_custkey IN (SELECT o_custkey FROM orders) AS stored FROM customer) GROUP BY ALL",
    "latest_version": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "translated_pages": "SELECT l_suppkey AS doc_sha, count(DISTINCT l_partkey) AS translated_page_count FROM lineitem GROUP BY l_suppkey",
    "recent_docs": "SELECT o_orderkey, o_orderdate, o_custkey FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10) WHERE o_orderstatus <> 'F'",
    "range_parse": f"SELECT c_custkey, {_RANGE} AS range, array_to_string({_PAGES}, ' ') AS pages FROM customer",
    "estimate_eta": f"""SELECT c_custkey, s AS selected, n AS new_count, s - n AS reused_count, eta AS eta_sec,
  CASE WHEN eta < 60 THEN eta || '초' WHEN eta % 60 = 0 THEN (eta // 60) || '분' ELSE (eta // 60) || '분 ' || (eta % 60) || '초' END AS eta_text
FROM (SELECT c_custkey, len({_PAGES})::INT AS s, len(list_filter({_PAGES}, lambda x: x > 20))::INT AS n, (ceil(len(list_filter({_PAGES}, lambda x: x > 20)) / 6) * 15)::INT AS eta FROM customer)""",
    "outline_sections": """SELECT a.p_partkey, coalesce(min(b.p_partkey) - 1, 10000000)::BIGINT AS end_page FROM part a
LEFT JOIN part b ON a.p_brand = b.p_brand AND b.p_partkey > a.p_partkey AND b.p_size % 4 <= a.p_size % 4 GROUP BY a.p_partkey""",
    "id_join": "SELECT conv_id, turn, md5(text) AS source_md5, CASE WHEN r = 'assistant' THEN md5(t) END AS ko_md5 FROM (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS t FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'",
    "response_join": """WITH i AS (SELECT l_orderkey::INT AS page_no, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT page_no, count(*) FILTER (WHERE q % 5 <> 0) AS answered, count(*) FILTER (WHERE q % 7 = 0 AND q % 5 <> 0) AS twice, (count(*) FILTER (WHERE q % 5 = 0))::INT AS n_missing, (count(*) FILTER (WHERE q = 1))::INT AS n_unknown FROM i GROUP BY page_no""",
    "html_export": """WITH l AS (SELECT doc_id, text IS NULL AS gone, list_transform(string_split(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), chr(10)),
  lambda t, i: CASE WHEN i > 1 AND (i - 1) % 5 = 2 THEN '<table><tbody><tr><td>' || replace(t, ' ', '</td><td>') || '</td></tr></tbody></table>' WHEN t = '' OR (i > 1 AND (i - 1) % 5 = 3) THEN '' WHEN i = 1 THEN '<h2>' || t || '</h2>'
    WHEN (i - 1) % 5 = 1 THEN '<ul><li>' || replace(t, ' ', '</li><li>') || '</li></ul>' ELSE '<p>' || t || '</p>' END) AS h FROM documents)
SELECT doc_id, CASE WHEN NOT gone THEN md5('<section id="page-' || doc_id || '"><aside><small>' || doc_id || '</small></aside><article lang="ko">' || array_to_string(h, '') || '</article></section>') END AS html_md5 FROM l""",
    "html_blocks": "SELECT page_id, type, count(*) AS n, sum(length(t))::BIGINT AS chars FROM ("
    + " UNION ALL ".join(f"SELECT page_id, '{kind}' AS type, unnest(regexp_extract_all(html, '(?s)<{tag}(?: [^>]*)?>(.*?)</{tag}>', 1)) AS t FROM pages" for tag, kind in (("h1", "heading"), ("li", "list"), ("footer", "header_footer"), ("p", "paragraph")))
    + ") GROUP BY ALL",
    "job_events": f"WITH {_LOG} SELECT job_id, seq, type, page, done, total, warn_count, skipped_count FROM log",
    "job_progress": f"WITH {_LOG} SELECT job_id, count(*) FILTER (WHERE type = 'page_done') AS done, count(*) FILTER (WHERE type = 'page_error') AS failed, count(*) FILTER (WHERE type = 'job_done') AS ended, max(warn_count) AS warn_count, max(skipped_count) AS skipped_count FROM log GROUP BY job_id",
    "job_resume": f"""WITH {_LOG} SELECT job_id, count(*) AS n, min(seq) AS first, sum(length('id: ' || seq || chr(10) || 'data: {{"type":"' || type || '"' || coalesce(',"page":' || page, '') || coalesce(',"done":' || done, '') || coalesce(',"total":' || total, '')
  || coalesce(',"reason":"' || reason || '"', '') || coalesce(',"cached":' || cached, '') || coalesce(',"warn_count":' || warn_count, '') || coalesce(',"skipped_count":' || skipped_count, '') || '}}' || chr(10) || chr(10)))::BIGINT AS chars FROM log WHERE seq > 4 GROUP BY job_id""",
}

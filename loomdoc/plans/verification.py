"""Queries of the verification rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc import config as C
from loomdoc.functions import text as T
from loomdoc.functions import verify as V
from loomdoc.plans import common
from loomdoc.plans.common import PAIRS, table, tokens_sql, verdict_sql


def verify_number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens of each kind every source holds."""
    found = common.pairs(spark, sf_dir).select("doc_id", V.tokens(F.col("source"), V.nfkc_table).alias("t"))
    return found.select("doc_id", *[F.size(F.col("t")[k]).alias("n_" + k) for k in V.KINDS])


def spec_part_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard and part numbers of every source, in order."""
    found = common.pairs(spark, sf_dir).select("doc_id", V.tokens(F.col("source"), V.nfkc_table).alias("t"))
    return found.select("doc_id", *[F.array_join(F.col("t")[k], "|").alias(k) for k in V.KINDS[:3]])


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.with_text_check(common.pairs(spark, sf_dir), F.col("source"), F.col("target"), "v", V.nfkc_table)


def verify_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every document's translation."""
    return _judged(spark, sf_dir).select("doc_id", F.col("v.status").alias("status"), F.size("v.missing").alias("n_missing"))


def verify_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).groupBy("lang", F.col("v.status").alias("status")).agg(F.count("*").alias("n"), F.sum(F.size("v.missing")).alias("n_missing"))


def newline_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.pairs(spark, sf_dir)
    a, b = V.line_breaks(F.col("source")), V.line_breaks(F.col("target"))
    return rows.select("doc_id", a.alias("source_breaks"), b.alias("target_breaks"), (a == b).alias("same"))


def truncation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.pairs(spark, sf_dir).select("doc_id", V.is_truncated(F.col("source"), F.col("target")).alias("truncated"))


def script_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of unexpected scripts, with some put into every third text."""
    docs = table(spark, sf_dir, "documents")
    given = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " шესаბ ш").otherwise(""))
    return docs.select("doc_id", F.array_join(V.foreign_letters(given), "").alias("letters"))


def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    held = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("i"))
    whole = lambda x: x.cast("long").cast("string")
    source = held.withColumn("cells", F.transform("i", lambda x: F.array(whole(x["l_linenumber"]), whole(x["l_partkey"]), whole(x["l_quantity"]), x["l_returnflag"])))
    turn = F.col("l_orderkey") % 5
    bump = lambda row: F.array(row[0], row[1], (row[2].cast("long") + 1).cast("string"), row[3])
    return source.withColumn(
        "other",
        F.when(turn == 0, F.col("cells"))
        .when(turn == 1, F.slice("cells", F.lit(1), F.size("cells") - 1))
        .when(turn == 2, F.transform("cells", bump))
        .when(turn == 3, F.transform("cells", lambda row: F.array(row[0], row[1], row[2], F.lit("가")))),
    )


def table_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every order's items as a grid against a changed copy."""
    return _grids(spark, sf_dir).withColumn("v", V.check_table(F.col("cells"), F.col("other"))).select("l_orderkey", F.col("v.status").alias("status"), F.size("v.missing").alias("n_missing"))


def symbol_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol-font glyphs put into every text and mapped back; one has no mapping."""
    given = F.concat("text", F.lit(chr(0xF061) + chr(0xF044) + chr(0xF03D) + chr(0xF0D6) + chr(0xF035) + chr(0xF0FF)))
    fixed = T.repair_symbols(given)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(fixed.cast("binary")).alias("fixed_md5"), T.private_left(fixed).cast("int").alias("left"))


def noise_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with stray commas, blanks and dots around it, cleaned."""
    given = F.concat(F.lit(" ,; "), F.translate("text", "e", ","), F.lit("  ,,  end ·;"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean(given).cast("binary")).alias("clean_md5"))


def formula_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which first lines, with an equation number or digits in place of words added, read like formulas."""
    line = F.split("text", "\n")[0]
    turn = F.col("doc_id") % 3
    given = F.when(turn == 0, line).when(turn == 1, F.concat(F.lit("x = y k (2.12) "), F.substring(line, 1, 6))).otherwise(F.concat(F.lit("1a 2b 3c 4d 5e 6f "), F.substring(line, 1, 8)))
    return table(spark, sf_dir, "documents").select("doc_id", T.looks_like_formula(given).alias("formula"), T.is_axis_label(given).alias("label"))


_FORMULA = r"""
WITH g AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN string_split(text, chr(10))[1] WHEN 1 THEN 'x = y k (2.12) ' || left(string_split(text, chr(10))[1], 6) ELSE '1a 2b 3c 4d 5e 6f ' || left(string_split(text, chr(10))[1], 8) END AS t FROM documents),
k AS (SELECT *, list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '') AS w FROM g),
a AS (SELECT *, list_filter(w, lambda x: regexp_matches(x, '[\p{L}\p{N}]')) AS tok FROM k),
c AS (SELECT *, len(tok) AS n,
  len(list_filter(list_distinct(tok), lambda x: regexp_matches(regexp_replace(x, '[.,;:!?)]+$', ''), '^\p{L}{3,}$'))) AS words, len(list_distinct(tok)) AS kinds,
  len(list_filter(tok, lambda x: length(x) = 1 OR (length(x) = 2 AND NOT regexp_matches(x, '^\p{L}+$')))) AS short,
  len(list_filter(tok, lambda x: regexp_matches(x, '\p{Nd}'))) AS dig, len(list_filter(tok, lambda x: length(x) >= 3 AND NOT regexp_matches(x, '\p{Nd}'))) AS long,
  len(list_filter(w, lambda x: regexp_matches(x, '^[-+]?[\p{Nd}.,]+([eE][-+]?\p{Nd}+)?$'))) AS num FROM a)
SELECT doc_id, CASE WHEN n = 0 THEN false WHEN regexp_matches(t, '\(\p{Nd}{1,2}\.\p{Nd}{1,3}[a-z]?\)') AND words <= 0.3 * kinds THEN true
    WHEN n >= 4 THEN short / n >= 0.6 OR (dig / n >= 0.4 AND long / n <= 0.2) ELSE false END AS formula,
  CASE WHEN len(w) = 0 THEN false ELSE num / len(w) >= 0.7 OR length(t) <= 25 END AS label FROM c
"""

QUERIES = {f.__name__: f for f in (verify_number_tokens, spec_part_mask, verify_missing, verify_status_rollup, newline_check, truncation_check, script_check, table_check, symbol_repair, noise_clean, formula_test)}

ORACLES = {
    "verify_number_tokens": f"WITH {PAIRS}, {tokens_sql('s', 'pairs', 'source', 'doc_id')} SELECT doc_id, len(spec)::INT AS n_spec_numbers, len(part)::INT AS n_part_numbers, len(unit)::INT AS n_unit_numbers, len(bare)::INT AS n_bare_numbers FROM s",
    "spec_part_mask": f"WITH {PAIRS}, {tokens_sql('s', 'pairs', 'source', 'doc_id')} SELECT doc_id, array_to_string(spec, '|') AS spec_numbers, array_to_string(part, '|') AS part_numbers, array_to_string(unit, '|') AS unit_numbers FROM s",
    "verify_missing": f"WITH {PAIRS}, {verdict_sql()} SELECT doc_id, status, n_missing FROM judged",
    "verify_status_rollup": f"WITH {PAIRS}, {verdict_sql()} SELECT lang, status, count(*) AS n, sum(n_missing)::BIGINT AS n_missing FROM judged GROUP BY lang, status",
    "newline_check": f"WITH {PAIRS}, b AS (SELECT doc_id, (length(source) - length(replace(source, chr(10), '')))::INT AS source_breaks, (length(target) - length(replace(target, chr(10), '')))::INT AS target_breaks FROM pairs) SELECT *, source_breaks = target_breaks AS same FROM b",
    "truncation_check": f"WITH {PAIRS} SELECT doc_id, length(source) >= {C.TRUNCATED_FROM} AND length(target) < length(source) * {C.TRUNCATED_RATIO} AS truncated FROM pairs",
    "script_check": r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text || CASE WHEN doc_id % 3 = 0 THEN ' шესаბ ш' ELSE '' END, '[\x{0400}-\x{04FF}\x{0530}-\x{058F}\x{10A0}-\x{10FF}\x{0590}-\x{05FF}\x{0600}-\x{06FF}\x{0E00}-\x{0E7F}\x{0900}-\x{097F}]'))), '') AS letters FROM documents",
    "table_check": """SELECT l_orderkey, CASE WHEN l_orderkey % 5 IN (0, 3) THEN 'ok' ELSE 'warn' END AS status, (CASE l_orderkey % 5 WHEN 0 THEN 0 WHEN 3 THEN 0 WHEN 2 THEN count(*) ELSE 1 END)::INT AS n_missing FROM lineitem GROUP BY l_orderkey""",
    "symbol_repair": "SELECT doc_id, md5(text || 'αΔ=√5' || chr(61695)) AS fixed_md5, 1 AS left FROM documents",
    "noise_clean": r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(' ,; ' || translate(text, 'e', ',') || '  ,,  end ·;', '\s*,\s*,+', ',', 'g'), '[ \t]{2,}', ' ', 'g'), '^[ \t,;]+|[ \t,;·]+$', '', 'g'), '^\s+|\s+$', '', 'g')) AS clean_md5 FROM documents",
    "formula_test": _FORMULA,
}

"""Inputs that the queries derive from the driver's tables, in Spark and in DuckDB SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc import config as C
from loomdoc.functions.verify import TABLE_FROM, TABLE_TO


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files make fewer splits than there are: small tables under costly expressions. Large tables
    have splits enough and are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sources, with numbers, standards, parts, units and a bullet added, and a translation that is the
    source, lacks its digits, its line breaks, or most of its text."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    code = F.col("doc_id").cast("string")
    source = F.concat(
        F.coalesce("text", F.lit("")), F.lit("\n• see IEC 60"), F.lpad(code, 4, "0"), F.lit("-2 at ½ of 3,2"), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.lit(" mm², P/N: AB-"), code,
        F.lit("X and 71"), F.when(F.col("doc_id") % 7 == 0, ",36").otherwise(".36"), F.lit(" kV"),
    )
    turn = F.col("doc_id") % 4
    target = (
        F.when(turn == 0, F.col("source"))
        .when(turn == 1, F.regexp_replace("source", "[0-9]", ""))
        .when(turn == 2, F.translate("source", "\n", " "))
        .otherwise(F.substring(F.col("source"), F.lit(1), (F.length("source") * 3 / 10).cast("int")))
    )
    return docs.withColumn("source", source).withColumn("target", target).drop("text")


PAIRS = r"""
src AS (SELECT doc_id, lang, coalesce(text, '') || chr(10) || '• see IEC 60' || CASE WHEN length(doc_id::VARCHAR) >= 4 THEN left(doc_id::VARCHAR, 4) ELSE lpad(doc_id::VARCHAR, 4, '0') END || '-2 at ½ of 3,2'
    || lpad((doc_id % 100)::VARCHAR, 2, '0') || ' mm², P/N: AB-' || doc_id || 'X and 71' || CASE WHEN doc_id % 7 = 0 THEN ',36' ELSE '.36' END || ' kV' AS source FROM documents),
pairs AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN regexp_replace(source, '[0-9]', '', 'g') WHEN 2 THEN translate(source, chr(10), ' ')
    ELSE left(source, floor(length(source) * 3 / 10)::INT) END AS target FROM src)
"""


def normalised_sql(text: str) -> str:
    for sign, value in C.FRACTIONS.items():
        text = f"replace({text}, '{sign}', '{value}')"
    text = f"replace(translate({text}, '{TABLE_FROM}', '{TABLE_TO}'), '℃', '°C')"
    for _ in range(2):  # neighbouring groups share a digit, so a second pass takes the rest
        text = rf"regexp_replace({text}, '(\d) (\d{{3}})\b', '\1\2', 'g')"
    return f"translate({text}, '{C.HYPHENS}', '{'-' * len(C.HYPHENS)}')"


#: DuckDB has no look-around: a sign before and after is matched along and put back.
EDGE = "(^|[^A-Za-z0-9])"
_SPEC = C.SPEC_PATTERN.replace("(?<![A-Za-z0-9])", "").replace("(?![A-Za-z0-9])", "")
_PART = C.PART_PATTERN.replace("(?i)", "").replace("(?<![A-Za-z0-9])", "").replace("(?![A-Za-z0-9])", "")
SQL_SPEC = f"{EDGE}({_SPEC})($|[^A-Za-z0-9])"
SQL_PART = f"(?i){EDGE}({_PART})($|[^A-Za-z0-9])"
SQL_UNIT = rf"(-?{C.NUMBER}\s?(?:{C.UNITS}))($|[^A-Za-z0-9])"
SQL_BARE = f"-?{C.NUMBER}"


def tokens_sql(name: str, source: str, text: str, keep: str) -> str:
    """CTEs that end in ``name``: ``keep`` and the token lists spec, part, unit and bare of ``text`` in ``source``."""
    return rf"""
{name}_0 AS (SELECT {keep}, {normalised_sql(text)} AS n FROM {source}),
{name}_1 AS (SELECT *, regexp_extract_all(n, '{SQL_SPEC}', 2) AS spec, regexp_replace(n, '{SQL_SPEC}', '\1\3', 'g') AS n1 FROM {name}_0),
{name}_2 AS (SELECT *, regexp_extract_all(n1, '{SQL_PART}', 2) AS part, regexp_replace(n1, '{SQL_PART}', '\1\3', 'g') AS n2 FROM {name}_1),
{name}_3 AS (SELECT *, regexp_extract_all(n2, '{SQL_UNIT}', 1) AS unit, regexp_replace(n2, '{SQL_UNIT}', '\2', 'g') AS n3 FROM {name}_2),
{name} AS (SELECT {keep}, spec, part, unit, regexp_extract_all(n3, '{SQL_BARE}') AS bare FROM {name}_3)"""


def lost_sql(a: str, b: str) -> str:
    return f"list_filter(list_distinct({a}), lambda x: len(list_filter({a}, lambda y: y = x)) > len(list_filter({b}, lambda y: y = x)))"


def plain_sql(items: str) -> str:
    prefix = rf"regexp_extract(trim(x), '^-?{C.NUMBER}')"
    rest = f"trim(substring(trim(x), length({prefix}) + 1))"
    return f"list_transform({items}, lambda x: replace({prefix}, ',', '') || CASE WHEN {rest} = '' THEN '' ELSE ' ' || {rest} END)"


def foreign_sql(items: str) -> str:
    return rf"len(list_filter({items}, lambda x: NOT regexp_matches(regexp_extract(trim(x), '^-?{C.NUMBER}'), '{C.ENGLISH_NUMBER}'))) > 0"


def verdict_sql(source: str = "pairs", more: str = "lang") -> str:
    """CTEs that end in ``judged``: doc_id, status and n_missing of (doc_id, source, target)."""
    return f"""
{tokens_sql("s", source, "source", f"doc_id, {more}, source, target")},
{tokens_sql("t", source, "coalesce(target, '')", "doc_id")},
lists AS (
  SELECT s.*, t.spec AS spec2, t.part AS part2, {plain_sql("s.unit")} AS unit1, {plain_sql("t.unit")} AS unit2, {plain_sql("s.bare")} AS bare1, {plain_sql("t.bare")} AS bare2,
    length(source) >= {C.TRUNCATED_FROM} AND length(target) < length(source) * {C.TRUNCATED_RATIO} AS short, list_concat(s.unit, s.bare) AS numbers
  FROM s JOIN t USING (doc_id)),
counted AS (
  SELECT *, len({lost_sql("spec", "spec2")}) + len({lost_sql("part", "part2")}) + len({lost_sql("unit1", "unit2")}) + len({lost_sql("bare1", "bare2")})
    + CASE WHEN length(source) - length(replace(source, chr(10), '')) <> length(target) - length(replace(target, chr(10), '')) THEN 1 ELSE 0 END AS lost, {foreign_sql("numbers")} AS odd
  FROM lists),
judged AS (
  SELECT doc_id, {more}, CASE WHEN short THEN 'warn' WHEN odd THEN 'skipped' WHEN lost > 0 THEN 'warn' ELSE 'ok' END AS status,
    (CASE WHEN short THEN 1 WHEN odd THEN 0 ELSE lost END)::INT AS n_missing
  FROM counted)"""


def layout_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one page: words on a grid of 40 by 14 points, the first line in larger type."""
    docs = spread(table(spark, sf_dir, "documents").select(F.lit("documents").alias("doc_sha"), F.col("doc_id").cast("int").alias("page_no"), "text"))
    lines = docs.select("doc_sha", "page_no", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    pieces = lines.select("doc_sha", "page_no", "line", F.posexplode(F.split("t", " ")).alias("k", "text"))
    placed = pieces.filter("text <> ''").withColumn("x0", 72.0 + 40 * F.col("k")).withColumn("top", 72.0 + 14 * F.col("line"))
    return placed.select(
        "doc_sha", "page_no", "text", "x0", "top", (F.col("x0") + 6 * F.length("text")).alias("x1"), (F.col("top") + 10).alias("bottom"), F.when(F.col("line") == 0, 14.0).otherwise(10.0).alias("size")
    )


def layout_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.lit("documents").alias("doc_sha"), F.col("doc_id").cast("int").alias("page_no"), F.lit(6000.0).alias("page_width"), (144.0 + 14 * F.size(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("page_height")
    )


#: The lines of ``layout_words``: doc_id, original line, dense line number, words.
LINES = r"""
raw AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS t FROM documents),
lines AS (SELECT doc_id, line, t, list_filter(string_split(t, ' '), lambda x: x <> '') AS w, (row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1)::INT AS line_no
  FROM raw WHERE len(list_filter(string_split(t, ' '), lambda x: x <> '')) > 0)
"""

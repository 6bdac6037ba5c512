"""Deterministic checks of a translation against its source, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc import config as C
from loomdoc.functions.text import strip
from loomdoc.model import VERIFY

SPEC, PART = "(?U)" + C.SPEC_PATTERN, "(?U)" + C.PART_PATTERN
BARE = f"(?U)-?{C.NUMBER}"
UNIT = rf"(?U)-?{C.NUMBER}\s?(?:{C.UNITS})(?![A-Za-z0-9])"
KINDS = ("spec_numbers", "part_numbers", "unit_numbers", "bare_numbers")


def nfkc(text: Column) -> Column:
    """NFKC. Spark has no such function, so this is a vectorised Python one; ASCII texts pass untouched."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))

    return F.pandas_udf(run, "string")(text)


#: A finite part of NFKC for plans that stay on the JVM: superscripts, full-width digits and signs that keep their length.
TABLE_FROM = "²³¹０１２３４５６７８９．，－／ 　"
TABLE_TO = "2310123456789.,-/  "


def nfkc_table(text: Column) -> Column:
    """What of NFKC the characters of ``TABLE_FROM`` need, and ℃."""
    return F.replace(F.translate(text, TABLE_FROM, TABLE_TO), F.lit("℃"), F.lit("°C"))


def normalise(text: Column, compose: Callable[[Column], Column] = nfkc) -> Column:
    """Vulgar fractions as decimals (before NFKC, which would take them apart), NFKC, blanks between thousands closed, one hyphen."""
    for sign, value in C.FRACTIONS.items():
        text = F.replace(text, F.lit(sign), F.lit(value))
    text = F.regexp_replace(compose(text), r"(?U)(?<=\d) (?=\d{3}\b)", "")
    return F.translate(text, C.HYPHENS, "-" * len(C.HYPHENS))


def tokens(text: Column, compose: Callable[[Column], Column] = nfkc, normalised: bool = False) -> Column:
    """Standard numbers, part numbers, numbers with a unit and bare numbers, each taken out before the next is sought."""
    rest, out = text if normalised else normalise(text, compose), []
    for kind, pattern in zip(KINDS, (SPEC, PART, UNIT, BARE), strict=True):
        out.append(F.regexp_extract_all(rest, F.lit(pattern), 0).alias(kind))
        rest = F.regexp_replace(rest, pattern, "")
    return F.struct(*out)


def numeric_prefix(token: Column) -> Column:
    found = F.regexp_extract(strip(token), f"(?U)^-?{C.NUMBER}", 0)
    return F.when(found == "", strip(token)).otherwise(found)


def is_english_number(token: Column) -> Column:
    return numeric_prefix(token).rlike("(?U)" + C.ENGLISH_NUMBER)


def plain_number(token: Column) -> Column:
    """Without thousands' commas, a single blank before the unit."""
    prefix = numeric_prefix(token)
    rest = strip(F.substring(strip(token), F.length(prefix) + 1, F.length(token)))
    number = F.replace(prefix, F.lit(","), F.lit(""))
    return F.when(rest == "", number).otherwise(F.concat(number, F.lit(" "), rest))


def lost(source: Column, target: Column) -> Column:
    """Distinct items that ``source`` holds more often than ``target``, in the source's order."""
    times = lambda items, x: F.size(F.filter(items, lambda y: y == x))
    return F.filter(F.array_distinct(source), lambda x: times(source, x) > times(target, x))


def foreign_letters(text: Column) -> Column:
    """Distinct characters of unexpected scripts, sorted."""
    ranges = "".join(f"\\x{{{lo:04X}}}-\\x{{{hi:04X}}}" for lo, hi in C.FOREIGN)
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(f"[{ranges}]"), F.lit(0))))


def is_truncated(source: Column, target: Column) -> Column:
    return (F.length(source) >= C.TRUNCATED_FROM) & (F.length(target) < F.length(source) * C.TRUNCATED_RATIO)


def line_breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _verdict(status: Column | str, missing: Column | None = None, reason: Column | str | None = None) -> Column:
    status = F.lit(status) if isinstance(status, str) else status
    none = F.array().cast("array<string>")
    return F.struct(status.alias("status"), (none if missing is None else missing).alias("missing"), F.lit(reason).cast("string").alias("reason")).cast(VERIFY)


def with_text_check(df: DataFrame, source: Column, target: Column, name: str = "verify", compose: Callable[[Column], Column] = nfkc) -> DataFrame:
    """``df`` with the verdict on a text block in ``name``. Nothing to check without a source; damage shows first, then
    numbers that are not written the English way put the block out of scope, then losses count.

    Token lists become columns before they are compared, so that each is computed once a row.
    """
    none = F.array().cast("array<string>")
    held = df.withColumns({"_source": source, "_target": F.coalesce(target, F.lit(""))})
    held = held.withColumns({"_sn": normalise(F.col("_source"), compose), "_tn": normalise(F.col("_target"), compose)})
    held = held.withColumns({"_st": tokens(F.col("_sn"), normalised=True), "_tt": tokens(F.col("_tn"), normalised=True)})
    lists = {}
    for side in ("s", "t"):
        for k in KINDS:
            found = F.col(f"_{side}t.{k}")
            lists[f"_{side}_{k}"] = F.transform(found, plain_number) if k in KINDS[2:] else found
    lists["_odd"] = F.exists(F.concat("_st.unit_numbers", "_st.bare_numbers"), lambda x: ~is_english_number(x))
    lists["_letters"] = foreign_letters(F.col("_target"))
    held = held.withColumns(lists)
    source, target, letters = F.col("_source"), F.col("_target"), F.col("_letters")
    damage = F.concat(
        F.when(F.size(letters) > 0, F.array(F.concat(F.lit(C.NOTE_FOREIGN), F.array_join(letters, "")))).otherwise(none),
        F.when(is_truncated(source, target), F.array(F.lit(C.NOTE_TRUNCATED))).otherwise(none),
    )
    breaks = F.when(line_breaks(source) != line_breaks(target), F.array(F.lit(C.NOTE_LINES))).otherwise(none)
    held = held.withColumns({"_damage": damage, "_missing": F.concat(*[lost(F.col(f"_s_{k}"), F.col(f"_t_{k}")) for k in KINDS], breaks)})
    verdict = (
        F.when(source.isNull() | (source == ""), _verdict("ok"))
        .when(F.size("_damage") > 0, _verdict("warn", F.col("_damage")))
        .when(F.col("_odd"), _verdict("skipped", reason=C.NOTE_NUMBERS))
        .otherwise(_verdict(F.when(F.size("_missing") > 0, "warn").otherwise("ok"), F.col("_missing")))
    )
    return held.withColumn("_verdict", verdict).select(*[c for c in df.columns if c != name], F.col("_verdict").alias(name))


def _quoted(cell: Column) -> Column:
    return F.when(cell.isNull(), "None").otherwise(F.concat(F.lit("'"), cell, F.lit("'")))


def composed_cells(grid: Column, compose: Callable[[Column], Column]) -> Column:
    """Stripped cells after fractions and ``compose``, which sees a grid as one text: Python functions can't stand inside a transform.

    Separators compose with nothing. One inside a cell becomes another control character; no number holds either.
    """

    def cell(text: Column) -> Column:
        text = F.translate(F.coalesce(strip(text), F.lit("")), "\x1d\x1e", "\x1f\x1f")
        for sign, value in C.FRACTIONS.items():
            text = F.replace(text, F.lit(sign), F.lit(value))
        return text

    rows = F.transform(grid, lambda row: F.coalesce(F.array_join(F.transform(row, cell), "\x1e"), F.lit("")))
    return F.transform(F.split(compose(F.array_join(rows, "\x1d")), "\x1d"), lambda row: F.split(row, "\x1e"))


def check_table(source: Column, target: Column, compose: Callable[[Column], Column] = nfkc_table, composed: Column | None = None) -> Column:
    """Verdict on a grid: as many rows and first-row columns, and numeric cells unchanged. Cells whose number is
    not written the English way, and null cells, are not judged; ragged rows are compared as far as both go.
    ``composed`` holds the source's ``composed_cells``; without it each cell is composed here."""
    width = lambda grid: F.when(F.size(grid) > 0, F.coalesce(F.size(grid[0]), F.lit(0))).otherwise(0)

    def cell(r: Column, c: Column, s: Column, o: Column) -> Column:
        number = normalise(strip(s), compose) if composed is None else normalise(F.get(F.get(composed, r), c), lambda text: text)
        r, c = r.cast("string"), c.cast("string")
        judged = s.isNotNull() & number.rlike(f"(?U)^-?{C.NUMBER}$") & is_english_number(number)
        changed = strip(F.coalesce(o, F.lit(""))) != strip(s)
        return F.when(judged & changed, F.concat(F.lit("["), r, F.lit(","), c, F.lit("] "), _quoted(s), F.lit(" -> "), _quoted(o)))

    def row(pair: Column, r: Column) -> Column:
        both = F.arrays_zip(pair["s"].alias("s"), pair["o"].alias("o"))
        known = F.slice(both, F.lit(1), F.least(F.size(pair["s"]), F.size(pair["o"])))
        return F.transform(known, lambda x, c: cell(r, c, x["s"], x["o"]))

    rows = F.transform(F.zip_with(source, target, lambda s, o: F.struct(s.alias("s"), o.alias("o"))), row)
    missing = F.filter(F.flatten(rows), lambda x: x.isNotNull())
    shape = lambda grid: F.concat(F.size(grid).cast("string"), F.lit("x"), width(grid).cast("string"))
    note = F.concat(F.lit("shape mismatch: "), shape(source), F.lit(" (원문) vs "), shape(target), F.lit(" (번역)"))
    return (
        F.when(source.isNull() | (F.size(source) == 0), _verdict("ok"))
        .when(target.isNull() | (F.size(target) == 0), _verdict("warn", F.array(F.lit(C.NOTE_NO_TABLE))))
        .when(shape(source) != shape(target), _verdict("warn", F.array(note)))
        .otherwise(_verdict(F.when(F.size(missing) > 0, "warn").otherwise("ok"), missing))
    )


def with_block_check(df: DataFrame, compose: Callable[[Column], Column] = nfkc) -> DataFrame:
    """Blocks (type, source, ko, table, verify) with their verdict by type. Page edges and figures are not judged here
    and keep the verdict they have."""
    kind = F.col("type")
    held = with_text_check(df, F.col("source"), F.col("ko"), "_text", compose)
    held = held.withColumn("_cells", composed_cells(F.when(kind == "table", F.col("table.cells_src")), compose))
    table = check_table(F.col("table.cells_src"), F.col("table.cells_ko"), composed=F.col("_cells"))
    verdict = F.when(kind.isin("header_footer", "figure"), F.col("verify")).when(kind == "table", table).otherwise(F.col("_text"))
    return held.withColumn("verify", verdict).drop("_text", "_cells")


def out_of_scope(kind: Column) -> Column:
    """The verdict on a block that is not judged."""
    return _verdict("skipped").withField("reason", F.concat(kind, F.lit(" - not verified")))

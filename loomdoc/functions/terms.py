"""Glossary terms in texts, and the hashes that results are stored under."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc import config as C

TERM = "struct<en:string,ko:string,note:string>"


def match_key(term: Column) -> Column:
    """Lower case, edges trimmed, runs of hyphens and blanks as one blank."""
    return F.regexp_replace(F.regexp_replace(F.lower(term), r"(?U)^\s+|\s+$", ""), r"(?U)[-\s]+", " ")


def plural(term: Column) -> Column:
    """The regular English plural of the term's last word."""
    return (
        F.when((F.length(term) > 1) & term.rlike("[^aeiou]y$"), F.regexp_replace(term, "y$", "ies"))
        .when(term.rlike("(?:s|x|z|ch|sh)$"), F.concat(term, F.lit("es")))
        .otherwise(F.concat(term, F.lit("s")))
    )


def term_pattern(term: Column) -> Column:
    """Regular expression for a term and its plural: any case, hyphen or blank alike, no ASCII letter or digit beside it."""
    quote = lambda x: F.replace(F.regexp_replace(x, r"([\\.^$|?*+()\[\]{}&/-])", r"\\$1"), F.lit(" "), F.lit(r"[-\s]"))
    key = match_key(term)
    return F.concat(F.lit(r"(?iuU)(?<![A-Za-z0-9])(?:"), quote(plural(key)), F.lit("|"), quote(key), F.lit(r")(?![A-Za-z0-9])"))


def occurrences(text: Column, pattern: Column) -> Column:
    """(start, stop) of every match, from the lengths of what lies between and of the matches."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(sizes)), sizes, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["g"]
        span = F.struct(begin.alias("start"), (begin + x["m"]).alias("stop"))
        return F.struct((begin + x["m"]).alias("at"), F.concat(acc["found"], F.array(span)).alias("found"))

    return F.aggregate(steps, start, step, lambda acc: acc["found"])


def chosen(candidates: Column) -> Column:
    """Greedy cover: candidates sorted by (-length, start, place in the glossary); one that overlaps an earlier choice goes."""
    kind = "array<struct<neg:int,start:int,pos:int,stop:int>>"
    clash = lambda acc, x: F.exists(acc, lambda y: (x["start"] < y["stop"]) & (x["stop"] > y["start"]))
    return F.aggregate(F.array_sort(candidates), F.array().cast(kind), lambda acc, x: F.when(clash(acc, x), acc).otherwise(F.concat(acc, F.array(x))))


def match_terms(text: Column, glossary: DataFrame) -> Column:
    """Terms of ``glossary`` (en, ko, note; in order of ``pos`` if it has one) that occur in ``text``, each once, longest matches first.

    The glossary is edited by hand; it becomes part of the expression, so matching needs no join or shuffle, and costs a search a term in each text. Empty and null texts match nothing.
    """
    order = ["pos"] if "pos" in glossary.columns else []
    terms = glossary.select("en", "ko", "note", term_pattern(F.col("en")).alias("p"), *order)
    rows = (terms.orderBy(*order) if order else terms).collect()
    if not rows:
        return F.array().cast(f"array<{TERM}>")
    # one literal each, however many terms
    patterns = F.from_json(F.lit(json.dumps([r["p"] for r in rows])), "array<string>")
    entries = F.from_json(F.lit(json.dumps([{c: r[c] for c in ("en", "ko", "note")} for r in rows])), f"array<{TERM}>")
    spans = F.flatten(
        F.transform(
            patterns,
            lambda p, i: F.transform(
                occurrences(F.coalesce(text, F.lit("")), p),
                lambda s: F.struct((s["start"] - s["stop"]).alias("neg"), s["start"].alias("start"), i.alias("pos"), s["stop"].alias("stop")),
            ),
        )
    )
    taken = F.transform(chosen(spans), lambda x: F.element_at(entries, x["pos"] + 1))
    once = F.aggregate(taken, F.array().cast(f"array<{TERM}>"), lambda acc, x: F.when(F.exists(acc, lambda y: y["en"] == x["en"]), acc).otherwise(F.concat(acc, F.array(x))))
    return once


def terms_hash(terms: Column) -> Column:
    """12 hex digits of the canonical JSON of the terms, whatever their order."""
    return F.substring(F.sha2(F.to_json(F.array_sort(terms)), 256), 1, 12)


def cache_key(terms: Column, model: Column) -> Column:
    """16 hex digits of the terms, the prompt version, the model and the target language."""
    return F.substring(F.sha2(F.concat_ws("|", terms_hash(terms), F.lit(C.PROMPT_VERSION), model, F.lit("ko")), 256), 1, 16)

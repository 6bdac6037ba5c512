"""Quality of a page's extraction, the model it goes to and the budget it gets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdoc import config as C
from loomdoc.operators.blocks import translatable


def quality_score(blocks: Column) -> Column:
    """0 to 1: orphan letters, private-use glyphs and short blocks cost a third each; 0 for pages with hardly any text."""
    texts = F.filter(blocks, lambda b: b["type"].isin("paragraph", "heading"))
    sources = F.transform(texts, lambda b: F.coalesce(b["source"], F.lit("")))
    joined = F.array_join(sources, " ")
    count = lambda pattern: F.regexp_count(joined, F.lit(pattern))
    one = F.lit(1.0)
    orphans = F.least(one, count(r"(?U)\s[a-zA-Z]\s") / 20)
    glyphs = F.least(one, count(r"[\x{F000}-\x{F0FF}]") / 5)
    short = F.least(one, F.size(F.filter(sources, lambda s: F.length(s) < C.SHORT_BLOCK)) / F.size(sources))
    return F.when((F.size(texts) == 0) | (F.length(joined) < C.MIN_PAGE_CHARS), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - (orphans + glyphs + short) / 3))


def has_drawing(blocks: Column) -> Column:
    return F.exists(blocks, lambda b: b["type"].isin("table", "figure"))


def needs_image(has_text_layer: Column, blocks: Column) -> Column:
    return ~has_text_layer | has_drawing(blocks)


def choose_model(has_text_layer: Column, blocks: Column) -> Column:
    return (
        F.when(~has_text_layer, C.MODEL_SCANNED)
        .when(has_drawing(blocks) | (quality_score(blocks) < C.MIN_SCORE), C.MODEL_IMAGE)
        .otherwise(C.MODEL_TEXT)
    )


def token_budget(blocks: Column) -> Column:
    """Four tokens a character of what is sent, within bounds."""
    per, low, high = C.BUDGET
    kept = F.filter(blocks, lambda b: translatable(b["type"]))
    size = lambda b: F.when(b["type"] == "table", F.array_join(F.flatten(b["table"]["cells_src"]), "")).otherwise(F.coalesce(b["source"], F.lit("")))
    chars = F.aggregate(F.transform(kept, lambda b: F.length(size(b))), F.lit(0), lambda a, x: a + x)
    return F.greatest(F.lit(low), F.least(F.lit(high), chars * per))

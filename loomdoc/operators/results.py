"""Stored page results: lookups, versions, selections and what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdoc.functions import pages as P
from loomdoc.functions import terms as K
from loomdoc.operators.layout import PAGE


def latest(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The newest row of each key, of equally new ones the one with the largest ``tie``. One partial aggregate, no sort."""
    rest = F.struct(*[c for c in rows.columns if c not in keys])
    best = rows.groupBy(*keys).agg(F.max_by(rest, F.struct(at, tie)).alias("_r"))
    return best.select(*keys, "_r.*").select(*rows.columns)


def stored_pages(results: DataFrame, schema: str) -> DataFrame:
    """Latest result of each page, parsed. A page whose newest version is broken counts as missing."""
    newest = latest(results, PAGE, "written_at", "cache_key")
    return newest.withColumn("page", F.from_json("page_json", schema, {"mode": "PERMISSIVE"})).filter("page.page_no IS NOT NULL")


def translated_pages(results: DataFrame) -> DataFrame:
    """Pages with any stored version, and how many a document has."""
    return results.groupBy("doc_sha").agg(F.array_sort(F.collect_set("page_no")).alias("cached_pages"), F.countDistinct("page_no").alias("translated_page_count"))


def cache_split(pages: DataFrame, results: DataFrame) -> DataFrame:
    """Pages (with terms and model_id) with their key, ``hit`` and the stored ``page_json``."""
    keyed = pages.withColumn("cache_key", K.cache_key(F.col("terms"), F.col("model_id")))
    stored = latest(results, [*PAGE, "cache_key"], "written_at", "page_json").select(*PAGE, "cache_key", "page_json")
    return keyed.join(stored, [*PAGE, "cache_key"], "left").withColumn("hit", F.col("page_json").isNotNull())


def reused(selected: DataFrame, results: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    return selected.join(results.select(*keys).distinct(), keys, "left_semi")


def missing(selected: DataFrame, results: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    return selected.join(results.select(*keys).distinct(), keys, "left_anti")


def estimate(pages: Column, cached: Column) -> Column:
    """Selected, new and reused pages of a selection, and how long the new ones take."""
    kept = F.size(F.array_intersect(pages, cached))
    new = F.size(pages) - kept
    seconds = P.eta_seconds(new)
    return F.struct(F.size(pages).alias("selected"), new.alias("new_count"), kept.alias("reused_count"), seconds.alias("eta_sec"), P.eta_text(seconds).alias("eta_text"))


def requested(pages: Column, results: DataFrame) -> DataFrame:
    """``results`` restricted to the requested pages, in the order asked for."""
    return results.withColumn("_at", F.array_position(pages, F.col("page_no"))).filter("_at > 0").orderBy("_at").drop("_at")


def recent(docs: DataFrame, at: str, tie: str, results: DataFrame | None = None, limit: int = 10, broken: Column | None = None) -> DataFrame:
    """The newest documents; broken records go after the limit, so fewer may be left."""
    top = docs.orderBy(F.desc(at), tie).limit(limit)
    top = top if broken is None else top.filter(~broken)
    if results is None:
        return top
    counts = translated_pages(results).select("doc_sha", "translated_page_count")
    return top.join(counts, top["sha256"] == counts["doc_sha"], "left").drop("doc_sha").fillna(0, ["translated_page_count"])


def section_ends(outline: DataFrame, doc: str, index: str, level: str, page: str, last: Column) -> DataFrame:
    """Each outline entry with ``end_page``: the page before the next entry of its level or a higher one, or the last.

    For each level that occurs, one pass from the document's end holds the nearest entry of that level or a higher one: time
    grows with entries times levels.
    """
    levels = sorted(r[0] for r in outline.select(level).distinct().collect() if r[0] is not None)  # outlines are a few levels deep
    later = W.partitionBy(doc).orderBy(F.desc(index)).rowsBetween(W.unboundedPreceding, -1)
    nearest = F.lit(None).cast(outline.schema[page].dataType)
    for k in levels:
        nearest = F.when(F.col(level) == k, F.last(F.when(F.col(level) <= k, F.col(page)), ignorenulls=True).over(later)).otherwise(nearest)
    return outline.withColumn("end_page", F.coalesce(nearest - 1, last))


def verification_counts(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Warnings of all blocks and skipped blocks of text and tables."""
    status = F.col("verify.status")
    return blocks.groupBy(*keys).agg(
        F.count_if(status == "warn").alias("warn_count"), F.count_if((status == "skipped") & ~F.col("type").isin("header_footer", "figure")).alias("skipped_count")
    )


def append_only_new(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Documents whose content hash is not stored yet; a second upload keeps the first record and its file name."""
    first = latest(docs.withColumn("_neg", -F.unix_micros("created_at")), ["sha256"], "_neg", "filename").drop("_neg")
    return first.join(known.select("sha256"), "sha256", "left_anti")


def badges(pages: DataFrame, meta: DataFrame, cached: DataFrame) -> DataFrame:
    """Whether a page has a table and whether it is translated."""
    held = pages.join(meta.select(F.col("sha256").alias("doc_sha"), "table_pages"), "doc_sha", "left").join(cached.select("doc_sha", "cached_pages"), "doc_sha", "left")
    has = lambda c: F.coalesce(F.array_contains(c, F.col("page_no")), F.lit(False))
    return held.withColumn("has_table", has(F.col("table_pages"))).withColumn("is_cached", has(F.col("cached_pages"))).drop("table_pages", "cached_pages")


def selection_order(events: DataFrame, pages: list[int]) -> DataFrame:
    """Rows in the order in which their pages were asked for."""
    place = F.array_position(F.array(*map(F.lit, pages)), F.col("page"))
    return events.filter(place > 0).orderBy(place)

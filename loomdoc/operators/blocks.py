"""Pages as ordered, numbered blocks, from words, table candidates and drawing primitives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc import config as C
from loomdoc.functions import text as T
from loomdoc.model import BLOCK, GRID, TABLE, UNTRANSLATED, VERIFY
from loomdoc.operators import layout, packed, zones
from loomdoc.operators.layout import PAGE


def verdict(status: str, reason: str | Column | None = None) -> Column:
    reason = reason if isinstance(reason, Column) else F.lit(reason).cast("string")
    return F.struct(F.lit(status).alias("status"), F.array().cast("array<string>").alias("missing"), reason.alias("reason")).cast(VERIFY)


def block_id(page: Column, index: Column) -> Column:
    return F.format_string("p%03d-b%02d", page, index)


_FOUND = "array<struct<type:string,bbox:array<double>,lines:array<string>,size:double,n_lines:int,cells:array<array<string>>>>"
#: Pages and words of a batch at most, beyond the last page's.
_PAGES, _WORDS = 256, 100_000


def _paragraphs(lines: list[tuple], gap: float) -> list[list[tuple]]:
    """Lines whose gap to the line before is at most ``gap``."""
    out: list[list[tuple]] = []
    for k, line in enumerate(lines):
        if k and line[2] - lines[k - 1][4] <= gap:
            out[-1].append(line)
        else:
            out.append([line])
    return out


def _found(page: packed.Page, words: packed.Words, width: float | None, height: float | None) -> tuple[float, list[tuple]]:
    """Median line size and blocks (type, bbox, lines, size, n_lines, cells) of a page with words, by top and left edge; tables, figures
    and text stand in this order where both are equal."""
    body = layout.median_size(words.numbers[4], C.DEFAULT_SIZE)
    tables = [(z, cells) for z, fit, cells in page.candidates if fit and zones.large_enough(z, width, body)]
    taken = [z for z, _ in tables]
    figures = [z for z, fit, _ in page.candidates if not (fit and zones.large_enough(z, width, body))]
    figures += zones.page_diagrams([z for z, _ in page.primitives], [image for _, image in page.primitives], taken)
    wide = [zones.widened(z, body * C.FIGURE_MARGIN, width, height) for z in zones.merge_vertical(figures)]
    if wide:
        lines = layout.page_lines(words, *words.numbers, body * C.SCRIPT_GAP)
        wide = zones.absorb_labels(wide, [line[1:5] for line in lines if T.labels_axis(T.repaired(line[0]))])
    free = np.flatnonzero(zones.outside(words.numbers[:4], [*taken, *wide]))
    lines = layout.page_lines(words, *words.numbers[:, free], body * C.SCRIPT_GAP, free)
    blocks = [("table", z, None, None, None, cells) for z, cells in sorted(tables, key=lambda t: t[0][1])]
    blocks += [("figure", z, None, None, None, None) for z in wide]
    for held in _paragraphs(lines, body * C.PARAGRAPH_GAP):
        texts, x0, top, x1, bottom, sizes = zip(*held, strict=True)
        blocks.append(("text", [min(x0), min(top), max(x1), max(bottom)], [T.repaired(t) for t in texts], sum(sizes) / len(sizes), len(held), None))
    return layout.median_size([line[5] for line in lines], 0.0), sorted(blocks, key=lambda b: (b[1][1], b[1][0]))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (doc_sha, page_no, width, height, median, blocks) as Arrow columns."""
    held = [b for r in rows for b in r[5] or ()]
    type_, bbox, lines, size, n_lines, cells = zip(*held, strict=True) if held else ((),) * 6
    one = pa.StructArray.from_arrays(
        [
            pa.array(type_, pa.string()), pa.array(bbox, pa.list_(pa.float64())), pa.array(lines, pa.list_(pa.string())), pa.array(size, pa.float64()), pa.array(n_lines, pa.int32()),
            pa.array(cells, pa.list_(pa.list_(pa.string()))),
        ],
        ["type", "bbox", "lines", "size", "n_lines", "cells"],
    )
    ends = np.append(0, np.cumsum([len(r[5] or ()) for r in rows])).astype(np.int32)
    blocks = pa.ListArray.from_arrays(pa.array(ends), one, mask=pa.array([r[5] is None for r in rows]))
    plain = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64()))]
    return pa.RecordBatch.from_arrays([*plain, blocks], ["doc_sha", "page_no", "page_width", "page_height", "median", "blocks"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with their blocks; null for those without words. Words of pages that have no size are left out."""
    rows, n = [], 0
    for page in packed.pages_of(batches):
        words = page.words() if page.sizes else None
        if words is None:
            rows += [(page.doc_sha, page.page_no, *size, None, None) for size in page.sizes]
        else:
            size = max(page.sizes, key=lambda s: [v or 0.0 for v in s])
            rows.append((page.doc_sha, page.page_no, *size, *_found(page, words, *size)))
            n += len(words.lengths)
        if len(rows) >= _PAGES or n >= _WORDS:
            yield _batch(rows)
            rows, n = [], 0
    if rows:
        yield _batch(rows)


def extract_blocks(words: DataFrame, candidates: DataFrame, primitives: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks (doc_sha, page_no, id, type, bbox, source, table, ko, verify) of every page, numbered in reading order.

    Valid tables and merged, widened drawings take their words out of the text; what is left becomes paragraphs. Pages without words get one
    block for the whole page, whose verdict stays skipped. Words are read once and moved once; a worker holds one page at a time.
    """
    found = packed.gathered(words, candidates, primitives, pages, zones.holds_table(F.col("cells"))).mapInArrow(_extracted, f"doc_sha string, page_no int, page_width double, page_height double, median double, blocks {_FOUND}")

    def cleaned(b: Column) -> Column:
        source = F.when(b["lines"].isNotNull(), T.tidy(T.join_lines(b["lines"])))
        return F.struct(b["type"].alias("type"), b["bbox"].alias("bbox"), source.alias("source"), b["size"].alias("size"), b["n_lines"].alias("n_lines"), b["cells"].alias("cells"))

    kept = F.filter(F.transform("blocks", cleaned), lambda b: b["source"].isNull() | (b["source"] != ""))
    bare = F.col("_bare")
    rows = found.select(*PAGE, "page_width", "page_height", "median", F.col("blocks").isNull().alias("_bare"), F.posexplode_outer(kept).alias("_i", "_b"))
    rows = rows.filter(bare | F.col("_i").isNotNull()).select(*PAGE, "page_width", "page_height", "median", "_bare", "_i", "_b.*").withColumn("_marked", T.marked_words(F.col("source")))
    top, bottom = F.col("bbox")[1], F.col("bbox")[3]
    kind = layout.block_kind(F.col("source"), F.col("_marked"), top, bottom, F.col("page_height"), F.col("n_lines"), F.col("size"), F.col("median"))
    rows = rows.withColumn("_of", F.col("type")).withColumn("type", F.when(bare, "paragraph").when(F.col("_of") == "text", kind).otherwise(F.col("_of")))
    cells = F.col("cells")
    grid = F.struct(
        F.size(cells).alias("rows"), F.when(F.size(cells) > 0, F.size(cells[0])).otherwise(0).alias("cols"), T.clean_cells(cells).alias("cells_src"), F.lit(None).cast(GRID).alias("cells_ko")
    ).cast(TABLE)
    type_, of, zero = F.col("type"), F.col("_of"), F.lit(0.0)
    verify = (
        F.when(bare, verdict("skipped", C.NOTE_SCANNED))
        .when(of == "figure", verdict("skipped", "figure - not translated/verified"))
        .when(type_ == "header_footer", verdict("skipped", "header_footer - not translated/verified"))
        .when(type_ == "figure", verdict("skipped", "formula - not translated/verified"))
        .otherwise(verdict("ok"))
    )
    return rows.select(
        *PAGE, block_id(F.col("page_no"), F.coalesce("_i", F.lit(0))).alias("id"), "type", F.when(bare, F.array(zero, zero, "page_width", "page_height")).otherwise(F.col("bbox")).alias("bbox"),
        "source", F.when(of == "table", grid).alias("table"), F.lit(None).cast("string").alias("ko"), verify.alias("verify"),
    )


def nest(blocks: DataFrame, pages: DataFrame, words: DataFrame) -> DataFrame:
    """Page records with their blocks in order."""
    one = F.struct("id", "type", "bbox", "source", "table", "ko", "verify").cast(BLOCK)
    held = blocks.groupBy(*PAGE).agg(F.array_sort(F.collect_list(one), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).alias("blocks"))
    has = words.select(*PAGE).distinct().withColumn("_w", F.lit(True))
    return pages.join(has, PAGE, "left").join(held, PAGE, "left").select(
        *PAGE, "page_width", "page_height", F.lit(C.RENDER_SCALE).alias("render_scale"), F.coalesce("_w", F.lit(False)).alias("has_text_layer"),
        F.coalesce("blocks", F.array().cast(f"array<{BLOCK}>")).alias("blocks"),
    )


def translatable(kind: Column) -> Column:
    return ~kind.isin(*UNTRANSLATED)


def page_text(blocks: Column) -> Column:
    """What is sent for translation, joined by blanks: cells and sources of translatable blocks."""
    kept = F.filter(blocks, lambda b: translatable(b["type"]))
    parts = F.transform(kept, lambda b: F.when(b["type"] == "table", F.filter(F.flatten(b["table"]["cells_src"]), lambda c: c.isNotNull() & (c != ""))).otherwise(F.array(b["source"])))
    return F.array_join(F.filter(F.flatten(parts), lambda x: x.isNotNull() & (x != "")), " ")

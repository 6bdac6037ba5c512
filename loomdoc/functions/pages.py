"""Page ranges, names, geometry and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdoc import config as C


def parse_range(text: Column, lenient: bool = False) -> Column:
    """``12-18, 25`` as sorted distinct page numbers; a reversed part is empty. A part that is no number raises an error, or is ignored if ``lenient``."""
    number = lambda x: (F.trim(x).try_cast("int") if lenient else F.trim(x).cast("int"))

    def pages(part: Column) -> Column:
        first = number(F.substring_index(part, "-", 1))
        last = number(F.when(part.contains("-"), F.substring(part, F.instr(part, "-") + 1, F.length(part))).otherwise(part))
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, pages))))


def toggled(pages: Column, page: Column) -> Column:
    """A selection with one page switched."""
    one = F.array(page)
    return F.array_sort(F.when(F.array_contains(pages, page), F.array_except(pages, one)).otherwise(F.array_union(pages, one)))


def eta_seconds(new_pages: Column) -> Column:
    return (F.ceil(new_pages / C.CONCURRENCY) * C.ETA_SECONDS).cast("int")


def eta_text(seconds: Column) -> Column:
    minutes, rest = F.floor(seconds / 60).cast("int"), (seconds % 60).cast("int")
    return (
        F.when(seconds < 60, F.format_string("%d초", seconds.cast("int")))
        .when(rest == 0, F.format_string("%d분", minutes))
        .otherwise(F.format_string("%d분 %d초", minutes, rest))
    )


def render_name(page: Column) -> Column:
    return F.format_string("p%03d.png", page)


def thumbnail_name(page: Column) -> Column:
    return F.format_string("p%03d_thumb.png", page)


def result_name(page: Column, key: Column) -> Column:
    return F.format_string("p%03d__%s.json", page, key)


def page_of_name(name: Column) -> Column:
    """12 of ``…/p012__key.json``; null for other names."""
    return F.nullif(F.regexp_extract(name, r"(?:^|/)p(\d+)__[^/]*\.json$", 1), F.lit("")).cast("int")


def overlaps(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Boxes (x0, top, x1, bottom) share more than an edge."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def near(a: tuple[Column, ...], b: tuple[Column, ...], gap: float) -> Column:
    """Gaps in both directions are at most ``gap``."""
    return (b[0] - a[2] <= gap) & (a[0] - b[2] <= gap) & (b[1] - a[3] <= gap) & (a[1] - b[3] <= gap)


def expanded(box: tuple[Column, ...], margin: Column, width: Column, height: Column) -> tuple[Column, ...]:
    zero = F.lit(0.0)
    return F.greatest(zero, box[0] - margin), F.greatest(zero, box[1] - margin), F.least(width, box[2] + margin), F.least(height, box[3] + margin)


def overlay(bbox: Column, width: Column, height: Column) -> Column:
    """Left, top, width and height of a box in percent of the page, clamped to it."""
    left, top = F.greatest(F.lit(0.0), bbox[0] / width * 100), F.greatest(F.lit(0.0), bbox[1] / height * 100)
    return F.struct(
        left.alias("left"), top.alias("top"), F.least(100 - left, (bbox[2] - bbox[0]) / width * 100).alias("width"), F.least(100 - top, (bbox[3] - bbox[1]) / height * 100).alias("height")
    )


def sse(seq: Column, event: Column) -> Column:
    """One server-sent event."""
    return F.format_string("id: %d\ndata: %s\n\n", seq, F.to_json(event))

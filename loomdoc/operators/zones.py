"""Tables, drawings and what they keep out of the text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc import config as C
from loomdoc.functions import pages as P
from loomdoc.functions import text as T
from loomdoc.operators.layout import PAGE
from loomdoc.shipping import ship

BOX = ["x0", "top", "x1", "bottom"]
#: Hulls held at once against those near them in x.
CLUSTER_ROWS = 256
ZONE = "doc_sha string, page_no int, zone_no int, x0 double, top double, x1 double, bottom double"


def box(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(prefix + c) for c in BOX)


def filled_ratio(cells: Column) -> Column:
    """Share of cells that are neither null nor empty; 0 for a grid without cells."""
    flat = F.flatten(cells)
    return F.when(F.size(flat) > 0, F.size(F.filter(flat, lambda c: c.isNotNull() & (c != ""))) / F.size(flat)).otherwise(0.0)


def holds_table(cells: Column) -> Column:
    """A candidate's cells make a table: filled, enough of them, some long. Its box has to be ``large_enough`` besides."""
    rows, columns = F.size(cells), F.when(F.size(cells) > 0, F.size(cells[0])).otherwise(0)
    long = F.size(F.filter(F.flatten(cells), lambda c: c.isNotNull() & (F.length(T.strip(c)) >= C.LONG_CELL)))
    return (filled_ratio(cells) >= C.FILLED_RATIO) & (rows >= 2) & (columns >= 2) & (rows * columns >= C.MIN_CELLS) & (long >= C.MIN_LONG_CELLS)


def large_enough(zone: list[float], width: float | None, body_size: float) -> bool:
    return width is not None and zone[2] - zone[0] >= width * C.TABLE_WIDTH and zone[3] - zone[1] >= body_size * C.TABLE_HEIGHT


def _least_near(low: np.ndarray, high: np.ndarray, gap: float) -> np.ndarray:
    """For hulls in order of their left edge, the place of the first one that is near in both directions, itself included.

    Only hulls whose extents in x can be near are held against each other, some rows at a time.
    """
    n, slack = len(low), gap + 1e-6 * (1 + np.abs(low).max() + np.abs(high).max())
    reach = np.maximum.accumulate(high[:, 0])
    found = np.empty(n, np.int64)
    for start in range(0, n, CLUSTER_ROWS):
        rows = slice(start, min(n, start + CLUSTER_ROWS))
        first = np.searchsorted(reach, low[start, 0] - slack, "left")
        held = slice(first, np.searchsorted(low[:, 0], high[rows, 0].max() + slack, "right"))
        near = np.ones((rows.stop - start, held.stop - first), bool)
        for axis in (0, 1):
            near &= low[rows, axis, None] - high[None, held, axis] <= gap
            near &= low[None, held, axis] - high[rows, axis, None] <= gap
        found[rows] = first + near.argmax(1)
    return found


def cluster_boxes(boxes: np.ndarray, images: np.ndarray, gap: float = C.CLUSTER_GAP) -> list[tuple[np.ndarray, int, bool]]:
    """Hull, members and whether one is an image, for boxes merged while hulls are near in both directions.

    Hulls only grow, so the result does not depend on the order of merges. Boxes whose corners share a cell of the
    gap's size are near in any case and are merged first. In each round every hull joins the first one near it and whatever that one joins.
    """
    if len(boxes) == 1:
        return [(boxes[0], 1, bool(images[0]))]
    cells = np.floor(boxes[:, :2] / max(gap, 1e-9)).astype(np.int64)
    _, label = np.unique(cells, axis=0, return_inverse=True)
    label = label.ravel()
    hulls, counts, image = boxes, np.ones(len(boxes), int), images.astype(bool)
    while True:
        n = label.max() + 1
        low, high = np.full((n, 2), np.inf), np.full((n, 2), -np.inf)
        np.minimum.at(low, label, hulls[:, :2])
        np.maximum.at(high, label, hulls[:, 2:])
        order = np.argsort(low[:, 0], kind="stable")
        low, high = low[order], high[order]
        counts, image = np.bincount(label, counts, n).astype(int)[order], (np.bincount(label, image, n) > 0)[order]
        hulls = np.hstack([low, high])
        joins = _least_near(low, high, gap)
        while (joins[joins] != joins).any():
            joins = joins[joins]
        _, label = np.unique(joins, return_inverse=True)
        if label.max() + 1 == n:
            return list(zip(hulls, counts.tolist(), image.tolist(), strict=True))


def _page_clusters(rows: pd.DataFrame) -> pd.DataFrame:
    found = cluster_boxes(rows[BOX].to_numpy(float), rows["is_image"].to_numpy(bool))
    sha, page = rows["doc_sha"].iloc[0], rows["page_no"].iloc[0]
    return pd.DataFrame([(sha, page, *hull, count, image) for hull, count, image in found], columns=["doc_sha", "page_no", *BOX, "members", "has_image"])


def diagrams(primitives: DataFrame, tables: DataFrame) -> DataFrame:
    """Clusters of drawing primitives with an image or enough members that touch no table."""
    ship(primitives.sparkSession)
    found = primitives.groupBy(*PAGE).applyInPandas(_page_clusters, "doc_sha string, page_no int, x0 double, top double, x1 double, bottom double, members int, has_image boolean")
    large = found.filter(F.col("has_image") | (F.col("members") >= C.CLUSTER_MIN))
    return without_overlap(large, tables)


def without_overlap(rows: DataFrame, zones: DataFrame) -> DataFrame:
    """Rows whose box overlaps no zone of their page: an equi-join on the page with the boxes as residual."""
    there = zones.select(*[F.col(c).alias(f"_z_{c}") for c in [*PAGE, *BOX]])
    same = (F.col("doc_sha") == F.col("_z_doc_sha")) & (F.col("page_no") == F.col("_z_page_no"))
    return rows.join(there, same & P.overlaps(box(), box("_z_")), "left_anti")


def merge_vertical(boxes: list[tuple[float, ...]], gap: float = C.FIGURE_MERGE_GAP) -> list[list[float]]:
    """From top to bottom, a box joins the one before if they overlap in x and lie within ``gap``. Equal tops go from left to right."""
    out: list[list[float]] = []
    for b in sorted(boxes, key=lambda x: (x[1], x[0], x[3], x[2])):
        if out and b[0] < out[-1][2] and out[-1][0] < b[2] and b[1] - out[-1][3] <= gap:
            a = out[-1]
            a[:] = min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])
        else:
            out.append(list(b))
    return out


def _page_merged(rows: pd.DataFrame) -> pd.DataFrame:
    sha, page = rows["doc_sha"].iloc[0], rows["page_no"].iloc[0]
    merged = merge_vertical(list(rows[BOX].itertuples(index=False, name=None)))
    return pd.DataFrame([(sha, page, k, *b) for k, b in enumerate(merged)], columns=["doc_sha", "page_no", "zone_no", *BOX])


def merged_figures(figures: DataFrame) -> DataFrame:
    ship(figures.sparkSession)
    return figures.select(*PAGE, *BOX).groupBy(*PAGE).applyInPandas(_page_merged, ZONE)


def widened(zone: list[float], margin: float, width: float | None, height: float | None) -> list[float]:
    """A figure with its margin, as far as the page goes."""
    right, low = zone[2] + margin, zone[3] + margin
    return [max(0.0, zone[0] - margin), max(0.0, zone[1] - margin), right if width is None else min(width, right), low if height is None else min(height, low)]


def absorb_labels(zones: list[list[float]], labels: list[tuple[float, ...]], reach: float = C.LABEL_REACH) -> list[list[float]]:
    """Each label, in order, widens the first zone within reach; later labels meet the wider zone."""
    zones = [list(z) for z in zones]
    for x0, top, x1, bottom in labels:
        for z in zones:
            if x0 < z[2] + reach and x1 > z[0] - reach and top < z[3] + reach and bottom > z[1] - reach:
                z[:] = min(z[0], x0), min(z[1], top), max(z[2], x1), max(z[3], bottom)
                break
    return zones


def outside(boxes: np.ndarray, zones: list[list[float]]) -> np.ndarray:
    """Which of the boxes (rows x0, top, x1, bottom) share no more than an edge with any zone."""
    free = np.ones(boxes.shape[1], bool)
    for z in zones:
        free &= ~((boxes[0] < z[2]) & (z[0] < boxes[2]) & (boxes[1] < z[3]) & (z[1] < boxes[3]))
    return free


def page_diagrams(boxes: list[list[float]], images: list[bool], tables: list[list[float]]) -> list[list[float]]:
    """``diagrams`` of one page."""
    if not boxes:
        return []
    found = [hull for hull, count, image in cluster_boxes(np.array(boxes), np.array(images)) if image or count >= C.CLUSTER_MIN]
    return [hull.tolist() for hull in found if outside(hull[:, None], tables)[0]]

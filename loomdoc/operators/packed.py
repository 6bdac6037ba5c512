"""Pages brought together in one exchange: words packed by page, table candidates, drawing primitives and page sizes.

``gathered`` makes rows of one form of all four, so that words are read once and moved once, in compressed fragments of a page.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.model import GRID
from loomdoc.operators.layout import PAGE, Texts
from loomdoc.operators.zones import BOX
from loomdoc.shipping import ship

SIZES, CANDIDATE, PRIMITIVE, WORDS = range(4)
NUMBERS = [*BOX, "size"]
_FRAGMENT = pa.schema([("doc_sha", pa.string()), ("page_no", pa.int32()), ("part", pa.int64()), ("raw", pa.int64()), ("held", pa.binary())])
_ROW = f"doc_sha string, page_no int, kind int, part bigint, x0 double, top double, x1 double, bottom double, flag boolean, cells {GRID}, raw bigint, held binary"


class Words(Texts):
    """A page's words: ``signs`` holds their UTF-8 with one blank between two, ``lengths`` their bytes, ``numbers`` the rows x0, top, x1, bottom, size."""

    def __init__(self, signs: bytes, lengths: np.ndarray, numbers: np.ndarray):
        self.signs, self.lengths, self.numbers = signs, lengths, numbers
        self.ends = np.cumsum(lengths + 1, dtype=np.int64) - 1

    def joined(self, places: list[int]) -> str:
        return " ".join([self.run(k, k) for k in places])

    def run(self, first: int, last: int) -> str:
        return self.signs[self.ends[first] - self.lengths[first] : self.ends[last]].decode()


def pack(signs: bytes, lengths: np.ndarray, numbers: np.ndarray) -> tuple[int, bytes]:
    """Words as compressed bytes, and how many they are without: number, width of a number, lengths, numbers (short if all are exact so), characters."""
    short = numbers.astype("<f4")
    if (short == numbers).all():
        numbers = short
    raw = b"".join((np.array([len(lengths), numbers.itemsize], "<i8").tobytes(), lengths.astype("<i4").tobytes(), np.ascontiguousarray(numbers).tobytes(), signs))
    return len(raw), pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(raw: int, held: bytes) -> Words:
    found = pa.Codec("zstd").decompress(held, raw, asbytes=True)
    n, width = np.frombuffer(found, "<i8", 2).tolist()
    at = 16 + 4 * n
    numbers = np.frombuffer(found, f"<f{width}", n * len(NUMBERS), at).astype(float).reshape(len(NUMBERS), n)
    return Words(found[at + width * n * len(NUMBERS) :], np.frombuffer(found, "<i4", n, 16), numbers)


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run of one page's words in a batch as one row."""
    part = 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sha, page, text = (batch.column(c) for c in (*PAGE, "text"))
        text = pc.fill_null(text.cast(pa.string()), "")
        numbers = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in NUMBERS])
        new = pc.or_(pc.not_equal(sha[1:], sha[:-1]), pc.not_equal(page[1:], page[:-1])).to_numpy(zero_copy_only=False)
        starts = np.append(0, np.flatnonzero(new) + 1)
        bounds, lengths = np.append(starts, n), pc.binary_length(text).to_numpy(zero_copy_only=False)
        signs = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), text), " ").cast(pa.binary()).to_pylist()
        packed = [pack(s, lengths[a:z], numbers[:, a:z]) for s, a, z in zip(signs, bounds.tolist(), bounds[1:].tolist(), strict=False)]
        parts = np.arange(part, part + len(packed))
        part += len(packed)
        yield pa.RecordBatch.from_arrays(
            [sha.take(pa.array(starts)), page.take(pa.array(starts)), pa.array(parts), pa.array([r for r, _ in packed], pa.int64()), pa.array([h for _, h in packed], pa.binary())], schema=_FRAGMENT
        )


def _as_rows(df: DataFrame, kind: int, **given: Column) -> DataFrame:
    columns = [c.strip().rsplit(" ", 1) for c in _ROW.split(",")]
    given = {"doc_sha": F.col("doc_sha"), "page_no": F.col("page_no"), "kind": F.lit(kind), **given}
    return df.select(*[given.get(name, F.lit(None)).cast(type_).alias(name) for name, type_ in columns])


def gathered(words: DataFrame, candidates: DataFrame, primitives: DataFrame, pages: DataFrame, fits: Column) -> DataFrame:
    """Rows of the four inputs, each page's together and in the order of ``kind``; ``fits`` becomes the flag of a candidate.

    Rows without a page belong to none; only ``pages`` keeps them.
    """
    ship(words.sparkSession)
    known = F.col("doc_sha").isNotNull() & F.col("page_no").isNotNull()
    there = {c: F.col(c) for c in BOX}
    given = words.filter(known).select(F.col("doc_sha").cast("string"), F.col("page_no").cast("int"), "text", *[F.col(c).cast("double") for c in BOX], F.coalesce(F.col("size").cast("double"), F.lit(0.0)).alias("size"))
    fragments = given.mapInArrow(_fragments, "doc_sha string, page_no int, part bigint, raw bigint, held binary")
    rows = (
        _as_rows(pages, SIZES, x1=F.col("page_width"), bottom=F.col("page_height"))
        .unionByName(_as_rows(candidates.filter(known), CANDIDATE, **there, flag=F.coalesce(fits, F.lit(False)), cells=F.col("cells")))
        .unionByName(_as_rows(primitives.filter(known), PRIMITIVE, **there, flag=F.coalesce("is_image", F.lit(False))))
        .unionByName(_as_rows(fragments, WORDS, part=F.col("part"), raw=F.col("raw"), held=F.col("held")))
    )
    return rows.repartition(*PAGE).sortWithinPartitions(*PAGE, "kind", "part")


@dataclass
class Page:
    """What ``gathered`` holds of one page."""

    doc_sha: str | None
    page_no: int | None
    sizes: list[tuple[float | None, float | None]] = field(default_factory=list)
    candidates: list[tuple[list[float], bool, list | None]] = field(default_factory=list)
    primitives: list[tuple[list[float], bool]] = field(default_factory=list)
    fragments: list[tuple[int, bytes]] = field(default_factory=list)

    def words(self) -> Words | None:
        parts = [unpack(*f) for f in self.fragments]
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else Words(b" ".join(p.signs for p in parts), np.concatenate([p.lengths for p in parts]), np.hstack([p.numbers for p in parts]))


def pages_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Page]:
    """The pages of ``gathered``, one at a time."""
    page = None
    for batch in batches:
        columns = [batch.column(c) for c in (*PAGE, "kind", *BOX, "flag", "raw", "held")]
        for at, (sha, number, kind, x0, top, x1, bottom, flag, raw, held) in enumerate(zip(*[c.to_pylist() for c in columns], strict=True)):
            if page is None or (page.doc_sha, page.page_no) != (sha, number):
                if page:
                    yield page
                page = Page(sha, number)
            if kind == WORDS:
                page.fragments.append((raw, held))
            elif kind == SIZES:
                page.sizes.append((x1, bottom))
            else:
                box = [math.nan if v is None else v for v in (x0, top, x1, bottom)]
                if kind == CANDIDATE:
                    page.candidates.append((box, flag, batch.column("cells")[at].as_py()))
                else:
                    page.primitives.append((box, flag))
    if page:
        yield page

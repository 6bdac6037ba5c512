"""Removal of passages that occur before, by overlapping windows of three lines.

Every three consecutive lines of a text are hashed. Windows found twice or more anywhere are repeated; the first
occurrence, in the order of (doc_id, text hash, position), stays. Later occurrences mark the lines they cover, the marks of overlapping
windows merge, and the marked lines go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.store import packed, unpacked

WINDOW = 3


def _windows(lines: Column) -> Column:
    """Position and 128-bit hash of each window that holds a line with something on it."""
    starts = F.when(F.size(lines) >= WINDOW, F.sequence(F.lit(0), F.size(lines) - WINDOW)).otherwise(F.array().cast("array<int>"))

    def window(i: Column) -> Column:
        held = [F.get(lines, i + k) for k in range(WINDOW)]
        return F.struct(
            i.alias("pos"),
            F.xxhash64(*held).alias("h1"),
            F.xxhash64(F.lit(1), *reversed(held)).alias("h2"),
            (F.length(F.trim(F.concat(*held))) > 0).alias("some"),
        )

    return F.filter(F.transform(starts, window), lambda w: w["some"])


def repeated_lines(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with ``removed`` (long, lines that go) and ``deduped`` (what stays; null for a null text).

    Lines end at ``\\n``; texts of fewer than three lines have no window and stay. Windows of blank lines alone are not
    counted. Rows equal in doc_id and text are one document: each gets the same result. Null doc_ids come first in the order of
    occurrences. Extra columns pass through; input columns named ``removed`` or ``deduped`` are replaced; an empty
    table gives no rows.

    Shuffles: window hashes twice (counted with partial sums, then joined with the repeated ones, where adaptive
    execution splits a passage that very many documents hold), and the texts once with their marked positions. Time and memory grow with a
    text's length, not its square.
    """
    own = docs.select(F.col("doc_id").alias("_d"), F.xxhash64(column).alias("_t"), F.split(column, "\n").alias("_l"))
    marks = own.select("_d", "_t", F.explode(_windows(F.col("_l"))).alias("_w")).select(
        F.struct("_d", "_t", "_w.pos").alias("at"), F.col("_w.h1").alias("h1"), F.col("_w.h2").alias("h2")
    )
    first = marks.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("at").alias("first")).filter("n > 1").drop("n")
    later = marks.join(first, ["h1", "h2"]).filter(F.col("at") > F.col("first"))
    covered = later.groupBy(F.col("at._d").alias("_d"), F.col("at._t").alias("_t")).agg(F.array_sort(F.collect_set("at.pos")).alias("_p"))
    rows = packed(docs, _id="doc_id", _text=column, _h=F.xxhash64(column))
    joined = rows.join(covered, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_t")), "left")
    # what lies between the marks, in runs of lines; the split text is read more than once, so it stays a column of its own
    split = joined.withColumn("_l", F.when(F.col("_p").isNotNull(), F.split("_text", "\n")))
    begins = F.concat(F.array(F.lit(0)), F.transform("_p", lambda p: p + WINDOW))
    stops = F.concat(F.col("_p"), F.array(F.size("_l")))
    runs = F.filter(F.zip_with(begins, stops, lambda a, b: F.struct(a.alias("a"), (b - a).alias("n"))), lambda r: r["n"] > 0)
    flagged = split.select("_row", "_text", "_p", "_l", runs.alias("_r"))
    held = F.aggregate("_r", F.lit(0), lambda n, r: n + r["n"])
    text = F.array_join(F.transform("_r", lambda r: F.array_join(F.slice("_l", r["a"] + 1, r["n"]), "\n")), "\n")
    out = flagged.withColumn("removed", F.coalesce(F.size("_l") - held, F.lit(0)).cast("long")).withColumn(
        "deduped", F.when(F.col("_p").isNull(), F.col("_text")).otherwise(text)
    )
    return unpacked(out, docs.columns, ["removed", "deduped"])

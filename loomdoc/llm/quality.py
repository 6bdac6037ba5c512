"""Quality rules on documents and on their hosts.

Base rules judge each document. A host's failures are counted over all its documents; its rate is shrunk towards the
corpus by a beta prior whose two parameters are fitted to the hosts' rates by the method of moments, and hosts whose
shrunken rate is too high take their remaining documents with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.llm import batches
from loomdoc.llm.store import materialise, packed, unpacked

#: Characters between words, and the symbols that are counted.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Odd multipliers for window sums; equal sums are compared word by word.
FACTORS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) | 1 for k in range(1, WINDOW + 1)], np.uint64)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more, first occurrences included. Exact."""
    count = len(words) - window + 1
    if count < 2:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.uint64, len(words))
    if len(codes) == len(words):
        return 0
    sums = np.zeros(count, np.uint64)
    mixed = (ids + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    for k in range(window):
        sums += mixed[k : k + count] * FACTORS[k % WINDOW]
    order = np.argsort(sums, kind="stable")
    ranked = sums[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    left, right = order[:-1][same], order[1:][same]
    alike = np.ones(len(left), bool)
    for k in range(window):
        alike &= ids[left + k] == ids[right + k]
    if alike.all():
        hit = np.zeros(count, bool)
        hit[left] = hit[right] = True
    else:  # different windows with one sum: count the windows themselves
        seen: dict[tuple, list[int]] = {}
        for i in range(count):
            seen.setdefault(tuple(ids[i : i + window].tolist()), []).append(i)
        hit = np.zeros(count, bool)
        hit[[i for at in seen.values() if len(at) > 1 for i in at]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(hit)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def _counted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    batches.claim("quality")
    for texts in parts:
        rows = []
        for text in texts:
            words = text.split()  # bytes split at exactly the six blanks
            lines = [x for x in text.split(b"\n") if x.strip()]
            rows.append((len(words), len(lines) - len(set(lines)), repeated_words(words)))
        yield pd.DataFrame(rows, columns=["n_words", "n_dup_lines", "n_repeat_words"])


def measured(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with the base counts of ``column`` and ``base_failed``. Null texts count as empty."""
    batches.bound(docs.sparkSession)
    text = F.coalesce(F.col(column), F.lit(""))

    def without(chars: str) -> Column:
        return F.length(F.translate(text, chars, ""))

    count = F.pandas_udf(_counted, "n_words long, n_dup_lines long, n_repeat_words long")
    wide = docs.withColumn("_m", count(text.cast("binary")))
    wide = wide.select(
        "*", "_m.*", without(BLANKS).cast("long").alias("word_chars"), (F.length(text) - without(SYMBOLS)).cast("long").alias("n_symbols")
    ).drop("_m")
    return wide.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Parameters by moments of the hosts' failure rates, each host counting once; (1, 1) where they do not vary enough
    to tell. ``hosts`` has docs and failed."""
    rate = F.col("failed") / F.col("docs")
    m, v, noise, n = hosts.select(F.avg(rate), F.var_pop(rate), F.avg(1 / F.col("docs")), F.count("*")).first()  # one row
    if not n or m in (0.0, 1.0) or v is None:
        return 1.0, 1.0
    between = max(v - m * (1 - m) * noise, 1e-4)  # without what sampling within hosts adds
    strength = min(max(m * (1 - m) / between - 1, 1.0), 1e4)
    return m * strength, (1 - m) * strength


def host_rules(docs: DataFrame, host: str = "source", most: float = 0.5, column: str = "text") -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``host_rate`` (shrunken failure rate) and ``kept``.

    Kept are documents that pass the base rules on hosts whose shrunken rate is at most ``most``: a bad host must
    fail more often than not before clean documents suffer. Documents without a host are judged alone (rate null).
    Hosts are counted with partial sums before the shuffle, and their verdicts are joined back by key, so a host with
    a third of all rows is a skewed join at worst, which adaptive execution splits or broadcasts. Texts are measured
    once for the counts and once for the result, which is cheaper than to store them. Empty tables give no rows; columns of the input
    that clash with the result's are replaced.
    """
    base = measured(packed(docs, _text=column, _of=host), "_text")
    counted = base.filter("_of IS NOT NULL").groupBy(F.col("_of").alias("_host")).agg(F.count("*").alias("docs"), F.count_if("base_failed").alias("failed"))
    counted, _ = materialise(counted, "hosts")
    alpha, beta = beta_prior(counted)
    rates = counted.select("_host", ((F.col("failed") + alpha) / (F.col("docs") + alpha + beta)).alias("host_rate"))
    judged = base.join(rates, F.col("_of") == F.col("_host"), "left")
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("host_rate"), F.lit(0.0)) <= most))
    return unpacked(judged, docs.columns, [*MEASURES, "host_rate", "kept"])

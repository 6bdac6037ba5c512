"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The rows lie in hash buckets (the source partitions). How many rows each bucket sends to each shard is drawn
exactly, as by a uniform permutation of all rows (rows of the matrix are multivariate hypergeometric). Each bucket
is then permuted on its own and cut by its row of the matrix, rows are exchanged, and each shard is permuted again.
Shard sizes differ by one at most, whatever the keys or texts.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdoc.llm.store import packed, unpacked

#: Above this total numpy's generator refuses; the windowed inversion below takes over.
NUMPY_LIMIT = 10**9
BROADCAST_BYTES = 8 << 20


def shard_sizes(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One exact draw, for totals of any size."""
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mean = draws * good / (good + bad)
    spread = math.sqrt(mean * max(1e-12, bad / (good + bad))) + 1
    lo, hi = max(low, int(mean - 40 * spread)), min(high, int(mean + 40 * spread) + 1)
    k = np.arange(lo, hi, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logp = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.cumsum(np.exp(logp - logp.max()))
    return lo + int(np.searchsorted(p, rng.random() * p[-1], side="right"))


def communication_matrix(parts: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Row sums are ``parts``, column sums are ``shards``; distributed as under a uniform permutation."""
    rng, left, out = np.random.default_rng(seed), list(shards), []
    for n in parts:
        row, rest, total = [], n, sum(left)
        for cap in left:
            total -= cap
            got = hypergeometric(rng, cap, total, rest) if rest else 0
            row.append(got)
            rest -= got
        out.append(row)
        left = [a - b for a, b in zip(left, row, strict=True)]
    return out


def permuted(index: Column, size: Column, salt: Column, seed: int, largest: int) -> Column:
    """A keyed bijection of 0..size-1: eight half rounds of a Feistel network on a grid barely larger than size,
    walked until the value lies inside (a walk is at most as long as the grid's overhang, under sqrt(size))."""
    side = F.ceil(F.sqrt(size.cast("double")))
    other = F.ceil(size / side)
    noise = lambda x, r, m: F.pmod(F.xxhash64(x, r, salt, F.lit(seed)), m)

    def once(x: Column) -> Column:
        start = F.struct((x.cast("double") / other).cast("long").alias("u"), F.pmod(x, other).cast("long").alias("v"))
        end = F.aggregate(
            F.array(*[F.lit(r) for r in range(8)]),
            start,
            lambda s, r: F.struct(
                F.when(r % 2 == 0, F.pmod(s["u"] + noise(s["v"], r, side), side)).otherwise(s["u"]).alias("u"),
                F.when(r % 2 == 1, F.pmod(s["v"] + noise(s["u"], r, other), other)).otherwise(s["v"]).alias("v"),
            ),
            lambda s: s["u"] * other + s["v"],
        )
        return end.cast("long")

    # a step ends outside with odds under 1/sqrt(size): 40 are enough in practice, and a walk that were longer is an error, not a wrong place
    walk = max(1, min(40, math.isqrt(max(0, largest)) + 1))
    place = F.aggregate(F.sequence(F.lit(1), F.lit(walk)), once(index), lambda x, _: F.when(x < size, x).otherwise(once(x)), lambda x: F.struct(x.alias("x"), size.alias("n")))
    return F.transform(F.array(place), lambda p: F.when(p["x"] < p["n"], p["x"]).otherwise(F.raise_error(F.lit("a walk of the permutation did not end inside")).cast("long")))[0]


def shuffle_into_shards(
    docs: DataFrame, shards: int = 16, seed: int = 7, key: tuple[str, ...] = ("doc_id", "text"), rows_per_bucket: int = 1 << 20, min_buckets: int = 1024, block_rows: int = 4096
) -> DataFrame:
    """Every row of ``docs`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in its shard), in shard and slot order within partitions.

    Buckets come from a hash of ``key``, so a retried task finds the same rows; in a bucket, rows lie in the order of that hash and then of
    a hash of all their columns, so that only rows equal in all of them are interchangeable. Nulls hash like other values; rows equal
    in ``key`` share a bucket. A table with fewer rows than shards leaves some shards
    empty; an empty table gives no rows. Columns named ``shard`` or ``slot`` in the input are replaced.
    """
    spark = docs.sparkSession
    total = docs.count()
    buckets = max(min_buckets, -(-total // rows_per_bucket))
    # maps have no hash of their own; their entries have
    whole = [F.to_json(F.array(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields]
    rows = packed(docs, _h=F.xxhash64(*[F.col(c) for c in key], F.lit(seed)), _all=F.xxhash64(*whole))
    bucket = F.pmod("_h", F.lit(buckets)).cast("int")
    counts = {r[0]: r[1] for r in rows.groupBy(bucket.alias("b")).count().collect()}  # one row a bucket
    present = sorted(counts)
    sizes = shard_sizes(sum(counts.values()), shards)
    matrix = communication_matrix([counts[b] for b in present], sizes, seed)
    base, plan = [0] * shards, []
    for b, row in zip(present, matrix, strict=True):
        cuts = np.cumsum(row).tolist()
        plan.append([b, cuts, [base[s] - (cuts[s] - row[s]) for s in range(shards)]])
        base = [x + y for x, y in zip(base, row, strict=True)]
    table = spark.range(1, numPartitions=1).select(
        F.inline(F.from_json(F.lit(json.dumps([{"_b": b, "_cuts": c, "_base": o} for b, c, o in plan])), "array<struct<_b:int,_cuts:array<bigint>,_base:array<bigint>>>"))
    )
    table = F.broadcast(table) if len(plan) * shards * 16 <= BROADCAST_BYTES else table
    local = W.partitionBy("_b").orderBy(F.xxhash64(F.col("_h"), F.lit(seed + 1)), F.col("_h"), F.col("_all"))
    ranked = rows.withColumn("_b", bucket).withColumn("_r", F.row_number().over(local).cast("long") - 1)
    sent = ranked.join(table, "_b").withColumn("shard", F.size(F.filter("_cuts", lambda c: c <= F.col("_r"))))
    sent = sent.withColumn("_i", F.element_at("_base", F.col("shard") + 1) + F.col("_r"))
    q, rem = divmod(total, shards)
    size = F.when(F.col("shard") < rem, F.lit(q + 1)).otherwise(F.lit(q)).cast("long")
    # the second permutation needs no further pass: positions in a shard are gapless already
    placed = sent.select("_row", "shard", permuted(F.col("_i"), size, F.col("shard"), seed + 2, q + 1).alias("slot"))
    block = F.floor(F.col("slot") / block_rows)
    return unpacked(placed.repartition(F.col("shard"), block).sortWithinPartitions("shard", "slot"), docs.columns, ["shard", "slot"])

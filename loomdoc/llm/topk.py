"""Exact top-k by inner product with the threshold algorithm.

Vectors and queries are cut into blocks; each pair of a query block and a vector block is one task of bounded size.
In a task every dimension has the block's vectors sorted by its component. A query walks the lists in parallel from
the end that favours it (the top for a positive weight, the bottom for a negative one), scores what it meets for
the first time in full, and stops once the best score that an unseen vector could have, the sum of its weights times the
components reached, is below its k-th score. Blocks' best are merged by rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdoc.llm import batches

#: Vectors a block, and queries a block.
BLOCK = 8192
#: First depth of the lists that is read at once; it doubles.
DEPTH = 16
#: Inner products below this are exact in doubles.
EXACT = 2**53


def quantised(vector: Column) -> Column:
    """Components as floor(256 x); null for a vector that is null or has a null or non-finite component."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    good = F.coalesce(F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    return F.when(good, F.transform(wide, lambda x: F.floor(x * 256)))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def threshold_search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, vector id, score) of each query's k best among ``vectors``, itself left out by id."""
    n, dims = vectors.shape
    order = np.argsort(vectors, axis=0, kind="stable")  # ascending lists
    sizes = [np.abs(x).max(initial=0) for x in (vectors, queries)]
    fits = float(sizes[0]) * float(sizes[1]) * max(1, dims) < EXACT
    table = vectors.astype(np.float64) if fits else vectors.astype(object)
    depths = []
    at = DEPTH
    while at < n:
        depths.append(at)
        at *= 2
    depths.append(n)
    columns = np.arange(dims)
    low = {d: table[order[d - 1], columns] for d in depths}  # components reached from the bottom
    high = {d: table[order[n - d], columns] for d in depths}
    out = []
    for qid, query in zip(query_ids.tolist(), queries, strict=True):
        weights = query.astype(np.float64) if fits else query.astype(object)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = ids == qid
        found_ids, found = np.zeros(0, ids.dtype), np.zeros(0, table.dtype)
        before = 0
        for depth in depths:
            fresh = np.zeros(n, bool)
            if depth == n:
                fresh[:] = True
            else:
                fresh[order[n - depth : n - before, up]] = True
                fresh[order[before:depth, down]] = True
            fresh &= ~seen
            new = np.flatnonzero(fresh)
            if len(new):
                seen |= fresh
                scores, names = np.concatenate([found, table[new] @ weights]), np.concatenate([found_ids, ids[new]])
                top = _best(scores, names, k)
                found, found_ids = scores[top], names[top]
            before = depth
            bound = high[depth][up] @ weights[up] + low[depth][down] @ weights[down]
            if len(found) == k and bound < found[-1]:  # an equal score could have a smaller id
                break
        out += [(qid, int(i), int(s)) for i, s in zip(found_ids.tolist(), found.tolist(), strict=True)]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, block: int = BLOCK) -> DataFrame:
    """query_id, rank (int from 1), vec_id and score (long) of the k highest inner products of quantised vectors.

    ``vectors`` has vec_id and embedding; rows for which ``is_query`` holds are queries, candidates are all rows but
    those with the query's own vec_id. Rows whose id or vector is null, or that hold a null or non-finite component, take no part;
    a query meets only candidates of its length. Ties go to the smaller vec_id; rows that share an id count as
    separate candidates; a query id on several rows is searched once for each distinct vector and keeps its best. With fewer than k candidates all
    are returned; an empty table gives no rows. Blocks come from a hash of the id, so any id may be hot but one.

    Each query travels once to each block of vectors, each vector once to each block of queries, and a block returns at
    most k rows a query.
    """
    spark = vectors.sparkSession
    batches.bound(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v"), is_query.alias("q")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    total, asked = rows.agg(F.count("*"), F.count_if("q")).first()  # one row
    parts, groups = max(1, -(-total // block)), max(1, -(-asked // block))
    spread = F.xxhash64("vec_id", "v")
    held = rows.withColumn("d", F.size("v")).withColumn("vb", F.pmod(spread, F.lit(parts)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    wanted = rows.filter("q").select("vec_id", "v").distinct().withColumn("d", F.size("v")).withColumn("qb", F.pmod(spread, F.lit(groups)).cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    keys = ["d", "qb", "vb"]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        batches.claim("topk")
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        ids, names = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        found = threshold_search(ids, np.stack(left["v"].to_list()).reshape(len(ids), int(left["d"].iloc[0])), names, np.stack(right["v"].to_list()).reshape(len(names), int(right["d"].iloc[0])), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    cells = held.select(*keys, "vec_id", "v").groupBy(*keys).cogroup(wanted.select(*keys, "vec_id", "v").groupBy(*keys))
    best = cells.applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.store import discard, materialise


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``comp``, the smallest node reachable over ``links`` (a, b); nodes without a link are not listed.

    Labels sink to the smallest among neighbours and then jump to their label's label, so the number of rounds grows
    with the logarithm of the longest path. Each round is written to the shared folder. A node with very many links is summed partially.
    """
    spark = links.sparkSession
    both, kept = materialise(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels, path = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        sunk = labels.join(near, "node").select("node", F.least("comp", "near").alias("low"), F.col("comp").alias("was"))
        above = labels.select(F.col("node").alias("low"), F.col("comp").alias("up"))
        new, nxt = materialise(sunk.join(above, "low").select("node", F.least("low", "up").alias("comp"), (F.least("low", "up") != F.col("was")).alias("moved")), "labels")
        going = not new.filter("moved").isEmpty()
        discard(spark, path)
        labels, path = new.drop("moved"), nxt
        if not going:
            discard(spark, kept)
            return labels


def extended(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """A table like that of ``components`` for the links behind ``labels`` (None: none) and ``links``.

    Only the new links are followed, between the components that are known; a component keeps its smallest node. Nodes of ``links``
    that no label names are their own component so far. Links that are empty leave the labels as they are.
    """
    if labels is None:
        return components(links)
    known = labels.select("node", "comp")
    for end in ("a", "b"):
        links = links.join(known.select(F.col("node").alias(end), F.col("comp").alias(f"_{end}")), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    moved = components(links.filter("a <> b")).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    old = known.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    new = moved.join(known.select(F.col("node").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("node"), F.col("to").alias("comp"))
    return materialise(old.unionByName(new), "components")[0]

"""Mixing of sources to target weights over a tree of domains, languages and sources.

A node's budget goes to its children by weight. A child that cannot use its share (all its tokens, as many epochs as are
allowed) returns the rest to its siblings; only what a whole subtree cannot use goes on to the siblings of its ancestors. Each leaf
then reads its documents in epochs, each a seeded permutation, and takes the prefix of that stream that its budget pays for.
All amounts are whole tokens and all divisions are exact, so the choice does not depend on the order of sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdoc.llm.store import materialise, packed, unpacked

LEVELS = ("_domain", "_lang", "_source")
#: The order key has 60 bits; its first 12 name a stretch of the permutation, and the first 6 of these a run of stretches.
STRETCH, RUN = 1 << 48, 1 << 6
#: Whole numbers whose products do not fit 64 bits.
WIDE = "decimal(19,0)"


def estimated_tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up; null texts have none."""
    return F.floor((F.coalesce(F.octet_length(text), F.lit(0)) + 3) / 4).cast("long")


def _weight(weights: dict[tuple[str, ...], int], path: list[str]) -> Column:
    """The whole-number weight of a node; 1 where none is set."""
    held = {k: v for k, v in weights.items() if len(k) == len(path)}
    if not held:
        return F.lit(1).cast("long")
    table = F.create_map(*[x for k, v in held.items() for x in (F.lit("\x1f".join(k)), F.lit(int(v)).cast("long"))])
    return F.coalesce(F.try_element_at(table, F.concat_ws("\x1f", *path)), F.lit(1).cast("long"))


def _share(nodes: DataFrame, parent: list[str], own: list[str]) -> DataFrame:
    """``nodes`` (own, weight, cap) of parents with ``budget``: each gets ``given``, short ones all they can use."""
    among = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    # smallest cap for its weight first; exact ties cannot change who is short
    order = among.orderBy(F.expr("cap div weight"), F.expr("cap % weight / weight"), *own)
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    onward = F.sum("weight").over(among) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    short = F.col("cap").cast(WIDE) * onward.cast(WIDE) <= F.col("weight").cast(WIDE) * (F.col("budget") - before).cast(WIDE)
    marked = nodes.withColumn("short", short)
    used = F.coalesce(F.sum(F.when(F.col("short"), F.col("cap"))).over(among), F.lit(0))
    rest = F.sum(F.when(~F.col("short"), F.col("weight"))).over(among)
    shared = marked.withColumn("used", used).withColumn("rest", rest)
    return shared.withColumn("given", F.when(F.col("short"), F.col("cap")).otherwise(F.expr(f"CAST(weight AS {WIDE}) * CAST(budget - used AS {WIDE}) div rest"))).drop("short", "used", "rest")


def budgets(leaves: DataFrame, weights: dict[tuple[str, ...], int], total: Column, max_epochs: int) -> DataFrame:
    """Leaves (three levels, ``tokens``) with their ``budget``, from the top of the tree down."""
    nodes = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    level = None
    for depth in range(1, len(LEVELS) + 1):
        own, parent = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
        here = nodes.groupBy(*own).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(weights, own)).filter("weight > 0 AND cap > 0")
        if level is None:
            here = here.withColumn("budget", total)
        else:
            here = here.join(level.select(*parent, F.col("given").alias("budget")), parent)
        level = _share(here, parent, own)
    return leaves.join(level.select(*LEVELS, F.col("given").alias("budget")), list(LEVELS), "left").fillna(0, ["budget"])


def _key(seed: int, epoch: Column, name: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), epoch, name).cast("binary")), 1, 15), 16, 10).cast("long")


def _end(sums: DataFrame, at: str, before: Column) -> DataFrame:
    """For each leaf the first place ``at`` at which the running sum of ``t``, ``before`` included, exceeds ``_rest``, and the sum up to there."""
    along = W.partitionBy(*LEVELS).orderBy(at).rowsBetween(W.unboundedPreceding, W.currentRow)
    over = sums.withColumn("_after", before + F.sum("t").over(along)).filter("_after > _rest")
    return over.groupBy(*LEVELS).agg(F.min(at).alias("_end"), F.min_by(F.col("_after") - F.col("t"), at).alias("_before"))


def mix(
    docs: DataFrame,
    weights: dict[tuple[str, ...], int],
    domain: Column,
    share: float = 1.0,
    max_epochs: int = 4,
    seed: int = 11,
    tokens: Column | None = None,
) -> DataFrame:
    """Chosen rows of ``docs`` (doc_id, text, lang, source and others), one for each epoch that takes them, with ``epoch`` (int, from 0) and ``tokens`` (long).

    ``weights`` maps paths (domain,), (domain, lang), (domain, lang, source) to whole numbers; others weigh 1, 0 leaves a
    subtree out. The budget is ``share`` (in millionths) of all tokens. A prefix never exceeds its budget: it ends before the first document that would. Null
    domain, lang and source count as empty ones. Documents without doc_id are ordered by a hash of their text;
    rows with one order key are taken together. Texts without tokens ride along with their neighbours. Input columns named ``epoch`` or ``tokens`` are
    replaced; an empty table gives no rows.

    Documents are never sorted or shuffled whole: a leaf's tokens are summed by 4,096 stretches of its permutation in 64 runs, and only
    the run and then the stretch in which the budget ends are looked at row by row, so a leaf with a third of all rows costs one task
    64 sums at a time. Tables of leaves are joined by their size; siblings of one node are shared out in one task, in time that grows
    with their number.
    """
    own = tokens if tokens is not None else estimated_tokens(F.col("text"))
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(blank(F.col("text")).cast("binary")))
    rows = packed(docs, tokens=own, _domain=blank(domain), _lang=blank(F.col("lang")), _source=blank(F.col("source")), _name=name)
    leaves, _ = materialise(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]  # one row
    split, _ = materialise(
        budgets(leaves, weights, F.lit(total * round(share * 1_000_000) // 1_000_000).cast("long"), max_epochs)
        .withColumn("_full", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).cast("int"))
        .withColumn("_rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("_full") * F.col("tokens")).otherwise(0))
        .drop("tokens", "budget"),
        "budgets",
    )
    keyed = rows.join(split, list(LEVELS)).withColumn("_k", _key(seed, F.col("_full"), F.col("_name"))).withColumn("_s", F.floor(F.col("_k") / STRETCH).cast("int"))
    sums = keyed.groupBy(*LEVELS, "_rest", "_s").agg(F.sum("tokens").alias("t"))
    sums, _ = materialise(sums, "stretches")
    run = F.expr(f"_s div {RUN}").cast("int")
    runs = _end(sums.groupBy(*LEVELS, "_rest", run.alias("_run")).agg(F.sum("t").alias("t")), "_run", F.lit(0))
    held = sums.withColumn("_run", run).join(runs.select(*LEVELS, F.col("_end").alias("_run"), "_before"), [*LEVELS, "_run"])
    ends, _ = materialise(_end(held, "_s", F.col("_before")), "ends")
    last = keyed.join(ends, list(LEVELS)).filter("_s = _end").groupBy(*LEVELS, "_rest", "_before", "_k", "_name").agg(F.sum("tokens").alias("t"))
    within = W.partitionBy(*LEVELS).orderBy("_k", "_name").rowsBetween(W.unboundedPreceding, W.currentRow)
    cuts = last.withColumn("_sum", F.col("_before") + F.sum("t").over(within)).filter("_sum <= _rest").groupBy(*LEVELS).agg(F.max(F.struct("_k", "_name")).alias("_cut"))
    plan, _ = materialise(split.join(ends.drop("_before"), list(LEVELS), "left").join(cuts, list(LEVELS), "left"), "plan")
    chosen = rows.join(plan, list(LEVELS)).withColumn("_k", _key(seed, F.col("_full"), F.col("_name"))).withColumn("_s", F.floor(F.col("_k") / STRETCH).cast("int"))
    ending = F.col("_end").isNotNull() & (
        (F.col("_s") < F.col("_end")) | ((F.col("_s") == F.col("_end")) & F.coalesce(F.struct("_k", "_name") <= F.col("_cut"), F.lit(False)))
    )
    epochs = F.concat(
        F.when(F.col("_full") > 0, F.sequence(F.lit(0), F.col("_full") - 1)).otherwise(F.array().cast("array<int>")),
        F.when(ending, F.array("_full")).otherwise(F.array().cast("array<int>")),
    )
    return unpacked(chosen.withColumn("epoch", F.explode(epochs)), docs.columns, ["epoch", "tokens"])

"""Near duplicates by fast similarity sketches, banding and exact verification.

A sketch has ``COORDINATES`` bins. In round i each shingle falls into one bin with a value that starts with i; a bin
keeps its least. Rounds go on until all bins are full, which a document of any size reaches after about
t ln t placements; after t rounds, round t + j puts all shingles into bin j alone, so every coordinate fills. Two sets
agree in a coordinate with the probability of their similarity, and sums over coordinates concentrate as for
independent ones. Bands of equal coordinates give candidates; links are confirmed on the full sets.

With 48 bands of 5 a pair at similarity 0.75 is missed with probability 2.3e-6, at 0.8 with 5e-9.

Candidates are not all pairs of a bucket. Members are first held against the bucket's hub. Documents of one component need no further link, so only buckets
that still hold several components go on, without documents that cannot reach the threshold: a link to another component needs
3/7 of both sizes in shingles which other components have. What is left when pairs are few beside the rows or when hubs find
no more is joined on rare shingles, which every linked pair has in common; else the next hub is tried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.llm import batches
from loomdoc.llm.graph import extended
from loomdoc.llm.store import discard, materialise, packed, unpacked

WORDS, BANDS, ROWS = 5, 48, 5
COORDINATES = BANDS * ROWS
#: Similarity of a link, as a fraction.
ENOUGH = (75, 100)
#: Tables of ids up to this size are broadcast, larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: What hubs leave is joined on rare shingles if its buckets hold no more pairs than this for each row.
PAIRS_A_ROW = 64
#: Hub rounds before it is joined in any case.
HUB_ROUNDS = 8
#: Sets with the same rare shingle that one part takes, and rows of a bucket.
PART, JOINED = 1024, 256
#: Components from this many documents on are large.
LARGE = 8
#: Shingles placed at once, and bytes of a worker's table of word hashes.
PLACED, WORD_BYTES = 2048, 24 << 20
SKETCH = "n long, f1 long, f2 long, bands array<long>"

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_SEEDS = _mix(np.arange(1, 2 * COORDINATES + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
_SHINGLE = _mix(np.arange(101, 101 + WORDS, dtype=_U)) | _U(1)
_BAND = _mix(np.arange(201, 201 + ROWS, dtype=_U)) | _U(1)
_BAND_NO = _mix(np.arange(301, 301 + BANDS, dtype=_U))


class _WordHashes(batches.Bounded):
    def make(self, word: bytes) -> int:
        return xxhash.xxh64_intdigest(word)

    def cost(self, word: bytes, made: int) -> int | None:
        return 180 + len(word) if len(word) <= 64 else None


_words = _WordHashes(WORD_BYTES)


def _claim() -> None:
    def release() -> None:
        global _words
        _words = _WordHashes(WORD_BYTES)

    batches.claim("neardup", release)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; of fewer words, one of the whole sequence."""
    words = text.lower().split()  # on bytes: A-Z only, and exactly the six blanks
    if not words:
        return np.zeros(0, _U)
    codes = np.fromiter(map(_words.__getitem__, words), _U, len(words))
    width, count = min(WORDS, len(words)), max(1, len(words) - WORDS + 1)
    sums = np.full(count, width, _U)
    for k in range(width):
        sums += codes[k : k + count] * _SHINGLE[k]
    return np.unique(_mix(sums))


def sketch(items: np.ndarray) -> np.ndarray:
    """The coordinates of a non-empty set: round and least value."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, _U)
    start, step = 0, max(1, PLACED // len(items))
    while start < COORDINATES:
        rounds = np.arange(start, min(COORDINATES, start + step))
        placed = _mix(items[None, :] ^ _SEEDS[rounds][:, None])
        bins = ((placed >> _U(32)) * _U(COORDINATES)) >> _U(32)
        values = (placed & _U(0xFFFFFFFF)) | (rounds.astype(_U) << _U(32))[:, None]
        np.minimum.at(out, bins.ravel().astype(np.intp), values.ravel())
        start += step
        if out.max() < np.iinfo(np.uint64).max:
            return out
    for j in np.flatnonzero(out == np.iinfo(np.uint64).max):
        last = COORDINATES + int(j)
        out[j] = (_U(last) << _U(32)) | (_mix(items ^ _SEEDS[last]) & _U(0xFFFFFFFF)).min()
    return out


def bands(items: np.ndarray) -> np.ndarray:
    """One hash for each band."""
    return _mix((sketch(items).reshape(BANDS, ROWS) * _BAND).sum(axis=1, dtype=_U) + _BAND_NO)


def _sketched(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    _claim()
    for texts in parts:
        rows = []
        for text in texts:
            items = shingles(text)
            if len(items):
                one, two = xxhash.xxh64_intdigest(items.tobytes()), xxhash.xxh64_intdigest(items.tobytes(), seed=1)
                rows.append((len(items), np.uint64(one).astype(np.int64), np.uint64(two).astype(np.int64), bands(items).view(np.int64)))
            else:
                rows.append((0, None, None, None))
        yield pd.DataFrame(rows, columns=["n", "f1", "f2", "bands"]).astype({"f1": "Int64", "f2": "Int64"})


def _sets(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    _claim()
    for texts in parts:
        yield pd.Series([shingles(t).view(np.int64) for t in texts])


def _sized(ids: DataFrame, count: int, width: int = 32) -> DataFrame:
    return F.broadcast(ids) if count * width <= BROADCAST_BYTES else ids


def _close(a: Column, b: Column) -> Column:
    """Sizes that allow a link at all."""
    return (ENOUGH[1] * F.least(a, b)) >= (ENOUGH[0] * F.greatest(a, b))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    held = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("c"), (F.size("x") + F.size("y")).alias("s"))
    return held.filter(ENOUGH[1] * F.col("c") >= ENOUGH[0] * (F.col("s") - F.col("c"))).select("a", "b")


def _met(rows: DataFrame, by: str, buckets: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with the one row that ``buckets`` has for a key. Large buckets are dealt to parts of about ``JOINED`` rows by
    the column ``by``, and their row goes to each part; ``size`` of both sides is that of the bucket at the start."""
    parts = F.ceil(F.col("size") / JOINED)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(by), parts))
    given = buckets.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("size")
    return dealt.join(given, ["key", "part"], how).drop("part")


def _against_hubs(members: DataFrame, score: Column) -> DataFrame:
    """Each bucket's members with the one that scores highest, if their components differ and their sizes and caps allow a link."""
    hubs = members.groupBy("key").agg(F.max(F.struct(score.alias("s"), F.col("rep"), F.col("n"), F.col("comp"), F.col("cap"))).alias("hub"), F.max("size").alias("size"))
    allowed = _close(F.col("n"), F.col("hub.n")) & (F.col("n") <= F.col("hub.cap")) & (F.col("hub.n") <= F.col("cap"))
    found = _met(members, "rep", hubs).filter((F.col("comp") != F.col("hub.comp")) & allowed)
    return found.select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b")).distinct()


def _rare_pairs(live: DataFrame, sets: DataFrame) -> tuple[DataFrame, str]:
    """Pairs of different components that meet in a bucket and in a rare shingle, if sizes and caps allow a link; and a table they are read from.

    Shingles are ordered: those of one component first, then by how many sets have them. Linked sets have 3/4 of each in common, so the
    first shingle they share is among the first quarter (and one) of both, and as many as a link needs must not come before it. A
    shingle of many sets is dealt to parts of ``PART`` sets, each of which meets all others there.
    """
    caps = [F.max(c).alias(c) for c in ("big", "cap_l", "cap_s")]
    docs = live.groupBy("rep").agg(F.min("comp").alias("comp"), *caps, F.collect_set("key").alias("keys"))  # a document has one key a band
    own = docs.select("rep", "comp").join(sets, "rep").select("rep", "comp", F.xxhash64("items").alias("set"), F.explode("items").alias("item"))
    held = own.groupBy("item").agg((F.min("comp") != F.max("comp")).alias("shared"), F.count("*").alias("often"))
    ranked = own.join(held, "item").groupBy("rep", "set").agg(F.array_sort(F.collect_set(F.struct("shared", "often", "item"))).alias("items"))
    first = F.expr(f"slice(items, 1, cast(size(items) - ({ENOUGH[0]}L * size(items) + {ENOUGH[1] - 1}) div {ENOUGH[1]} + 1 as int))")
    rare = ranked.select("rep", F.size("items").cast("long").alias("n"), F.posexplode(first).alias("at", "x")).filter("x.shared")
    placed, path = materialise(rare.select("rep", "n", (F.col("n") - F.col("at")).alias("left"), F.col("x.item").alias("item")).join(docs, "rep"), "placed")
    parts = placed.groupBy("item").agg(F.ceil(F.count("*") / PART).alias("parts"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    dealt = placed.join(parts.filter("lo <> hi").select("item", "parts"), "item")
    one = dealt.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts"))).drop("parts")
    every = dealt.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    two = every.select("item", "part", *[F.col(c).alias(f"{c}2") for c in ("rep", "n", "left", "comp", "big", "cap_l", "cap_s", "keys")])
    meets = (F.col("n2") <= F.when(F.col("big2"), F.col("cap_l")).otherwise(F.col("cap_s"))) & (F.col("n") <= F.when(F.col("big"), F.col("cap_l2")).otherwise(F.col("cap_s2")))
    enough = sum(ENOUGH) * F.least("left", "left2") >= ENOUGH[0] * (F.col("n") + F.col("n2"))
    allowed = (F.col("rep") < F.col("rep2")) & (F.col("comp") != F.col("comp2")) & _close(F.col("n"), F.col("n2")) & meets & enough
    found = one.join(two, ["item", "part"]).filter(allowed & F.arrays_overlap("keys", "keys2"))
    return found.select(F.col("rep").alias("a"), F.col("rep2").alias("b")).distinct(), path


def _mixed(members: DataFrame) -> DataFrame:
    """Rows of buckets that hold more than one component."""
    keys = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("size").alias("size")).filter("lo <> hi").select("key", "size")
    return _met(members, "rep", keys, "left_semi")


def _capped(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows with ``cap``, the largest size that a document of another component here can have to link with the row's.

    A link needs |x & y| >= 3/7 (|x| + |y|), and x has no more in common with y than with all other components: u(x) shingles, so
    |y| <= 7/3 u(x) - |x|. Documents of large components (``big``) and of small ones have a cap each: ``cap_l`` and ``cap_s``.
    """
    docs = mixed.select("rep", "comp").distinct()
    sizes = docs.groupBy("comp").agg((F.count("*") >= LARGE).alias("big"))
    own = docs.join(sizes, "comp").join(sets, "rep").select("rep", "comp", "big", F.explode("items").alias("item"))
    at = lambda f, big: f(F.when(F.col("big") == big, F.col("comp")))
    held = own.groupBy("item").agg(at(F.min, True).alias("l1"), at(F.max, True).alias("l2"), at(F.min, False).alias("s1"), at(F.max, False).alias("s2"))
    held = held.filter(F.least("l1", "s1") != F.greatest("l2", "s2"))
    other = lambda lo, hi: F.count_if((F.col(lo) != F.col("comp")) | (F.col(hi) != F.col("comp")))
    reach = own.join(held, "item").groupBy("rep", "big").agg(other("l1", "l2").alias("ul"), other("s1", "s2").alias("us"))
    caps = mixed.join(reach, "rep").select("key", "size", "rep", "n", "comp", "big", (F.expr("7 * ul div 3") - F.col("n")).alias("cap_l"), (F.expr("7 * us div 3") - F.col("n")).alias("cap_s"))
    return caps.withColumn("cap", F.greatest("cap_l", "cap_s"))


def _hopeful(members: DataFrame, sets: DataFrame) -> tuple[DataFrame, str] | None:
    """A table of the rows whose bucket holds another component with a document small enough for the row's cap, and one whose cap the row
    meets; none if no bucket holds two components. Steps that are read more than once are tables, which keeps the plans small."""
    spark = members.sparkSession
    mixed, at_mixed = materialise(_mixed(members), "mixed")
    if mixed.isEmpty():
        discard(spark, at_mixed)
        return None
    capped, at_capped = materialise(_capped(mixed, sets), "capped")
    per = capped.groupBy("key", "comp").agg(F.min("n").alias("lo"), F.max("cap").alias("hi"), F.max("size").alias("size"))
    one = per.groupBy("key").agg(F.min(F.struct("lo", "comp")).alias("a"), F.max(F.struct("hi", "comp")).alias("b"), F.max("size").alias("size"))
    two = (
        _met(per, "comp", one)
        .groupBy("key", "a", "b")
        .agg(F.max("size").alias("size"), F.min(F.when(F.col("comp") != F.col("a.comp"), F.col("lo"))).alias("lo2"), F.max(F.when(F.col("comp") != F.col("b.comp"), F.col("hi"))).alias("hi2"))
    )
    least = F.when(F.col("comp") == F.col("a.comp"), F.col("lo2")).otherwise(F.col("a.lo"))
    most = F.when(F.col("comp") == F.col("b.comp"), F.col("hi2")).otherwise(F.col("b.hi"))
    fits = (F.col("cap") >= least) & (4 * F.col("cap") >= 3 * F.col("n")) & (most >= F.col("n"))
    fitting, at_fitting = materialise(_met(capped, "rep", two).filter(fits).select(*capped.columns), "fitting")
    live = materialise(_mixed(fitting), "live")
    discard(spark, at_mixed, at_capped, at_fitting)
    return live


def linked(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, ``n_shingles``, ``component_id`` (smallest doc_id reachable over links) and ``kept`` for every row.

    Null and empty texts and texts without words have no shingles and stand alone. Rows with a null doc_id take no part: component null, kept.
    Rows equal in doc_id and shingles are one document and are kept or dropped together; of rows that share a doc_id but
    not their shingles, each is judged by the component of its shingles. Equal sets are one class and are compared once, so large groups of copies cost a
    join. Extra columns are not read; an empty table gives no rows. Executors may be lost at any time: every step
    starts from tables in the shared folder.
    """
    return _judged(docs, column).drop("f1", "f2")


def _judged(docs: DataFrame, column: str) -> DataFrame:
    """``linked`` with the fingerprint of each row's shingles, ``f1`` and ``f2``."""
    spark = docs.sparkSession
    batches.bound(spark)
    text = F.coalesce(F.col(column), F.lit("")).cast("binary")
    made = F.pandas_udf(_sketched, SKETCH)
    sketches, at_sketches = materialise(docs.select("doc_id", made(text).alias("s")).select("doc_id", "s.*"), "sketches")
    classes, at_classes = materialise(
        sketches.filter("n > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes"
    )
    keyed = classes.select("rep", F.col("n").cast("int").alias("n"), F.explode("bands").alias("key"))
    full = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members, at_members = materialise(keyed.join(full, "key"), "members")
    scored = members.groupBy("rep").agg(F.sum("size").alias("score"))
    scores, at_scores = materialise(scored, "scores")
    count = scores.count()
    wanted = _sized(scores.select(F.col("rep").alias("doc_id")), count)
    texts = docs.select("doc_id", F.coalesce(F.col(column), F.lit("")).cast("binary").alias("t")).join(wanted, "doc_id", "left_semi")
    take = F.pandas_udf(_sets, "array<long>")
    made_sets = texts.select(F.col("doc_id").alias("rep"), take("t").alias("items"))
    # a doc_id with several texts has a set for each, and a link of any of them counts
    sets, at_sets = materialise(made_sets, "sets")
    live = members.join(scores, "rep").select("key", "size", "rep", "n", "score", F.col("rep").alias("comp"), F.lit(1 << 30).alias("cap"))
    comps, paths, fresh = None, [], True
    for turn in range(HUB_ROUNDS + 1):
        if turn == 0:
            pairs = _against_hubs(live, F.col("score"))
        else:
            rows, cross = live.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("q")).agg(
                F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("q")) / 2), F.lit(0))
            ).first()  # one row
            if not rows:
                break
            last = turn == HUB_ROUNDS or not fresh or cross <= PAIRS_A_ROW * rows
            if last:
                pairs, path = _rare_pairs(live, sets)
                paths.append(path)
            else:
                pairs = _against_hubs(live, F.xxhash64("rep", F.lit(turn)))
        new, path = materialise(_verified(pairs, sets), "verified")
        paths.append(path)
        fresh = not new.isEmpty()
        if comps is None or fresh:
            comps = extended(comps, new)
        if turn and last:
            break
        live = members.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("key", "size", "rep", "n", F.coalesce("comp", "rep").alias("comp"))
        found = _hopeful(live, sets)
        if found is None:
            break
        live, path = found
        paths.append(path)
    named = classes.join(comps, F.col("rep") == F.col("node"), "left").select("f1", "f2", F.coalesce("comp", "rep").alias("comp"))
    out = sketches.select("doc_id", "n", "f1", "f2").join(named, ["f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("comp", "doc_id"))
    result = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "f1", "f2")
    discard(spark, at_members, at_scores, at_sets, *paths)
    del at_sketches, at_classes
    return result


def without_near_duplicates(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id. Texts are not shuffled unless the
    ids to drop exceed what may be broadcast.

    Of a doc_id with several texts each goes or stays by its own shingles. Rows with a null doc_id take part under numbers beyond the
    largest doc_id, which depend on the text alone; of equal ones one row stays.
    """
    spark = docs.sparkSession
    nulls, top = docs.agg(F.count_if(F.col("doc_id").isNull()), F.coalesce(F.max("doc_id"), F.lit(0))).first()  # one row
    # texts that are equal share a number; others meet with the chance of a hash collision
    number = F.lit(max(top, 0)) + 1 + F.pmod(F.xxhash64(column, F.lit(2)), F.lit(max(1, (1 << 63) - 2 - max(top, 0))))
    own = (F.coalesce(F.col("doc_id"), number) if nulls else F.col("doc_id")).cast("long")
    judged = _judged(docs.select(own.alias("doc_id"), F.col(column).alias("text")), "text")
    dropped, _ = materialise(judged.filter("NOT kept").select("doc_id", "f1", "f2").distinct(), "dropped")
    ids = dropped.select("doc_id").distinct()
    # ids that lose some of their texts
    mixed, _ = materialise(judged.filter("kept").select("doc_id").join(_sized(ids, dropped.count()), "doc_id", "left_semi").distinct(), "mixed")
    some = mixed.count()
    whole = ids.join(_sized(mixed, some), "doc_id", "left_anti") if some else ids
    rows = packed(docs, _id=own, _text=column, _known=F.col("doc_id").isNotNull())
    gone = lambda t: _sized(t, dropped.count())
    left = rows.join(gone(whole.withColumnRenamed("doc_id", "_id")), "_id", "left_anti")
    if some:
        made = F.pandas_udf(_sketched, SKETCH)(F.coalesce("_text", F.lit("")).cast("binary"))
        several = left.join(_sized(mixed.withColumnRenamed("doc_id", "_id"), some), "_id", "left_semi").withColumn("_s", made)
        several = several.select("*", F.col("_s.f1").alias("f1"), F.col("_s.f2").alias("f2")).drop("_s")
        several = several.join(gone(dropped.withColumnRenamed("doc_id", "_id")), ["_id", "f1", "f2"], "left_anti").select(left.columns)
        left = left.join(_sized(mixed.withColumnRenamed("doc_id", "_id"), some), "_id", "left_anti").select(left.columns).unionAll(several)
    if nulls:
        worded = ~F.col("_known") & F.coalesce(F.col("_text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        left = left.filter(~worded).unionAll(left.filter(worded).dropDuplicates(["_id"]))
    return unpacked(left, docs.columns, [])

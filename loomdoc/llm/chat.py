"""Transcripts to chat format by a hidden Markov model over lines.

Hidden states are (role, first line of a turn or a later one). A line shows a speaker marker (of a known role, of an unknown name, or
none), its length, whether a blank line stands before it and whether it asks. The model's tables are relative frequencies with
Laplace smoothing on transcripts whose roles are known; Viterbi's path gives the turns, which are rendered alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdoc.llm import batches
from loomdoc.llm.store import materialise, packed, unpacked

ROLES = ("system", "user", "assistant")
STATES = [(role, first) for role in ROLES for first in (True, False)]
#: Speaker names by role.
NAMES = {
    "system": ("system", "context"),
    "user": ("user", "human", "question", "q", "instruction", "customer", "prompt"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "response", "model", "agent"),
}
KINDS = ("none", *ROLES, "other")
_ROLE = {name: role for role, names in NAMES.items() for name in names}
_MARK = re.compile(r"^\s*(?:#{1,4}\s*|\*\*|\[|<\|?)?\s*([A-Za-z][\w.'-]*(?: [A-Z][\w.'-]*){0,2})\s*(?:\*\*|\]|\|?>)?\s*:(?:\*\*)?[ \t]*")
#: Lengths in words count by powers of two up to this one.
LENGTHS = 8
#: Turns of a conversation that one row holds at most.
PART_TURNS = 1 << 14
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def marker(line: str) -> tuple[str, int]:
    """Kind of the line's speaker marker and where its text begins."""
    lead = len(line) - len(line.lstrip())
    found = _MARK.match(line[lead : lead + 120])  # a marker is short; blanks before it may be many
    if not found:
        return "none", 0
    role = _ROLE.get(found[1].lower())
    if role is None and (not found[1][0].isupper() or len(found[1]) > 24):
        return "none", 0
    return role or "other", lead + found.end()


def observed(lines: list[str]) -> list[tuple[int, int, int, int]]:
    """Marker, length, blank line before, question: an index for each feature of each line."""
    out, blank = [], 0
    for line in lines:
        kind, _ = marker(line)
        out.append((KINDS.index(kind), min(LENGTHS - 1, len(line.split()).bit_length()), blank, int(line.rstrip().endswith("?"))))
        blank = int(not line.strip())
    return out


SIZES = (len(KINDS), LENGTHS, 2, 2)


def counted(transcripts: Iterable[tuple[list[str], list[int]]]) -> list[np.ndarray]:
    """How often transcripts start in each state, go from one to another, and show each value of each feature in it."""
    s = len(STATES)
    start, move, show = np.zeros(s), np.zeros((s, s)), [np.zeros((s, n)) for n in SIZES]
    for lines, states in transcripts:
        if not states:
            continue
        start[states[0]] += 1
        np.add.at(move, (states[:-1], states[1:]), 1)
        for j, values in enumerate(zip(*observed(lines), strict=True)):
            np.add.at(show[j], (states, list(values)), 1)
    return [start, move, *show]


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    show: list[np.ndarray]

    @staticmethod
    def fit(transcripts: list[tuple[list[str], list[int]]], smooth: float = 0.1) -> Model:
        """From lines and their states. Without any, markers alone decide: a known marker starts its role's turn."""
        return Model.of(counted(transcripts), smooth)

    @staticmethod
    def of(counts: list[np.ndarray], smooth: float = 0.1) -> Model:
        """From the tables of ``counted``, or sums of such."""
        start, move, *show = [x + smooth for x in counts]
        for k, (role, first) in enumerate(STATES):
            show[0][k, KINDS.index(role if first else "none")] += 1
        for a, (role, _) in enumerate(STATES):
            for b, (other, first) in enumerate(STATES):
                if not first and other != role:
                    move[a, b] = 0  # a later line stays with its turn
        start[[k for k, (_, first) in enumerate(STATES) if not first]] = 0
        with np.errstate(divide="ignore"):
            return Model(np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True)), [np.log(x / x.sum(1, keepdims=True)) for x in show])

    def viterbi(self, lines: list[str]) -> list[int]:
        seen = observed(lines)
        score, back = None, []
        for values in seen:
            shown = sum(table[:, v] for table, v in zip(self.show, values, strict=True))
            if score is None:
                score = self.start + shown
                continue
            ways = score[:, None] + self.move
            back.append(ways.argmax(0))
            score = ways.max(0) + shown
        if score is None:
            return []
        path = [int(score.argmax())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return path[::-1]

    def turns(self, text: str | None) -> list[tuple[str, str]]:
        """Roles and texts of a transcript's turns; markers and blank edges go. Nothing for a null or blank text."""
        if not text or not text.strip():
            return []
        lines = text.split("\n")
        out: list[tuple[str, list[str]]] = []
        for line, state in zip(lines, self.viterbi(lines), strict=True):
            role, first = STATES[state]
            if first or not out:
                out.append((role, [line[marker(line)[1] :]]))
            else:
                out[-1][1].append(line)
        held = [(role, "\n".join(part).strip("\n")) for role, part in out]
        return [(role, part) for role, part in held if part.strip()]


def rendered(turns: list[tuple[str, str]]) -> str:
    """Canonical form. Delimiters inside a text are broken by a space, so a text can't open a turn."""
    safe = lambda x: x.replace("<|im_", "<| im_")
    return "".join(f"{OPEN}{role}\n{safe(text)}{CLOSE}\n" for role, text in turns)


def parse(transcripts: DataFrame, model: Model, column: str = "transcript") -> DataFrame:
    """``transcripts`` with ``turns`` (array of role and text) and ``chat`` (canonical rendering) of ``column``.

    Null, empty and blank transcripts give no turns and an empty rendering. Whole texts of any length, one row at a time: no shuffle. Input
    columns named ``turns`` or ``chat`` are replaced.
    """
    batches.bound(transcripts.sparkSession)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        batches.claim("chat")
        for texts in parts:
            found = [model.turns(t) for t in texts]
            yield pd.DataFrame({"turns": [[{"role": r, "text": x} for r, x in f] for f in found], "chat": [rendered(f) for f in found]})

    made = F.pandas_udf(run, "turns array<struct<role:string,text:string>>, chat string")
    rows = packed(transcripts, _text=column).withColumn("_parsed", made("_text")).select("_row", "_parsed.turns", "_parsed.chat")
    return unpacked(rows, transcripts.columns, ["turns", "chat"])


#: Speaker markers by style, for system, user and assistant; None stands for no marker but a blank line between turns.
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("Context: ", "Human: ", "AI: "),
    ("[system]: ", "[user]: ", "[bot]: "),
    ("### Context: ", "### Instruction: ", "### Response: "),
    ("**Host:** ", "**Guest:** ", "**Expert:** "),
    (None, None, None),
)


def segments(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as rows: conv_id, segment, part, ``said`` (turns in order).

    A conversation is one row of whole turns in the order of (turn, role, text). One of more than 16,384 turns is several, in the order of
    ``part``, each but the last of just so many turns: its places come from a sort over all tasks, so that no task holds
    it whole. Repeated rows count once. Rows without conv_id or turn stand alone, ``segment`` being a hash of their text
    and role (0 for all others). Null roles and texts stay as they are.
    """
    key, rest = ["conv_id", "segment"], ["turn", "role", "text"]
    own = turns.select("conv_id", *rest).distinct()
    loose = F.col("conv_id").isNull() | F.col("turn").isNull()
    keyed = own.withColumn("segment", F.when(loose, F.xxhash64("text", "role")).otherwise(F.lit(0)))
    said = F.array_sort(F.collect_list(F.struct(*rest))).alias("said")
    whole = lambda df: df.groupBy(*key).agg(said).select(*key, F.lit(0).alias("part"), "said")
    large, _ = materialise(keyed.groupBy(*key).count().filter(F.col("count") > PART_TURNS).select(F.col("conv_id").alias("_c"), F.col("segment").alias("_s")), "large")
    if large.isEmpty():
        return whole(keyed)
    here = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("segment") == F.col("_s"))
    long = keyed.join(large, here, "left_semi").withColumn("_head", F.substring("text", 1, 64))
    ordered = long.repartitionByRange(*key, "turn", "role", "_head").sortWithinPartitions(*key, *rest)
    placed, _ = materialise(ordered.drop("_head").withColumn("_task", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    # one row a conversation and task
    tasks = placed.groupBy(*key, "_task").agg(F.count("*").alias("n"), F.min("_at").alias("_from"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*key).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = tasks.select(F.col("conv_id").alias("_c"), F.col("segment").alias("_s"), F.col("_task").alias("_t"), (before - F.col("_from")).alias("_shift"))
    numbered = placed.join(starts, here & (F.col("_task") == F.col("_t"))).withColumn("part", F.floor((F.col("_at") + F.col("_shift")) / PART_TURNS).cast("int"))
    return whole(keyed.join(large, here, "left_anti")).unionByName(numbered.groupBy(*key, "part").agg(said))


def transcript(said: Column, style: Column) -> Column:
    """Raw transcript of ordered turns in one of ``STYLES``. Turns without text are left out."""
    table = F.array(*[F.array(*[F.lit(m) for m in marks]) for marks in STYLES])
    spot = lambda role: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ROLES)), F.coalesce(role, F.lit("user"))), F.lit(0)), F.lit(2)).cast("int")
    mark = lambda x: F.element_at(F.element_at(table, style + 1), spot(x["role"]))
    shown = F.filter(said, lambda x: F.length(F.trim(x["text"])) > 0)
    lines = F.transform(shown, lambda x, i: F.concat(F.when(mark(x).isNull() & (i > 0), "\n").otherwise(""), F.coalesce(mark(x), F.lit("")), x["text"]))
    return F.array_join(lines, "\n")


def labelled(said: list[tuple[str | None, str | None]], style: int) -> tuple[list[str], list[int]]:
    """Lines of the raw transcript of (role, text) turns and their states, as ``transcript`` writes them."""
    lines, states = [], []
    for role, text in said:
        if not text or not text.strip(" "):
            continue
        role = role if role in ROLES else "user"
        mark = STYLES[style][ROLES.index(role)]
        own = ((mark or "") + text).split("\n")
        if mark is None and lines:
            lines.append("")
            states.append(STATES.index((STATES[states[-1]][0], False)))
        lines += own
        states += [STATES.index((role, k == 0)) for k in range(len(own))]
    return lines, states


def fit(parts: DataFrame, style: Column, sample: int = 2000) -> Model:
    """A model from at most ``sample`` rows (columns of ``segments``), those with the smallest hashes: a bounded sample of labelled
    rows. They are counted where they lie and only sums of counts, the size of the model, reach the driver. Null roles count
    as the user's, turns without text are left out, and an empty table gives the model of markers alone."""
    batches.bound(parts.sparkSession)
    key = F.xxhash64("conv_id", "segment", "part")
    edge = parts.select(key.alias("k")).orderBy("k").limit(sample).agg(F.max("k")).first()[0]  # one row
    if edge is None:
        return Model.fit([])
    shapes = [x.shape for x in counted([])]

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batches.claim("chat")
        for frame in frames:
            found = counted(labelled(list(zip(roles, texts, strict=True)), k) for k, roles, texts in zip(frame["style"], frame["roles"], frame["texts"], strict=True))
            yield pd.DataFrame([(t, i, x) for t, table in enumerate(found) for i, x in enumerate(table.ravel().tolist()) if x], columns=["t", "i", "n"])

    some = parts.filter(key <= edge).select(style.alias("style"), F.transform("said", lambda x: x["role"]).alias("roles"), F.transform("said", lambda x: x["text"]).alias("texts"))
    sums = some.mapInPandas(count, "t int, i int, n double").groupBy("t", "i").agg(F.sum("n").alias("n"))
    tables = [np.zeros(shape) for shape in shapes]
    for t, i, n in sums.collect():  # a row for each count of the model
        tables[t].flat[i] = n
    return Model.of(tables)

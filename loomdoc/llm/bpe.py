"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming UTF-8 decoder.

An encoding is the one sequence of tokens in which each neighbouring pair survives its own merging: a merge across a
boundary would have happened in the pair alone. So after each byte exactly one token can end there, and the only
prefixes that still matter are those from which a vocabulary entry that can stand goes on. A machine state is that set
of live prefixes: trie node and last token before it, or, once few entries remain below the node, the entries that can
stand, so that last tokens which allow the same entries share a state. Transitions are made on first use; a transition
emits the token that ends at its byte. The tokens are those on the way back from the end, and wherever the ways of all
live prefixes meet, what lies before is settled: no live prefix is longer than the longest entry, which bounds the
lookahead.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.llm import batches
from loomdoc.llm.store import packed, unpacked

#: Bytes that a worker's tables may take: transitions of the machine for long pieces and of the one for short pieces, and known
#: stretches of text. Beyond them they are made anew, which changes no result.
MACHINE_BYTES, LANE_BYTES, STRETCH_BYTES = 16 << 20, 24 << 20, 32 << 20
#: Fixed value: the pre-tokenizer's pattern under which a blank after no white space starts a piece, letters are one piece, and a letter
#: and a sign after it are two. Texts under another pattern are cut by the pattern alone.
PLAIN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SIGNS = ".,;:!?"
#: Letters below this one are letters in every version of the standard.
LATIN = "\u0250"
#: Bytes of a long piece, and characters of texts that are encoded together.
LONG, TOGETHER = 96, 1 << 20
#: Estimated bytes of a state, a transition, a remembered pair and a remembered live prefix.
STATE, MOVE, PAIR, MEMBER = 460, 90, 70, 100
#: Nodes with at most this many entries below are known by the entries that can stand.
FEW = 12
#: Bytes of a piece after which settled tokens are taken off.
SETTLE = 4096
#: Longest stretch of text that is remembered.
STRETCH = 64

_LOW = (1 << 32) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merges:
    """Which tokens come from which two, and which pairs of tokens survive side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        self.left, self.right = array("i", range(size)), array("i", range(size))  # single bytes are their own halves
        self.reached = bytearray(size)
        self.joins: dict[int, int] = {}
        get = ranks.get
        for text, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(text) == 1:
                self.reached[rank] = 1
                continue
            for cut in range(1, len(text)):
                a, b = get(text[:cut], rank), get(text[cut:], rank)
                if a < rank and b < rank and self.reached[a] and self.survive(a, b):
                    self.left[rank], self.right[rank], self.reached[rank] = a, b, 1
                    self.joins[a << 32 | b] = rank
                    break

    def survive(self, a: int, b: int) -> bool:
        """Whether the merges leave the boundary between ``a`` and ``b``, going back through both tokens' merges, latest first: the two
        neighbours of a moment must not have a merge that is due before either of them is next merged."""
        if not self.reached[b]:
            return False
        joins, left, right = self.joins, self.left, self.right
        due = 1 << 40
        while True:
            if joins.get(a << 32 | b, due) < due:
                return False
            inner, outer = right[a], left[b]
            if inner != a and (a > b or outer == b):
                a, due = inner, a
            elif outer != b:
                b, due = outer, b + 1  # of equal ranks the left one goes first
            else:
                return True


class State(dict):
    """Transitions by byte: next state and the token that ends; made on first use."""

    __slots__ = ("live", "machine")

    def __missing__(self, byte: int) -> tuple[State, int]:
        out = self[byte] = self.machine.advance(self.live, byte)
        return out


class Transducer:
    """Encodes one piece of bytes at a time."""

    def __init__(self, ranks: dict[bytes, int], size: int = MACHINE_BYTES):
        self.ranks, self.most = ranks, size
        self.merges = Merges(ranks)
        self.length = array("i", bytes(4 * (max(ranks.values(), default=-1) + 1)))
        self.child: dict[int, int] = {}
        self.entry, self.depth = array("i", [-1]), array("i", [0])
        # in the order of their bytes, the entries below a node are one stretch
        self.order = array("i")
        self.low, self.high = array("i", [0]), array("i", [len(ranks)])
        for text, rank in sorted(ranks.items()):
            node, self.length[rank] = 0, len(text)
            place = len(self.order)
            self.order.append(rank)
            for byte in text:
                nxt = self.child.get(node << 8 | byte)
                if nxt is None:
                    nxt = self.child[node << 8 | byte] = len(self.entry)
                    self.entry.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    self.low.append(place)
                    self.high.append(place)
                node = nxt
                self.high[node] = place + 1
            self.entry[node] = rank
            self.low[node] = place + 1
        self.restart()

    def restart(self) -> None:
        self.pairs: dict[int, bool] = {}
        self.members: dict[int, int | None] = {}
        self.classes: list[tuple[int, tuple[int, ...]]] = []
        self.named: dict[tuple[int, tuple[int, ...]], int] = {}
        self.states: dict[tuple[int, ...], State] = {}
        self.made = 0
        self.start = self.state((0,))

    def size(self) -> int:
        """Estimated bytes of the tables."""
        return STATE * len(self.states) + MOVE * self.made + PAIR * len(self.pairs) + MEMBER * (len(self.members) + 2 * len(self.classes))

    def state(self, live: tuple[int, ...]) -> State:
        found = self.states.get(live)
        if found is None:
            found = self.states[live] = State()
            found.live, found.machine = live, self
        return found

    def below(self, node: int) -> array:
        """The entries below a node, itself left out."""
        return self.order[self.low[node] : self.high[node]]

    def stands(self, left: int, right: int) -> bool:
        """Whether ``right`` can follow ``left`` (-1: the start of the piece)."""
        if left < 0:
            return bool(self.merges.reached[right])
        known = self.pairs.get(left << 32 | right)
        if known is None:
            known = self.pairs[left << 32 | right] = self.merges.survive(left, right)
        return known

    def of_class(self, node: int, allowed: tuple[int, ...]) -> int | None:
        """A live prefix as the complement of its class's number; none if no entry can stand."""
        if not allowed:
            return None
        number = self.named.get((node, allowed))
        if number is None:
            number = self.named[node, allowed] = len(self.classes)
            self.classes.append((node, allowed))
        return ~number

    def member(self, node: int, left: int) -> int | None:
        key = node << 32 | left + 1
        if self.high[node] - self.low[node] > FEW:
            return key
        found = self.members.get(key, 0)
        if found == 0:
            survive = self.merges.survive
            found = self.members[key] = self.of_class(node, tuple([t for t in self.below(node) if left < 0 or survive(left, t)]))
        return found

    def advance(self, live: tuple[int, ...], byte: int) -> tuple[State, int]:
        out, ended = [], -1
        for one in live:
            if one < 0:
                node, allowed = self.classes[~one]
            else:
                node, left = one >> 32, (one & _LOW) - 1
            child = self.child.get(node << 8 | byte)
            if child is None:
                continue
            token = self.entry[child]
            if token >= 0 and ended < 0 and (token in allowed if one < 0 else self.stands(left, token)):
                ended = token
            if self.low[child] < self.high[child]:
                if one < 0:
                    below = self.below(child)
                    more = self.of_class(child, tuple([t for t in below if t in allowed]))
                else:
                    more = self.member(child, left)
                if more is not None:
                    out.append(more)
        if ended < 0:
            raise ValueError(f"the vocabulary lacks byte {byte}")
        out.append(ended + 1)
        self.made += 1
        return self.state(tuple(out)), ended

    def starts(self, live: tuple[int, ...], at: int) -> set[int]:
        """Where the live prefixes of a state begin, which is reached at ``at``."""
        return {at - self.depth[self.classes[~one][0] if one < 0 else one >> 32] for one in live}

    def back(self, ends: list[int], at: int) -> list[int]:
        """The tokens on the way back from ``at``, in order."""
        out, length = [], self.length
        while at:
            token = ends[at - 1]
            out.append(token)
            at -= length[token]
        out.reverse()
        return out

    def settled(self, ends: list[int], live: tuple[int, ...]) -> int:
        """Up to where the tokens are the same for all live prefixes."""
        places = self.starts(live, len(ends))
        while len(places) > 1:
            last = max(places)
            places.remove(last)
            places.add(last - self.length[ends[last - 1]])
        return places.pop()

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if self.size() > self.most:
            self.restart()
        state, ends, out = self.start, [], []
        for start in range(0, len(piece), SETTLE):
            if start:
                place = self.settled(ends, state.live)
                out += self.back(ends, place)
                del ends[:place]
                if self.size() > self.most:
                    live = state.live
                    # class numbers do not outlive a restart
                    kept = [self.classes[~one] if one < 0 else one for one in live]
                    self.restart()
                    state = self.state(tuple([one if isinstance(one, int) else self.of_class(*one) for one in kept]))
            for byte in piece[start : start + SETTLE]:
                state, token = state[byte]
                ends.append(token)
        return out + self.back(ends, len(ends)) if out else self.back(ends, len(ends))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted, non-empty ``keys``, and whether they are there."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


class Lanes:
    """The same machine for many short pieces at once, a byte of each at a time, its tables held in flat sorted arrays.

    States are the live prefixes as they are (node, last token). What a step lacks is made for all lanes together.
    """

    def __init__(self, machine: Transducer, size: int = LANE_BYTES):
        flat = lambda x: np.frombuffer(x, np.int32).astype(np.int64)
        merges = machine.merges
        self.left, self.right, self.reached = flat(merges.left), flat(merges.right), np.frombuffer(bytes(merges.reached), np.uint8) > 0
        self.joins = np.array(sorted(merges.joins), np.int64)
        self.joined = np.array([merges.joins[k] for k in self.joins.tolist()], np.int64)
        self.edges = np.array(sorted(machine.child), np.int64)
        self.child = np.array([machine.child[k] for k in self.edges.tolist()], np.int64)
        self.entry, self.length = flat(machine.entry), flat(machine.length)
        self.goes_on = flat(machine.low) < flat(machine.high)
        self.most = size
        self.restart()

    def restart(self) -> None:
        self.keys, self.next, self.ends = np.array([-1]), np.zeros(1, np.int64), np.zeros(1, np.int32)  # by state and byte
        self.at, self.live = np.array([0, 1]), np.zeros(1, np.int64)  # state 0: the root, after no token
        self.names, self.named = np.zeros(1, np.uint64), np.zeros(1, np.int64)  # states by a hash of their prefixes
        self.names[0] = self.hashed(self.live, np.zeros(1, np.int64), 1)[0]

    def size(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.next, self.ends, self.at, self.live, self.names, self.named))

    def survive(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``Merges.survive`` for each pair; -1 on the left is the start of a piece."""
        out = self.reached[b].copy()
        lane = np.flatnonzero(out & (a >= 0))
        a, b, due = a[lane], b[lane], np.full(len(lane), 1 << 40)
        while len(lane):
            at, known = _find(self.joins, a << 32 | b) if len(self.joins) else (np.zeros(len(a), np.int64), np.zeros(len(a), bool))
            early = known & (np.where(known, self.joined[at] if len(self.joins) else 0, 0) < due)
            out[lane[early]] = False
            inner, outer = self.right[a], self.left[b]
            leftward = ~early & (inner != a) & ((a > b) | (outer == b))
            rightward = ~early & ~leftward & (outer != b)
            due = np.where(leftward, a, b + 1)
            a, b = np.where(leftward, inner, a), np.where(rightward, outer, b)
            on = leftward | rightward
            lane, a, b, due = lane[on], a[on], b[on], due[on]
        return out

    @staticmethod
    def hashed(members: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """A hash of each row's members in order; ``row`` ascends."""
        place = np.arange(len(row)) - np.searchsorted(row, row)
        x = members.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
        out = np.zeros(rows, np.uint64)
        np.add.at(out, row, x)
        return out

    def members(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The live prefixes of each state, and which of the states each is of."""
        counts = self.at[states + 1] - self.at[states]
        row = np.repeat(np.arange(len(states)), counts)
        return self.live[np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + self.at[states][row]], row

    def learn(self, keys: np.ndarray) -> None:
        """Make the transitions ``keys`` (state and byte, distinct)."""
        live, row = self.members(keys >> 8)
        at, found = _find(self.edges, live >> 32 << 8 | (keys & 255)[row])
        child, last, row = self.child[at[found]], (live[found] & _LOW) - 1, row[found]
        token = self.entry[child]
        maybe = np.flatnonzero(token >= 0)
        maybe = maybe[self.survive(last[maybe], token[maybe])]
        ended = np.full(len(keys), -1, np.int64)
        ended[row[maybe]] = token[maybe]
        if (ended < 0).any():
            raise ValueError(f"the vocabulary lacks byte {int(keys[ended < 0][0]) & 255}")
        more = self.goes_on[child]
        members = np.concatenate([child[more] << 32 | last[more] + 1, ended + 1])
        row = np.concatenate([row[more], np.arange(len(keys))])
        order = np.argsort(row, kind="stable")
        members, row = members[order], row[order]
        names = self.hashed(members, row, len(keys))
        counts = np.bincount(row, minlength=len(keys))
        starts = np.cumsum(counts) - counts
        # states that are there already; a hash alone does not make two the same
        at, same = _find(self.names, names)
        target = np.where(same, self.named[at], -1)
        same &= counts == self.at[target + 1] - self.at[target]
        rows = np.flatnonzero(same)
        held, of = self.members(target[rows])
        new = members[np.arange(len(of)) - np.searchsorted(of, of) + starts[rows][of]]
        same[rows[of[held != new]]] = False
        # of the rest, those alike become one state
        fresh = np.flatnonzero(~same)
        if len(fresh):
            _, first, which = np.unique(names[fresh], return_index=True, return_inverse=True)
            lead = fresh[first][which]
            pairs = np.flatnonzero(counts[lead] == counts[fresh])
            twin = np.zeros(len(fresh), bool)
            twin[pairs] = True
            span = np.repeat(pairs, counts[fresh[pairs]])
            step = np.arange(len(span)) - np.searchsorted(span, span)
            twin[span[members[starts[fresh[span]] + step] != members[starts[lead[span]] + step]]] = False
            own = np.flatnonzero(~twin | (lead == fresh))
            number = np.full(len(keys), -1, np.int64)
            number[fresh[own]] = len(self.at) - 1 + np.arange(len(own))
            target[fresh] = np.where(twin, number[lead], number[fresh])
            take = fresh[own]
            span = np.repeat(np.arange(len(take)), counts[take])
            self.live = np.concatenate([self.live, members[np.arange(len(span)) - np.searchsorted(span, span) + starts[take][span]]])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(counts[take])])
            self.names, self.named = self.merged((self.names, self.named), (names[take], number[take]))
        self.keys, self.next, self.ends = self.merged((self.keys, self.next, self.ends), (keys, target, ended.astype(np.int32)))

    @staticmethod
    def merged(held: tuple[np.ndarray, ...], more: tuple[np.ndarray, ...]) -> list[np.ndarray]:
        """Tables sorted by their first column with more rows."""
        order = np.argsort(more[0])
        at = np.searchsorted(held[0], more[0][order])
        return [np.insert(x, at, y[order]) for x, y in zip(held, more, strict=True)]

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian ids of each piece."""
        if self.size() > self.most:
            self.restart()
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join([pieces[k] for k in order.tolist()]), np.uint8)
        lengths = lengths[order]
        start = np.cumsum(lengths) - lengths
        ends, state = np.zeros(len(data), np.int32), np.zeros(len(pieces), np.int64)
        for k in range(int(lengths[0]) if len(lengths) else 0):
            n = int(np.searchsorted(-lengths, -k, "left"))  # lanes that are longer
            keys = state[:n] << 8 | data[start[:n] + k]
            at, known = _find(self.keys, keys)
            if not known.all():
                self.learn(np.unique(keys[~known]))
                at, _ = _find(self.keys, keys)
            state[:n], ends[start[:n] + k] = self.next[at], self.ends[at]
        # the way back from each end
        lane, place, taken = np.arange(len(pieces)), start + lengths, []
        counts = np.zeros(len(pieces), np.int64)
        while len(lane):
            token = ends[place - 1]
            taken.append((lane, token))
            counts[lane] += 1
            place = place - self.length[token]
            on = place > start[lane]
            lane, place = lane[on], place[on]
        stop = np.cumsum(counts)
        ids = np.zeros(int(counts.sum()), "<u4")
        for k, (lane, token) in enumerate(taken):
            ids[stop[lane] - 1 - k] = token
        raw, out = ids.tobytes(), [b""] * len(pieces)
        for k, a, b in zip(order.tolist(), (4 * (stop - counts)).tolist(), (4 * stop).tolist(), strict=True):
            out[k] = raw[a:b]
        return out


class Stretches:
    """Ids of stretches of text that start at a piece boundary after ``lead``, in two generations of bounded size."""

    def __init__(self, encoder: Encoder, lead: str, size: int):
        self.encoder, self.lead, self.half = encoder, lead, size // 2
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0
        self.long: list[str] = []

    def need(self, stretches: set[str]) -> None:
        """Have ``known`` hold all of ``stretches``."""
        if self.size > self.half:
            self.old, self.known, self.size = self.known, {}, 0
        missing = stretches.difference(self.known)
        again = missing.intersection(self.old)
        for text in again:
            self.known[text] = self.old[text]
        missing -= again
        known = self.known
        # a letter and a sign after it are never one piece: "word," is "word" and ","
        signed = [t for t in missing if t[-1:] in SIGNS and t[-2:-1].isalpha()] if self.encoder.plain else []
        missing.difference_update(signed)
        heads = {t[:-1] for t in signed}.difference(known)
        missing |= heads
        new = list(missing)
        known.update(zip(new, self.encoder.made(self.lead, new), strict=True))
        for text in signed:
            known[text] = known[text[:-1]] + self.encoder.signs[text[-1]]
        self.long = [t for t in new if len(t) > STRETCH] + [t for t in signed if len(t) > STRETCH]
        self.size += 215 * (len(again) + len(new) + len(signed))

    def drop_long(self) -> None:
        for text in self.long:
            del self.known[text]


class Encoder:
    """Whole texts: pieces by the pre-tokenizer's pattern, each through the transducer."""

    #: a blank after white space does not start a piece for certain
    UNSURE = regex.compile(r"^\s|\s ")

    def __init__(self, ranks: dict[bytes, int], pattern: str, machine_bytes: int = MACHINE_BYTES, lane_bytes: int = LANE_BYTES, stretch_bytes: int = STRETCH_BYTES):
        self.machine, self.pattern = Transducer(ranks, machine_bytes), regex.compile(pattern)
        self.lanes = Lanes(self.machine, lane_bytes)
        self.plain = pattern == PLAIN
        self.signs = {x: struct.pack("<I", ranks[x.encode()]) for x in SIGNS} if self.plain else {}
        self.bare, self.spaced = Stretches(self, "", stretch_bytes // 4), Stretches(self, " ", stretch_bytes // 4 * 3)

    def made(self, lead: str, stretches: list[str]) -> list[bytes]:
        """Ids of each stretch: short pieces side by side, long ones alone."""
        pieces, many = [], []  # all pieces, and the stretches of more or fewer than one
        for k, text in enumerate(stretches):
            if self.plain and text.isalpha() and (text.isascii() or max(text) < LATIN):
                pieces.append((lead + text).encode())
            else:
                found = self.pattern.findall(lead + text)
                if len(found) != 1:
                    many.append((k, len(pieces), len(found)))
                pieces += [x.encode() for x in found]
        whole = self.machine.ranks.get
        out: list[bytes] = [b""] * len(pieces)
        short = []
        for k, piece in enumerate(pieces):
            rank = whole(piece)
            if rank is not None:
                out[k] = struct.pack("<I", rank)
            elif len(piece) <= LONG:
                short.append(k)
            else:
                ids = self.machine.encode(piece)
                out[k] = struct.pack(f"<{len(ids)}I", *ids)
        for k, ids in zip(short, self.lanes.encode([pieces[k] for k in short]), strict=True):
            out[k] = ids
        if not many:
            return out
        joined, at = [], 0
        for k, first, count in many:
            joined += out[at:first]
            joined.append(b"".join(out[first : first + count]))
            at = first + count
        return joined + out[at:]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text; null texts have none."""
        split = []
        for text in texts:
            if not text:
                split.append(([], []))
            elif not self.plain or self.UNSURE.search(text):
                split.append((self.pattern.findall(text), []))
            else:
                head, *rest = text.split(" ")
                split.append(([head], rest))
        bare, spaced = set(chain.from_iterable([x for x, _ in split])), set(chain.from_iterable([x for _, x in split]))
        self.bare.need(bare)
        self.spaced.need(spaced)
        out = [b"".join([*map(self.bare.known.__getitem__, heads), *map(self.spaced.known.__getitem__, rest)]) for heads, rest in split]
        self.bare.drop_long()
        self.spaced.drop_long()
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


def grouped(texts: Iterable[str | None], size: int) -> Iterator[list[str | None]]:
    """Runs of texts that end where their length reaches ``size``."""
    held, length = [], 0
    for text in texts:
        held.append(text)
        length += len(text or "")
        if length >= size:
            yield held
            held, length = [], 0
    if held:
        yield held


#: The well-formed byte sequences of UTF-8 as (first byte from, to, bytes to follow, second byte from, to).
UTF8_LEADS = (
    (0x00, 0x7F, 0, 0, 0),
    (0xC2, 0xDF, 1, 0x80, 0xBF),
    (0xE0, 0xE0, 2, 0xA0, 0xBF),
    (0xE1, 0xEC, 2, 0x80, 0xBF),
    (0xED, 0xED, 2, 0x80, 0x9F),
    (0xEE, 0xEF, 2, 0x80, 0xBF),
    (0xF0, 0xF0, 3, 0x90, 0xBF),
    (0xF1, 0xF3, 3, 0x80, 0xBF),
    (0xF4, 0xF4, 3, 0x80, 0x8F),
)
LEAD = {b: (more, lo, hi) for first, last, more, lo, hi in UTF8_LEADS for b in range(first, last + 1)}


class StreamDecoder:
    """Ids to text, token by token. State: bytes still awaited, range of the next one, bits so far. Malformed sequences give U+FFFD."""

    REST = (0, 0, 0, 0)

    def __init__(self, ranks: dict[bytes, int]):
        self.token = {i: t for t, i in ranks.items()}
        self.moves: dict[tuple, tuple[str, tuple]] = {}
        self.plain: dict[int, str | None] = {}

    def bytewise(self, state: tuple, text: bytes) -> tuple[str, tuple]:
        out = []
        for byte in text:
            more, low, high, bits = state
            if more and not low <= byte <= high:
                out.append("�")
                more = 0
            if more:
                bits, more = bits << 6 | byte & 0x3F, more - 1
            elif (lead := LEAD.get(byte)) is None:
                out.append("�")
                state = self.REST
                continue
            else:
                more, low, high = lead
                bits = byte & (0x7F >> (more + bool(more)))
                if more:
                    state = (more, low, high, bits)
                    continue
            if more:
                state = (more, 0x80, 0xBF, bits)
            else:
                out.append(chr(bits))
                state = self.REST
        return "".join(out), state

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes known; the last item is U+FFFD if the ids end within a character."""
        state = self.REST
        for token in ids:
            move = self.moves.get((state, token))
            if move is None:
                move = self.moves[(state, token)] = self.bytewise(state, self.token[token])
            text, state = move
            yield text
        if state != self.REST:
            yield "�"

    def text(self, ids: list[int]) -> str:
        """All at once; tokens that are whole characters need no state."""
        known = [self.plain.get(i, 0) for i in ids]
        for k, piece in enumerate(known):
            if piece == 0:
                text, state = self.bytewise(self.REST, self.token[ids[k]])
                known[k] = self.plain[ids[k]] = text if state == self.REST and "�" not in text else None
        return "".join(self.decode(ids)) if None in known else "".join(known)


_MADE: dict[tuple, tuple[Encoder, StreamDecoder]] = {}


def codec(path: str, pattern: str) -> tuple[Encoder, StreamDecoder]:
    """One codec a worker process, kept between the tasks of this operator."""
    batches.claim("bpe", _MADE.clear)
    if (path, pattern) not in _MADE:
        ranks = load_ranks(path)
        _MADE[path, pattern] = Encoder(ranks, pattern), StreamDecoder(ranks)
    return _MADE[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str, column: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` (string) of ``column``.

    A null or empty text has no ids and decodes to the empty string. Texts of any length are encoded whole; the
    vocabulary file at ``path`` must be readable on the executors. No shuffle. Columns named ``ids`` or ``decoded``
    in the input are replaced.
    """
    batches.bound(docs.sparkSession, size=2 << 20)  # a batch is held as text, ids and decoded text

    @F.pandas_udf("ids binary, decoded string")
    def both(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder, decoder = codec(path, pattern)
        for texts in parts:
            ids = [x for some in grouped(texts, TOGETHER) for x in encoder.encode_all(some)]
            yield pd.DataFrame({"ids": ids, "decoded": [decoder.text(list(struct.unpack(f"<{len(x) // 4}I", x))) for x in ids]})

    rows = packed(docs, _text=column).withColumn("_both", both("_text")).select("_row", "_both.ids", "_both.decoded")
    return unpacked(rows, docs.columns, ["ids", "decoded"])


def digest(ids: list[int]) -> str:
    return hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()

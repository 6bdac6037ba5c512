"""Token ids in binary files of bit planes.

A file is one range of documents in ascending id order. Its ids are cut into fixed-size blocks; a block is transposed
into byte planes (all first bytes, all second bytes, ...) or bit planes, each plane is compressed with zstandard, and
an index at the end holds every chunk's place, so a reader can fetch any block or document alone.

Layout, little-endian::

    magic "LDTOK1\\0\\0" | planes of block 0, block 1, ... | chunk index | document index | footer

    chunk index      one row a plane: offset, length (unsigned 64-bit each)
    document index   zstandard frame of doc_id (signed 64-bit) | 1 if the id is not null | n_tokens (unsigned 64-bit)
    footer           blocks, planes a block, ids a block, ids, documents, bits (0: byte planes), offset and
                     length of the indexes (unsigned 64-bit each) | magic

Tasks write under names of their own attempt and the manifest lists only the attempts that were committed.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomdoc.llm import batches, store

MAGIC = b"LDTOK1\0\0"
BLOCK_IDS, LEVEL = 1 << 16, 3
#: Cached words are dropped beyond this many bytes, by estimate, which bounds memory and changes no result.
WORD_BYTES = 192 << 20
SIGNS = b".,;:!?"
#: A capital before a character from U+0300 on, which may be a mark that composes with it.
MARKED = re.compile(rb"[A-Z][\xcc-\xf4]")


def planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of one block, lowest first; only as many as its largest id needs."""
    top = int(ids.max()) if len(ids) else 0
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)[:, : max(1, -(-top.bit_length() // 8))]
    if not bits:
        return [np.ascontiguousarray(octets[:, k]).tobytes() for k in range(octets.shape[1])]
    spread = np.unpackbits(octets, axis=1, bitorder="little")[:, : max(1, top.bit_length())]
    return [np.packbits(np.ascontiguousarray(spread[:, k]), bitorder="little").tobytes() for k in range(spread.shape[1])]


def unplanes(parts: list[bytes], count: int, bits: bool) -> np.ndarray:
    octets = np.zeros((count, 4), np.uint8)
    if bits:
        spread = np.zeros((count, 32), np.uint8)
        for k, part in enumerate(parts):
            spread[:, k] = np.unpackbits(np.frombuffer(part, np.uint8), count=count, bitorder="little")
        octets = np.packbits(spread, axis=1, bitorder="little")
    else:
        for k, part in enumerate(parts):
            octets[:, k] = np.frombuffer(part, np.uint8)
    return np.ascontiguousarray(octets).view("<u4").reshape(-1)


class Writer:
    """Streams ids of documents into one file; holds one block at a time."""

    def __init__(self, sink, bits: bool = False, block_ids: int = BLOCK_IDS):
        self.sink, self.bits, self.block_ids = sink, bits, block_ids
        self.pending: list[np.ndarray] = []
        self.waiting = self.ids = self.at = 0
        self.chunks: list[tuple[int, int]] = []
        self.starts: list[int] = []
        self.docs: list[tuple[int, int, int]] = []
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self.put(MAGIC)

    def put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((0 if doc_id is None else doc_id, doc_id is not None, len(ids)))
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block_ids:
            joined = np.concatenate(self.pending)
            full = len(joined) // self.block_ids * self.block_ids
            for k in range(0, full, self.block_ids):
                self.block(joined[k : k + self.block_ids])
            self.pending, self.waiting = [joined[full:]], len(joined) - full

    def block(self, ids: np.ndarray) -> None:
        self.starts.append(len(self.chunks))
        self.ids += len(ids)
        for plane in planes(ids, self.bits):
            packed = self.pack.compress(plane)
            self.chunks.append((self.at, len(packed)))
            self.put(packed)

    def close(self) -> tuple[int, int]:
        if self.waiting:
            self.block(np.concatenate(self.pending))
        place = self.at
        self.put(struct.pack(f"<{2 * len(self.chunks)}Q", *[x for c in self.chunks for x in c]) + struct.pack(f"<{len(self.starts)}Q", *self.starts))
        index = self.at
        self.put(self.pack.compress(b"".join(struct.pack("<qQQ", *d) for d in self.docs)))
        self.put(struct.pack("<8Q", len(self.starts), len(self.chunks), self.block_ids, self.ids, len(self.docs), self.bits, place, index) + MAGIC)
        return self.ids, len(self.docs)


class Reader:
    """Random access to one file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        foot = source.read_at(72, size - 72)
        if foot[64:] != MAGIC:
            raise ValueError("not a token file")
        self.blocks, n, self.block_ids, self.ids, docs, self.bits, place, index = struct.unpack("<8Q", foot[:64])
        at = struct.unpack(f"<{2 * n + self.blocks}Q", source.read_at(8 * (2 * n + self.blocks), place))
        self.chunks, self.starts = [(at[2 * k], at[2 * k + 1]) for k in range(n)], [*at[2 * n :], n]
        self.unpack = zstandard.ZstdDecompressor()
        raw = self.unpack.decompress(source.read_at(size - 72 - index, index), max_output_size=max(1, 24 * docs))
        self.docs = [struct.unpack_from("<qQQ", raw, 24 * k) for k in range(docs)]

    def block(self, k: int) -> np.ndarray:
        count = min(self.block_ids, self.ids - k * self.block_ids)
        size = -(-count // 8) if self.bits else count
        parts = [self.unpack.decompress(self.source.read_at(n, at), max_output_size=size) for at, n in self.chunks[self.starts[k] : self.starts[k + 1]]]
        return unplanes(parts, count, bool(self.bits))

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Documents in order: id, place in the file, ids. Reads a block at a time."""
        start, held, first, nxt = 0, np.zeros(0, "<u4"), 0, 0
        for doc_id, known, n in self.docs:
            got = [held[start - first : start - first + n]]
            have = len(got[0])
            while have < n:
                first, held = nxt * self.block_ids, self.block(nxt)
                nxt += 1
                got.append(held[: n - have])
                have += len(got[-1])
            yield (doc_id if known else None), start, np.concatenate(got)
            start += n


#: Settings of a tokenizer file under which a text's ids are those of its words. White space is dropped and never
#: crossed, letters are composed and then lower-cased, and a letter and a sign after it are never one piece.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None,
    "padding": None,
}


class Tokenizer:
    """Ids of the tokenizers library, as it comes, for whole texts.

    Where the file's settings are ``WORDWISE`` and its added tokens hold no white space and are found in the text as it
    stands, each distinct word goes through the library once while it stays in the table. Any other file gets whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        held = json.loads(self.library.to_str())
        added = held["added_tokens"]
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) and len(t["content"].split()) == 1 for t in added)
        plain &= not any(t["content"][-1] in SIGNS.decode() for t in added)
        self.wordwise = plain and all(held[k] == v for k, v in WORDWISE.items())
        # added tokens are found anywhere, in the case they are written in; in another case they must not become one
        self.added = [t["content"].encode().lower() for t in added]
        self.words: dict[bytes, bytes] = {}
        self.size = 0

    def split(self, text: bytes) -> list[bytes]:
        """Words, in lower case (A-Z) where that changes no id.

        The vocabulary composes (NFC) before it lower-cases, and some marks compose with a letter's lower case alone (J, H, T, W, Y).
        Marks are at U+0300 and above and compose with a capital only in the word it stands in, so such words stay as they
        are, and so do words that hold an added token in any case.
        """
        low = text.lower()
        if not self.holds_added(low) and (text.isascii() or not MARKED.search(text)):
            return low.split()
        return [w if MARKED.search(w) or self.holds_added(w.lower()) else w.lower() for w in text.split()]

    def holds_added(self, low: bytes) -> bool:
        for token in self.added:
            if token in low:
                return True
        return False

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.wordwise:
            got = self.library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
            return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in got]
        split = [self.split(t) for t in texts]
        known = self.words
        if self.size > WORD_BYTES:
            known.clear()
            self.size = 0
        new = set(chain.from_iterable(split)).difference(known)
        # a letter and a sign after it are never one piece: "word," is "word" and ","; no added token ends in such a pair
        signed = [w for w in new if w[-1] in SIGNS and w[-2:-1].isalpha()]
        new.difference_update(signed)
        new.update(x for w in signed for x in (w[:-1], w[-1:]) if x not in known)
        self.learn(list(new))
        for w in signed:
            known[w] = known[w[:-1]] + known[w[-1:]]
            self.size += 170 + 5 * len(w)
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def learn(self, words: list[bytes]) -> None:
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            for word, got in zip(part, self.library.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                ids = got.ids
                self.words[word] = struct.pack(f"<{len(ids)}I", *ids)
                self.size += 170 + len(word) + 4 * len(ids)


_MADE: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One tokenizer a worker process, single-threaded: Spark's tasks are the parallelism."""
    batches.claim("tokenfile", _MADE.clear)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _MADE:
        _MADE[path] = Tokenizer(path)
    return _MADE[path]


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int = 1, bits: bool = False, partitions: int | None = None) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text) and write them in ascending ``doc_id`` order; the manifest, one row a file:
    ``file`` (order), ``path``, ``first`` (ids in all files before), ``ids``, ``docs``.

    A null text has no ids but the end id. Null doc_ids come first; equal ones lie in the order of their texts. An
    empty table gives an empty manifest. Other columns are not written. The only shuffle is the sort by doc_id.
    """
    spark = docs.sparkSession
    batches.bound(spark)
    folder = store.workspace(spark, "tokens")
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = [partitions] if partitions else []
    ordered = docs.select("doc_id", text.cast("binary").alias("text")).repartitionByRange(*parts, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", "text")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, number = tokenizer(vocabulary).encode, TaskContext.get().partitionId()
        end = struct.pack("<I", end_id)
        out = None
        for frame in frames:
            if out is None and len(frame):
                where, place = fs.FileSystem.from_uri(folder)
                where.create_dir(place, recursive=True)
                name = f"{number:06d}-{uuid.uuid4().hex}.ldtok"
                sink = where.open_output_stream(f"{place}/{name}")
                out = Writer(sink, bits)
            for doc_id, ids in zip(frame["doc_id"], encode(list(frame["text"])), strict=True):
                out.add(None if pd.isna(doc_id) else int(doc_id), np.frombuffer(ids + end, "<u4"))
        if out is not None:
            ids, count = out.close()
            sink.close()
            yield pd.DataFrame({"file": [number], "path": [f"{folder}/{name}"], "ids": [ids], "docs": [count]})

    written, _ = store.materialise(ordered.mapInPandas(write, "file int, path string, ids long, docs long"), "manifest")
    # one row a file: the running total needs no more than the manifest
    return written.withColumn("first", F.sum("ids").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1))).fillna(0, ["first"])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Documents from the files: doc_id, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` (binary, little-endian unsigned 32-bit)."""
    batches.bound(manifest.sparkSession)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, first in zip(frame["path"], frame["first"], strict=True):
                where, place = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with where.open_input_file(place) as source:
                    for doc_id, start, ids in Reader(source):
                        rows.append((doc_id, first + start, len(ids), ids.tobytes()))
                        size += 4 * len(ids) + 64
                        if size > batches.BYTES:
                            yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids"]).astype({"doc_id": "Int64"})
                            rows, size = [], 0
                yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids"]).astype({"doc_id": "Int64"})

    # a number keeps adaptive execution from putting all files into one task
    dealt = manifest.select("path", "first").repartition(max(1, min(manifest.count(), 1 << 15)), F.col("path"))
    return dealt.mapInPandas(read, "doc_id long, start long, n_tokens long, ids binary")


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())



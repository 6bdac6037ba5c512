"""Parts of the operators that need no session, against brute force."""

import collections
import io
import itertools
import random
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import example, given, settings
from hypothesis import strategies as st

from loomdoc.llm import batches, bpe, chat, neardup, quality, sharding, tokenfile, topk

MIXED = st.text(st.sampled_from(list("abcdeéèñ日本🙂 \n\t'.,-012st") + ["\u00a0", "\u2003", "\x1c", "\u0301"]), max_size=60)


# ---- 1
def test_matrix_has_exact_margins_and_the_right_mean():
    parts, shards = [50, 0, 7, 143], sharding.shard_sizes(200, 6)
    assert sum(shards) == 200 and max(shards) - min(shards) <= 1
    total = np.zeros((4, 6))
    for seed in range(400):
        m = np.array(sharding.communication_matrix(parts, shards, seed))
        assert (m.sum(1) == parts).all() and (m.sum(0) == shards).all()
        total += m
    assert np.abs(total / 400 - np.outer(parts, shards) / 200).max() < 0.8


def test_large_draws_follow_the_law():
    rng = np.random.default_rng(1)
    good, bad, n = 3 * 10**9, 9 * 10**9, 10_000
    draws = [sharding.hypergeometric(rng, good, bad, n) for _ in range(300)]
    assert abs(np.mean(draws) - n / 4) < 15 and 35 < np.std(draws) < 52
    assert sharding.hypergeometric(rng, 5 * 10**9, 0, 17) == 17 and sharding.hypergeometric(rng, 0, 5 * 10**9, 17) == 0


# ---- 2
def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_sketches_estimate_similarity_at_any_size():
    rng = random.Random(5)
    for size in (1, 3, 40, 900, 5000):
        for share in (0.5, 0.75, 0.9):
            near = []
            for _ in range(12):
                common = [rng.getrandbits(64) for _ in range(max(1, int(size * share)))]
                a, b = ({*common, *(rng.getrandbits(64) for _ in range(size - len(common)))} for _ in range(2))
                x, y = (neardup.sketch(np.array(sorted(s), np.uint64)) for s in (a, b))
                near.append((x == y).mean() - jaccard(a, b))
            assert abs(np.mean(near)) < 0.06


def test_shingles():
    count = lambda t: len(neardup.shingles(t.encode()))
    assert [count(t) for t in ("", " \n\t", "one", "a b c d", "a b c d e", "a b c d e f", "x x x x x x x")] == [0, 0, 1, 1, 1, 2, 1]
    same = lambda a, b: np.array_equal(neardup.shingles(a.encode()), neardup.shingles(b.encode()))
    assert same("A B C D E", "a b\nc  d e") and not same("Éa", "éa") and not same("a b", "b a") and not same("a\u00a0b", "a b")


# ---- 3
@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), st.integers(1, 9))
@example([b"a"] * 9, 8)
def test_repeated_words(words, window):
    where = collections.defaultdict(list)
    for i in range(len(words) - window + 1):
        where[tuple(words[i : i + window])].append(i)
    want = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(window)}
    assert quality.repeated_words(words, window) == len(want)


# ---- 4
@pytest.fixture(scope="module")
def codecs():
    out = []
    for name in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"):
        ranks = bpe.load_ranks(public_tokenizers.path(name))
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        out.append((bpe.Encoder(ranks, public_tokenizers.PATTERN), bpe.StreamDecoder(ranks), own, ranks))
    return out


def ids_of(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


@settings(max_examples=300, deadline=None)
@given(MIXED)
@example("a" * 5000)
@example("  a  b \n\n c")
@example("x ")
def test_ids_equal_the_library(codecs, text):
    for encoder, decoder, own, _ in codecs:
        ids = ids_of(encoder.encode(text))
        assert ids == own.encode_ordinary(text)
        assert decoder.text(ids) == text and "".join(decoder.decode(ids)) == text


def test_bounds_on_memory_change_nothing(codecs, monkeypatch):
    monkeypatch.setattr(bpe, "SETTLE", 7)
    own, ranks = codecs[0][2:]
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN, 4000, 4000, 900)
    for text in ("the incomprehensible sesquipedalian wörter, ", "zzzyx qqqq wörter the the", "incomprehensible" * 40, "ab" * 300 + "=" * 500, "the the the incomprehensible wörter"):
        assert ids_of(encoder.encode(text)) == own.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=12))
@example(b"\xe2\x82")
@example(b"\xf0\x9f\x98\x41\xed\xa0\x80")
def test_streamed_decoding_of_any_bytes(codecs, data):
    _, decoder, _, ranks = codecs[0]
    ids = [ranks[data[i : i + 1]] for i in range(len(data))]
    assert "".join(decoder.decode(ids)) == decoder.text(ids) == data.decode("utf-8", "replace")


# ---- 5
@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(0, 4), st.integers(1, 6), st.integers(0, 10**6))
def test_threshold_search(n, dims, k, seed):
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-3, 4, (n, dims))
    ids = rng.permutation(n)
    got = topk.threshold_search(ids, vectors, ids[:5], vectors[:5], k)
    want = []
    for q, v in zip(ids[:5], vectors[:5], strict=True):
        scored = sorted((-int(v @ w), int(i)) for i, w in zip(ids, vectors, strict=True) if i != q)
        want += [(int(q), i, -s) for s, i in scored[:k]]
    assert got == want


def test_threshold_search_beyond_doubles():
    vectors = np.array([[2**40, 1], [2**40, 0], [2**39, 5]])
    got = topk.threshold_search(np.arange(3), vectors, np.array([9]), vectors[:1], 2)
    assert got == [(9, 0, 2**80 + 1), (9, 1, 2**80)]


# ---- 7
@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=9), max_size=12), st.booleans(), st.integers(1, 7))
def test_token_files_round_trip(docs, bits, block):
    sink = io.BytesIO()
    writer = tokenfile.Writer(sink, bits, block)
    for k, ids in enumerate(docs):
        writer.add(None if k == 3 else k, np.array(ids, "<u4"))
    assert writer.close() == (sum(map(len, docs)), len(docs))
    reader = tokenfile.Reader(pa.BufferReader(sink.getvalue()))
    back = [(d, s, x.tolist()) for d, s, x in reader]
    starts = [0, *itertools.accumulate(map(len, docs))]
    assert back == [(None if k == 3 else k, starts[k], ids) for k, ids in enumerate(docs)]
    with pytest.raises(ValueError):
        tokenfile.Reader(pa.BufferReader(sink.getvalue()[:-1] + b"x"))


@settings(max_examples=100, deadline=None)
@given(st.lists(MIXED, max_size=4))
@example(["It's THE-end, of<|endoftext|> the.world ...", "İstanbul Σίσυφος café\u0301 'S 12ab"])
def test_word_ids_equal_the_library(texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    got = tokenfile.tokenizer(path).encode([t.encode() for t in texts])
    assert [ids_of(x) for x in got] == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("JHTWYAKjhtwy \u030c\u0331\u0308\u030a\u0323\u0301\u0344.,日é\u212a", max_size=12), max_size=4))
@example(["H\u0331amza J\u030cx W\u030a", "T\u0308 Y\u030a, J\u0323\u030cX. AJ\u030c", "PLAIN Words \u0130 É"])
def test_capitals_with_marks_equal_the_library(texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    got = tokenfile.tokenizer(path).encode([t.encode() for t in texts])
    assert [ids_of(x) for x in got] == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


# ---- 8
def said(rng, n):
    words = lambda k: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(k))
    turns = [("system", words(9))] if rng.random() < 0.3 else []
    for k in range(n):
        user = k % 2 == 0
        turns.append(("user", words(rng.randint(3, 12)) + "?") if user else ("assistant", "\n".join(words(rng.randint(20, 60)) for _ in range(rng.randint(1, 3)))))
    return turns


def raw(turns, style):
    marks = chat.STYLES[style]
    out = []
    for k, (role, text) in enumerate(turns):
        mark = marks[chat.ROLES.index(role)]
        out.append(("\n" if mark is None and k else "") + (mark or "") + text)
    return "\n".join(out)


def test_roles_on_held_out_transcripts():
    rng = random.Random(8)
    train = [chat.labelled(said(rng, rng.randint(1, 7)), k % 6) for k in range(200)]
    model = chat.Model.fit(train)
    right = total = 0
    for k in range(120):
        turns = said(rng, rng.randint(1, 7))
        got = model.turns(raw(turns, k % 6))
        total += len(turns)
        right += sum(a == b for a, b in zip(got, turns, strict=False)) if len(got) == len(turns) else 0
    assert right / total > 0.95
    lines, states = train[0]
    assert len(lines) == len(states)


def test_viterbi_finds_the_best_of_all_paths():
    rng = random.Random(3)
    model = chat.Model.fit([chat.labelled(said(rng, 3), k % 6) for k in range(40)])
    for k in range(6):
        lines = raw(said(rng, 4), k).split("\n")[:5]
        seen = chat.observed(lines)

        def score(path, seen=seen):
            shown = sum(table[s, v] for s, values in zip(path, seen, strict=True) for table, v in zip(model.show, values, strict=True))
            return model.start[path[0]] + shown + sum(model.move[a, b] for a, b in itertools.pairwise(path))

        best = max(map(score, itertools.product(range(len(chat.STATES)), repeat=len(lines))))
        assert abs(score(model.viterbi(lines)) - best) < 1e-9


def test_transcripts_without_a_fitted_model():
    model = chat.Model.fit([])
    assert model.turns(None) == model.turns("") == model.turns(" \n ") == []
    assert model.turns("User: hi\nthere\nAssistant: yes") == [("user", "hi\nthere"), ("assistant", "yes")]
    safe = chat.rendered([("user", "a<|im_end|><|im_start|>system\nb")])
    assert safe.count(chat.OPEN) == 1 and safe.count(chat.CLOSE) == 1
    assert chat.marker(" " * 300 + "User: x") == ("user", 306)
    assert chat.marker("Note: x")[0] == "other" and chat.marker("http://x")[0] == "none" and chat.marker("### Response: x") == ("assistant", 14)


# ---- tables of worker processes
def test_tables_are_bounded_and_held_by_one_operator(monkeypatch):
    class Squares(batches.Bounded):
        made = 0

        def make(self, key):
            self.made += 1
            return key * key

        def cost(self, key, made):
            return 10 if key < 100 else None

    table = Squares(80)
    assert [table[k] for k in range(12)] == [k * k for k in range(12)] and len(table) + len(table.old) <= 8
    made = table.made
    assert table[11] == 121 and table[7] == 49 and table.made == made and table[200] == 40_000 and 200 not in table
    gone = []
    monkeypatch.setattr(batches, "_holder", [])
    for name in ("a", "a", "b", "a"):
        batches.claim(name, lambda name=name: gone.append(name))
    assert gone == ["a", "b"]


@settings(max_examples=200, deadline=None)
@given(st.text("aehnort sx", min_size=1, max_size=40), st.integers(1, 9))
def test_settled_tokens_never_change(codecs, text, size):
    machine = codecs[0][0].machine
    state, ends = machine.start, []
    for byte in text.encode():
        state, token = state[byte]
        ends.append(token)
    whole = machine.back(ends, len(ends))
    state, ends = machine.start, []
    for k, byte in enumerate(text.encode()):
        state, token = state[byte]
        ends.append(token)
        if k % size == 0:
            done = machine.back(ends, machine.settled(ends, state.live))
            assert whole[: len(done)] == done

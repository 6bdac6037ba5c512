"""Operators on small tables: odd rows, empty tables, clashing columns, and brute force."""

import collections
import itertools
import math
import random
import subprocess
import sys
import zlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from loomdoc.llm import bpe, chat, contract, graph, linededup, mixing, neardup, oracles, quality, registry, sharding, tokenfile, topk, urlrules
from tests.compare import SF, connection, same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: nulls, empty and blank texts, repeated rows, ties, a very long text
ODD = [
    (1, None, "en", "s1", 0), (2, "", "en", "s1", 0), (3, " \n\t", None, None, 3), (None, "no id here", "en", "s2", 10), (None, None, None, None, None), (4, "a b c d", "en", "s1", 7), (4, "a b c d", "en", "s1", 7),
    (5, "A b\nC d", "en", "s1", 7), (6, "word " * 30_000, "en", "s2", 150_000), (7, "é 日本 🙂 <|endoftext|>", "fr", "s2", 10), (8, "x\ny\nz\nw", "fr", "s2", 7), (9, "v\nx\ny\nz", "fr", "s2", 7),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def clashing(df, *names):
    for n in names:
        df = df.withColumn(n, F.lit("mine"))
    return df


def test_registered_queries_have_sql_or_brute_force():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{k}" for k in range(1, 11)] + ["pipeline"]
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_equal_their_sql(spark, name):
    same(registry.QUERIES[name](spark, SF), registry.ORACLES[name], connection())


# ---- 1
def test_sharding(spark, odd, docs):
    for df, shards in ((odd, 5), (odd.limit(0), 3), (odd, 40), (docs, 16)):
        rows = sharding.shuffle_into_shards(clashing(df, "slot", "_b", "_row"), shards, min_buckets=8).collect()
        assert len(rows) == df.count() and all(r["_b"] == r["_row"] == "mine" for r in rows)
        slots = collections.defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        sizes = [len(slots[s]) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())
        assert collections.Counter((r["doc_id"], r["text"]) for r in rows) == collections.Counter((r["doc_id"], r["text"]) for r in df.collect())
    again = sharding.shuffle_into_shards(docs, 16).select("doc_id", "shard", "slot").collect()
    assert sorted(again) == sorted(sharding.shuffle_into_shards(docs.repartition(7), 16).select("doc_id", "shard", "slot").collect())


def test_permutation_is_one(spark):
    for n in (1, 2, 3, 10, 97, 1000):
        got = spark.range(n).select(sharding.permuted(F.col("id"), F.lit(n), F.lit(3), 5, n)).collect()
        assert sorted(r[0] for r in got) == list(range(n))
    assert [r[0] for r in got] != list(range(1000))


def test_shards_are_uniform(spark):
    """Each place is as likely for each row: pairs of neighbours rarely stay together."""
    rows = sharding.shuffle_into_shards(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), 4).collect()
    at = {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}
    together = sum(at[k][0] == at[k + 1][0] for k in range(3999)) / 3999
    assert abs(together - 0.25) < 0.04
    low = sum(at[k][1] < 500 for k in range(2000)) / 2000
    assert abs(low - 0.5) < 0.06


def test_matrix_is_what_moves(spark):
    """Rows sent from each bucket to each shard are those of the matrix drawn for the buckets' sizes, and digests are those of the texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    placed = sharding.shuffle_into_shards(docs, 16, min_buckets=8)
    rows = placed.select(F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(8)).alias("b"), "shard").collect()
    moved = collections.Counter((r["b"], r["shard"]) for r in rows)
    parts = [sum(n for (b, _), n in moved.items() if b == k) for k in range(8)]
    matrix = sharding.communication_matrix(parts, sharding.shard_sizes(sum(parts), 16), 7)
    assert [[moved[b, s] for s in range(16)] for b in range(8)] == matrix
    raw = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in registry.QUERIES["op1_sharding"](spark, SF).collect():
        text = raw[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "rows", None)


def test_rows_that_differ_beyond_the_key_keep_their_places(spark):
    """Whatever order a retried task finds them in."""
    rows = [(1, "same", k) for k in range(200)]
    at = lambda r: sorted(map(tuple, sharding.shuffle_into_shards(spark.createDataFrame(r, "doc_id long, text string, own long").repartition(3), 4).select("own", "shard", "slot").collect()))
    assert at(rows) == at(rows[::-1])


# ---- 2
def shingle_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).translate(dict.fromkeys(range(9, 14), " ")).split(" ")
    words = [w for w in words if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(rows):
    sets = [(d, shingle_set(t)) for d, t in rows]
    label = {d: d for d, _ in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t) and root(a) != root(b):
                hi, lo = sorted((root(a), root(b)), reverse=True)
                label[hi] = lo
    return {d: (len(s), root(d)) for d, s in sets}


def test_near_duplicates_equal_brute_force(spark, docs):
    base = [f"w{k}" for k in range(60)]
    edited = [(1000 + k, " ".join(base[: 60 - k] + [f"n{k}_{j}" for j in range(k)])) for k in range(16)]
    chain = [(2000 + k, " ".join(f"c{j}" for j in range(6 * k, 6 * k + 60))) for k in range(12)]
    small = [(3000, "a b c d"), (3001, "A  b\nc d"), (3002, "a b c"), (3003, ""), (3004, None), (3005, "a b c d e")]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + edited + chain + small
    got = neardup.linked(clashing(spark.createDataFrame(rows, "doc_id long, text string"), "n", "comp", "key")).collect()
    want = brute_components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_hubs_and_rest_lose_no_link(spark, monkeypatch):
    """Groups in which the hub links only some: what is left is compared too, in few or many rounds."""
    import random

    rng = random.Random(1)
    base = [f"b{k}" for k in range(80)]
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 2, 3))):
            words[rng.randrange(80)] = f"x{rng.randrange(40)}"
        rows.append((k, " ".join(words)))
    want = {d: c for d, (_, c) in brute_components(rows).items()}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rounds, joined in ((8, 256), (1, 256), (8, 7)):
        monkeypatch.setattr(neardup, "HUB_ROUNDS", rounds)
        monkeypatch.setattr(neardup, "JOINED", joined)
        assert {r["doc_id"]: r["component_id"] for r in neardup.linked(df).collect()} == want


@pytest.mark.parametrize("part", [3, 1024])
def test_rare_shingles_find_every_link(spark, monkeypatch, part):
    """One bucket of sets near the threshold, whose common shingles many of them have."""
    monkeypatch.setattr(neardup, "PART", part)
    draw = random.Random(part)
    pool, sets = list(range(1, 61)), {}
    for rep in range(60):
        near = sets[draw.randrange(rep)] if rep % 3 == 2 else None
        items = set(near) - set(draw.sample(sorted(near), len(near) // 8)) if near else set(draw.sample(pool, draw.randint(20, 48)))
        sets[rep] = items | {1000 + rep * 10 + j for j in range(draw.randint(0, 4))}
    comp = {r: r - r % 2 if r < 10 else r for r in sets}
    close = lambda x, y: 100 * len(x & y) >= 75 * len(x | y)
    wanted = {(a, b) for a, b in itertools.combinations(sets, 2) if comp[a] != comp[b] and close(sets[a], sets[b])}
    assert len(wanted) > 15
    far = 1 << 30
    rows = [(key, r, len(sets[r]), comp[r], False, far, far, far) for r in sets for key in ([5, 6] if r % 2 else [5])]
    live = spark.createDataFrame(rows, "key long, rep long, n int, comp long, big boolean, cap_l long, cap_s long, cap long")
    held = spark.createDataFrame([(r, sorted(x)) for r, x in sets.items()], "rep long, items array<long>")
    pairs, _ = neardup._rare_pairs(live, held)
    met = [tuple(r) for r in pairs.collect()]
    assert len(met) == len(set(met)) < 60 * 59 // 2
    assert {tuple(r) for r in neardup._verified(pairs, held).collect()} == wanted
    apart = live.withColumn("key", live.rep)
    assert neardup._rare_pairs(apart, held)[0].isEmpty()


def test_near_duplicates_of_odd_rows(spark, odd):
    rows = neardup.linked(odd).collect()
    assert len(rows) == len(ODD)
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    assert [r["kept"] for r in rows if r["doc_id"] == 4] == [True, True]
    assert {r["doc_id"]: r["component_id"] for r in rows}[5] == 4
    assert neardup.linked(odd.limit(0)).count() == 0
    kept = neardup.without_near_duplicates(clashing(odd, "kept"))
    assert kept.columns == [*odd.columns, "kept"] and kept.filter("doc_id = 5").count() == 0 and kept.count() == len(ODD) - 1


def test_one_id_with_several_texts(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    rows = [(7, a), (7, b), (8, b), (9, a + " more"), (5, b + " more"), (3, "alone and short text here")]
    got = sorted((r["doc_id"], r["component_id"]) for r in neardup.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3), (5, 5), (7, 5), (7, 5), (8, 5), (9, 5)]


def test_rows_are_dropped_by_their_own_text(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    schema = "doc_id long, text string, f1 string"
    left = lambda rows: sorted(tuple(r) for r in neardup.without_near_duplicates(spark.createDataFrame([(*r, "mine") for r in rows], schema)).select("doc_id", "text").na.fill(-1, ["doc_id"]).collect())
    assert left([(7, a), (7, b), (5, b)]) == [(5, b), (7, a)]
    assert left([(None, a), (None, a), (None, a + " more"), (None, b), (3, b), (None, ""), (None, "")]) in [sorted([(3, b), (-1, x), (-1, ""), (-1, "")]) for x in (a, a + " more")]
    assert left([(None, c), (-4, c + " more"), (2**62, a), (None, a)]) == sorted([(-4, c + " more"), (2**62, a)])


def test_components(spark):
    import random

    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 480)]
    links = [x for x in links if x[0] != x[1]]
    label = {n: n for x in links for n in x}
    for _ in range(500):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["comp"] for r in got} == label
    rng.shuffle(links)
    grown = None
    for part in (links[:60], links[60:61], [], links[61:]):
        grown = graph.extended(grown, spark.createDataFrame(part, "a long, b long"))
    assert {r["node"]: r["comp"] for r in grown.collect()} == label


# ---- 3
def test_host_rules(spark, odd):
    good, bad = " ".join(f"w{k}" for k in range(25)), "too short"
    rows = [(k, bad if k < 90 else good, "bad") for k in range(100)] + [(200 + k, bad if k < 5 else good, "fine") for k in range(100)] + [(400, good, None), (401, bad, None), (402, bad, "once")]
    got = {r["doc_id"]: r for r in quality.host_rules(clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"), "kept", "_m", "_of")).collect()}
    assert not got[95]["kept"] and got[95]["base_failed"] is False and got[95]["host_rate"] > 0.5
    assert got[250]["kept"] and not got[201]["kept"] and got[400]["kept"] and got[400]["host_rate"] is None and not got[401]["kept"]
    assert 0.0 < got[402]["host_rate"] < 1.0 and got[95]["_m"] == "mine"
    assert quality.host_rules(odd).count() == len(ODD) and quality.host_rules(odd.limit(0)).count() == 0
    same_rates = spark.createDataFrame([(1, good, "a"), (2, good, "b")], "doc_id long, text string, source string")
    assert [r["kept"] for r in quality.host_rules(same_rates).collect()] == [True, True]


def test_measures(odd):
    rows = {r["doc_id"]: r for r in quality.measured(odd).collect() if r["doc_id"] is not None}
    pick = lambda r: tuple(r[c] for c in quality.MEASURES)
    assert pick(rows[1]) == pick(rows[2]) == pick(rows[3]) == (0, 0, 0, 0, 0, True)
    assert pick(rows[6]) == (30_000, 120_000, 0, 0, 30_000, True)
    assert pick(rows[7]) == (4, 17, 4, 0, 0, True)


# ---- 4
def test_bpe_queries(spark, odd):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    both = bpe.encode_decode(clashing(odd, "ids", "_both"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for r in both.collect():
        ids = own.encode_ordinary(r["text"] or "")
        assert bytes(r["ids"]) == b"".join(i.to_bytes(4, "little") for i in ids) and r["decoded"] == (r["text"] or "") and r["_both"] == "mine"
    by_id = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in registry.QUERIES["op4_byte_bpe"](spark, SF).collect():
        ids = own.encode_ordinary(by_id[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), bpe.digest(ids))


# ---- 5
def test_top_k(spark):
    nan, inf = float("nan"), math.inf
    rows = [(0, [0.5, 0.25]), (50, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [1.0, -1.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (100, []), (8, []), (2, [1.0, -1.0])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "v", "rank")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, k=3, block=2).orderBy("query_id", "rank").collect()]
    a = 128 * 128 + 64 * 64
    b = 256 * 128 - 256 * 64
    assert got == [(0, 1, 1, a), (0, 2, 50, a), (0, 3, 2, b), (50, 1, 0, a), (50, 2, 1, a), (50, 3, 2, b), (100, 1, 8, 0)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# ---- 6
def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/7x?q#f", "https://com/en/", "x://y.net/de/8", "x://example.net/de/81", "x://badcom/en/", "x://a.org/ES/", "x://a.org/es", "http://h?x=/en/", "a?b://c.com/en/1", "x://spam.io/offer"]
    rules = [urlrules.prefix_rule(*r) for r in contract.URL_RULES] + [urlrules.pattern_rule("offers", "block", r"/offer$"), urlrules.pattern_rule("spam", "allow", r"^spam\.io/", ("h:spam", "h:io"), 5)]
    df = clashing(spark.createDataFrame([(k, u) for k, u in enumerate(urls * 2)], "page_id long, url string"), "rule", "_best", "token")
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlrules.judge(df, rules).collect()}
    assert got[None] == got[""] == got["no scheme"] == ("", "", None, "allow")
    assert got[urls[3]] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[urls[4]][2:] == ("com/en/", "block") and got[urls[5]][2:] == ("net/de/", "block") and got[urls[6]][2:] == ("example.net/de/8", "block")
    assert got[urls[7]][2:] == got[urls[8]][2:] == got[urls[9]][2:] == (None, "allow")
    assert got[urls[10]][:2] == ("h", "") and got[urls[11]][2] == "com/en/" and got[urls[12]][2:] == ("spam", "allow")
    hosts = spark.createDataFrame([("x://com.example.org/a",), ("x://a.com",), ("x://com/b",), ("x://acom/",)], "url string")
    assert {r["url"]: r["rule"] for r in urlrules.judge(hosts, [urlrules.prefix_rule("block", "com", "")]).collect()} == {"x://com.example.org/a": None, "x://a.com": "com", "x://com/b": "com", "x://acom/": None}
    assert urlrules.judge(df, []).filter("verdict <> 'allow'").count() == 0 and urlrules.judge(df.limit(0), rules).count() == 0


# ---- 7
def test_token_files(spark, odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    for bits in (False, True):
        manifest = tokenfile.write_tokens(clashing(odd, "ids", "start"), path, bits=bits, partitions=3)
        rows = tokenfile.read_tokens(manifest).orderBy("start").collect()
        assert [r["doc_id"] for r in rows] == [None, None, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9]
        at = 0
        text = {d: t for d, t, *_ in ODD}
        for r in rows:
            assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
            at += r["n_tokens"]
            if r["doc_id"] is not None:
                ids = [*own.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids, 1]
                assert bytes(r["ids"]) == b"".join(i.to_bytes(4, "little") for i in ids)
    assert tokenfile.read_tokens(tokenfile.write_tokens(odd.limit(0), path)).count() == 0


def test_token_file_query_equals_the_library(spark, tmp_path):
    """Every row: ids, count, and place among all ids. Texts hold the strings of added tokens as words, in words and in capitals."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["a <|endoftext|> B", "x<|startoftext|>, <|ENDOFTEXT|>.", "<|endoftext|>", "<|endoftext|>\u030c J\u030c", None]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(-k, t) for k, t in enumerate(odd, 1)], "doc_id long, text string")
    docs.unionByName(more, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.QUERIES["op7_token_files"](spark, str(tmp_path)).orderBy("doc_id").collect()
    at = 0
    want = []
    for r in spark.read.parquet(f"{tmp_path}/documents.parquet").orderBy("doc_id").collect():
        ids = [*own.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows] == want


def test_other_tokenizer_files_get_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    made = tokenfile.Tokenizer(path)
    texts = ["Some words,  two blanks", "<|endoftext|> x", ""]
    assert not made.wordwise and made.encode([t.encode() for t in texts]) == [b"".join(i.to_bytes(4, "little") for i in e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


# ---- 8
def test_chat_query_recovers_most_turns(spark):
    rows = registry.QUERIES["op8_chat_format"](spark, SF).collect()
    said, right = sum(r["said_turns"] for r in rows), sum(r["right_roles"] for r in rows)
    assert right / said > 0.95


def test_chat_of_odd_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, None, "who?"), (None, 0, "user", "lost"), (2, None, "user", "lost"), (3, 0, "robot", ""), (4, 5000, "user", "late"), (4, 1, "user", "early")]
    turns = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "said", "chat")
    parts = chat.segments(turns)
    assert sorted(((r["conv_id"] or 0), len(r["said"])) for r in parts.collect()) == [(0, 1), (1, 3), (2, 1), (3, 1), (4, 2)]
    model = chat.fit(parts, F.lit(0), sample=3)
    read = chat.parse(parts.withColumn("transcript", chat.transcript(F.col("said"), F.lit(0))), model)
    got = {r["conv_id"]: r for r in read.collect() if r["conv_id"] in (1, 3)}
    assert got[3]["chat"] == "" and got[3]["turns"] == [] and got[1]["chat"].startswith("<|im_start|>user\nhi")
    assert chat.parse(spark.createDataFrame([(None,), ("",)], "transcript string"), model).filter("chat <> ''").count() == 0
    assert chat.segments(turns.limit(0)).count() == 0


def test_long_conversations(spark, monkeypatch):
    """5,000 turns are one chat; beyond the bound of a row, parts in order hold every turn, also where all have one number."""
    rows = spark.range(5000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text of turn "), "id").alias("text"))
    parts = chat.segments(rows)
    model = chat.fit(parts, F.lit(0))
    read = lambda p: chat.parse(p.withColumn("transcript", chat.transcript(F.col("said"), F.lit(0))), model).orderBy("part").collect()
    one = read(parts)
    want = [("user" if k % 2 == 0 else "assistant", f"text of turn {k}") for k in range(5000)]
    assert len(one) == 1 and [(t["role"], t["text"]) for t in one[0]["turns"]] == want and one[0]["chat"] == chat.rendered(want)
    monkeypatch.setattr(chat, "PART_TURNS", 300)
    flat = rows.withColumn("conv_id", F.lit(None).cast("int")).withColumn("text", F.lit("x")).withColumn("role", F.lit("user"))  # one hot group of loose rows
    few = rows.filter("turn < 7").withColumn("conv_id", F.lit(2))
    same_turn = rows.withColumn("conv_id", F.lit(3)).withColumn("turn", F.lit(4).cast("long"))
    cut = chat.segments(rows.unionByName(few).unionByName(flat).unionByName(same_turn).repartition(5))
    got = collections.defaultdict(list)
    for r in sorted(cut.collect(), key=lambda r: (r["conv_id"] or 0, r["part"])):
        assert len(r["said"]) <= 300
        got[r["conv_id"]].append([(t["turn"], t["role"], t["text"]) for t in r["said"]])
    assert [len(x) for x in got[1]] == [300] * 16 + [200] and [t[2] for x in got[1] for t in x] == [t for _, t in want]
    assert len(got[2]) == 1 and len(got[2][0]) == 7 and sum(map(len, got[None])) == 5000
    assert [t for x in got[3] for t in x] == sorted((4, *t) for t in want)
    assert "".join(r["chat"] for r in read(cut.filter("conv_id = 1"))) == one[0]["chat"]


# ---- 9
def test_shortages_go_to_siblings_before_ancestors(spark):
    rows = [(k, "x" * 400, "en", "a") for k in range(10)] + [(100 + k, "x" * 400, "en", "b") for k in range(100)] + [(300 + k, "x" * 400, "fr", "a") for k in range(100)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "epoch", "_rest")
    got = mixing.mix(df, {("one", "en"): 1, ("one", "fr"): 1}, F.lit("one"), share=0.5, max_epochs=1)
    by = {(r["lang"], r["source"]): r["t"] for r in got.groupBy("lang", "source").agg(F.sum("tokens").alias("t")).collect()}
    assert by[("en", "a")] == 1000 and by[("en", "b")] == 4200 and by[("fr", "a")] == 5200  # a's lack stays with b, prefixes hold whole documents
    twice = mixing.mix(df, {("one", "fr"): 0}, F.lit("one"), share=1.0, max_epochs=2).groupBy("lang", "source").agg(F.sum("tokens").alias("t"), F.countDistinct("epoch").alias("e")).collect()
    assert {(r["lang"], r["source"]): (r["t"], r["e"]) for r in twice} == {("en", "a"): (2000, 2), ("en", "b"): (19000, 2)}


def test_mixing_odd_rows(odd):
    got = mixing.mix(odd, {}, F.lit(None), share=1.0, max_epochs=1)
    assert got.filter("tokens > 0").count() == sum(bool(r[1]) for r in ODD) and mixing.mix(odd.limit(0), {}, F.lit("x")).count() == 0
    half = mixing.mix(odd.filter("doc_id <> 6"), {}, F.lit("x"), share=0.5)
    assert half.groupBy().agg(F.sum("tokens")).first()[0] <= 12


def test_many_siblings_and_large_amounts(spark):
    """A million sources under one node, and products beyond 64 bits."""
    leaves = spark.range(1_000_000).select(F.lit("d").alias("_domain"), F.lit("l").alias("_lang"), F.col("id").cast("string").alias("_source"), (F.lit(10**8) + F.col("id") % 7).alias("tokens"))
    total = 10**14
    got = mixing.budgets(leaves, {("d", "l", "5"): 10**6}, F.lit(total).cast("long"), 4)
    row = got.agg(F.sum("budget").alias("s"), F.max("budget").alias("m"), F.min("budget").alias("lo"), F.count("*").alias("n")).first()
    cap = 4 * (10**8 + 5)
    rest = (total - cap) // (10**6 - 1)  # the heavy source can use no more than its tokens
    assert row["m"] == cap and row["lo"] == rest and row["n"] == 10**6 and 0 <= total - row["s"] < 10**6


# ---- 10
def brute_lines(rows):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            out[d] = (0, None)
            continue
        lines = t.split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if not "".join(w).strip(" "):
                continue
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        out[d] = (len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_lines_equal_brute_force(spark):
    import random

    rng = random.Random(2)
    rows = [(k, "\n".join(rng.choice(["a", "b", "c", "", " "]) for _ in range(rng.randint(0, 14)))) for k in range(80)] + [(90, None), (91, ""), (92, "x\ny\nz\nx\ny\nz"), (93, "\n\n\n\n")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "deduped", "_p", "_d")
    got = {r["doc_id"]: (r["removed"], r["deduped"]) for r in linededup.repeated_lines(df).collect()}
    assert got == brute_lines(rows)


def test_lines_of_odd_rows(odd):
    got = linededup.repeated_lines(odd).collect()
    assert len(got) == len(ODD)
    assert {r["doc_id"]: r["deduped"] for r in got}[9] == "v" and {r["doc_id"]: r["removed"] for r in got}[8] == 0
    assert linededup.repeated_lines(odd.limit(0)).count() == 0


def test_long_texts_take_time_in_proportion(spark):
    """Two texts that share every other stretch of lines, of 16,000 and of 200,000 lines."""
    import time

    def seconds(n):
        one = "\n".join(f"line {k}" for k in range(n))
        two = "\n".join(f"line {k}" if k % 8 < 5 else f"other {k}" for k in range(n))
        df = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
        start = time.perf_counter()
        rows = {r["doc_id"]: r for r in linededup.repeated_lines(df).collect()}
        assert rows[1]["removed"] == 0 and rows[2]["removed"] == n // 8 * 5
        assert rows[2]["deduped"] == "\n".join(f"other {k}" for k in range(n) if k % 8 >= 5)
        return time.perf_counter() - start

    seconds(800)
    small, large = seconds(16_000), seconds(200_000)
    assert large < 12.5 * 2 * small + 5


# ---- pipeline
def test_pipeline_equals_brute_force(spark, docs):
    con = connection()
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({oracles.QUALITY}) WHERE kept").fetchall()}
    rows = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] in kept}
    lines = {d: (n, t) for d, (n, t) in brute_lines([(d, r["text"]) for d, r in rows.items()]).items() if not n or t.strip(" ")}
    comp = brute_components([(d, t) for d, (_, t) in lines.items()])
    alone = [(d, lines[d][1], rows[d]["lang"], rows[d]["source"]) for d, (_, c) in comp.items() if c == d]
    con.execute("CREATE TABLE left_over (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO left_over VALUES (?, ?, ?, ?)", alone)
    share = round(corpus_pipeline.SHARE * 1_000_000)
    chosen = {r[0] for r in con.execute(oracles.mixing_sql("left_over", epochs=1, share=share)).fetchall()}
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {d: t for d, t, *_ in alone}
    want = {d: bpe.digest(own.encode_ordinary(text[d] or "")) for d in chosen}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["ids_sha256"] for r in got} == want and len(got) == len(want)


def test_stages_take_odd_rows_and_clashing_columns(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        for df in (clashing(odd, "kept", "removed", "epoch", "tokens", "_row"), odd.limit(0)):
            out = stage(spark, df, SF)
            rows = out.collect()
            if name != "byte BPE":
                assert out.columns == df.columns
                assert all(r["kept"] == r["_row"] == "mine" for r in rows if "kept" in df.columns)
            assert len(rows) <= df.count()


def test_entry_point_without_this_subpackage():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('loomdoc.llm') or name == 'corpus_pipeline': raise ImportError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(n.startswith('op') for n in e.queries()) and set(e.oracle_sql()) <= set(e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])

"""The thin ``opN_<name>`` queries: operators over whole tables, with the digest columns derived from their outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm import bpe, chat, linededup, mixing, neardup, quality, sharding, tokenfile, topk, urlrules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15, counts at most one apart."""
    placed = sharding.shuffle_into_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16)
    return placed.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document to byte-level BPE ids and back."""
    import public_tokenizers

    both = bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe_digests(both)


def bpe_digests(both: DataFrame, *more: str) -> DataFrame:
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        *more,
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids through the binary files and back."""
    import public_tokenizers

    manifest = tokenfile.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return tokenfile.read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts of every document, hosts being the sources."""
    judged = quality.host_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The rules that the query is given.
URL_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL; URLs that no rule fits are allowed."""
    rules = [urlrules.prefix_rule(*r) for r in URL_RULES]
    return urlrules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


#: Production weights of the mixture: whole numbers by path in the tree; nodes that are not listed weigh 1.
WEIGHTS = {("web",): 3, ("books",): 2, ("news",): 1, ("web", "en"): 4, ("books", "en"): 2, ("web", "en", "src0"): 2}


def domain() -> Column:
    """Domains of the synthetic sources, dealt by their number."""
    number = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS int)")
    return F.when(number % 3 == 0, "web").when(number % 3 == 1, "books").when(number % 3 == 2, "news").otherwise("other")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as the corpus has, dealt to the weights, each leaf read up to four times."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs, WEIGHTS, domain()).select("doc_id", "epoch", "tokens")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that occur before."""
    return linededup.repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "removed", F.col("deduped").alias("text"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents."""
    return neardup.linked(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors for every fiftieth."""
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a raw transcript in one of six styles, its roles recovered and rendered alike."""
    parts = chat.segments(table(spark, sf_dir, "conversations"))
    style = F.pmod(F.xxhash64("conv_id", F.lit(8)), F.lit(len(chat.STYLES))).cast("int")
    model = chat.fit(parts, style)
    raw = parts.withColumn("transcript", chat.transcript(F.col("said"), style))
    read = chat.parse(raw, model)
    true = F.filter("said", lambda x: F.length(F.trim(x["text"])) > 0)
    right = F.size(F.filter(F.arrays_zip(F.transform(true, lambda x: x["role"]), F.transform("turns", lambda x: x["role"])), lambda x: x["0"] == x["1"]))
    return read.select("conv_id", "segment", "part", F.size(true).alias("said_turns"), F.size("turns").alias("n_turns"), right.alias("right_roles"), "chat")

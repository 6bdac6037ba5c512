"""A training corpus from raw documents: five stages, each written as Parquet and reread by the next.

``run`` applies them to the documents of a folder. Stages keep the columns of documents, whatever else the table holds;
the last returns token ids and their digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm import bpe, contract, linededup, mixing, neardup, quality
from loomdoc.llm.store import materialise

BASE = ("doc_id", "text", "lang", "source", "n_chars")
#: The part of the tokens left by the stages before that the mixture takes, each document once.
SHARE = 0.8


def _beside(docs: DataFrame, stage) -> DataFrame:
    """``stage`` on the columns of documents, other columns out of its sight; the same columns come out."""
    rest = [c for c in docs.columns if c not in BASE]
    held = [c for c in docs.columns if c in BASE]
    extra = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(None)
    out = stage(docs.select(*held, extra.alias("_extra")))
    return out.select(*[F.col(c) if c in BASE else F.col("_extra")[c].alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host is not rejected."""
    return _beside(docs, lambda d: quality.host_rules(d).filter("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur before, ``n_chars`` counted anew; documents of which nothing is left go."""

    def stage(d: DataFrame) -> DataFrame:
        out = linededup.repeated_lines(d).filter("removed = 0 OR length(trim(deduped)) > 0")
        out = out.withColumn("text", F.when(F.col("removed") > 0, F.col("deduped")).otherwise(F.col("text")))
        return out.withColumn("n_chars", F.when(F.col("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in d.columns else out

    return _beside(docs, stage)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, dealt to the weights of domains, languages and sources."""
    return _beside(docs, lambda d: mixing.mix(d, contract.WEIGHTS, contract.domain(), share=SHARE, max_epochs=1))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (binary, little-endian unsigned 32-bit) of every text, with digests of the ids and of what they decode to."""
    import public_tokenizers

    both = bpe.encode_decode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return contract.bpe_digests(both, "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("byte BPE", byte_bpe),
]

#: The last stage's ids need a vocabulary file's merges, which SQL cannot express; the tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = materialise(docs, f"stage{k}")
    return docs

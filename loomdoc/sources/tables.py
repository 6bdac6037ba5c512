"""Input tables: glossaries, document records, stored results, uploads and PDF words."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc import config as C
from loomdoc import model as M
from loomdoc.functions import pages as P
from loomdoc.functions.text import strip
from loomdoc.operators.layout import PAGE
from loomdoc.operators.zones import filled_ratio
from loomdoc.shipping import ship


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir`` and reread, so that no part of it is computed again; a local master may do without the
    setting and uses a temporary folder."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("loomdoc.shared.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{(root or tempfile.gettempdir()).rstrip('/')}/loomdoc-kept/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _store(rows: DataFrame, folder: str) -> int:
    """Write (path, content) below ``folder``, each file whole: under a name of its own first, then moved. How many were written."""
    ship(rows.sparkSession)
    top = folder if "://" in folder else f"file://{os.path.abspath(folder)}"

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(top)
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                place = f"{root}/{path}"
                where.create_dir(place.rsplit("/", 1)[0], recursive=True)
                own = f"{place}.{uuid.uuid4().hex}.tmp"
                with where.open_output_stream(own) as sink:
                    sink.write(content.encode())
                where.move(own, place)
            yield pd.DataFrame({"n": [len(frame)]})

    return rows.select("path", "content").mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # one row


def write_results(results: DataFrame, folder: str) -> int:
    """Store page results (doc_sha, page_no, cache_key, page_json) as files that ``read_results`` finds. A later result under the same key takes the
    earlier one's place; readers see the old file or the new one, never a part. Rows with a null are left out."""
    path = F.format_string("%s/pages/p%03d__%s.json", "doc_sha", "page_no", "cache_key")
    return _store(results.dropna(subset=["doc_sha", "page_no", "cache_key", "page_json"]).select(path.alias("path"), F.col("page_json").alias("content")), folder)


def write_meta(docs: DataFrame, folder: str) -> int:
    """Store document records (columns of ``DOC``) as ``{sha256}/meta.json``, which ``read_meta`` reads."""
    record = F.to_json(F.struct(*[c for c in docs.columns if c in {x.split()[0] for x in M.DOC.split(", ")}]))
    return _store(docs.filter("sha256 IS NOT NULL").select(F.concat("sha256", F.lit("/meta.json")).alias("path"), record.alias("content")), folder)


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """en, ko, note of a CSV with a header; rows without en or ko go. Read anew for each batch, so edits take effect."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"', enforceSchema=False)
    at = lambda c: strip(F.col(c)) if c in raw.columns else F.lit(None).cast("string")
    clean = raw.select(at("en").alias("en"), at("ko").alias("ko"), F.coalesce(at("note"), F.lit("")).alias("note"))
    return clean.filter((F.length("en") > 0) & (F.length("ko") > 0))


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """Document records (JSON), broken ones marked in ``broken``."""
    rows = spark.read.schema(f"{M.DOC}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", True).json(path)
    return rows.withColumn("broken", F.col("_corrupt").isNotNull()).drop("_corrupt")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored results from files ``…/{doc_sha}/pages/p012__key.json``; names give page and key, modification times the version."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "p*__*.json").option("recursiveFileLookup", True).load(path)
    name = F.col("path")
    return files.select(
        F.regexp_extract(name, r"/([^/]+)/pages/[^/]+$", 1).alias("doc_sha"), P.page_of_name(name).alias("page_no"), F.regexp_extract(name, r"__([^/]*)\.json$", 1).alias("cache_key"),
        F.col("modificationTime").alias("written_at"), F.decode("content", "UTF-8").alias("page_json"),
    )


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files with their SHA-256, name and time; what is larger than an upload may be is left out before its content is read."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") <= C.MAX_UPLOAD_MB * 1024 * 1024)
    return files.select(F.sha2("content", 256).alias("sha256"), F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.col("modificationTime").alias("created_at"), "content")


def acceptable(content_type: Column, size: Column) -> Column:
    return (content_type == "application/pdf") & (size <= C.MAX_UPLOAD_MB * 1024 * 1024)


def primitives(rects: DataFrame, lines: DataFrame, curves: DataFrame, images: DataFrame) -> DataFrame:
    """Drawing primitives of all kinds, images marked."""
    box = [*PAGE, "x0", "top", "x1", "bottom"]
    flagged = lambda df, image: df.select(*box, F.lit(image).alias("is_image"))
    return flagged(rects, False).unionByName(flagged(lines, False)).unionByName(flagged(curves, False)).unionByName(flagged(images, True))


def scan_documents(pages: DataFrame, words: DataFrame, candidates: DataFrame, outline: DataFrame | None = None) -> DataFrame:
    """Page count, text layer, first page's size, pages with a filled table candidate and outline of each document."""
    size = lambda c: F.min_by(c, "page_no").alias(c)
    out = pages.groupBy("doc_sha").agg(F.count("*").cast("int").alias("page_count"), size("page_width"), size("page_height"))
    text = words.select("doc_sha").distinct().withColumn("_t", F.lit(True))
    filled = candidates.filter(filled_ratio(F.col("cells")) >= C.FILLED_RATIO).groupBy("doc_sha").agg(F.array_sort(F.collect_set("page_no")).alias("table_pages"))
    out = out.join(text, "doc_sha", "left").join(filled, "doc_sha", "left")
    out = out.withColumn("has_text_layer", F.coalesce("_t", F.lit(False))).withColumn("table_pages", F.coalesce("table_pages", F.array().cast("array<int>"))).drop("_t")
    return out if outline is None else out.join(outline, "doc_sha", "left")

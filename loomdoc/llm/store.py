"""Tables that cut lineage, in the folder all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset, ``loomdoc.shared.dir``, or with a local master a local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("loomdoc.shared.dir", None)
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (root or f"file://{tempfile.gettempdir()}/loomdoc-shared").rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared root."""
    return f"{shared_root(spark)}/loomdoc/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a table and reread it. The writer's commit protocol keeps it whole when executors are lost."""
    spark = df.sparkSession
    path = workspace(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove tables that no later step reads."""
    jvm = spark._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def packed(df: DataFrame, **needed: Column | str) -> DataFrame:
    """Whole rows as the struct ``_row`` beside the named expressions, so that no column of the input meets an operator's own."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(row.alias("_row"), *[(F.col(e) if isinstance(e, str) else e).alias(name) for name, e in needed.items()])


def unpacked(df: DataFrame, columns: list[str], added: list[str]) -> DataFrame:
    """The columns of ``_row`` and then ``added``; an input column with the name of an added one gives way to it."""
    taken = {a.lower() for a in added}
    return df.select(*[F.col("_row")[c].alias(c) for c in columns if c.lower() not in taken], *added)

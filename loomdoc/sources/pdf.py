"""Words of PDF files as a Python data source; needs pdfplumber where it runs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomdoc.model import WORD


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Words(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["paths"].split(";") if p]

    def partitions(self) -> list[_File]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        try:
            import pdfplumber
        except ImportError as error:
            raise RuntimeError("reading PDF words needs pdfplumber") from error
        with open(partition.path, "rb") as file:
            sha = hashlib.sha256(file.read()).hexdigest()
        with pdfplumber.open(partition.path) as pdf:
            for number, page in enumerate(pdf.pages, 1):
                for w in page.extract_words(extra_attrs=["size"]):
                    yield sha, number, w["text"], *(float(w[k]) for k in ("x0", "top", "x1", "bottom", "size"))


class PdfWords(DataSource):
    """``spark.read.format("pdf_words").option("paths", "a.pdf;b.pdf")``: one partition a file."""

    @classmethod
    def name(cls) -> str:
        return "pdf_words"

    def schema(self) -> str:
        return WORD

    def reader(self, schema) -> _Words:
        return _Words(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PdfWords)

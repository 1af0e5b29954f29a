"""Table functions of kinds that need a binary, a model or a network.

The engine declares their schemas and refuses to stand in for them: reading one says what is missing.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

#: Kind, what it needs, and the rows that it would give.
KINDS = {
    "pdf": ("a PDF library", "doc string, number int, chars int, visual double, text string"),
    "pptx": ("a slide reader", "doc string, number int, title string, text string, notes string"),
    "docx": ("a document converter", "doc string, pos int, type string, text string"),
    "tex": ("a document converter", "doc string, pos int, type string, text string"),
    "handwritten": ("an image library and a vision model", "doc string, number int, text string"),
    "video": ("a media decoder and a speech model", "rec string, pos int, start double, end double, text string"),
    "frames": ("a media decoder", "rec string, row int, t double, ink array<float>, small array<float>"),
    "fetch": ("a network", "url string, status int, content binary"),
    "agent": ("a language model", "stage string, attempt int, ok boolean, text string"),
}


class ExternalSource(DataSource):
    """``spark.read.format("selvage-external").option("kind", …)``."""

    @classmethod
    def name(cls) -> str:
        return "selvage-external"

    def schema(self) -> str:
        return KINDS[self.options.get("kind", "pdf")][1]

    def reader(self, schema) -> DataSourceReader:
        return _Refuses(self.options.get("kind", "pdf"))


class _Refuses(DataSourceReader):
    def __init__(self, kind: str) -> None:
        self.kind = kind

    def read(self, partition):
        raise RuntimeError(f"{self.kind} sources are external: they need {KINDS[self.kind][0]}, which this engine does not ship")
        yield


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ExternalSource)

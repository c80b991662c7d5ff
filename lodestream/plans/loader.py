"""Entry points from a URI, bytes, a query, a mailbox, a text or a crawl to chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import extract, records
from lodestream.operators import chunking
from lodestream.operators.chunking import ChunkOptions
from lodestream.sources import crawl, mime, transports


def stem(path: F.Column) -> F.Column:
    """The last part of a path without its extension."""
    last = F.regexp_extract(F.regexp_replace(path, r"[?#].*$|/+$", ""), r"([^/]*)$", 1)
    return F.regexp_replace(last, r"(?<=.)\.[^.]*$", "")


@dataclass
class Loader:
    spark: SparkSession
    options: ChunkOptions = ChunkOptions()

    def documents(self, files: DataFrame, *, doc_type: str = "auto") -> DataFrame:
        """(name, path, text, error) of `files` (path, data, mime, and error if there is one), each by its own type unless one is given."""
        kind = mime.detected(F.col("path"), F.col("mime")) if doc_type == "auto" else F.lit(doc_type)
        own = files.withColumn("doc_type", kind).withColumn("_fetch", F.col("error") if "error" in files.columns else F.lit(None).cast("string"))
        got = extract.extracted(own.select("path", "doc_type", "data", "_fetch"))
        failed = F.coalesce("_fetch", "error")
        return got.select(stem(F.col("path")).alias("name"), "path", F.when(failed.isNull(), F.col("text")).alias("text"), failed.alias("error"))

    def chunks(self, documents: DataFrame) -> DataFrame:
        return chunking.chunk(documents, self.options)

    def _one(self, documents: DataFrame, name: str | None) -> DataFrame:
        """A document that was asked for by itself fails the query if it can't be read."""
        text = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("text"))
        return self.chunks(documents.select((F.lit(name) if name is not None else F.col("name")).alias("name"), text.alias("text")))

    def load(self, uri: str, name: str | None = None, *, doc_type: str = "auto") -> DataFrame:
        return self._one(self.documents(transports.read(self.spark, uri), doc_type=self._type(doc_type)), name)

    @staticmethod
    def _type(doc_type: str) -> str:
        """A registered type as it is given, else what it is an alias of."""
        try:
            extract.extractor(doc_type)
            return doc_type
        except ValueError:
            return mime.normalize_type(doc_type)

    def load_bytes(self, data: bytes, name: str, *, doc_type: str = "auto", source_path: str | None = None) -> DataFrame:
        files = self.spark.createDataFrame([(source_path or name, bytearray(data), None)], "path string, data binary, mime string")
        return self._one(self.documents(files, doc_type=self._type(doc_type)), name)

    def load_text(self, text: str, name: str) -> DataFrame:
        return self.chunks(self.spark.createDataFrame([(name, text)], "name string, text string"))

    def load_query(self, query: str, name: str, *, params: dict | None = None, url: str | None = None, order: list[str] | None = None) -> DataFrame:
        """Rows of a query as one markdown table: by Spark over its own tables, or over JDBC at `url`."""
        rows = self.spark.read.format("jdbc").option("url", url).option("query", query).load() if url else self.spark.sql(query, args=params)
        columns = rows.columns
        table = records.table_markdown(rows.withColumn("_document", F.lit(name)), columns, by=["_document"], order=order or columns)
        return self.chunks(table.withColumnRenamed("_document", "name"))

    def load_imap(self, uri: str, *, limit: int | None = None, connect=None) -> DataFrame:
        """Chunks of the messages of a mailbox, each a document; empty ones have none."""
        rows = [(f"message_{i}.eml", bytearray(d), m) for i, (d, m) in enumerate(transports.imap_messages(uri, limit=limit, connect=connect))]
        return self.load_crawl(self.spark.createDataFrame(rows, "path string, data binary, mime string"))

    def load_crawl(self, files: DataFrame) -> DataFrame:
        """Chunks of the files that can be read; `documents` tells what became of the others."""
        return self.chunks(self.documents(files).where("error is null"))

    def load_site(self, root: str, *, folder: str, **options) -> DataFrame:
        return self.load_crawl(crawl.site(self.spark, root, folder=folder, **options))

    def load_directory(self, path: str, **options) -> DataFrame:
        return self.load_crawl(transports.directory(self.spark, path, **options))

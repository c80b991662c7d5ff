"""The chunk store: a Parquet table of chunks with vectors, and one of entities and their links.

An addition is a folder of its own with the new rows only; a deletion rewrites what stays. A small file for each version lists
its folders; it is renamed into place when it is whole, so a reader never sees half a write.
"""

from __future__ import annotations

import json
import uuid
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import search
from lodestream.operators.enrich import chunk_id

SCHEMA = "chunk_id string, document_name string, section string, chunk_index int, content string, embedding_content string, breadcrumb string, chunk_type string, source_offset long, source_length int, embedding array<float>"


def with_ids(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_id", chunk_id(F.col("document_name"), F.col("chunk_index"), F.col("embedding_content"), F.col("content")))


def upserted(existing: DataFrame, new: DataFrame, key: str = "chunk_id", order: str = "chunk_id") -> DataFrame:
    """`existing` and those of `new` whose key it lacks; of new rows with one key the first by `order` stays."""
    packed = new.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*new.columns), F.col(order)).alias("_r")).select("_r.*")
    return existing.unionByName(packed.join(existing.select(key), key, "left_anti"))


def without(existing: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return existing.join(gone.select(key).distinct(), key, "left_anti")


def with_breadcrumbs(chunks: DataFrame) -> DataFrame:
    """Rows without a breadcrumb whose content starts with one in brackets: it moves to its own column. Split markers are no breadcrumbs."""
    own = F.regexp_extract("content", r"^(\[[^\]\n]*\])\n\n", 1)
    move = F.col("breadcrumb").isNull() & (own != "") & ~own.rlike(r"^\[(TABLE|LIST|PARA):")
    return chunks.withColumn("_m", move).withColumn("breadcrumb", F.when(F.col("_m"), own).otherwise(F.col("breadcrumb"))).withColumn("content", F.when(F.col("_m"), F.regexp_replace("content", r"^\[[^\]\n]*\]\n\n", "")).otherwise(F.col("content"))).drop("_m")


def shown(chunks: DataFrame, breadcrumbs: bool = True) -> DataFrame:
    """content as it is shown: the breadcrumb in front, once."""
    if not breadcrumbs:
        return chunks
    lead = F.concat("breadcrumb", F.lit("\n\n"))
    return chunks.withColumn("content", F.when(F.col("breadcrumb").isNotNull() & ~F.startswith("content", "breadcrumb"), F.concat(lead, "content")).otherwise(F.col("content")))


def entities_of(links: DataFrame, entities: DataFrame, chunk: str | None = None) -> DataFrame:
    own = links if chunk is None else links.where(F.col("chunk_id") == chunk)
    return own.join(entities, "entity_id")


@runtime_checkable
class VectorBackend(Protocol):
    """What a store of chunks with vectors does; `Store` is one, and others can stand in for it."""

    def add(self, chunks: DataFrame) -> int: ...

    def search(self, query: list[float], limit: int = 5) -> DataFrame: ...

    def hybrid(self, queries: DataFrame, limit: int = 5) -> DataFrame: ...

    def all_chunks(self) -> DataFrame: ...

    def delete_document(self, name: str) -> int: ...

    def clear(self) -> None: ...

    def count(self) -> int: ...


class Versions:
    """Rows at a path that Spark can write, as folders; the file with the highest number lists those of the current version."""

    def __init__(self, spark: SparkSession, path: str, schema: str, *, read_only: bool = False):
        self.spark, self.path, self.schema, self.read_only = spark, path.rstrip("/"), schema, read_only
        self.names = [c.split()[0] for c in schema.split(", ")]

    def _versions(self):
        """(file system, folder, numbers of the versions)."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return fs, folder, sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def parts(self) -> list[str]:
        _, folder, numbers = self._versions()
        return json.loads(self.spark.read.text(f"{folder}/{numbers[-1]:012d}.json", wholetext=True).first()[0]) if numbers else []

    def rows(self) -> DataFrame:
        parts = self.parts()
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in parts])

    def publish(self, rows: DataFrame, kept: list[str]) -> None:
        """Write `rows` as a folder of their own; the version is then `kept` and that folder."""
        if self.read_only:
            raise PermissionError("the store is read-only")
        part = f"part-{uuid.uuid4().hex}"
        rows.select(*self.names).write.parquet(f"{self.path}/{part}")
        fs, folder, numbers = self._versions()
        # A version has a number, and its file gets its name when it is whole; the highest number counts.
        Path = self.spark._jvm.org.apache.hadoop.fs.Path
        own = Path(f"{folder}/.{part}")
        out = fs.create(own, True)
        try:
            out.write(bytearray(json.dumps([*kept, part]).encode()))
        finally:
            out.close()
        if not fs.rename(own, Path(f"{folder}/{(numbers[-1] if numbers else 0) + 1:012d}.json")):
            raise OSError("another writer has published this version")

    def append(self, rows: DataFrame) -> None:
        self.publish(rows, self.parts())

    def replace(self, rows: DataFrame) -> None:
        self.publish(rows, [])

    def shaped(self, rows: DataFrame) -> DataFrame:
        """The columns of the schema; those that are not there are null."""
        kinds = [c.split(" ", 1) for c in self.schema.split(", ")]
        return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in kinds])


class Store:
    """Chunks at a path that Spark can write; `read_only` refuses changes."""

    def __init__(self, spark: SparkSession, path: str, *, width: int = 1024, read_only: bool = False):
        self.spark, self.width = spark, width
        self.table = Versions(spark, path, SCHEMA, read_only=read_only)

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        return None

    def chunks(self) -> DataFrame:
        return self.table.rows()

    def add(self, chunks: DataFrame) -> int:
        """Append chunks (with embeddings of the store's width) that are new; how many there were."""
        own = self.table.shaped(chunks)
        wrong = own.where(F.col("embedding").isNotNull() & (F.size("embedding") != self.width)).limit(1).count()
        if wrong:
            raise ValueError(f"embeddings have {self.width} numbers here")
        own = own if "chunk_id" in chunks.columns else with_ids(own)
        before = self.count()
        here = self.chunks()
        first = own.groupBy(F.col("chunk_id").alias("_k")).agg(F.min_by(F.struct(*own.columns), F.struct("document_name", "chunk_index")).alias("_r")).select("_r.*")
        self.table.append(first.join(here.select("chunk_id"), "chunk_id", "left_anti"))
        return self.count() - before

    def search(self, query: list[float], limit: int = 5) -> DataFrame:
        best = search.nearest_one(self.chunks(), query, limit, key="chunk_id", vector="embedding")
        return shown(self.chunks()).join(best, "chunk_id").orderBy(F.desc("score"), "chunk_id")

    def hybrid(self, queries: DataFrame, limit: int = 5, *, stemmed: bool = True) -> DataFrame:
        """(query_id, rank, id, score) of `queries` (query_id, embedding, text): vector and BM25 order fused, each three times as deep.

        Ids of chunks are strings, so vectors are ranked under a hash of them.
        """
        rows = self.chunks().select("chunk_id", "embedding", "content")
        ids = rows.select("chunk_id", F.xxhash64("chunk_id").alias("_n"))
        near = search.nearest(rows.join(ids, "chunk_id"), queries, 3 * limit, key="_n", query_key="query_id").join(ids, F.col("id") == F.col("_n")).select("query_id", "rank", F.col("chunk_id").alias("id"), "score")
        said = search.bm25(rows, queries, 3 * limit, key="chunk_id", query_key="query_id", text="content", query_text="text", stemmed=stemmed)
        return search.fused(near, said, limit)

    def delete_document(self, name: str) -> int:
        gone = self.chunks().where(F.col("document_name") == name).count()
        if gone:
            self.table.replace(self.chunks().where(~F.col("document_name").eqNullSafe(name)))
        return gone

    def all_chunks(self) -> DataFrame:
        return self.chunks().orderBy("document_name", "chunk_index")

    def migrate_breadcrumbs(self) -> int:
        n = self.chunks().where("breadcrumb is null").count()
        self.table.replace(with_breadcrumbs(self.chunks()))
        return n - self.chunks().where("breadcrumb is null").count()

    def count(self) -> int:
        return self.chunks().count()

    def clear(self) -> None:
        self.table.replace(self.spark.createDataFrame([], SCHEMA))


ENTITIES = "entity_id string, name string, display_name string, type string, aliases array<string>"
LINKS = "chunk_id string, entity_id string, frequency int, score double"


class EntityStore:
    """Entities, and which chunks they stand in, beside a store of chunks."""

    def __init__(self, spark: SparkSession, path: str, *, read_only: bool = False):
        root = path.rstrip("/")
        self.entities_table = Versions(spark, f"{root}/entities", ENTITIES, read_only=read_only)
        self.links_table = Versions(spark, f"{root}/links", LINKS, read_only=read_only)

    def _add(self, table: Versions, rows: DataFrame, keys: list[str]) -> None:
        own = table.shaped(rows)
        packed = own.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(F.struct(*own.columns)).alias("_r")).select("_r.*")
        table.append(packed.join(table.rows().select(*keys), keys, "left_anti"))

    def add_entities(self, entities: DataFrame) -> None:
        """Entities whose id is here already stay as they are."""
        self._add(self.entities_table, entities, ["entity_id"])

    def link(self, links: DataFrame) -> None:
        self._add(self.links_table, links, ["chunk_id", "entity_id"])

    def entities(self) -> DataFrame:
        return self.entities_table.rows()

    def links(self) -> DataFrame:
        return self.links_table.rows()

    def entities_of(self, chunk: str | None = None) -> DataFrame:
        return entities_of(self.links(), self.entities(), chunk)

    def unlink(self, chunks: DataFrame) -> None:
        """Links of `chunks` (chunk_id) go."""
        self.links_table.replace(without(self.links(), chunks, "chunk_id"))

    def remove(self, ids: DataFrame) -> None:
        """Entities of `ids` (entity_id) go, and their links."""
        self.entities_table.replace(without(self.entities(), ids, "entity_id"))
        self.links_table.replace(without(self.links(), ids, "entity_id"))


def missing(documents: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """Documents without a cached result, such as a vector of one model, under `keys`."""
    return documents.join(cached.select(*keys).distinct(), keys, "left_anti")

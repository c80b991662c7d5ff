"""Context in front of chunk bodies, and chunk ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRATEGIES = ("prefix", "inline")


def context(document: Column, section: Column, strategy: str = "prefix") -> Column:
    """The context string; parts that are null or empty are left out."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy: one of {', '.join(STRATEGIES)}")
    d, s = F.coalesce(document, F.lit("")), F.coalesce(section, F.lit(""))
    if strategy == "prefix":
        head = F.concat(F.when(d != "", F.concat(F.lit("Document: "), d, F.lit("\n"))).otherwise(""), F.when(s != "", F.concat(F.lit("Section: "), s, F.lit("\n"))).otherwise(""))
        return F.when(head != "", F.concat(head, F.lit("\n"))).otherwise("")
    inner = F.array_join(F.filter(F.array(d, s), lambda x: x != ""), " > ")
    return F.when(inner != "", F.concat(F.lit("["), inner, F.lit("] "))).otherwise("")


def enrich(chunks: DataFrame, strategy: str = "prefix", *, double_prefix: bool = False) -> DataFrame:
    """`chunks` with embedding_content made of the context and the body.

    double_prefix: put it before `content`, which may have a breadcrumb already.
    """
    base = F.col("content") if double_prefix or "body" not in chunks.columns else F.col("body")
    return chunks.withColumn("embedding_content", F.concat(context(F.col("document_name"), F.col("section"), strategy), base))


def chunk_id(document: Column, index: Column, embedded: Column, content: Column) -> Column:
    """name_index_hash, over the first 100 characters of what is embedded."""
    head = F.substring(F.coalesce(embedded, content), 1, 100)
    digest = F.left(F.sha2(F.concat_ws(":", document, index.cast("string"), head), 256), F.lit(16))
    return F.concat_ws("_", document, index.cast("string"), digest)

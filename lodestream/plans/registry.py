"""Every registered query of the retrieval engine, and the SQL that must give the same rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import extract, records
from lodestream.operators import chunking, cohort, entities, metrics, search, store
from lodestream.operators.chunking import ChunkOptions
from lodestream.operators.enrich import chunk_id, context
from lodestream.plans import oracle
from lodestream.sources import links, mime
from lodestream.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = oracle.SQL
OPTIONS = ChunkOptions(least=400, most=1200)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), "text")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for the written tables of one run, where all executors see it."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/lodestream-{name}-{uuid.uuid4().hex}"


# Text structure


@query
def paragraph_explode(spark, d):
    return chunking.lines(table(spark, d, "documents"), "doc_id").select("doc_id", F.col("pos").cast("long").alias("pos"), F.length("line").cast("long").alias("n_chars"))


@query
def sentence_split_stats(spark, d):
    parts = F.split("text", r"(?<=[.!?])[ \t\n\f\r]+")
    return table(spark, d, "documents").select("doc_id", F.size(parts).cast("long").alias("n_sentences"), F.array_max(F.transform(parts, lambda x: F.length(x).cast("long"))).alias("longest"))


@query
def line_classify(spark, d):
    return chunking.line_classes(table(spark, d, "documents"), "doc_id").groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query
def merge_blocks_islands(spark, d):
    return chunking.merged_lines(table(spark, d, "documents"), "doc_id").select("doc_id", F.col("block").cast("long").alias("block"), "kind", "n_lines", F.col("first_pos").cast("long").alias("first_pos"))


@query
def markdown_sections(spark, d):
    own = F.concat(F.lit("# "), F.replace("text", F.lit("."), F.lit("\n#")))
    return table(spark, d, "documents").select("doc_id", F.size(chunking.sections(own, F.lit("markdown"))).cast("long").alias("n_sections"))


@query
def naive_windows(spark, d):
    return chunking.token_windows(table(spark, d, "documents"), "doc_id").select("doc_id", F.col("window").cast("long").alias("window"), F.col("n_tokens").cast("long").alias("n_tokens"), F.md5("content").alias("digest"))


@query
def chunk_documents(spark, d):
    return chunking.chunk(named(spark, d), OPTIONS).select("document_name", "chunk_index", "section", "breadcrumb", "content", "block_type", "source_offset", "source_length")


@query
def chunk_size_histogram(spark, d):
    chunks = chunking.chunk(named(spark, d), OPTIONS)
    return chunks.groupBy((F.length("body") / 200).cast("int").alias("size_class"), "block_type").agg(F.count("*").alias("n"), F.sum("source_length").alias("bytes"))


def _context(spark, d, strategy):
    return table(spark, d, "documents").select("doc_id", F.md5(F.concat(context(F.col("source"), F.when(F.col("lang") != "en", F.col("lang")), strategy), F.coalesce("text", F.lit("")))).alias("digest"))


@query
def enrich_prefix(spark, d):
    return _context(spark, d, "prefix")


@query
def enrich_inline(spark, d):
    return _context(spark, d, "inline")


@query
def chunk_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", chunk_id(F.col("source"), F.col("doc_id"), F.lit(None).cast("string"), F.col("text")).alias("chunk_id"))


@query
def marker_strip(spark, d):
    kind = F.element_at(F.array(F.lit("TABLE"), F.lit("LIST"), F.lit("PARA")), F.pmod("doc_id", F.lit(3)).cast("int") + 1)
    wrapped = F.concat(F.lit("["), kind, F.lit(":start]\n"), F.coalesce("text", F.lit("")), F.lit("\n["), kind, F.lit(":cont]"))
    return table(spark, d, "documents").select("doc_id", F.md5(chunking.without_markers(wrapped)).alias("digest"))


#: The chunking configurations that are compared: sizes, and whether chunks carry their context.
STRATEGIES = {
    "naive_small": ChunkOptions(least=150, most=300, breadcrumb=False), "naive_medium": ChunkOptions(least=400, most=800, breadcrumb=False), "naive_large": ChunkOptions(least=800, most=1600, breadcrumb=False),
    "context_small": ChunkOptions(least=150, most=300), "context_medium": ChunkOptions(least=400, most=800), "context_large": ChunkOptions(least=800, most=1600), "context_wide": ChunkOptions(least=400, most=1200),
}


@query
def strategy_matrix(spark, d):
    out = None
    for name, options in STRATEGIES.items():
        own = chunking.chunk(named(spark, d), options).agg(F.count("*").alias("n_chunks"), F.sum("source_length").alias("bytes"), F.max(F.length("body").cast("long")).alias("longest")).withColumn("strategy", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


# Types, pages and records


@query
def mime_detect(spark, d):
    pages = table(spark, d, "pages").withColumn("mime", F.when(F.col("page_id") % 3 == 0, "text/html; charset=utf-8").when(F.col("page_id") % 3 == 1, "application/vnd.x+json"))
    return pages.select("page_id", mime.detected(F.when(F.col("page_id") % 5 == 0, F.concat("url", F.lit(".PDF?x=1"))).otherwise(F.col("url")), F.col("mime")).alias("doc_type"))


@query
def url_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", links.normalized(F.concat("url", F.when(F.col("page_id") % 2 == 0, "/?q=1#top").otherwise("#end"))).alias("url"))


@query
def html_links(spark, d):
    return links.hrefs(table(spark, d, "pages"), "page_id").groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query
def url_visitable(spark, d):
    keep = links.visitable(F.col("url"), include=r"/(en|de)/", exclude=(r"[?]utm_", r"#top$"))
    return table(spark, d, "pages").select("page_id", keep.alias("keep"))


@query
def page_links(spark, d):
    return links.links(table(spark, d, "pages"), "page_id").select("page_id", "url", "target")


@query
def html_to_markdown(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.col("url").alias("path"), F.lit("html").alias("doc_type"), F.encode("html", "UTF-8").alias("data"))
    return extract.extracted(pages).select("page_id", "text", "error")


@query
def html_chunks(spark, d):
    pages = table(spark, d, "pages").select(F.col("url").alias("path"), F.lit("html").alias("doc_type"), F.encode("html", "UTF-8").alias("data"))
    return chunking.chunk(extract.extracted(pages).withColumnRenamed("path", "name"), OPTIONS).select("document_name", "chunk_index", "section", "content")


@query
def table_to_markdown(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return records.table_markdown(rows, ["n_nationkey", "n_name", "r_name"], by=["r_regionkey"], order=["n_nationkey"])


@query
def json_outline(spark, d):
    files = table(spark, d, "events").select("event_id", F.lit("e.json").alias("path"), F.lit("json").alias("doc_type"), F.encode("props", "UTF-8").alias("data"))
    return extract.extracted(files).select("event_id", F.md5("text").alias("digest"), "error")


@query
def record_sections(spark, d):
    own = records.drug_markdown(F.col("p_name"), {"Brand": F.array("p_brand"), "Kind": F.split("p_type", " ")})
    return table(spark, d, "part").select("p_partkey", F.md5(own).alias("digest"))


@query
def first_of_name(spark, d):
    own = table(spark, d, "part").select("p_partkey", F.concat(F.lit(" "), F.upper("p_type")).alias("name"), "p_brand")
    return records.first_of_name(own, "name", "p_partkey")


@query
def latest_of_form(spark, d):
    own = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus"))).alias("os"))
    column = lambda c: F.transform("os", lambda o: o[c].cast("string"))
    return own.select("o_custkey", records.latest(column("o_orderstatus"), F.transform("os", lambda o: F.struct(o["o_orderdate"], o["o_orderkey"])), column("o_orderkey"), "F").alias("newest"))


@query
def conversation_documents(spark, d):
    return records.conversations(table(spark, d, "conversations")).select("conv_id", "n_turns", F.md5("text").alias("digest"))


def _page_edges(spark, d):
    """Pages that are linked through a shared target: page -> target -> page."""
    found = links.hrefs(table(spark, d, "pages"), "page_id").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("p"), F.concat(F.lit("h"), F.col("href")).alias("h")).distinct()
    return found.selectExpr("p as source", "h as target").unionByName(found.selectExpr("h as source", "p as target"))


@query
def link_bfs(spark, d):
    roots = spark.range(1).select(F.lit("p0").alias("url"))
    return links.reached(_page_edges(spark, d), roots, 4, folder=folder(spark, "bfs")).select("url", F.col("depth").cast("long").alias("depth"))


# Search


@query
def vector_topk(spark, d):
    rows = table(spark, d, "embeddings")
    found = search.nearest(rows, rows.where("vec_id % 50 = 0"), 10, key="vec_id", query_key="vec_id")
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"))


@query
def bm25_topk(spark, d):
    found = search.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), 5, key="doc_id", query_key="item_id")
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"))


@query
def tfidf_topk(spark, d):
    found = search.tfidf(table(spark, d, "documents"), table(spark, d, "benchmark"), 5, key="doc_id", query_key="item_id")
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"))


@query
def rrf_hybrid(spark, d):
    rows, queries = table(spark, d, "documents"), table(spark, d, "benchmark")
    lists = [f(rows, queries, 15, key="doc_id", query_key="item_id") for f in (search.bm25, search.tfidf)]
    return search.fused(*lists, 5).select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 9).alias("score"))


@query
def federated_search(spark, d):
    rows, queries = table(spark, d, "documents"), table(spark, d, "benchmark")
    english, others = rows.where("lang = 'en'"), rows.where("not lang <=> 'en'")
    lists = {"english": search.bm25(english, queries, 5, key="doc_id", query_key="item_id"), "others": search.bm25(others, queries, 5, key="doc_id", query_key="item_id")}
    return search.federated(lists, 5).select("query_id", F.col("rank").cast("long").alias("rank"), "library", "id", F.round("score", 9).alias("score"))


@query
def bm25_stemmed_topk(spark, d):
    found = search.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), 5, key="doc_id", query_key="item_id", stemmed=True)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"))


def _shared_words(queries, contents):
    """A stand-in for a reranking model: the share of the query's words that the text has."""
    import pandas as pd

    return pd.Series([len(set((q or "").lower().split()) & set((c or "").lower().split())) / max(1, len(set((q or "").split()))) for q, c in zip(queries, contents, strict=True)])


@query
def rerank_topk(spark, d):
    rows, queries = table(spark, d, "documents"), table(spark, d, "benchmark")
    found = search.bm25(rows, queries, 20, key="doc_id", query_key="item_id")
    few = F.broadcast(found.select("query_id", "id")) if 20 * queries.count() <= search.BROADCAST_TERMS else found.select("query_id", "id")
    joined = rows.select(F.col("doc_id").alias("id"), F.col("text").alias("content")).join(few, "id").join(queries.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id")
    return search.reranked(joined, _shared_words, 5).select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"))


# Store


@query
def embedding_cache_missing(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("model"))
    return store.missing(rows, rows.where("doc_id % 2 = 0"), ["doc_id", "model"])


@query
def store_upsert_first_wins(spark, d):
    rows = table(spark, d, "documents").select(F.md5("text").alias("chunk_id"), "doc_id")
    return store.upserted(rows.where("doc_id % 3 = 0").groupBy("chunk_id").agg(F.min("doc_id").alias("doc_id")), rows, order="doc_id")


@query
def delete_by_document(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source")
    gone = rows.where("doc_id % 7 = 0").select("source")
    return store.without(rows, gone.where("source in ('src1', 'src2')"), "source")


@query
def breadcrumb_migration(spark, d):
    own = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("["), F.col("source"), F.lit(" > a]\n\n"), F.col("text"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("[TABLE:start]\n\n"), F.col("text"))).otherwise(F.col("text"))
    rows = table(spark, d, "documents").select("doc_id", F.lit(None).cast("string").alias("breadcrumb"), own.alias("content"))
    return store.with_breadcrumbs(rows).select("doc_id", "breadcrumb", F.md5("content").alias("digest"))


# Entities. The vocabulary: every word of six letters and more that stands in at least a fiftieth of the documents.


def _kept(spark, df, name):
    """Used more than once: written, so that it is made once."""
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def vocabulary(spark, d):
    docs = table(spark, d, "documents")
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z][a-z0-9]*"), F.lit(0)))
    words = docs.select("doc_id", F.explode(F.filter(tokens, lambda t: F.length(t) >= 6)).alias("term"))
    n = F.broadcast(docs.agg(F.count("*").alias("n")))  # one row
    common = words.groupBy("term").agg(F.count_distinct("doc_id").alias("df")).crossJoin(n).where("50 * df >= n")
    return _kept(spark, common.select(F.col("term").alias("surface"), F.concat(F.lit("ent_"), "term").alias("entity_id"), (F.col("df") / F.col("n")).alias("share")), "vocabulary")


def matched(spark, d, words=None):
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"))
    return entities.match(rows, vocabulary(spark, d) if words is None else words)


@query
def vocab_match(spark, d):
    return matched(spark, d).select("chunk_id", "entity_id", F.col("frequency").cast("long").alias("frequency"), F.element_at("positions", 1).cast("long").alias("first"), F.element_at("positions", -1).cast("long").alias("last"))


def _associated(spark, d):
    return entities.associations(_kept(spark, matched(spark, d), "matches"), table(spark, d, "documents").count())


@query
def entity_scores(spark, d):
    return _associated(spark, d).select("chunk_id", "entity_id", "df", F.round("score", 6).alias("score"))


@query
def entity_topn(spark, d):
    return entities.top_chunks(_associated(spark, d), 3).select("entity_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 6).alias("score"))


@query
def merge_matches_overlap(spark, d):
    """Words of a twenty-fifth of the documents are the vocabulary, all of them the other matcher's."""
    words = vocabulary(spark, d)
    generic = matched(spark, d, words.select("surface", F.concat(F.lit("gen_"), "surface").alias("entity_id"))).select("chunk_id", "entity_id", F.inline("spans"))
    own = matched(spark, d, words.where("share >= 0.04")).select("chunk_id", "entity_id", F.inline("spans"))
    return entities.merged(own, generic).select("chunk_id", "entity_id", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))


@query
def entity_scores_after_removal(spark, d):
    own = entities.EntityIndex(_kept(spark, _associated(spark, d), "scored"))
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "source")
    return own.without(docs.where("source = 'src1'"), docs.where("source <> 'src1' or source is null").count()).scored.select("chunk_id", "entity_id", "df", F.round("score", 6).alias("score"))


def _pairs(spark, d, words=None):
    return entities.cooccurrence(_kept(spark, matched(spark, d, words), "matches"), table(spark, d, "documents").count())


@query
def cooccurrence(spark, d):
    return _pairs(spark, d).select("a", "b", "n", "df_a", "df_b", F.round("jaccard", 6).alias("jaccard"), F.round("pmi", 6).alias("pmi"))


def _clustered(spark, d):
    words = vocabulary(spark, d)
    pairs = _kept(spark, _pairs(spark, d, words), "pairs")
    nodes = words.select("entity_id")
    return pairs, _kept(spark, entities.dbscan(entities.distances(pairs, "jaccard"), nodes, 0.6, folder=folder(spark, "dbscan")), "clusters")


@query
def cluster_dbscan(spark, d):
    return entities.numbered(_clustered(spark, d)[1])


@query
def cluster_cohesion(spark, d):
    pairs, labels = _clustered(spark, d)
    return entities.cohesion(labels, pairs, "jaccard")


@query
def cluster_neighbors(spark, d):
    return entities.neighbours(_clustered(spark, d)[1]).select("entity_id", F.explode("members").alias("neighbor"))


@query
def cluster_agglomerative(spark, d):
    words = vocabulary(spark, d)
    return entities.average_linkage(entities.distances(_kept(spark, _pairs(spark, d, words), "pairs"), "jaccard"), words.select("entity_id"), 0.7, folder=folder(spark, "linkage"))


@query
def cluster_modularity(spark, d):
    words = vocabulary(spark, d)
    return entities.modularity(_kept(spark, _pairs(spark, d, words), "pairs"), words.select("entity_id"), folder=folder(spark, "modularity"))


# Cohorts: chunks of all documents; the queries are the first chunks of every fiftieth document.


def _prepared(spark, d):
    chunks = chunking.chunk(named(spark, d), OPTIONS).select("document_name", "chunk_index", "content", F.concat_ws("_", "document_name", F.col("chunk_index").cast("string")).alias("chunk_id"))
    chunks = _kept(spark, chunks, "chunks")
    vectors = _kept(spark, search.hashed_vectors(chunks, "chunk_id", "content"), "vectors")
    number = F.regexp_extract("chunk_id", r"^doc_(-?\d+)_0$", 1)
    queries = vectors.where(number != "").select(number.try_cast("long").alias("query_id"), "embedding").where("query_id % 50 = 0")
    words, n_chunks = vocabulary(spark, d), chunks.count()
    matches = _kept(spark, entities.match(chunks, words), "matches")
    scored = _kept(spark, entities.associations(matches, n_chunks), "scored")
    pairs = _kept(spark, entities.cooccurrence(matches, n_chunks), "pairs")
    clusters = _kept(spark, entities.dbscan(entities.distances(pairs, "jaccard"), words.select("entity_id"), 0.6, folder=folder(spark, "dbscan")), "clusters")
    ids = chunks.select("chunk_id", F.xxhash64("chunk_id").alias("n"))
    found = search.nearest(vectors.join(ids, "chunk_id").select("n", "embedding"), queries, 15, key="n", query_key="query_id")
    seeds = _kept(spark, found.join(ids, found.id == ids.n).select("query_id", "rank", F.col("chunk_id").alias("id"), "score"), "seeds")
    return chunks, vectors, queries, scored, clusters, seeds


@query
def cohort_mmr(spark, d):
    chunks, vectors, queries, scored, clusters, seeds = _prepared(spark, d)
    return cohort.cohorts(cohort.pool(seeds, chunks, scored, clusters), vectors, queries).withColumn("score", F.round("score", 6))


@query
def cohort_ablations(spark, d):
    chunks, vectors, queries, scored, clusters, seeds = _prepared(spark, d)
    out = None
    for name, o in cohort.ablations(cohort.CohortOptions()).items():
        own = cohort.cohorts(cohort.pool(seeds, chunks, scored, clusters, o), vectors, queries, o).groupBy("provenance").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score")).withColumn("variant", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


@query
def structural_neighbors(spark, d):
    rows = table(spark, d, "conversations").select(F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"), F.col("conv_id").cast("string").alias("document_name"), F.col("turn").alias("chunk_index"))
    found = rows.where("chunk_index % 3 = 0").select(F.lit(0).cast("long").alias("query_id"), F.lit(1).alias("place"), "chunk_id")
    return cohort.structural_neighbours(found, rows).select("query_id", "chunk_id")


def _found(spark, d):
    return table(spark, d, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.lit(1).alias("place"), F.col("doc_id").cast("string").alias("chunk_id"))


@query
def entity_expand(spark, d):
    return cohort.entity_neighbours(_found(spark, d), _kept(spark, _associated(spark, d), "scored"), 3).select("query_id", F.col("place").cast("long").alias("place"), "chunk_id", "entity_id")


@query
def cluster_expand(spark, d):
    return cohort.cluster_neighbours(_found(spark, d), _kept(spark, _associated(spark, d), "scored"), _clustered(spark, d)[1], 10).select("query_id", F.col("place").cast("long").alias("place"), "chunk_id", "entity_id", "label")


# Metrics


def _results(spark, d):
    rows = table(spark, d, "embeddings")
    found = search.nearest(rows, rows.where("vec_id % 50 = 0"), 10, key="vec_id", query_key="vec_id")
    own = rows.select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("l"))
    asked = rows.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql"))
    return found.join(own, "id").join(asked, "query_id").withColumn("relevance", F.when(F.col("l") == F.col("ql"), 2).when(F.abs(F.col("l") - F.col("ql")) == 1, 1).otherwise(0)).withColumn("n_chars", F.col("id") % 97)


@query
def ndcg_scope_efficiency(spark, d):
    own = _kept(spark, _results(spark, d), "results")
    joined = metrics.ndcg(own).join(metrics.scope(own), "query_id")
    return joined.select("query_id", *[F.round(c, 6).alias(c) for c in ("ndcg", "scope", "efficiency")])


@query
def marginal_relevance(spark, d):
    return metrics.marginal_relevance(_results(spark, d)).select("query_id", *[F.round(c, 6).alias(c) for c in ("mean_score", "redundancy", "marginal")])


@query
def cluster_quality(spark, d):
    return metrics.cluster_quality(table(spark, d, "embeddings"), label="label", vector="embedding", width=64).select(F.round("intra", 6).alias("intra"), F.round("inter", 6).alias("inter"))


@query
def rqi_rollup(spark, d):
    own = _kept(spark, _results(spark, d), "results")
    scores = metrics.ndcg(own).join(metrics.coherence(own), "query_id").join(metrics.scope(own), "query_id").withColumn("category", F.when(F.col("query_id") % 3 == 0, "scoped").when(F.col("query_id") % 3 == 1, "synthesis").otherwise("broad"))
    return metrics.quality_index(scores).select("category", "n", F.round("rqi", 6).alias("rqi"))


@query
def cross_context_pairs(spark, d):
    return metrics.activated(_results(spark, d), context="l", least=0.1)


@query
def graded_relevance(spark, d):
    none = F.array().cast("array<string>")
    grade = metrics.graded(F.col("source"), F.col("lang"), F.col("text"), F.array(F.lit("SRC1"), F.lit("src2")), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("EN"), F.lit("the "))).otherwise(none))
    return table(spark, d, "documents").select("doc_id", grade.cast("long").alias("grade"))


@query
def answers_by_type(spark, d):
    own = table(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return metrics.by_type(own, "event_type", ["value"]).withColumn("value", F.round("value", 6))


@query
def strategy_advantage(spark, d):
    own = table(spark, d, "events").groupBy(F.month("ts").alias("size"), F.when(F.col("event_type") == "view", "contextual").otherwise(F.col("event_type")).alias("strategy")).agg(F.avg("value").alias("rqi"))
    return metrics.advantage(own).select("size", F.round("best_naive", 6).alias("best_naive"), F.round("contextual", 6).alias("contextual"), "naive", F.round("percent", 6).alias("percent"))


@query
def evidence_passages(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", F.array("text").alias("evidence"))
    return metrics.evidence(turns, key="conv_id").select("evidence_id", "n_records")


@query
def first_hit(spark, d):
    return metrics.first_hit(_results(spark, d)).select("query_id", "precision_at_1", F.round("margin", 6).alias("margin"))


@query
def stratified_sample(spark, d):
    return metrics.stratified(table(spark, d, "documents"), 100, stratum="source", key="doc_id").select("doc_id", "source")


# Events


@query
def event_windows(spark, d):
    return ingest.windowed(table(spark, d, "events"), width="6 hours").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query
def event_sessions(spark, d):
    own = ingest.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), gap="12 hours")
    return own.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort_mmr(spark, sf_dir)

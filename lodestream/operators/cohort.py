"""Cohort search: seeds, three expansions by joins, and a greedy selection of diverse chunks for each query."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators import search

STAGES = ("seed", "structural", "entity_adjacent", "cluster_adjacent")
PRIORITY = (1.0, 0.9, 0.7, 0.5)
POOL = "query_id long, stage int, place int, chunk_id string, linked_by string, cluster string"


@dataclass(frozen=True)
class CohortOptions:
    k: int = 5
    seed_factor: int = 3
    per_entity: int = 3
    cluster_budget: int | None = None  # 2k
    diversity: float = 0.3
    relevance: float = 0.5
    priority: float = 0.2
    coverage: float = 0.3
    structural: bool = True
    entity: bool = True
    cluster: bool = True

    def __post_init__(self):
        if self.k < 1 or self.seed_factor < 1 or self.per_entity < 1:
            raise ValueError("k, seed_factor and per_entity are positive")


def _rows(df: DataFrame, stage: int, linked: str = "cast(null as string)", cluster: str = "cast(null as string)") -> DataFrame:
    return df.selectExpr("query_id", f"{stage} as stage", "place", "chunk_id", f"{linked} as linked_by", f"{cluster} as cluster")


def _first_of(pool: DataFrame) -> DataFrame:
    """One row for each chunk of a query: the one of the earliest stage and place."""
    best = F.min(F.struct("stage", "place", "linked_by", "cluster")).alias("m")
    return pool.groupBy("query_id", "chunk_id").agg(best).select("query_id", "m.stage", "m.place", "chunk_id", "m.linked_by", "m.cluster")


def structural_neighbours(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks before and after each found one: (query_id, place, chunk_id)."""
    at = found.join(chunks.select("chunk_id", "document_name", "chunk_index"), "chunk_id")
    near = at.select("query_id", F.col("place").alias("p"), "document_name", F.explode(F.array(F.col("chunk_index") - 1, F.col("chunk_index") + 1)).alias("chunk_index"))
    return near.join(chunks.select("chunk_id", "document_name", "chunk_index"), ["document_name", "chunk_index"]).groupBy("query_id", "chunk_id").agg(F.min("p").alias("place"))


def entity_neighbours(found: DataFrame, scored: DataFrame, n: int) -> DataFrame:
    """The n best chunks of each entity of the found chunks: (query_id, place, chunk_id, entity_id)."""
    w = Window.partitionBy("entity_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    best = scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).select("entity_id", F.col("chunk_id").alias("to"), "r")
    own = found.join(scored.select("chunk_id", "entity_id"), "chunk_id").select("query_id", "entity_id").distinct()
    return own.join(best, "entity_id").groupBy("query_id", F.col("to").alias("chunk_id")).agg(F.min(F.struct("r", "entity_id")).alias("m")).select("query_id", F.col("m.r").alias("place"), "chunk_id", F.col("m.entity_id").alias("entity_id"))


def cluster_neighbours(found: DataFrame, scored: DataFrame, clusters: DataFrame, budget: int) -> DataFrame:
    """The best chunk of each other entity in the clusters of the found chunks' entities, `budget` new chunks a query."""
    w = Window.partitionBy("entity_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    best = scored.withColumn("r", F.row_number().over(w)).where("r = 1").select("entity_id", F.col("chunk_id").alias("to"), "score")
    own = found.join(scored.select("chunk_id", "entity_id"), "chunk_id").select("query_id", "entity_id").distinct()
    mine = own.join(clusters.select("entity_id", "label"), "entity_id").select("query_id", "label").distinct()
    near = mine.join(clusters.select("entity_id", "label"), "label").join(own, ["query_id", "entity_id"], "left_anti")
    reached = near.join(best, "entity_id").groupBy("query_id", F.col("to").alias("chunk_id")).agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "entity_id", "label")).alias("m"))
    new = reached.join(found.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("m.s", "chunk_id"))
    return new.withColumn("place", place).where(F.col("place") <= budget).select("query_id", "place", "chunk_id", F.col("m.entity_id").alias("entity_id"), F.col("m.label").alias("label"))


def pool(seeds: DataFrame, chunks: DataFrame, scored: DataFrame, clusters: DataFrame, o: CohortOptions = CohortOptions()) -> DataFrame:
    """POOL of each query; `seeds` is (query_id, rank, id)."""
    found = _rows(seeds.selectExpr("query_id", "rank as place", "id as chunk_id"), 0)
    if o.structural:
        found = _first_of(found.unionByName(_rows(structural_neighbours(found, chunks), 1)))
    if o.entity:
        found = _first_of(found.unionByName(_rows(entity_neighbours(found, scored, o.per_entity), 2, "entity_id")))
    if o.cluster:
        budget = 2 * o.k if o.cluster_budget is None else o.cluster_budget
        found = _first_of(found.unionByName(_rows(cluster_neighbours(found, scored, clusters, budget), 3, "entity_id", "label")))
    return found


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    out = a @ b.T
    return np.divide(out, np.outer(na, nb), out=np.zeros_like(out), where=np.outer(na, nb) > 0)


def select(candidates: pd.DataFrame, o: CohortOptions) -> list[tuple[int, float]]:
    """(row, score when picked) of the k picks; ties fall to the earlier row. Rows without a vector have relevance 0."""
    has = np.array([v is not None and len(v) > 0 for v in candidates.embedding])
    query = np.array(candidates["query"].iloc[0], float)
    vectors = np.zeros((len(candidates), len(query)))
    for i in np.flatnonzero(has):
        vectors[i] = candidates.embedding.iloc[i]
    relevance = np.where(has, _cosines(vectors, query[None])[:, 0], 0.0)
    between = _cosines(vectors, vectors)
    nearest = np.zeros(len(candidates))
    priority = np.array([PRIORITY[s] for s in candidates.stage])
    left = np.ones(len(candidates), bool)
    seen = False
    picks: list[tuple[int, float]] = []
    while left.any() and len(picks) < o.k:
        coverage = relevance - o.diversity * nearest
        score = np.round(o.relevance * relevance + o.priority * priority + o.coverage * coverage, 12)
        best = int(np.argmax(np.where(left, score, -np.inf)))
        picks.append((best, float(score[best])))
        left[best] = False
        if has[best]:
            similar = np.where(has, between[best], 0.0)
            nearest = np.maximum(nearest, similar) if seen else similar
            seen = True
    return picks


COHORT = "query_id long, rank int, chunk_id string, score double, provenance string, linked_by string, cluster string"


def cohorts(pooled: DataFrame, vectors: DataFrame, queries: DataFrame, o: CohortOptions = CohortOptions()) -> DataFrame:
    """COHORT of each query. `vectors` is (chunk_id, embedding), `queries` (query_id, embedding).

    A pool holds a few hundred chunks at most, whatever the size of the store.
    """
    joined = pooled.join(vectors.select("chunk_id", "embedding"), "chunk_id", "left").join(queries.select("query_id", F.col("embedding").alias("query")), "query_id")

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["stage", "place", "chunk_id"], kind="stable").reset_index(drop=True)
        rows = [(group.query_id[0], r + 1, group.chunk_id[i], s, STAGES[group.stage[i]], group.linked_by[i], group.cluster[i]) for r, (i, s) in enumerate(select(group, o))]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in COHORT.split(", ")])

    return joined.groupBy("query_id").applyInPandas(pick, COHORT)


def ablations(o: CohortOptions) -> dict[str, CohortOptions]:
    """Variants that leave one expansion out, or all."""
    off = {"no_structural": ("structural",), "no_entity": ("entity",), "no_cluster": ("cluster",), "seeds_only": ("structural", "entity", "cluster")}
    return {"full": o} | {name: reduce(lambda x, f: type(x)(**(vars(x) | {f: False})), fields, o) for name, fields in off.items()}


def expand(vectors: DataFrame, queries: DataFrame, chunks: DataFrame, scored: DataFrame, clusters: DataFrame, o: CohortOptions = CohortOptions(), *, text: bool = False) -> DataFrame:
    """COHORT of `queries` (query_id, embedding, and text if `text`) from the seeds on: vector order, or with text fused with BM25.

    `vectors` is (chunk_id, embedding), `chunks` (chunk_id, document_name, chunk_index, content).
    """
    n = o.k * o.seed_factor
    ids = vectors.select("chunk_id", F.xxhash64("chunk_id").alias("_n"))
    near = search.nearest(vectors.join(ids, "chunk_id"), queries, 3 * n if text else n, key="_n", query_key="query_id").join(ids, F.col("id") == F.col("_n")).select("query_id", "rank", F.col("chunk_id").alias("id"), "score")
    if text:
        near = search.fused(near, search.bm25(chunks, queries, 3 * n, key="chunk_id", query_key="query_id", text="content", query_text="text", stemmed=True), n)
    return cohorts(pool(near, chunks, scored, clusters, o), vectors, queries, o)

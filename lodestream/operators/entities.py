"""Vocabulary matching, entity-chunk associations, co-occurrence and clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.functions.arrow import slices, small_batches

MATCHES = "chunk_id string, entity_id string, frequency int, positions array<int>, spans array<struct<s:int,e:int>>, chunk_length int"
#: Surfaces of one automaton; a larger vocabulary is matched by several passes.
SURFACES = 200_000


def slug(name: F.Column) -> F.Column:
    return F.concat(F.lit("ent_"), F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_")))


def surfaces(entities: DataFrame, *, exact: bool = False, least: int = 2, order: str | None = None) -> DataFrame:
    """(surface, entity_id) of `entities` (entity_id, name, display_name, aliases); of entities with one surface the last by `order` stays."""
    texts = F.concat(F.array("name", "display_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    every = entities.select("entity_id", F.col(order or "entity_id").alias("_o"), F.explode(texts).alias("surface")).where(F.length("surface") >= least)
    if not exact:
        every = every.withColumn("surface", F.lower("surface"))
    return every.groupBy("surface").agg(F.max_by("entity_id", F.struct("_o", "entity_id")).alias("entity_id"))


def match(chunks: DataFrame, vocabulary: DataFrame, *, exact: bool = False, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """MATCHES of every surface of `vocabulary` (surface, entity_id) that stands between characters that are no letter or digit.

    Overlapping occurrences count. The vocabulary goes to the tasks in automata of at most SURFACES surfaces.
    """
    small_batches(chunks.sparkSession)
    n = vocabulary.count()
    parts = max(1, -(-n // SURFACES))
    out = None
    for i in range(parts):
        own = vocabulary.where(F.pmod(F.xxhash64("surface"), F.lit(parts)) == i) if parts > 1 else vocabulary
        pairs = [(r.surface, r.entity_id) for r in own.select("surface", "entity_id").collect()]  # about SURFACES
        found = chunks.select(F.col(key).cast("string"), text).mapInArrow(_matcher(pairs, exact), "chunk_id string, entity_id string, s int, e int, chunk_length int")
        out = found if out is None else out.unionByName(found)
    spans = F.sort_array(F.collect_list(F.struct("s", "e")))  # of one entity in one chunk
    grouped = out.groupBy("chunk_id", "entity_id").agg(spans.alias("spans"), F.first("chunk_length").alias("chunk_length"))
    return grouped.select("chunk_id", "entity_id", F.size("spans").alias("frequency"), F.transform("spans", lambda x: x["s"]).alias("positions"), "spans", "chunk_length")


def _matcher(pairs: list[tuple[str, str]], exact: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for surface, entity in pairs:
            automaton.add_word(surface, (len(surface), entity))
        if pairs:
            automaton.make_automaton()
        for batch in slices(batches, 1):
            rows: list[tuple] = []
            for cid, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                if not text or not pairs:
                    continue
                own = text if exact else text.lower()
                for last, (n, entity) in automaton.iter(own):
                    first = last + 1 - n
                    if (first == 0 or not own[first - 1].isalnum()) and (last + 1 == len(own) or not own[last + 1].isalnum()):
                        rows.append((cid, entity, first, last + 1, len(text)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["chunk_id", "entity_id", "s", "e", "chunk_length"])

    return work


def merged(vocabulary: DataFrame, generic: DataFrame) -> DataFrame:
    """Spans (chunk_id, entity_id, s, e) of both matchers; a generic one that overlaps a vocabulary one of its chunk goes."""
    v, g = vocabulary.alias("v"), generic.alias("g")
    overlap = (F.col("v.chunk_id") == F.col("g.chunk_id")) & (F.col("v.s") < F.col("g.e")) & (F.col("g.s") < F.col("v.e"))
    return vocabulary.unionByName(g.join(v, overlap, "left_anti")).groupBy("chunk_id", "entity_id", "s").agg(F.max("e").alias("e"))


def merged_matches(vocabulary: DataFrame, generic: DataFrame) -> DataFrame:
    """Matches (chunk_id, entity_id, frequency, positions) of `merged` spans: frequencies count what is left of each entity in each chunk."""
    spans = merged(vocabulary, generic).groupBy("chunk_id", "entity_id").agg(F.sort_array(F.collect_list("s")).alias("positions"))  # of one entity in one chunk
    return spans.select("chunk_id", "entity_id", F.size("positions").alias("frequency"), "positions")


def stripped(spans: DataFrame, text: str = "surface", marks: str = " \t\n.,;:!?\"'()[]{}<>*_-–—/\\|") -> DataFrame:
    """Spans without the blanks and punctuation at their ends; nothing left: no row."""
    bare = F.btrim(text, F.lit(marks))
    lead = F.length(text) - F.length(F.ltrim(F.col(text), F.lit(marks)))
    return spans.withColumn("s", F.col("s") + lead).withColumn(text, bare).withColumn("e", F.col("s") + F.length(text)).where(F.length(text) > 0)


def associations(matches: DataFrame, n_chunks: int | F.Column, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> DataFrame:
    """`matches` with df and score = w0 ln(1 + f) + w1 (1 - first / length) + w2 ln(N / df)."""
    df = matches.groupBy("entity_id").agg(F.count("*").alias("df"))
    total = F.lit(n_chunks) if isinstance(n_chunks, int) else n_chunks
    first = F.element_at("positions", 1) / F.greatest("chunk_length", F.lit(1))
    score = weights[0] * F.log1p("frequency") + weights[1] * (1 - first) + weights[2] * F.log(total / F.col("df"))
    return matches.join(df, "entity_id").withColumn("score", score)


def top_chunks(scored: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("entity_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def without_chunks(matches: DataFrame, gone: DataFrame) -> DataFrame:
    return matches.join(gone.select("chunk_id").distinct(), "chunk_id", "left_anti")


def cooccurrence(matches: DataFrame, n_chunks: int, *, least: int = 2) -> DataFrame:
    """(a, b, n, df_a, df_b, jaccard, pmi) of entity pairs that share at least `least` chunks.

    A chunk's pairs are made from the array of its entities, which the chunk's size bounds.
    """
    own = matches.select("chunk_id", "entity_id").distinct()
    sets = own.groupBy("chunk_id").agg(F.sort_array(F.collect_set("entity_id")).alias("es")).where(F.size("es") > 1)
    pairs = F.flatten(F.transform("es", lambda x, i: F.transform(F.slice("es", i + 2, F.size("es")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    counted = sets.select(F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    df = own.groupBy("entity_id").agg(F.count("*").alias("df"))
    total = max(n_chunks, 1)
    out = counted.join(df.toDF("a", "df_a"), "a").join(df.toDF("b", "df_b"), "b")
    pmi = F.log2(F.col("n") / total / ((F.col("df_a") / total) * (F.col("df_b") / total)))
    return out.select("a", "b", "n", "df_a", "df_b", (F.col("n") / (F.col("df_a") + F.col("df_b") - F.col("n"))).alias("jaccard"), pmi.alias("pmi"))


def distances(pairs: DataFrame, score: str) -> DataFrame:
    """(a, b, score, d): d = 1 - the score scaled to [0, 1]; all scores equal: 0."""
    ends = F.broadcast(pairs.agg(F.min(score).alias("lo"), F.max(score).alias("hi")))  # one row
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col(score) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    return pairs.crossJoin(ends).select("a", "b", F.col(score).alias("score"), F.greatest(F.lit(0.0), 1 - scaled).alias("d"))


def linked(edges: DataFrame, nodes: DataFrame, *, folder: str) -> DataFrame:
    """(entity_id, label): the least id that each node is linked to, by label propagation over written tables."""
    spark = edges.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    loops = nodes.select(F.col("entity_id").alias("a"), F.col("entity_id").alias("b"))
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(loops).distinct(), "both")
    labels = written(both.groupBy(F.col("a").alias("entity_id")).agg(F.min("b").alias("label")), "l0")
    k = 0
    while True:
        k += 1
        near = both.join(labels, both.b == labels.entity_id).groupBy(F.col("a").alias("entity_id")).agg(F.min("label").alias("near"))
        up = labels.select(F.col("entity_id").alias("_n"), F.col("label").alias("up"))
        new = written(near.join(up, near.near == up._n).select("entity_id", F.least("near", "up").alias("label")), f"l{k}")
        same = new.join(labels.toDF("entity_id", "old"), "entity_id").where("label <> old").limit(1).count() == 0
        labels = new
        if same:
            return labels


def dbscan(dist: DataFrame, nodes: DataFrame, eps: float, *, folder: str) -> DataFrame:
    """Density clusters with two as the least size: the components of d <= eps, single ones apart. eps >= 1 joins all."""
    if eps >= 1:
        least = F.broadcast(nodes.agg(F.min("entity_id").alias("label")))  # one row
        return nodes.select("entity_id").distinct().crossJoin(least)
    return linked(dist.where(F.col("d") <= eps), nodes, folder=folder)


def numbered(labels: DataFrame) -> DataFrame:
    """cluster_0000, cluster_0001, ... in the order of the labels."""
    names = labels.select("label").distinct().withColumn("cluster_id", F.format_string("cluster_%04d", F.row_number().over(Window.orderBy("label")) - 1))
    return labels.join(names, "label").select("entity_id", "cluster_id")


def average_linkage(dist: DataFrame, nodes: DataFrame, threshold: float, *, folder: str) -> DataFrame:
    """(entity_id, label) by average linkage, cut below `threshold`; pairs without a distance are 1 apart.

    Up to a threshold of 1 components of d < 1 cannot merge, so each is clustered on its own; above it all are one group.
    """
    parts = linked(dist.where("d < 1"), nodes, folder=folder) if threshold <= 1 else nodes.select("entity_id").distinct().withColumn("label", F.lit(""))
    inside = dist.where("d < 1") if threshold <= 1 else dist
    edges = inside.join(parts.toDF("a", "part"), "a").select("part", "a", "b", "d")
    alone = parts.select(F.col("label").alias("part"), F.col("entity_id").alias("a"), F.col("entity_id").alias("b"), F.lit(0.0).alias("d"))

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*group.a, *group.b})
        at = {x: i for i, x in enumerate(names)}
        n = len(names)
        m = np.ones((n, n))
        for a, b, d in zip(group.a, group.b, group.d, strict=True):
            m[at[a], at[b]] = m[at[b], at[a]] = d
        np.fill_diagonal(m, np.inf)
        size, own = np.ones(n), np.arange(n)
        while n > 1:
            i, j = divmod(int(m.argmin()), n)
            if not m[i, j] < threshold:
                break
            i, j = min(i, j), max(i, j)
            row = (size[i] * m[i] + size[j] * m[j]) / (size[i] + size[j])
            m[i], m[:, i], m[i, i] = row, row, np.inf
            m[j], m[:, j] = np.inf, np.inf
            size[i] += size[j]
            own[own == j] = i
        return pd.DataFrame({"entity_id": names, "label": [names[i] for i in own]})

    return edges.unionByName(alone).groupBy("part").applyInPandas(cluster, "entity_id string, label string")


def modularity(pairs: DataFrame, nodes: DataFrame, *, resolution: float = 1.0, rounds: int = 20, folder: str) -> DataFrame:
    """(entity_id, label) by greedy local moves on modularity, component by component; deterministic (nodes in id order)."""
    weights = distances(pairs, "n").select("a", "b", (1 - F.col("d")).alias("w"))
    parts = linked(pairs, nodes, folder=folder)
    edges = weights.join(parts.toDF("a", "part"), "a").select("part", "a", "b", "w")
    alone = parts.select(F.col("label").alias("part"), F.col("entity_id").alias("a"), F.col("entity_id").alias("b"), F.lit(0.0).alias("w"))

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*group.a, *group.b})
        near: dict[str, dict[str, float]] = {x: {} for x in names}
        for a, b, w in zip(group.a, group.b, group.w, strict=True):
            if a != b:
                near[a][b] = near[b][a] = w
        degree = {x: sum(v.values()) for x, v in near.items()}
        twice = sum(degree.values()) or 1.0
        own = {x: x for x in names}
        volume = dict(degree)
        for _ in range(rounds):
            moved = False
            for x in names:
                volume[own[x]] -= degree[x]
                gain: dict[str, float] = {own[x]: 0.0}
                for y, w in near[x].items():
                    gain[own[y]] = gain.get(own[y], 0.0) + w
                best = min(gain, key=lambda c: (-(gain[c] - resolution * degree[x] * volume[c] / twice), c != own[x], c))
                moved |= best != own[x]
                own[x] = best
                volume[best] += degree[x]
            if not moved:
                break
        least: dict[str, str] = {}
        for x in names:
            least.setdefault(own[x], x)
        return pd.DataFrame({"entity_id": names, "label": [least[own[x]] for x in names]})

    return edges.unionByName(alone).groupBy("part").applyInPandas(cluster, "entity_id string, label string")


def cohesion(clusters: DataFrame, pairs: DataFrame, score: str) -> DataFrame:
    """(label, size, cohesion): the mean score of the pairs inside each cluster; 0 without pairs."""
    inside = pairs.join(clusters.toDF("a", "la"), "a").join(clusters.toDF("b", "lb"), "b").where("la = lb").groupBy(F.col("la").alias("label")).agg(F.avg(score).alias("c"))
    return clusters.groupBy("label").agg(F.count("*").alias("size")).join(inside, "label", "left").select("label", "size", F.round(F.coalesce("c", F.lit(0.0)), 4).alias("cohesion"))


def neighbours(clusters: DataFrame) -> DataFrame:
    """(entity_id, members): the cluster of each entity as one array a cluster, not as pairs."""
    members = clusters.groupBy("label").agg(F.sort_array(F.collect_list("entity_id")).alias("members"))
    return clusters.join(members, "label").select("entity_id", F.array_remove("members", F.col("entity_id")).alias("members"))


def cluster(pairs: DataFrame, nodes: DataFrame, method: str, *, score: str = "jaccard", threshold: float = 0.7, eps: float = 0.6, resolution: float = 1.0, folder: str) -> DataFrame:
    """(entity_id, label) of `nodes` (entity_id) by `agglomerative`, `dbscan` or `leiden` over co-occurrence `pairs`."""
    if method == "agglomerative":
        return average_linkage(distances(pairs, score), nodes, threshold, folder=folder)
    if method == "dbscan":
        return dbscan(distances(pairs, score), nodes, eps, folder=folder)
    if method == "leiden":
        return modularity(pairs, nodes, resolution=resolution, folder=folder)
    raise ValueError(f"unknown cluster method: {method}")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Entities (entity_id, name, display_name, type, aliases) of a JSON array, JSON lines, or a text file of names; in text, blank lines and those with # are left out.

    Entities without an id get one made of their name.
    """
    fields = "id string, name string, display_name string, type string, aliases array<string>"
    if path.lower().endswith((".json", ".jsonl", ".ndjson")):
        own = spark.read.schema(fields).json(path, multiLine=path.lower().endswith(".json"))
    else:
        own = spark.read.text(path).select(F.trim("value").alias("name")).where("name <> '' and not startswith(name, '#')")
        own = own.select(F.lit(None).cast("string").alias("id"), "name", F.lit(None).cast("string").alias("display_name"), F.lit(None).cast("string").alias("type"), F.array().cast("array<string>").alias("aliases"))
    return own.select(F.coalesce("id", slug(F.col("name"))).alias("entity_id"), "name", F.coalesce("display_name", "name").alias("display_name"), "type", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


# Labels of the common English recognisers.
LABELS = frozenset("CARDINAL DATE EVENT FAC GPE LANGUAGE LAW LOC MONEY NORP ORDINAL ORG PERCENT PERSON PRODUCT QUANTITY TIME WORK_OF_ART".split())
# End of fixed values.


def found_by(chunks: DataFrame, find: Callable[[str], list[tuple[int, int, str]]], *, labels: frozenset[str] | None = LABELS, numeric: bool = False, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """Spans (chunk_id, entity_id, surface, label, s, e) of a recogniser: a function of a text that gives (start, end, label).

    Ends are stripped of punctuation; spans without letters are left out unless `numeric`; equal slugs are one entity.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = [(cid, t[a:b], label, a) for cid, t in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True) if t for a, b, label in find(t) if labels is None or label in labels]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int32()), strict=True)], ["chunk_id", "surface", "label", "s"])

    small_batches(chunks.sparkSession)
    spans = chunks.select(F.col(key).cast("string"), F.col(text).cast("string")).mapInArrow(work, "chunk_id string, surface string, label string, s int")
    bare = stripped(spans.withColumn("e", F.lit(0)), "surface")
    if not numeric:
        bare = bare.where(F.col("surface").rlike(r"\p{L}"))
    return bare.select("chunk_id", slug(F.col("surface")).alias("entity_id"), "surface", "label", "s", F.col("e").cast("int").alias("e"))


class EntityIndex:
    """Matches with their association scores, as a table."""

    def __init__(self, scored: DataFrame):
        self.scored = scored

    @classmethod
    def build(cls, chunks: DataFrame, vocabulary: DataFrame, *, key: str = "chunk_id", text: str = "content", exact: bool = False) -> EntityIndex:
        """The number of chunks counts those without any entity too."""
        return cls(associations(match(chunks, vocabulary, exact=exact, key=key, text=text), chunks.count()))

    def chunks_of(self, entity: str, n: int | None = None) -> DataFrame:
        own = self.scored.where(F.col("entity_id") == entity).orderBy(F.desc(F.round("score", 9)), "chunk_id")
        return own if n is None else own.limit(n)

    def entities_of(self, chunk: str) -> DataFrame:
        return self.scored.where(F.col("chunk_id") == chunk).orderBy(F.desc(F.round("score", 9)), "entity_id")

    def association(self, chunk: str, entity: str) -> DataFrame:
        return self.scored.where((F.col("chunk_id") == chunk) & (F.col("entity_id") == entity))

    def frequencies(self) -> DataFrame:
        """(entity_id, df)."""
        return self.scored.groupBy("entity_id").agg(F.count("*").alias("df"))

    def without(self, gone: DataFrame, n_chunks: int) -> EntityIndex:
        """The index of what stays after `gone` (chunk_id), with scores made anew for `n_chunks` chunks."""
        return EntityIndex(associations(without_chunks(self.scored.drop("df", "score"), gone), n_chunks))

    def save(self, path: str) -> None:
        self.scored.write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> EntityIndex:
        return cls(spark.read.parquet(path))

    def as_json(self) -> DataFrame:
        """One JSON object for each match."""
        return self.scored.select(F.to_json(F.struct(*self.scored.columns)).alias("value"))


class ClusterMap:
    """(entity_id, label) of all entities, and the pairs that they came from."""

    def __init__(self, labels: DataFrame, pairs: DataFrame, score: str = "jaccard"):
        self.labels, self.pairs, self.score = labels, pairs, score

    def cluster_of(self, entity: str) -> DataFrame:
        return self.labels.where(F.col("entity_id") == entity)

    def neighbours(self) -> DataFrame:
        return neighbours(self.labels)

    def records(self) -> DataFrame:
        """(cluster_id, size, cohesion, members): one row a cluster."""
        members = self.labels.groupBy("label").agg(F.sort_array(F.collect_list("entity_id")).alias("members"))
        names = numbered(self.labels).join(self.labels, "entity_id").select("label", "cluster_id").distinct()
        return cohesion(self.labels, self.pairs, self.score).join(members, "label").join(names, "label").select("cluster_id", "size", "cohesion", "members")

    def count(self) -> int:
        return self.labels.select("label").distinct().count()

    def save(self, path: str) -> None:
        self.labels.write.parquet(f"{path}/labels")
        self.pairs.write.parquet(f"{path}/pairs")

    @classmethod
    def load(cls, spark: SparkSession, path: str, score: str = "jaccard") -> ClusterMap:
        return cls(spark.read.parquet(f"{path}/labels"), spark.read.parquet(f"{path}/pairs"), score)

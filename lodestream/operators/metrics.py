"""Retrieval metrics as aggregations over (query, rank, result) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.search import cosine

#: Weights of the components and of the query categories in the retrieval quality index.
COMPONENTS = {"ndcg": 0.30, "coherence": 0.15, "scope": 0.20, "sufficiency": 0.25, "efficiency": 0.10}
CATEGORIES = {"scoped": 0.4, "synthesis": 0.3, "broad": 0.3}


def graded(document: Column, section: Column, content: Column, target_documents: Column, target_sections: Column) -> Column:
    """2: a target document and a target section (or none asked for); 1: one of them; 0: neither."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    in_document = F.exists(target_documents, lambda t: F.contains(low(document), F.lower(t)))
    in_section = F.exists(target_sections, lambda t: F.contains(low(section), F.lower(t)) | F.contains(low(content), F.lower(t)))
    return F.when(in_document & (in_section | (F.size(target_sections) == 0)), 2).when(in_document | in_section, 1).otherwise(0)


def ndcg(results: DataFrame, *, by: str = "query_id", relevance: str = "relevance") -> DataFrame:
    """(query, ndcg) of ranked results; the ideal is the same results sorted by relevance."""
    w = Window.partitionBy(by).orderBy(F.desc(relevance), "rank")
    gain = lambda r: F.col(relevance) / F.log2(r + 1)
    sums = results.withColumn("ideal_rank", F.row_number().over(w)).groupBy(by).agg(F.sum(gain(F.col("rank"))).alias("dcg"), F.sum(gain(F.col("ideal_rank"))).alias("ideal"))
    return sums.select(by, F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def _pairs(results: DataFrame, by: str, vector: str) -> DataFrame:
    """Cosines of the pairs of results of one query; a query has k results."""
    a, b = results.select(by, F.col("rank").alias("r1"), F.col(vector).alias("v1")), results.select(by, F.col("rank").alias("r2"), F.col(vector).alias("v2"))
    return a.join(b, by).where("r1 < r2").select(by, cosine(F.col("v1"), F.col("v2")).alias("sim"))


def coherence(results: DataFrame, *, by: str = "query_id", vector: str = "embedding") -> DataFrame:
    """(query, coherence, complementarity): the mean cosine of its pairs, and one less it; a single result is 1 and 0."""
    means = _pairs(results, by, vector).groupBy(by).agg(F.avg("sim").alias("m"))
    return results.select(by).distinct().join(means, by, "left").select(by, F.coalesce("m", F.lit(1.0)).alias("coherence"), (1 - F.coalesce("m", F.lit(1.0))).alias("complementarity"))


def marginal_relevance(results: DataFrame, *, by: str = "query_id", vector: str = "embedding") -> DataFrame:
    """(query, mean_score, redundancy, marginal): mean score less the mean cosine of its pairs."""
    means = _pairs(results, by, vector).groupBy(by).agg(F.avg("sim").alias("redundancy"))
    own = results.groupBy(by).agg(F.avg("score").alias("mean_score")).join(means, by, "left")
    return own.select(by, "mean_score", F.coalesce("redundancy", F.lit(0.0)).alias("redundancy"), (F.col("mean_score") - F.coalesce("redundancy", F.lit(0.0))).alias("marginal"))


def cluster_quality(rows: DataFrame, *, label: str, vector: str, width: int) -> DataFrame:
    """(intra, inter): mean cosine of pairs with equal and with different labels, over all pairs, without forming any.

    The sum of the cosines of all pairs of a set is (|sum of unit vectors|^2 - number of unit vectors) / 2.
    """
    norm = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = rows.where(F.col(label).isNotNull()).select(label, F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0)).alias("u"), (norm > 0).cast("long").alias("has"))
    sums = unit.groupBy(label).agg(*[F.sum(F.get("u", F.lit(i))).alias(f"s{i}") for i in range(width)], F.count("*").alias("n"), F.sum("has").alias("m"))
    square = lambda cs: sum((c * c for c in cs), F.lit(0.0))
    per = sums.withColumn("own", (square(F.col(f"s{i}") for i in range(width)) - F.col("m")) / 2).withColumn("pairs", F.col("n") * (F.col("n") - 1) / 2)
    total = per.agg(F.sum("own").alias("own"), F.sum("pairs").alias("pairs"), F.sum("n").alias("n"), F.sum("m").alias("m"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])
    every = (square(F.col(f"s{i}") for i in range(width)) - F.col("m")) / 2
    rest = F.col("n") * (F.col("n") - 1) / 2 - F.col("pairs")
    ratio = lambda a, b: F.when(b > 0, a / b)
    return total.select(ratio(F.col("own"), F.col("pairs")).alias("intra"), ratio(every - F.col("own"), rest).alias("inter"))


def scope(results: DataFrame, *, by: str = "query_id") -> DataFrame:
    """(query, scope, efficiency): share of results of any relevance, and share of their characters."""
    hit = F.col("relevance") > 0
    chars = F.sum("n_chars")
    return results.groupBy(by).agg(F.avg(hit.cast("double")).alias("scope"), F.when(chars > 0, F.sum(F.when(hit, F.col("n_chars")).otherwise(0)) / chars).otherwise(0.0).alias("efficiency"))


def quality_index(scores: DataFrame, *, category: str = "category") -> DataFrame:
    """(category, n, rqi), and the whole as category `all`; components that are not there share their weight out."""
    have = {c: w for c, w in COMPONENTS.items() if c in scores.columns}
    whole = sum(have.values())
    per_query = scores.withColumn("_q", sum((F.col(c) * w / whole for c, w in have.items()), F.lit(0.0)))
    per = per_query.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("n"), F.avg("_q").alias("rqi"))
    weight = F.coalesce(*[F.when(F.col("category") == c, F.lit(w)) for c, w in CATEGORIES.items()], F.lit(0.0))
    total = per.withColumn("_w", weight).agg(F.sum("n").alias("n"), F.when(F.sum("_w") > 0, F.sum(F.col("rqi") * F.col("_w")) / F.sum("_w")).alias("rqi")).select(F.lit("all").alias("category"), "n", "rqi")
    return per.unionByName(total)


def cumulative(rows: DataFrame, scales: list[int], *, key: str) -> DataFrame:
    """`rows` with ``scale``, the least of `scales` whose sample has them; a larger sample holds the smaller ones. Rows beyond all are left out.

    The order is that of a hash of the key, so samples are the same in every run.
    """
    sizes = sorted(scales)
    first = rows.orderBy(F.xxhash64(key), key).limit(sizes[-1])  # a top-k of each task
    place = F.row_number().over(Window.orderBy(F.xxhash64(key), key))
    scale = F.coalesce(*[F.when(F.col("_place") <= n, F.lit(n)) for n in sizes])
    return first.withColumn("_place", place).withColumn("scale", scale).drop("_place")


def stratified(rows: DataFrame, n: int, *, stratum: str, key: str) -> DataFrame:
    """About n rows in proportion to the strata, one of each at least; the largest stratum takes the remainder."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("size"))
    all_of = Window.partitionBy()  # one row a stratum
    share = sizes.withColumn("take", F.least("size", F.greatest(F.lit(1), F.floor(F.lit(n) * F.col("size") / F.sum("size").over(all_of)))))
    rest = F.lit(n) - F.sum("take").over(all_of)
    largest = F.row_number().over(Window.orderBy(F.desc("size"), stratum)) == 1
    share = share.withColumn("take", F.when(largest, F.least("size", F.col("take") + F.greatest(rest, F.lit(0)))).otherwise(F.col("take")))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(key))
    # No stratum takes more than n rows, so each task passes on its first n of a stratum.
    return rows.withColumn("_place", place).where(F.col("_place") <= max(n, 1)).join(share.select(stratum, "take"), stratum).where("_place <= take").drop("_place", "take")


def first_hit(results: DataFrame, *, by: str = "query_id", win: float = 0.01) -> DataFrame:
    """(query, precision_at_1, margin, wins): whether the first result is relevant, and its lead over the second."""
    w = Window.partitionBy(by).orderBy("rank")
    own = results.withColumn("next", F.lead("score").over(w)).where("rank = 1")
    margin = F.col("score") - F.coalesce("next", F.lit(0.0))
    return own.select(by, (F.col("relevance") > 0).cast("int").alias("precision_at_1"), margin.alias("margin"), (margin > win).alias("wins"))


def by_type(answers: DataFrame, kind: str, metrics: list[str]) -> DataFrame:
    """Means by question type that skip null and NaN."""
    return answers.groupBy(kind).agg(F.count("*").alias("n"), *[F.avg(F.when(~F.isnan(m), F.col(m))).alias(m) for m in metrics])


def advantage(scores: DataFrame, *, strategy: str = "strategy", value: str = "rqi", contextual: str = "contextual") -> DataFrame:
    """(size, best_naive, contextual, percent): contextual against the best other strategy at each size."""
    sides = scores.groupBy("size").agg(F.max(F.when(F.col(strategy) == contextual, F.col(value))).alias("contextual"), F.max(F.when(F.col(strategy) != contextual, F.col(value))).alias("best_naive"), F.max_by(strategy, F.when(F.col(strategy) != contextual, F.col(value))).alias("naive"))
    return sides.withColumn("percent", F.when(F.col("best_naive") > 0, 100 * (F.col("contextual") / F.col("best_naive") - 1)))


def activated(results: DataFrame, *, by: str = "query_id", vector: str = "embedding", context: str = "document_name", least: float = 0.75) -> DataFrame:
    """(query, activated): pairs of a query's results from different contexts that are closer than `least`."""
    a, b = results.select(by, F.col("rank").alias("r1"), F.col(vector).alias("v1"), F.col(context).alias("c1")), results.select(by, F.col("rank").alias("r2"), F.col(vector).alias("v2"), F.col(context).alias("c2"))
    close = (cosine(F.col("v1"), F.col("v2")) > least) & ~F.col("c1").eqNullSafe(F.col("c2"))
    return a.join(b, by).where("r1 < r2").groupBy(by).agg(F.count_if(close).alias("activated"))


def evidence(records: DataFrame, *, key: str = "id", passages: str = "evidence") -> DataFrame:
    """(evidence_id, passage, n_records): distinct passages of all records under an id made of their text, and how many records cite each."""
    cited = records.select(key, F.explode(passages).alias("passage")).where("trim(passage) <> ''").distinct()
    return cited.groupBy("passage").agg(F.count("*").alias("n_records")).select(F.left(F.sha2("passage", 256), F.lit(16)).alias("evidence_id"), "passage", "n_records")

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.functions.stem import stem
from lodestream.operators import cohort, entities, search, store
from lodestream.operators.store import EntityStore, Store


def chunk_rows(spark, n, document="doc", width=4, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(document, i, f"[{document}]\n\ntext number {i}", f"[{document}]", [float(x) for x in rng.normal(size=width)]) for i in range(n)]
    return spark.createDataFrame(rows, "document_name string, chunk_index int, content string, breadcrumb string, embedding array<float>")


def test_store_adds_once_searches_and_deletes(spark, tmp_path):
    with Store(spark, str(tmp_path / "s"), width=4) as own:
        assert own.count() == 0 and own.add(chunk_rows(spark, 5)) == 5
        assert own.add(chunk_rows(spark, 5)) == 0
        assert own.add(chunk_rows(spark, 3, "other", seed=1)) == 3
        vector = own.chunks().where("document_name = 'doc' and chunk_index = 2").first().embedding
        best = own.search(list(vector), 3).collect()
        assert best[0].chunk_index == 2 and best[0].document_name == "doc" and abs(best[0].score - 1) < 1e-6
        assert [r.score for r in best] == sorted((r.score for r in best), reverse=True)
        assert [(r.document_name, r.chunk_index) for r in own.all_chunks().collect()] == [("doc", i) for i in range(5)] + [("other", i) for i in range(3)]
        queries = spark.createDataFrame([(1, [float(x) for x in vector], "number 2"), (2, [0.0] * 4, "absent")], "query_id long, embedding array<float>, text string")
        found = own.hybrid(queries, 2).collect()
        assert {(r.query_id, r.rank) for r in found} == {(1, 1), (1, 2), (2, 1), (2, 2)}
        assert next(r.id for r in found if (r.query_id, r.rank) == (1, 1)).startswith("doc_2_")
        assert own.delete_document("doc") == 5 and own.delete_document("doc") == 0 and own.count() == 3
        own.clear()
        assert own.count() == 0
    with pytest.raises(PermissionError):
        Store(spark, str(tmp_path / "s"), width=4, read_only=True).add(chunk_rows(spark, 1))
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path / "s"), width=8).add(chunk_rows(spark, 1))


def test_breadcrumbs_move(spark, tmp_path):
    rows = spark.createDataFrame([("d", 0, "[d > a]\n\nbody"), ("d", 1, "[TABLE:start]\n\nx"), ("d", 2, "plain")], "document_name string, chunk_index int, content string")
    own = Store(spark, str(tmp_path / "b"))
    own.add(rows)
    assert own.migrate_breadcrumbs() == 1
    got = {r.chunk_index: (r.breadcrumb, r.content) for r in own.chunks().collect()}
    assert got == {0: ("[d > a]", "body"), 1: (None, "[TABLE:start]\n\nx"), 2: (None, "plain")}
    assert {r.content for r in store.shown(own.chunks()).collect()} == {"[d > a]\n\nbody", "[TABLE:start]\n\nx", "plain"}


def test_entity_store(spark, tmp_path):
    own = EntityStore(spark, str(tmp_path / "e"))
    own.add_entities(spark.createDataFrame([("a", "A"), ("b", "B")], "entity_id string, name string"))
    own.add_entities(spark.createDataFrame([("a", "other"), ("c", "C")], "entity_id string, name string"))
    own.link(spark.createDataFrame([("c1", "a"), ("c1", "b"), ("c2", "a"), ("c1", "a")], "chunk_id string, entity_id string"))
    assert sorted(r.name for r in own.entities().collect()) == ["A", "B", "C"]
    assert sorted(r.name for r in own.entities_of("c1").collect()) == ["A", "B"] and own.entities_of().count() == 3
    own.unlink(spark.createDataFrame([("c2",)], "chunk_id string"))
    own.remove(spark.createDataFrame([("b",)], "entity_id string"))
    assert [(r.chunk_id, r.entity_id) for r in own.links().collect()] == [("c1", "a")]


def test_missing(spark):
    docs = spark.createDataFrame([("a", "m"), ("b", "m"), ("a", "n")], "doc string, model string")
    assert [tuple(r) for r in store.missing(docs, docs.where("doc = 'a' and model = 'm'"), ["doc", "model"]).orderBy("doc").collect()] == [("a", "n"), ("b", "m")]


@pytest.mark.parametrize(("word", "expected"), [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("filing", "file"), ("relational", "relat"), ("sky", "sky"), ("happy", "happi"), ("adoption", "adopt"), ("controlling", "control"), ("is", "is"), ("x2s", "x2s")])
def test_stems(word, expected):
    assert stem(word) == expected


def test_bm25_with_stems(spark):
    rows = spark.createDataFrame([(1, "connected connections"), (2, "a connected flight"), (3, "nothing"), (4, None)], "id long, text string")
    queries = spark.createDataFrame([(7, "Connecting")], "query_id long, text string")
    assert search.bm25(rows, queries, 5, key="id", query_key="query_id").count() == 0
    got = search.bm25(rows, queries, 5, key="id", query_key="query_id", stemmed=True, stop=("a",)).collect()
    assert [r.id for r in got] == [1, 2]


def test_rerank(spark):
    found = spark.createDataFrame([(1, 10, "q", "aa"), (1, 11, "q", "a"), (1, 12, "q", "aaa")], "query_id long, id long, query string, content string")
    got = search.reranked(found, lambda q, c: c.str.len().astype(float), 2).collect()
    assert [(r.rank, r.id) for r in got] == [(1, 12), (2, 10)]


def graph(spark, tmp_path):
    """Two pairs that often stand together, and one chunk with an entity of each."""
    rows = [("c1", "alpha beta"), ("c2", "Alpha, beta"), ("c3", "beta alpha"), ("c4", "gamma delta"), ("c5", "gamma-delta"), ("c6", "delta gamma"), ("c7", "alpha gamma"), ("c8", "alphabet soup"), ("c9", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, content string")
    vocabulary = entities.surfaces(spark.createDataFrame([(f"ent_{x}", x, x.title(), []) for x in ("alpha", "beta", "gamma", "delta")], "entity_id string, name string, display_name string, aliases array<string>"))
    return chunks, vocabulary


@pytest.mark.parametrize("method", ["dbscan", "agglomerative", "leiden"])
def test_clusters(spark, tmp_path, method):
    chunks, vocabulary = graph(spark, tmp_path)
    pairs = entities.cooccurrence(entities.match(chunks, vocabulary), 9, least=1)
    got = {(r.a, r.b): r.n for r in pairs.collect()}
    assert got == {("ent_alpha", "ent_beta"): 3, ("ent_delta", "ent_gamma"): 3, ("ent_alpha", "ent_gamma"): 1}
    labels = entities.cluster(pairs, vocabulary.select("entity_id").distinct(), method, eps=0.5, threshold=0.5, folder=str(tmp_path / method))
    own = entities.ClusterMap(labels, pairs)
    assert {tuple(r.members) for r in own.records().collect()} == {("ent_alpha", "ent_beta"), ("ent_delta", "ent_gamma")} and own.count() == 2
    assert {r.entity_id: r.members for r in own.neighbours().collect()}["ent_alpha"] == ["ent_beta"]
    own.save(str(tmp_path / f"{method}-map"))
    assert entities.ClusterMap.load(spark, str(tmp_path / f"{method}-map")).count() == 2


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        entities.cluster(None, None, "kmeans", folder="")


def test_entity_index(spark, tmp_path):
    chunks, vocabulary = graph(spark, tmp_path)
    own = entities.EntityIndex.build(chunks, vocabulary)
    own.save(str(tmp_path / "index"))
    own = entities.EntityIndex.load(spark, str(tmp_path / "index"))
    assert {r.entity_id: r.df for r in own.frequencies().collect()} == {"ent_alpha": 4, "ent_beta": 3, "ent_gamma": 4, "ent_delta": 3}
    assert [r.chunk_id for r in own.chunks_of("ent_beta", 1).collect()] == ["c3"]
    assert {r.entity_id for r in own.entities_of("c7").collect()} == {"ent_alpha", "ent_gamma"}
    score = own.association("c1", "ent_alpha").first().score
    assert abs(score - (0.4 * np.log(2) + 0.3 + 0.3 * np.log(9 / 4))) < 1e-9
    less = own.without(spark.createDataFrame([("c1",)], "chunk_id string"), 8)
    assert abs(less.association("c2", "ent_alpha").first().score - (0.4 * np.log(2) + 0.3 + 0.3 * np.log(8 / 3))) < 1e-9
    assert own.as_json().count() == own.scored.count()


def test_vocabulary_files(spark, tmp_path):
    (tmp_path / "v.txt").write_text("# a comment\nBig Ideas\n\nIQ\n")
    assert {r.entity_id for r in entities.read_vocabulary(spark, str(tmp_path / "v.txt")).collect()} == {"ent_big_ideas", "ent_iq"}
    (tmp_path / "v.json").write_text('[{"id": "e1", "name": "One", "aliases": ["Uno"]}, {"name": "Two"}]')
    got = entities.surfaces(entities.read_vocabulary(spark, str(tmp_path / "v.json")))
    assert {(r.surface, r.entity_id) for r in got.collect()} == {("one", "e1"), ("uno", "e1"), ("two", "ent_two")}


def test_recognisers_and_merge(spark):
    import re

    chunks = spark.createDataFrame([("c", "See (Big Ideas) and 42. Big"), ("d", None)], "chunk_id string, content string")
    spans = entities.found_by(chunks, lambda t: [(m.start(), m.end(), "NAME") for m in re.finditer(r"\(?[A-Z0-9]\w+(?: [A-Z]\w+)*\)?\.?", t)], labels=frozenset({"NAME"}))
    got = {(r.entity_id, r.surface, r.s, r.e) for r in spans.collect()}
    assert got == {("ent_see", "See", 0, 3), ("ent_big_ideas", "Big Ideas", 5, 14), ("ent_big", "Big", 24, 27)}
    vocabulary = spark.createDataFrame([("c", "v", 9, 14)], "chunk_id string, entity_id string, s int, e int")
    assert {r.entity_id for r in entities.merged(vocabulary, spans.select("chunk_id", "entity_id", "s", "e")).collect()} == {"v", "ent_see", "ent_big"}


def test_cohort(spark, tmp_path):
    vectors = spark.createDataFrame([(f"d{i // 3}_{i}", [float(x) for x in np.eye(9)[i] + 0.1]) for i in range(9)], "chunk_id string, embedding array<double>")
    chunks = vectors.select("chunk_id", F.split("chunk_id", "_")[0].alias("document_name"), F.split("chunk_id", "_")[1].cast("int").alias("chunk_index"), F.concat(F.lit("words "), "chunk_id").alias("content"))
    scored = spark.createDataFrame([("d0_0", "x", 1.0), ("d2_8", "x", 0.9), ("d2_7", "y", 0.5)], "chunk_id string, entity_id string, score double")
    clusters = spark.createDataFrame([("x", "x"), ("y", "x")], "entity_id string, label string")
    queries = vectors.where("chunk_id = 'd0_0'").select(F.lit(1).cast("long").alias("query_id"), "embedding", F.lit("words").alias("text"))
    o = cohort.CohortOptions(k=4, seed_factor=1)
    for text in (False, True):
        got = cohort.expand(vectors, queries, chunks, scored, clusters, o, text=text).orderBy("rank").collect()
        assert len(got) == 4 and got[0].chunk_id == "d0_0" and got[0].provenance == "seed"
    seeds = spark.createDataFrame([(1, 1, "d0_0")], "query_id long, rank int, id string")
    pooled = {r.chunk_id: (r.stage, r.linked_by, r.cluster) for r in cohort.pool(seeds, chunks, scored, clusters, o).collect()}
    assert pooled == {"d0_0": (0, None, None), "d0_1": (1, None, None), "d2_8": (2, "x", None), "d2_7": (3, "y", "x")}
    with pytest.raises(ValueError):
        cohort.CohortOptions(k=0)


def test_cumulative_samples_hold_the_smaller(spark):
    from lodestream.operators import metrics

    got = {r.id: r.scale for r in metrics.cumulative(spark.range(1000), [50, 10, 200], key="id").collect()}
    assert [sum(v == n for v in got.values()) for n in (10, 50, 200)] == [10, 40, 150]
    again = {r.id for r in metrics.cumulative(spark.range(1000).repartition(7), [10], key="id").collect()}
    assert again == {i for i, n in got.items() if n == 10}


def test_store_is_a_backend_and_versions_are_whole(spark, tmp_path):
    own = store.Store(spark, str(tmp_path / "s"), width=2)
    assert isinstance(own, store.VectorBackend)
    rows = spark.createDataFrame([("a", 0, "x", [1.0, 0.0]), ("b", 0, "y", [0.0, 1.0])], "document_name string, chunk_index int, content string, embedding array<float>")
    assert own.add(rows) == 2 and own.delete_document("a") == 1 and own.count() == 1
    names = sorted(f.name for f in (tmp_path / "s" / "versions").iterdir() if not f.name.startswith("."))
    assert names == ["000000000001.json", "000000000002.json"]


def test_merged_matches_count_what_is_left(spark):
    from lodestream.operators import entities

    v = spark.createDataFrame([("c", "v", 0, 4)], "chunk_id string, entity_id string, s int, e int")
    g = spark.createDataFrame([("c", "g", 2, 5), ("c", "g", 9, 12), ("c", "g", 20, 22), ("d", "g", 0, 3)], "chunk_id string, entity_id string, s int, e int")
    got = {(r.chunk_id, r.entity_id): (r.frequency, r.positions) for r in entities.merged_matches(v, g).collect()}
    assert got == {("c", "v"): (1, [0]), ("c", "g"): (2, [9, 20]), ("d", "g"): (1, [0])}

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestream.functions import arrow, extract
from lodestream.operators import chunking, entities, search


def made_texts(n, seed=0):
    rng = np.random.default_rng(seed)
    common = ["alpha", "beta", "gamma", "delta", "the", "of"]
    rows = [(i, " ".join([*rng.choice(common, rng.integers(1, 30)), f"rare{i % 17}", f"only{i}", "É3d x9"])) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (None, "alpha beta"), (n + 2, rows[3][1]), (n + 3, rows[3][1])]


QUERIES = [(0, "Alpha gamma rare3"), (1, "the d of of only7"), (2, "absent"), (3, "rare5 beta beta")]


def words(text):
    return re.findall("[a-z][a-z0-9]*", (text or "").lower())


def best(scores, k):
    found = []
    for q in {q for q, _ in scores}:
        own = sorted(((-round(s, 9), i) for (p, i), s in scores.items() if p == q))[:k]
        found += [(q, r, i, round(-s, 6)) for r, (s, i) in enumerate(own, 1)]
    return sorted(found)


def brute_bm25(rows, k):
    docs = {i: Counter(words(t)) for i, t in rows if i is not None}
    mean = np.mean([len(words(t)) for _, t in rows])
    scores = {}
    for q, text in QUERIES:
        for t in set(words(text)):
            df = sum(t in c for c in docs.values())
            for i, c in docs.items():
                if t in c:
                    w = math.log((len(rows) - df + 0.5) / (df + 0.5) + 1) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
                    scores[q, i] = scores.get((q, i), 0) + w
    return best(scores, k)


def brute_tfidf(rows, k):
    docs = {i: Counter(words(t)) for i, t in rows if i is not None}
    df = Counter(t for c in docs.values() for t in c)
    vector = lambda c: {t: n / sum(c.values()) * (math.log((len(rows) + 1) / (df[t] + 1)) + 1) for t, n in c.items() if df[t]}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    scores = {}
    for q, text in QUERIES:
        v = vector(Counter(words(text)))
        for i, c in docs.items():
            d = vector(c)
            if v.keys() & d.keys():
                scores[q, i] = sum(v[t] * d[t] for t in v.keys() & d.keys()) / norm(v) / norm(d)
    return best(scores, k)


@pytest.mark.parametrize("frequent", [4, 200_000])
def test_text_search_is_exact_and_shuffles_only_the_best(spark, monkeypatch, frequent):
    monkeypatch.setattr(search, "BROADCAST_TERMS", frequent)  # 4: several parts of the queries, and almost all terms are rare
    made = made_texts(120)
    rows, queries = spark.createDataFrame(made, "id long, text string").repartition(5), spark.createDataFrame(QUERIES, "q long, text string")
    for f, brute in ((search.bm25, brute_bm25), (search.tfidf, brute_tfidf)):
        for k in (3, 200):
            found = f(rows, queries, k, key="id", query_key="q")
            assert sorted((r.query_id, r.rank, r.id, round(r.score, 6)) for r in found.collect()) == brute(made, k)
    plan = search.bm25(rows, queries, 3, key="id", query_key="q")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan  # no postings, and no pairs of a row and a query


def test_stems_and_string_ids(spark):
    rows = spark.createDataFrame([("a", "connected 7cats"), ("b", "connection"), ("c", "dogs")], "id string, text string")
    queries = spark.createDataFrame([("q", "connecting cat")], "q string, text string")
    got = [r.id for r in search.bm25(rows, queries, 5, key="id", query_key="q", stemmed=True).collect()]
    assert got == ["a", "b"]
    assert search.bm25(rows, queries.where("false"), 5, key="id", query_key="q").count() == 0
    assert search.tfidf(rows.where("false"), queries, 5, key="id", query_key="q").count() == 0


def test_vectors_of_words_that_cancel_out(spark):
    cells = spark.range(3000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("w")).withColumn("h", F.xxhash64("w"))
    own = {}
    for r in cells.select("w", F.pmod("h", F.lit(64)).alias("i"), F.pmod(F.shiftright("h", 32), F.lit(2)).alias("s")).collect():
        own.setdefault((r.i, r.s), r.w)
    text = f"{own[5, 0]} {own[5, 1]}"
    rows = spark.createDataFrame([(1, text), (2, f"{text} other")], "id long, text string")
    got = {r.id: r.embedding for r in search.hashed_vectors(rows, "id").collect()}
    assert got[1] == [0.0] * 64 and abs(sum(x * x for x in got[2]) - 1) < 1e-9


def test_nearest_breaks_ties_by_id_and_blocks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_BYTES", 8 * 3 * 10)
    rows = [(i, [1.0, 1e-7 * (i % 3), 0.0]) for i in range(100)] + [(100, None), (101, []), (102, [None, 1.0, 0.0]), (103, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = search.nearest(df.repartition(3), df.where("id in (0, 102)").select(F.col("id").alias("q"), "v"), 5, key="id", query_key="q", vector="v").collect()
    assert sorted((r.query_id, r.rank, r.id) for r in got if r.query_id == 0) == [(0, r + 1, r) for r in range(5)]
    assert [r.id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 102][:2] == [102, 103]
    batch = pa.RecordBatch.from_pydict({"id": [r[0] for r in rows], "v": [r[1] for r in rows]}, pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64()))]))
    blocks = list(search._matrices("id", search.ROW_BLOCK)(iter([batch])))
    assert sum(len(b["ids"][0].as_py()) // 8 for b in blocks) == len(rows) and max(len(b["matrix"][0].as_py()) for b in blocks) <= 8 * 3 * 10


def test_slices_keep_all_rows_in_small_parts():
    texts = ["x" * (i % 50) for i in range(500)] + [None, "y" * 5000, ""]
    parts = list(arrow.slices([pa.RecordBatch.from_pydict({"t": texts})], "t", limit=200, rows=40))
    assert [t for p in parts for t in p["t"].to_pylist()] == texts
    assert all(p.num_rows <= 40 and (p.num_rows == 1 or sum(len(t or "") for t in p["t"].to_pylist()) <= 200) for p in parts)


def test_workers_hold_few_rows_at_once(spark):
    """Matches, chunks and pages leave a worker slice by slice, and batches that go to it are small."""
    batch = pa.RecordBatch.from_pydict({"id": [str(i) for i in range(3000)], "t": ["some words " * 300] * 3000})
    out = list(entities._matcher([("words", "w")], False)(iter([batch])))
    assert len(out) > 5 and sum(b.num_rows for b in out) == 300 * 3000
    rows = spark.createDataFrame([("a", "some words")], "name string, text string")
    pages = rows.select(F.col("name").alias("path"), F.lit("html").alias("doc_type"), F.encode("text", "UTF-8").alias("data"))
    for run in (lambda: chunking.chunk(rows), lambda: entities.match(rows, rows.selectExpr("'words' as surface", "'w' as entity_id"), key="name", text="text"), lambda: extract.extracted(pages)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        assert run().count() == 1
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= arrow.ROWS

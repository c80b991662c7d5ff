"""Weak supervision: held-out accuracy on the driver's labels, what may be an input of a score, and odd tables."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm import toxicity

SF = "/root/testdata/sf0.1"  # 97 toxic rows are held out here, 6 in the next smaller table


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return toxicity.train(*tables)


def test_held_out_accuracy(spark, tables, model):
    """Bounds: three standard errors from what five folds of the training rows gave (332 of 352 caught, 9 of 2803 rejected)."""
    docs, labels = tables
    rows = toxicity.score(docs, model).join(labels, "doc_id").select("doc_id", "toxic_score", "toxic", toxicity.held_out().alias("held")).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.toxic_score <= 1 for r in rows)
    for y, rate in ((1, 332 / 352), (0, 9 / 2803)):
        own = [r.toxic_score >= 0.5 for r in rows if r.held and r.toxic == y]
        assert abs(sum(own) - rate * len(own)) <= 3 * (len(own) * rate * (1 - rate)) ** 0.5 + 1


def test_held_out_labels_do_not_matter(tables, model):
    docs, labels = tables
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, turned).weights == pytest.approx(model.weights)


def test_other_columns_do_not_matter(spark, tables, model):
    docs = tables[0].limit(50)
    other = docs.withColumns({"lang": F.lit("x"), "source": F.lit("toxic"), "doc_id": F.col("doc_id") + 10_000, "toxic_score": F.lit("clash"), "_toxic": F.lit(1)})
    a = {r.text: r.toxic_score for r in toxicity.score(docs, model).collect()}
    scored = toxicity.score(other, model)
    assert set(scored.columns) == set(other.columns)
    assert {r.text: r.toxic_score for r in scored.collect()} == a


def test_odd_rows(spark, model):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "x" * 100_000), (3, "1 2 3")], "doc_id long, text string")
    got = toxicity.score(docs, model).collect()
    assert len(got) == 5 and len({r.toxic_score for r in got if not r.text}) == 1
    assert all(r.toxic_score < 0.5 for r in got)


def test_tables_without_rows_or_labels(spark, tables):
    docs, labels = tables
    none = labels.where("false")
    assert toxicity.rejected_removed(docs.limit(20), none).count() <= 20
    empty = docs.where("false")
    assert toxicity.rejected_removed(empty, labels).count() == 0
    odd = spark.createDataFrame([(None, 1, 1), (5, None, None), (5, 1, 1), (6, 0, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs.limit(20), toxicity.train(docs.limit(20), odd)).count() == 20


def sampled(rng, share, rate, parent, table, n):
    """Votes and classes of n documents drawn from a tree; parents come first."""
    y = (rng.random(n) < share).astype(int)
    x = np.zeros((n, len(parent)), int)
    for j, p in enumerate(parent):
        odds = rate[y, j] if p < 0 else table[y, j, x[:, p]]
        x[:, j] = rng.random(n) < odds
    return x, y


def test_posterior_is_that_of_all_vote_patterns():
    """Against Bayes' rule over the joint probability of every pattern, written out."""
    rng = np.random.default_rng(3)
    parent = np.array([-1, 0, 0, 2])
    table = rng.uniform(0.05, 0.95, (2, 4, 2))
    model = toxicity.LabelModel(0.2, None, parent, table, None, None)
    for mask in range(16):
        bits = [mask >> j & 1 for j in range(4)]
        joint = []
        for c, p in ((0, 0.8), (1, 0.2)):
            for j, b in enumerate(bits):
                on = table[c, j, 0 if parent[j] < 0 else bits[parent[j]]]
                p *= on if b else 1 - on
            joint.append(p)
        assert model.posterior(np.array([mask]))[0] == pytest.approx(joint[1] / sum(joint))


def test_label_model_finds_accuracies_edges_and_classes():
    rng = np.random.default_rng(0)
    voters = 6
    parent = [-1, -1, -1, 0, -1, -1]  # the fourth mostly says what the first says
    rate = np.array([[0.02, 0.05, 0.03, 0.0, 0.04, 0.5], [0.6, 0.5, 0.7, 0.0, 0.4, 0.5]])
    table = np.zeros((2, voters, 2))
    table[:, 3] = [0.01, 0.95]
    x, y = sampled(rng, 0.15, rate, parent, table, 40_000)
    known = np.where(rng.random(40_000) < 0.2, y, -1)  # a fifth of the documents is labelled
    masks, where = np.unique(x @ (1 << np.arange(voters)), return_inverse=True)
    rows, counts = np.unique(np.stack([masks[where], known], 1), axis=0, return_counts=True)
    first = np.where(rows[:, 0] & 0b10111, 0.7, 0.05)
    model = toxicity.fit_labels(rows[:, 0], rows[:, 1], counts.astype(float), 0.1, voters=voters, first=first)
    assert model.parent[3] == 0 or model.parent[0] == 3
    assert model.correlations[0, 3] > 0.8 and abs(model.correlations[1, 2]) < 0.1
    assert np.abs(model.rate[:, :3] - rate[:, :3]).max() < 0.05 and abs(model.share - 0.15) < 0.02
    assert model.accuracies[0] == pytest.approx((x[:, 0] * y).sum() / x[:, 0].sum(), abs=0.05)
    # As good as the classes' true probabilities, counted over all documents of each pattern.
    right = (model.posterior(masks)[where] >= 0.5) == y
    best = np.maximum(np.bincount(where, y), np.bincount(where, 1 - y)).sum() / len(y)
    assert right.mean() >= best - 0.005


def test_a_voter_that_repeats_another_adds_nothing():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.2
    one = np.stack([np.where(y, rng.random(20_000) < a, rng.random(20_000) < b) for a, b in ((0.6, 0.1), (0.5, 0.05), (0.7, 0.2))], 1).astype(int)
    labelled = rng.random(20_000) < 0.2
    again = np.concatenate([one, one[:, :1], one[:, :1]], 1)
    out = []
    for x in (one, again):
        n = x.shape[1]
        masks, where = np.unique(x @ (1 << np.arange(n)), return_inverse=True)
        rows, counts = np.unique(np.stack([masks[where], np.where(labelled, y, -1)], 1), axis=0, return_counts=True)
        model = toxicity.fit_labels(rows[:, 0], rows[:, 1], counts.astype(float), 0.2, voters=n, first=np.where(np.bitwise_count(rows[:, 0] & 7) >= 2, 0.8, 0.1))
        out.append(model.posterior(masks)[where])
    assert np.abs(out[0] - out[1]).max() < 0.1


def test_unlabelled_documents_weigh_alike_at_every_size():
    masks, known = np.array([1, 0, 1, 0]), np.array([1, 0, -1, -1])
    a, b = (toxicity.fit_labels(masks, known, np.array([50.0, 500, n, 20 * n]), voters=4) for n in (1e3, 1e7))
    assert a.posterior(np.array([0, 1])) == pytest.approx(b.posterior(np.array([0, 1])))


def test_terms_of_one_stem_share_a_voter_and_none_is_dropped():
    terms = {"schwein": 2.0, "schw*": 3.1, "schwachkopf": 2.2, "mist": 1.6, "depp": 9.0}
    own = toxicity.families(terms)
    assert sorted(t for v in own for t in v) == sorted(terms)
    assert sum("schwein" in v and "schw*" in v and "schwachkopf" in v for v in own) == 1
    assert "depp" in own[-1] and "mist" in own[0]


def test_lexicon_words_count_beside_terms(spark, tables, model):
    assert set(model.weights) >= toxicity.LEXICON and {f"#{i}" for i in range(toxicity.VOTERS)} <= set(model.weights)
    docs = spark.createDataFrame([(1, "du bist ein arschloch und ein schwachkopf , ein dummkopf"), (2, "le salaud est un connard , un abruti"), (3, "a signal to kill the process")], "doc_id long, text string")
    scores = {r.doc_id: r.toxic_score for r in toxicity.score(docs, model).collect()}
    assert scores[1] >= 0.5 and scores[2] >= 0.5 and scores[3] < 0.5


def test_one_model_form_without_terms(spark, tables):
    few = toxicity.train(tables[0].limit(50), tables[1].where("false"))
    docs = spark.createDataFrame([(1, "we took the trash out"), (2, "you pathetic worthless moron")], "doc_id long, text string")
    scores = {r.doc_id: r.toxic_score for r in toxicity.score(docs, few).collect()}
    assert set(few.weights) >= toxicity.LEXICON and scores[1] < 0.5 <= scores[2]


def test_clashing_column_stays(spark, tables):
    docs = tables[0].limit(30).withColumn("toxic_score", F.lit("mine"))
    kept = toxicity.rejected_removed(docs, tables[1])
    assert kept.columns == docs.columns and {r.toxic_score for r in kept.collect()} == {"mine"}

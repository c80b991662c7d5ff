"""Near duplicates against all pairs, and the estimate of the signatures."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("xxhash")
from lodestream.llm import bagminhash as near


def bag(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))


def brute(docs):
    """doc_id -> least doc_id of its component; equal ids are one document."""
    parent = {i: i for i, _ in docs if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [(i, bag(t)) for i, t in docs if i is not None]
    for k, (i, a) in enumerate(bags):
        for j, b in bags[:k]:
            if a and b and (same := sum((a & b).values())) and 5 * same >= 4 * (sum(a.values()) + sum(b.values()) - same):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in parent}


def made(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    docs = [(None, "a b c d e f g"), (None, None), (900, ""), (901, None), (902, " \n"), (903, "one two"), (904, "one  two"), (905, "one two three"), (906, "x " * 200), (907, "x " * 230), (908, "x " * 400), (909, "one two")]
    n = 0
    for _ in range(12):  # chains of edits, so that ends of a class are less alike than 0.8
        text = [rng.choice(words) for _ in range(rng.randrange(40, 160))]
        for _ in range(rng.randrange(1, 9)):
            docs.append((n, " ".join(text)))
            n += 1
            for _ in range(rng.randrange(1, 3)):
                text[rng.randrange(len(text))] = rng.choice(words)
    docs += [(n + i, t) for i, (_, t) in enumerate(docs[20:26])] + docs[30:32]
    ids = [i for i, _ in docs if i is not None and i < 900]
    swap = dict(zip(ids, rng.sample(ids, len(ids)), strict=True)) if len(set(ids)) == len(ids) else {}
    docs = [(swap.get(i, i), t) for i, t in docs]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("seed", "cell"), [(0, 2048), (1, 2048), (2, 3)])
def test_classes(spark, seed, cell, monkeypatch):
    monkeypatch.setattr(near, "CELL", cell)
    docs = made(seed)
    frame = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, digest string").repartition(4)
    got = near.classes(frame).collect()
    assert len(got) == len(docs)
    expected = brute(docs)
    assert {(r.doc_id, r.class_id) for r in got if r.doc_id is not None} == set(expected.items())
    assert all(r.class_id is None for r in got if r.doc_id is None)
    if seed == 0:
        kept = near.first_of_each(frame)
        assert kept.columns == ["doc_id", "text", "digest"]
        rows = kept.collect()
        assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(set(expected.values()))
        assert sum(r.doc_id is None for r in rows) == 2


def test_ids_with_several_texts(spark):
    a, b, c = ("w%d " * 30 % tuple(range(k, k + 30)) for k in (0, 100, 200))
    docs = [(5, a), (5, b), (9, b), (7, a), (8, c), (5, a)]
    got = near.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(5, 5), (5, 5), (5, 5), (7, 5), (8, 8), (9, 5)]


def test_first_of_each_is_one_row_whatever_the_order(spark):
    a, b = ("w%d " * 30 % tuple(range(k, k + 30)) for k in (0, 100))
    rows = [(5, a, 1, "x", 2), (5, b, 2, "y", 3), (5, a, 3, "z", 1), (6, a, 4, "v", 9), (None, a, 5, "u", 7), (8, None, 6, "t", 8)]
    got = []
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        frame = spark.createDataFrame(order, "doc_id long, text string, _id int, digest string, _kept int").repartition(3)
        kept = near.first_of_each(frame)
        assert kept.columns == frame.columns
        got.append(sorted(map(tuple, kept.collect()), key=repr))
    assert got[0] == got[1] == got[2]
    assert [r[0] for r in got[0]] == [5, 8, None] and set(got[0]) <= set(rows)


@pytest.mark.parametrize("texts", [[], [None], ["", "  "], ["a b  c\t", "\n\x0bé x" + "y" * 20, None, "z", " "]])
def test_words(texts):
    code, first, size, starts = near.words(*near.flattened(pa.array(texts, pa.string())))
    expected = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert np.diff(starts).tolist() == [len(w) for w in expected]
    assert len(set(code.tolist())) == len({w for ws in expected for w in ws})
    assert near.words(*near.flattened(pa.array(["q", *texts], pa.string()).slice(1)))[0].tolist() == code.tolist()


def test_cells_give_few_links():
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2
    n = 40
    texts = [text + f"end{i}" for i in range(n)]
    of, hashed, count = near.multisets(pa.array(texts))
    sig = near.signatures(of, hashed, count, n, near.BANDS * near.ROWS).view(np.uint64)
    sketch = [(near.mix(s) & near.U(255)).astype(np.uint8).tobytes() for s in sig]
    rows = {"slot": [0] * n, "side": [0] * n, "node": list(range(n)), "label": list(range(n)), "sketch": sketch, "bands": [[7] * near.BANDS] * n, "text": texts}
    assert near._linked_cells(pa.table(rows)).num_rows == n - 1


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(1)
    a = Counter({i: rng.randrange(1, 40) for i in range(200)})
    b = Counter({i: max(1, c + rng.randrange(-9, 9)) for i, c in a.items() if i % 7})
    true = sum((a & b).values()) / sum((a | b).values())
    of = np.repeat([0, 1], [len(a), len(b)])
    hashed = near.mix(np.array([*a, *b], np.uint64) + near.U(99))
    sig = near.signatures(of, hashed, np.array([*a.values(), *b.values()]), 2, 8192)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.02


def test_empty(spark):
    assert near.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0

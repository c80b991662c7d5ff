"""Substring dedup of words and bytes against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

pytest.importorskip("xxhash")
from lodestream.llm import repeats, suffix_array, suffix_tree


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array(seed):
    rng = random.Random(seed)
    s = [rng.randrange(rng.choice([1, 2, 3, 20])) for _ in range(rng.randrange(0, 120))]
    if seed % 4 == 0:
        s = s[:7] * 9
    assert suffix_array.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute(docs, length, units):
    """doc_id -> which units go."""
    least = {}
    cut = [(i, units(t)) for i, t in docs]
    for i, u in cut:
        if i is not None:
            for a in range(len(u) - length + 1):
                w = tuple(u[a : a + length])
                least[w] = min(least.get(w, i), i)
    out = []
    for i, u in cut:
        gone = [False] * len(u)
        if i is not None:
            for a in range(len(u) - length + 1):
                if least[tuple(u[a : a + length])] < i:
                    gone[a : a + length] = [True] * length
        out.append((i, u, gone))
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def made(seed, n=60):
    """Documents that share passages at random cuts, with copies, edits, runs, blanks and nulls."""
    rng = random.Random(seed)
    vocabulary = ["ab", "b", "é", "aba", "日本", "c,", "dd"] + [f"w{i}" for i in range(300)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(30, 200))] for _ in range(6)]
    docs = [(None, None), (None, " ".join(passages[0])), (500, None), (501, ""), (502, " \n\t "), (503, "x " * 300), (2, "x " * 120), (504, "a" * 400), (3, "a" * 90)]
    for i in range(n):
        own = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 80))]
        p = rng.choice(passages)
        a = rng.randrange(len(p))
        own += p[a : a + rng.randrange(20, 150)]
        if rng.random() < 0.3 and own:
            own[rng.randrange(len(own))] = "edit"
        own += [rng.choice(vocabulary) for _ in range(rng.randrange(0, 30))]
        docs.append((rng.randrange(1000), rng.choice([" ", "  ", "\n"]).join(own)))
    docs += [(i + 2000, t) for i, t in docs[9:15] if i is not None] + docs[20:23]
    rng.shuffle(docs)
    return docs


def frame(spark, docs, parts=5):
    return spark.createDataFrame([(i, t, "clash", 7) for i, t in docs], "doc_id long, text string, block string, n_chars long").repartition(parts)


@pytest.mark.parametrize("hot", [2000, 2])
@pytest.mark.parametrize("seed", range(2))
def test_words(spark, seed, hot, monkeypatch):
    docs = made(seed)
    expected = sorted(((i, len(u), sum(g), hashlib.sha256(" ".join(w for w, x in zip(u, g, strict=True) if not x).encode()).hexdigest()) for i, u, g in brute(docs, 50, words)), key=repr)
    own = suffix_tree.spec(block_bytes=20_000)
    run = hot_run(hot)
    got = run(lambda: [tuple(r) for r in suffix_tree.dedup(frame(spark, docs), own).collect()], monkeypatch)
    assert sorted(got, key=repr) == expected


def hot_run(hot):
    """Functions are pickled by reference, so workers see another limit only through their own copy of the module."""

    def run(work, monkeypatch):
        if hot == 2000:
            return work()
        real = repeats._repeated

        def told(table):
            repeats.HOT = hot
            return real(table)

        monkeypatch.setattr(repeats, "_repeated", told)
        return work()

    return run


@pytest.mark.parametrize("hot", [2000, 2])
@pytest.mark.parametrize("seed", range(2))
def test_bytes(spark, seed, hot, monkeypatch):
    docs = made(seed + 10)
    expected = []
    for i, u, g in brute(docs, 50, lambda t: (t or "").encode()):
        spans = sum(1 for k, x in enumerate(g) if x and (k == 0 or not g[k - 1]))
        expected.append((i, len(u), sum(g), spans, hashlib.sha256(bytes(b for b, x in zip(u, g, strict=True) if not x)).hexdigest()))
    got = hot_run(hot)(lambda: [tuple(r) for r in suffix_array.dedup(frame(spark, docs), suffix_array.spec(block_bytes=20_000)).collect()], monkeypatch)
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    if hot == 2000 and seed == 0:
        rows = suffix_array.deduplicated(frame(spark, docs)).collect()
        assert len(rows) == len(docs) and set(rows[0].asDict()) == {"doc_id", "text", "block", "n_chars"}
        assert all(r.n_chars == len(r.text) and r.block == "clash" for r in rows)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_tree.dedup(empty).count() == 0
    assert suffix_array.dedup(empty).count() == 0


@pytest.mark.parametrize("resolve", [suffix_tree.deep_nodes, suffix_array.shared_windows])
def test_resolvers(resolve):
    rng = np.random.default_rng(0)
    base = rng.integers(1, 200, 90).astype(np.uint8)
    sequences = [base, np.append(rng.integers(1, 200, 20), base[10:75]).astype(np.uint8), base[:60], rng.integers(1, 200, 80).astype(np.uint8)]
    if resolve is suffix_tree.deep_nodes:
        sequences = [s.astype(np.uint64) for s in sequences]
    v, offset, cls = resolve(np.zeros(4, np.int64), sequences)
    seen = {}
    for s, a, c in zip(v.tolist(), offset.tolist(), cls.tolist(), strict=True):
        assert seen.setdefault(c, tuple(sequences[s][a : a + 50])) == tuple(sequences[s][a : a + 50])
    assert set(v.tolist()) == {0, 1, 2}
    assert len(v) == 11 + 16 + 26 and len(seen) == 26


def test_holders():
    texts = [b"abc", b"ab", b"bc", b"xabc", b"q", b"abc", b"c"]
    got = suffix_array.holders(texts)
    assert all(t == w[k : k + len(t)] for t, (w, k) in zip(texts, got, strict=True))
    assert {w for w, _ in got} == {b"xabc", b"q"}


@pytest.mark.parametrize("seed", range(4))
def test_window_classes(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(3, 20))).encode() for _ in range(12)]
    cls = suffix_array.window_classes(texts, 3)
    seen, at = {}, 0
    for t in texts:
        for i in range(len(t) - 2):
            assert seen.setdefault(int(cls[at + i]), t[i : i + 3]) == t[i : i + 3]
        at += len(t) + 1
    assert len(seen) == len({t[i : i + 3] for t in texts for i in range(len(t) - 2)})


@pytest.mark.parametrize("group", [4096, 3])
@pytest.mark.parametrize("seed", range(4))
def test_maximal_repeats(seed, group, monkeypatch):
    """Against all repeats of all lengths: one is maximal if its places differ in the word before and in the word behind."""
    monkeypatch.setattr(suffix_tree, "GROUP", group)
    rng = np.random.default_rng(seed)
    base = rng.integers(1, 4, 30)
    sequences = [np.concatenate([rng.integers(1, 4, rng.integers(0, 6)), base[rng.integers(0, 10) : rng.integers(12, 30)], rng.integers(1, 4, rng.integers(0, 6))]).astype(np.uint64) for _ in range(9)]
    sequences += [sequences[0].copy(), np.full(20, 7, np.uint64), np.zeros(0, np.uint64)]
    length = 5
    places = {}
    for i, s in enumerate(sequences):
        for a in range(len(s)):
            for b in range(a + length, len(s) + 1):
                places.setdefault(tuple(s[a:b].tolist()), []).append((i, a))
    expected = []
    for words, at in places.items():
        before = {int(sequences[i][a - 1]) if a else (i, a) for i, a in at}
        behind = {int(sequences[i][a + len(words)]) if a + len(words) < len(sequences[i]) else (i, a) for i, a in at}
        if len(at) > 1 and len(before) > 1 and len(behind) > 1:
            expected.append((words, sorted(at)))
    assert sorted(suffix_tree.maximal_repeats(sequences, length)) == sorted(expected)


def test_messages_lie_in_one_row_for_a_slot():
    import pyarrow as pa

    names = [f"{part:06d}-{piece:05d}" for part in range(32) for piece in range(4)]
    held = np.bincount([repeats.block_slot(x, 51) for x in names], minlength=51)
    assert held.max() <= 4 and held.min() >= 1
    tables = [pa.Table.from_batches([repeats._rows(x, [(i, 0, b"x" * i) for i in range(7)])]) for x in names]
    rows = list(repeats.sent(iter(tables), lambda t: t["bucket"].to_numpy()))
    assert sum(b.num_rows for b in rows) == 7
    back = list(repeats.received(iter(rows), "block"))
    assert sorted(t["block"][0].as_py() for t in back) == names and all(t.num_rows == 7 for t in back)

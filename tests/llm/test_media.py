"""Copies of images against all pairs, and shapes that must not break anything."""

import time

import numpy as np
import pytest

from lodestream.llm import media


def texture(seed, size=64):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:size, 0:size] / size
    waves = sum(np.cos(2 * np.pi * (u * x + v * y) + p) * w for u, v, p, w in zip(rng.uniform(-9, 9, 24), rng.uniform(-9, 9, 24), rng.uniform(0, 6.28, 24), rng.normal(size=24), strict=True))
    return np.clip(128 + 20 * waves, 0, 255).astype(np.uint8)


def images():
    rows = [(None, media.pgm(texture(0))), (None, None), (900, None), (901, b""), (902, b"P5 nonsense"), (903, b"P5 9 9 255\n" + b"x" * 81), (904, media.pgm(np.zeros((64, 64), np.uint8))), (905, media.pgm(np.zeros((64, 64), np.uint8))), (906, b"P5 99 99 255\nshort")]
    for k in range(8):
        p = texture(k)
        rows += [(10 * k, media.pgm(p)), (10 * k + 1, media.pgm(p[5:60, 8:62])), (10 * k + 2, media.pgm((0.7 * p + 30).astype(np.uint8))), (10 * k + 3, media.pgm(np.rot90(p))), (10 * k + 4, media.pgm(p))]
    rows += [(7, media.pgm(texture(50))), (7, media.pgm(texture(51))), (8, media.pgm(texture(51))), (0, media.pgm(texture(0)))]
    return rows


def brute(rows):
    found = []
    for i, data in rows:
        pixels = media.decode(data)
        if i is not None and pixels is not None:
            _, geometry, bits = media.features(pixels[None])
            if len(bits):
                found.append((i, geometry.astype("<f4").astype(float), bits))
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, ga, da) in enumerate(found):
        for j, gb, db in found[:k]:
            if (ga.shape == gb.shape and (ga == gb).all() and (da == db).all()) or media.agree(*((ga, da), (gb, db)) if i < j else ((gb, db), (ga, da))) >= media.CONSENSUS:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in parent}


@pytest.mark.parametrize("cell", [512, 2])
def test_copies(spark, cell, monkeypatch):
    monkeypatch.setattr(media, "CELL", cell)
    rows = images()
    expected = brute(rows) | {905: 904}  # equal files are one node, with or without corners
    assert all(expected[10 * k + j] == 10 * k for k in range(1, 8) for j in range(5)) and len({expected[10 * k] for k in range(8)}) == 8
    got = media.classes(spark.createDataFrame([(i, d and bytearray(d), "clash") for i, d in rows], "image_id long, image binary, digest string").repartition(3)).collect()
    assert len(got) == len(rows)
    assert {(r.image_id, r.class_id) for r in got if r.image_id is not None} == set(expected.items())
    assert all(r.class_id is None for r in got if r.image_id is None)
    assert all((r.n_corners == 0) == (r.image_id in range(900, 907)) for r in got if r.image_id is not None)


def test_empty(spark):
    assert media.classes(spark.createDataFrame([], "image_id long, image binary")).count() == 0


def test_rendered(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i).normal(size=64)]) for i in range(20)] + [(None, None), (25, []), (31, [1.0] * 80), (3, None)]
    got = media.rendered(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(rows) and all(media.decode(r.image) is not None for r in got)
    classes = {r.image_id: r.class_id for r in media.classes(media.rendered(spark.createDataFrame(rows[:20], "vec_id long, embedding array<double>"))).collect()}
    assert [classes[i] for i in range(20)] == [0, 0, 0, 0, *range(4, 10), 10, 10, 10, 10, *range(14, 20)]


@pytest.mark.parametrize("change, least", [("noise", 0.97), ("half a pixel", 0.9)])
def test_recall_of_changed_copies(spark, change, least):
    rng = np.random.default_rng(1)
    own = [texture(1000 + k) for k in range(60)]
    if change == "noise":
        copies = [np.clip(np.rint(p + rng.normal(0, 25, p.shape)), 0, 255).astype(np.uint8) for p in own]
    else:
        copies = [np.rint((p[:-1, :-1].astype(float) + p[1:, :-1] + p[:-1, 1:] + p[1:, 1:]) / 4).astype(np.uint8) for p in own]
    sides = [[media.features(p[None])[1:] for p in side] for side in (own, copies)]
    agreeing = [k for k in range(60) if media.agree(sides[0][k], sides[1][k]) >= media.CONSENSUS]
    rows = [(100 * s + k, bytearray(media.pgm(p))) for s, side in enumerate((own, copies)) for k, p in enumerate(side)]
    found = {r.image_id: r.class_id for r in media.classes(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert len(agreeing) >= 50
    assert sum(found[k] == found[100 + k] for k in agreeing) >= least * len(agreeing)


def wave_image(seed, side=96, turn=0.0, scale=1.0, noise=0.0):
    """A texture drawn at any turn and size about its middle."""
    rng = np.random.default_rng(seed)
    waves = zip(rng.uniform(-9, 9, 24), rng.uniform(-9, 9, 24), rng.uniform(0, 6.28, 24), rng.normal(size=24), strict=True)
    y, x = (np.mgrid[0:side, 0:side] - (side - 1) / 2) / scale
    u, v = np.cos(turn) * x - np.sin(turn) * y, np.sin(turn) * x + np.cos(turn) * y
    p = 128 + 20 * sum(np.cos(2 * np.pi * (a * u + b * v) / 64 + c) * w for a, b, c, w in waves)
    return np.clip(np.rint(p + rng.normal(0, noise, p.shape) if noise else p), 0, 255).astype(np.uint8)


CHANGES = {
    "turned 5": {"turn": np.radians(5)}, "turned 15": {"turn": np.radians(15)}, "turned 30": {"turn": np.radians(30)}, "0.9 as large": {"scale": 0.9},
    "0.75 as large": {"scale": 0.75}, "1.25 as large": {"scale": 1.25}, "noise": {"noise": 30.0}, "middle half": {},
}


def test_recall_against_the_truth(spark):
    """Copies that were made, found by classes: at least 0.9 of each change; images that are no copies stay apart."""
    n = 30
    rows = [(k, wave_image(k)) for k in range(n)]
    for c, (name, own) in enumerate(CHANGES.items(), 1):
        rows += [(1000 * c + k, wave_image(k)[24:72, 24:72] if name == "middle half" else wave_image(k, **own)) for k in range(n)]
    got = {r.image_id: r.class_id for r in media.classes(spark.createDataFrame([(i, bytearray(media.pgm(p))) for i, p in rows], "image_id long, image binary").repartition(4)).collect()}
    found = {name: sum(got[1000 * c + k] == got[k] for k in range(n)) / n for c, name in enumerate(CHANGES, 1)}
    assert min(found.values()) >= 0.9, found
    assert len({got[k] for k in range(n)}) == n


def test_small_crops_of_large_images():
    rng = np.random.default_rng(5)
    for _ in range(2):
        noise = rng.normal(size=(1, 1100, 1000))
        p = media._box(media._box(noise, 3), 2)[0]
        p = np.clip(128 + 50 * p / p.std(), 0, 255).astype(np.uint8)
        whole = media.features(p[None])[1:]
        for y, x in ((301, 407), (37, 805)):
            crop = media.features(p[None, y : y + 161, x : x + 173])[1:]  # 2.5 % of the area, odd offsets
            assert media.agree(whole, crop) >= media.CONSENSUS
            assert media.agree(crop, whole) >= media.CONSENSUS


def test_many_copies_of_one_image(monkeypatch):
    """A third of a block is one image with noise: its members go on to meet only the others, and classes stay the same."""
    rng = np.random.default_rng(3)
    pixels = [np.clip(texture(7) + rng.normal(0, 8, (64, 64)), 0, 255).astype(np.uint8) for _ in range(40)] + [texture(100 + k // 2) for k in range(80)]
    parts = [media.features(p[None])[1:] for p in pixels]
    order = rng.permutation(120)
    blocks = [media.Block(np.sort(own), [parts[k] for k in np.sort(own)]) for own in (order[:60], order[60:])]

    def found():
        parent = list(range(120))
        for left, right in ((blocks[0], blocks[0]), (blocks[1], blocks[1]), (blocks[0], blocks[1])):
            for a, b in media.copies(left, right):
                assert a < b
                parent = [parent[a] if p == parent[b] else p for p in parent]
        return [parent.index(p) for p in parent]

    meetings = []
    whole = media.Block.taken
    monkeypatch.setattr(media.Block, "taken", lambda self, images: meetings.append(len(images)) or whole(self, images))
    expected = [0] * 40 + [40 + k // 2 * 2 for k in range(80)]
    assert found() == expected and not meetings
    monkeypatch.setattr(media, "TOGETHER", 1)
    assert found() == expected and meetings


@pytest.mark.parametrize("matrix", [32_000, 3_000])
def test_screening_loses_no_pair_that_agrees(monkeypatch, matrix):
    """All pairs of two blocks: what `agree` accepts is promising, whichever side has the smaller id, screened or too large for it."""
    monkeypatch.setattr(media, "MATRIX", matrix)
    sides = []
    for turn, nodes in ((0.0, range(0, 60, 2)), (0.3, range(1, 61, 2))):
        sides.append(media.Block(np.array(nodes)[:: -1 if turn else 1], [media._parts(g.astype("<f4").tobytes() + b.tobytes()) for _, g, b in (media.features(wave_image(k, 64, turn=turn)[None]) for k in range(30))]))
    left, right = sides
    i, j = (x.ravel() for x in np.meshgrid(np.arange(30), np.arange(30), indexing="ij"))
    good = media._promising(left, right, i, j)
    agreeing = np.array([media.agree(*((left.parts[a], right.parts[b]) if left.nodes[a] <= right.nodes[b] else (right.parts[b], left.parts[a]))) >= media.CONSENSUS for a, b in zip(i, j, strict=True)])
    assert agreeing.sum() >= 25 and (agreeing <= good).all()
    assert matrix < 32_000 or good.sum() < 2 * agreeing.sum()


def test_matches_are_those_of_agree():
    """Corners that are each other's nearest, against `_nearest`: repeated ones, and ones that differ in all 256 bits."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 256, (30, 32), np.uint8)

    def side(k):
        parts = []
        for _ in range(9):
            own = base[rng.integers(0, 30, 25)] ^ (rng.random((25, 32)) < 0.25).astype(np.uint8)
            parts.append((np.ones((28, 4)), np.concatenate([own, own[:2], ~base[:1]])))
        return media.Block(np.arange(9) + 100 * k, parts)

    left, right = side(0), side(1)
    held = np.empty(60_000, np.uint64), np.empty(60_000, np.uint8)
    found = [media._near(left, i, right, np.arange(9), held) for i in range(9)]
    got = media._mutual(*(np.concatenate(x) for x in zip(*((9 * i + own[0], *own[1:]) for i, own in enumerate(found)), strict=True)))
    expected = []
    for i in range(9):
        for j in range(9):
            best, distance, back = media._nearest(left.parts[i][1], right.parts[j][1])
            for k in np.flatnonzero((back[best] == np.arange(28)) & (distance <= media.HAMMING)).tolist():
                expected.append((9 * i + j, 28 * i + k, 28 * j + int(best[k])))
    assert list(zip(*(x.tolist() for x in got), strict=True)) == expected and len(expected) > 500


def test_one_pair_with_many_votes():
    """Votes of one pair that never agree do not make all other pairs be looked at again for each of them."""
    rng = np.random.default_rng(2)
    pair = np.repeat(np.arange(300_000), 2)
    many = np.append(pair, np.full(1200, 300_000))

    def votes(n):
        return np.stack([rng.random(n) * 1e6, rng.random(n) * 1e6, np.ones(n), rng.random(n) * 6], 1).astype(np.float32)

    def seconds(own):
        ga, gb = votes(len(own)), votes(len(own))
        began = time.process_time()
        assert len(media._agreeing(own, ga, gb)) < 10
        return time.process_time() - began

    few = min(seconds(pair) for _ in range(3))
    assert min(seconds(many) for _ in range(2)) < 6 * few

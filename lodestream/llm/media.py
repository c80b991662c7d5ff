"""Copies of images by local descriptors: multiscale corners, oriented binary tests, Hamming tables, geometric consensus.

Images are binary PGM (P5, 8 bits). Each level of a pyramid (`STEP` apart) gives the Harris corners that no stronger one is
within `APART` pixels of, placed between pixels, so their number grows with the area and a crop has those of the whole; the
intensity centroid of the surrounding disc is the orientation; `BITS` comparisons of smoothed places, turned by it, are the
descriptor.
Each of the first `TABLES` parts of `KEY` bits of a descriptor is a key of a Hamming table. Two corners that share a key and differ
in at most `HAMMING` bits are a vote for their images; images with two votes that one transform explains are candidates, and a
candidate pair is a copy if at least `CONSENSUS` matched corners agree on one scale, turn and shift. Images lie in blocks
of about `CELL`, as files in the shared folder, and every two blocks meet in one task, which keeps the tables in memory
and returns one link for each two components that it joins: no pair is shuffled, but the number of tasks grows with
the square of the number of images. Within a task, images of a component that fills much of a block meet only the others. Keys of two corners instead, dealt by shuffles, were tried: they found 0.37 of the copies
at 0.75 of the size and 0.85 of those turned by 30 degrees, where these find all but 1 of 60.

Equal files are one node, named by the smallest image_id. Null, empty, damaged or tiny images have no corners and are
alone unless another file is equal; null images are alone. Rows with a null image_id have a null class. Rows with equal
ids are one image. Other columns are ignored.

The driver's tables hold no images: `rendered` makes an image of each embedding, its 64 numbers taken as the coefficients
of a texture, with a cropped, a dimmed and a turned copy of the first of every ten. That is a stand-in for data, not a part of the operator.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm._shared import gathered, get_file, put_file, scratch, small_batches, trim, whole_groups, written
from lodestream.llm.bagminhash import components, same_ids

BITS, TABLES, KEY, RADIUS = 256, 10, 24, 8
#: Levels of the pyramid are this factor apart.
STEP = 2**0.5
APART = 2  # pixels of a level
HAMMING, CONSENSUS = 48, 5
#: Matches agree if the cosine of the difference of their turns exceeds ALIKE; images are no copies if CHANCE or more such pairs come about by chance.
ALIKE, CHANCE = 0.85, 1e-8
#: Images and bytes of features of a block.
CELL, CELL_BYTES = 4096, 8 << 20
#: Pairs of corners with an equal key that a task counts votes of at once, and of which it compares the bits at once.
TOGETHER, COMPARED = 2 << 20, 1 << 17
#: Distances of corners that are held at once; less than 65,536, because the places of corners share a number with them.
MATRIX = 32_000
_RNG = np.random.default_rng(7)
_TESTS = np.clip(_RNG.normal(0, RADIUS / 2.2, (BITS, 2, 2)), -RADIUS + 2, RADIUS - 2)
_PICKED = np.arange(TABLES * KEY).reshape(TABLES, KEY)
_DISC = np.array([(y, x) for y in range(-RADIUS + 1, RADIUS) for x in range(-RADIUS + 1, RADIUS) if x * x + y * y < RADIUS * RADIUS])


def pgm(pixels: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def decode(data: bytes | None) -> np.ndarray | None:
    """Pixels, or None if that is no binary PGM of 8 bits."""
    parts = (data or b"")[:64].split(None, 3)
    if len(parts) < 4 or parts[0] != b"P5":
        return None
    try:
        width, height = int(parts[1]), int(parts[2])
    except ValueError:
        return None
    size = width * height
    if width <= 0 or height <= 0 or len(data) < size:
        return None
    return np.frombuffer(data, np.uint8, size, len(data) - size).reshape(height, width)


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Means over (2r + 1)-squares of a stack of images, edges repeated."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r + 1, r)
        sums = np.cumsum(np.pad(a, pad, "edge"), axis=axis, dtype=np.float64)
        n = a.shape[axis]
        a = (np.take(sums, range(2 * r + 1, 2 * r + 1 + n), axis) - np.take(sums, range(n), axis)) / (2 * r + 1)
    return a


def _at(stack: np.ndarray, image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values between pixels; `image` names the image of each row of places."""
    y, x = np.clip(y, 0, stack.shape[1] - 1.001), np.clip(x, 0, stack.shape[2] - 1.001)
    low, left = y.astype(np.int64), x.astype(np.int64)
    down, right = y - low, x - left
    i = image[:, None]
    above = stack[i, low, left] * (1 - right) + stack[i, low, left + 1] * right
    return above * (1 - down) + (stack[i, low + 1, left] * (1 - right) + stack[i, low + 1, left + 1] * right) * down


def _scaled(stack: np.ndarray, scale: float) -> np.ndarray:
    """The images at 1 / scale of their size, smoothed before."""
    if scale == 1:
        return stack
    h, w = int(stack.shape[1] / scale), int(stack.shape[2] / scale)
    smooth = _box(stack, max(1, round(scale / 2)))
    y, x = (np.clip((np.arange(n) + 0.5) * scale - 0.5, 0, m - 1.001) for n, m in ((h, stack.shape[1]), (w, stack.shape[2])))
    low, left = y.astype(np.int64), x.astype(np.int64)
    rows = smooth[:, low] * (1 - (y - low))[None, :, None] + smooth[:, low + 1] * (y - low)[None, :, None]
    return rows[:, :, left] * (1 - (x - left)) + rows[:, :, left + 1] * (x - left)


def _peak(before: np.ndarray, at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Where a parabola through three values is highest, from -1/2 to 1/2."""
    bend = before - 2 * at + after
    flat = np.abs(bend) < 1e-12
    return np.where(flat, 0.0, np.clip(0.5 * (before - after) / np.where(flat, 1.0, bend), -0.5, 0.5))


def features(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of images of one shape: (image, [x, y, scale, angle], descriptor bytes) of every corner."""
    image, geometry, bits = [], [], []
    base = stack.astype(np.float64)
    scale = 1.0
    while int(min(base.shape[1:]) / scale) > 2 * RADIUS + 4:
        level = _scaled(base, scale)
        smooth = _box(level, 1)
        gy, gx = np.gradient(smooth, axis=(1, 2))
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = response[:, RADIUS:-RADIUS, RADIUS:-RADIUS]
        top = np.ones(inner.shape, bool)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    top &= inner > response[:, RADIUS + dy : response.shape[1] - RADIUS + dy, RADIUS + dx : response.shape[2] - RADIUS + dx]
        most = response
        for axis in (1, 2):
            near = np.swapaxes(most, axis, 2)
            near = np.pad(near, [(0, 0), (0, 0), (APART, APART)], "edge")
            near = np.lib.stride_tricks.sliding_window_view(near, 2 * APART + 1, axis=2).max(axis=3)
            most = np.swapaxes(near, axis, 2)
        i, y, x = np.nonzero(top & (inner > 1e-3) & (inner >= most[:, RADIUS:-RADIUS, RADIUS:-RADIUS]))
        y, x = y + RADIUS, x + RADIUS
        blurred = _box(level, 2)
        for c in range(0, len(i), 4096):
            own, v, u = i[c : c + 4096], y[c : c + 4096], x[c : c + 4096]
            fy = v + _peak(response[own, v - 1, u], response[own, v, u], response[own, v + 1, u])
            fx = u + _peak(response[own, v, u - 1], response[own, v, u], response[own, v, u + 1])
            disc = _at(smooth, own, fy[:, None] + _DISC[:, 0], fx[:, None] + _DISC[:, 1])
            angle = np.arctan2(disc @ _DISC[:, 0], disc @ _DISC[:, 1])
            cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
            a, b = (_at(blurred, own, fy[:, None] + _TESTS[:, e, 1] * sin + _TESTS[:, e, 0] * cos, fx[:, None] + _TESTS[:, e, 1] * cos - _TESTS[:, e, 0] * sin) for e in (0, 1))
            image.append(own)
            geometry.append(np.stack([(fx + 0.5) * scale, (fy + 0.5) * scale, np.full(len(own), scale), angle], 1))
            bits.append(np.packbits(a < b, axis=1))
        scale *= STEP
    if not image:
        return np.zeros(0, np.int64), np.zeros((0, 4)), np.zeros((0, BITS // 8), np.uint8)
    image, geometry, bits = np.concatenate(image), np.concatenate(geometry), np.concatenate(bits)
    order = np.argsort(image, kind="stable")
    return image[order], geometry[order], bits[order]


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in gathered(batches, "image", 1 << 20):
        pixels = [decode(d) for d in table["image"].to_pylist()]
        out: list[bytes | None] = [None] * len(pixels)
        shapes: dict[tuple[int, int], list[int]] = {}
        for k, p in enumerate(pixels):
            if p is not None:
                shapes.setdefault(p.shape, []).append(k)
        for shape, own in shapes.items():
            step = max(1, (1 << 18) // (shape[0] * shape[1]))
            for c in range(0, len(own), step):
                part = own[c : c + step]
                image, geometry, bits = features(np.stack([pixels[k] for k in part]))
                bounds = np.searchsorted(image, np.arange(len(part) + 1))
                for j, k in enumerate(part):
                    a, b = bounds[j], bounds[j + 1]
                    if b > a:
                        out[k] = geometry[a:b].astype("<f4").tobytes() + bits[a:b].tobytes()
        yield pa.RecordBatch.from_arrays([table["image_id"].combine_chunks(), table["digest"].combine_chunks(), pa.array(out, pa.binary())], ["image_id", "digest", "features"])
        trim()


def _parts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // (16 + BITS // 8)
    return np.frombuffer(data, "<f4", 4 * n).reshape(n, 4).astype(np.float64), np.frombuffer(data, np.uint8, offset=16 * n).reshape(n, BITS // 8)


def _nearest(da: np.ndarray, db: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each descriptor in `da` the nearest in `db` and its distance, and of each in `db` the nearest in `da`; the first of equal ones."""
    wa, wb = (np.ascontiguousarray(d).view("<u8") for d in (da, db))
    best, distance = np.empty(len(wa), np.int64), np.empty(len(wa), np.int64)
    back, least = np.zeros(len(wb), np.int64), np.full(len(wb), BITS + 1)
    step = max(1, (1 << 20) // len(wb))
    for k in range(0, len(wa), step):
        part = sum(np.bitwise_count(wa[k : k + step, None, i] ^ wb[None, :, i]).astype(np.int16) for i in range(BITS // 64))
        best[k : k + step] = part.argmin(axis=1)
        distance[k : k + step] = part.min(axis=1)
        nearer = part.min(axis=0) < least
        back[nearer] = k + part.argmin(axis=0)[nearer]
        least = np.minimum(least, part.min(axis=0))
    return best, distance, back


def agree(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """The most matched corners that one similarity transform explains, or 0 if so many may do so by chance; each side is (geometry, descriptors)."""
    (ga, da), (gb, db) = a, b
    best, distance, back = _nearest(da, db)
    mutual = (back[best] == np.arange(len(da))) & (distance <= HAMMING)
    n = int(mutual.sum())
    if n < CONSENSUS:
        return 0
    sides = np.ptp(gb[:, :2], axis=0)
    ga, gb = ga[mutual], gb[best[mutual]]
    ratio = gb[:, 2] / ga[:, 2]
    turn = gb[:, 3] - ga[:, 3]
    c, s = ratio * np.cos(turn), ratio * np.sin(turn)
    # Each match proposes a transform; a match agrees that has about its turn and scale, and whose corner it carries to within a few pixels.
    tx, ty = gb[:, 0] - (c * ga[:, 0] - s * ga[:, 1]), gb[:, 1] - (s * ga[:, 0] + c * ga[:, 1])
    reach = 9 * np.maximum(1, gb[:, 2]) ** 2
    most, step = 0, max(1, (1 << 20) // n)
    for k in range(0, n, step):
        own = np.s_[k : k + step, None]
        x = c[own] * ga[:, 0] - s[own] * ga[:, 1] + tx[own]
        y = s[own] * ga[:, 0] + c[own] * ga[:, 1] + ty[own]
        near = (x - gb[:, 0]) ** 2 + (y - gb[:, 1]) ** 2 <= reach
        near &= (np.cos(turn[own] - turn) > ALIKE) & (np.abs(np.log(ratio[own] / ratio)) < 0.8 * np.log(2))
        most = max(most, int(near.sum(axis=1).max()))
    # Matches that agree with one by chance: a place, a sixth of all turns, about half of the ratios.
    rate = n * min(0.5, float(np.pi * reach.mean() / max(1.0, sides[0] * sides[1]))) / 12
    return most if n * _tail(rate, most - 1) < CHANCE else 0


def _tail(rate: float, least: int) -> float:
    """The probability of at least `least` events where `rate` are expected."""
    term = math.exp(-rate)
    below = 0.0
    for k in range(least):
        below += term
        term *= rate / (k + 1)
    if below < 0.999:
        return 1 - below
    total = 0.0
    for k in range(least, least + 60):
        total += term
        term *= rate / (k + 1)
    return total


class Block:
    """Images: nodes in ascending order, and their corners one behind the other."""

    def __init__(self, nodes: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]):
        self.nodes, self.parts = nodes, parts
        self.starts = np.cumsum([0, *(len(d) for _, d in parts)])
        self.image = np.repeat(np.arange(len(nodes)), np.diff(self.starts))
        self.geometry = np.concatenate([g for g, _ in parts]).astype(np.float32)
        bits = np.ascontiguousarray(np.concatenate([d for _, d in parts]))
        self.words = bits.view("<u8")

    @classmethod
    def stored(cls, data: bytes) -> Block:
        table = pa.ipc.open_stream(data).read_all()
        return cls(table["node"].to_numpy(), [_parts(f) for f in table["features"].to_pylist()])

    def taken(self, images: np.ndarray) -> Block:
        return Block(self.nodes[images], [self.parts[i] for i in images.tolist()])

    def keys(self) -> Iterator[np.ndarray]:
        """The keys of all corners in one table after the other."""
        bits = np.ascontiguousarray(np.unpackbits(self.words.view(np.uint8), axis=1).T)
        for picked in _PICKED:
            out = np.zeros((len(self.image), 8), np.uint8)
            for k in range(0, KEY, 8):
                for shift, bit in enumerate(picked[k : k + 8]):
                    out[:, k // 8] |= bits[bit] << shift
            yield out.view("<u8")[:, 0]


def _equal_keys(left: Block, right: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each table the order of right corners, and of each left corner the first in that order with its key and how many have it."""
    orders = np.empty((TABLES, len(right.image)), np.int32)
    low, size = (np.empty((TABLES, len(left.image)), np.int32) for _ in range(2))
    for t, (own, other) in enumerate(zip(left.keys(), right.keys(), strict=True)):
        orders[t] = np.argsort(other, kind="stable")
        other = other[orders[t]]
        by = np.argsort(own)
        own = own[by]
        first = np.searchsorted(other, own, "left")
        low[t, by], size[t, by] = first, np.searchsorted(other, own, "right") - first
    return orders, low, size


def candidates(left: Block, right: Block, part: np.ndarray, of_left: np.ndarray, of_right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Places (in `left`, in `right`) of images with two votes that agree and that `agree` may accept; of one block with itself, each two once.

    part: the component of each image of the task, which the caller changes as pairs are found to be copies; `of_left` and
    `of_right` are the places there. Images of one component do not vote.
    """
    orders, low, size = _equal_keys(left, right)
    sums = np.cumsum(np.add.reduceat(size.sum(axis=0, dtype=np.int64), left.starts[:-1]))
    n, corners = len(right.nodes), len(right.image)
    first = 0
    while first < len(left.nodes):
        last = max(first + 1, int(np.searchsorted(sums, (sums[first - 1] if first else 0) + TOGETHER, "right")))
        begin, end = left.starts[first], left.starts[last]
        votes = []
        for t in range(TABLES):
            ends = np.cumsum(size[t, begin:end], dtype=np.int64)
            cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, int(ends[-1]), COMPARED), "right"), end - begin))
            for p, q in zip(cuts[:-1] + begin, cuts[1:] + begin, strict=True):
                m = size[t, p:q].astype(np.int64)
                a = np.repeat(np.arange(p, q), m)
                b = orders[t][np.repeat(low[t, p:q] - (np.cumsum(m) - m), m) + np.arange(len(a))].astype(np.int64)
                i, j = left.image[a], right.image[b]
                apart = part[of_left[i]] != part[of_right[j]]
                if left is right:
                    apart &= i < j
                a, b = a[apart], b[apart]
                near = np.bitwise_count(np.take(left.words, a, 0) ^ np.take(right.words, b, 0)).sum(axis=1, dtype=np.uint16) <= HAMMING
                votes.append((a[near] - begin) * corners + b[near])
        vote = np.sort(np.concatenate([np.zeros(0, np.int64), *votes]))
        vote = vote[np.append(True, vote[1:] != vote[:-1])[: len(vote)]]  # two corners vote once
        a, b = vote // corners + begin, vote % corners
        pairs = _agreeing((left.image[a] - first) * n + right.image[b], left.geometry[a], right.geometry[b])
        i, j = first + pairs // n, pairs % n
        good = _promising(left, right, i, j)
        yield from zip(i[good].tolist(), j[good].tolist(), strict=True)
        first = last
        # Many copies of one image would go on to share all their keys: those to come meet the images outside of their component.
        large, count = np.unique(part[of_right], return_counts=True)
        large = large[count.argmax()]
        inside = np.flatnonzero(part[of_left[first:]] == large) + first
        if count.max() * 8 >= n and len(inside) * 8 >= len(left.nodes):
            outside = np.flatnonzero(part[of_right] != large)
            rest = np.setdiff1d(np.arange(first, len(left.nodes)), inside)
            for lefts, rights in ((inside, outside), (rest, np.arange(n))):
                if len(lefts) and len(rights):
                    for i, j in candidates(left.taken(lefts), right.taken(rights), part, of_left[lefts], of_right[rights]):
                        yield int(lefts[i]), int(rights[j])
            return


def _runs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending numbers: which run of equal ones each place lies in, and how many of its run follow it."""
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
    sizes = np.diff(np.append(first, len(group)))
    return np.repeat(np.arange(len(first)), sizes), np.repeat(first + sizes - 1, sizes) - np.arange(len(group))


def _agreeing(pair: np.ndarray, ga: np.ndarray, gb: np.ndarray) -> np.ndarray:
    """The pairs that have two votes of about one turn, one of which carries the other's corner to within a few pixels."""
    bits = max(1, len(pair)).bit_length()
    order = np.sort(pair << bits | np.arange(len(pair))) & (1 << bits) - 1  # a stable order
    run, behind = _runs(pair[order])
    several = behind > 0
    several[1:] |= several[:-1]  # the last of a run follows one that has it behind
    order, run, behind = order[several], run[several], behind[several]
    pair = pair[order]
    ax, ay, a_scale, a_turn = ga[order].T.copy()
    bx, by, b_scale, b_turn = gb[order].T.copy()
    turn, ratio = b_turn - a_turn, b_scale / a_scale
    c, s = ratio * np.cos(turn), ratio * np.sin(turn)
    reach = 9 * np.maximum(1, b_scale) ** 2
    done = np.zeros(int(run[-1]) + 1 if len(run) else 0, bool)
    at, shift = np.flatnonzero(behind), 1
    while len(at):
        near = at[np.cos(turn[at] - turn[at + shift]) > 0.7]
        for u, v in ((near, near + shift), (near + shift, near)):
            dx, dy = ax[v] - ax[u], ay[v] - ay[u]
            x, y = bx[u] + c[u] * dx - s[u] * dy, by[u] + s[u] * dx + c[u] * dy
            done[run[near[(x - bx[v]) ** 2 + (y - by[v]) ** 2 <= reach[v]]]] = True
        at = at[(behind[at] > shift) & ~done[run[at]]]
        shift += 1
    return np.unique(pair[done[run]])


def copies(left: Block, right: Block) -> list[tuple[int, int]]:
    """Links (a, b), a < b, that join the copies among the images of two blocks, or of one with itself."""
    shift = 0 if left is right else len(left.nodes)
    part = np.arange(shift + len(right.nodes))
    found = []
    for i, j in candidates(left, right, part, np.arange(len(left.nodes)), shift + np.arange(len(right.nodes))):
        if part[i] == part[shift + j]:
            continue
        a, b = int(left.nodes[i]), int(right.nodes[j])
        sides = (left.parts[i], right.parts[j]) if a <= b else (right.parts[j], left.parts[i])
        if agree(*sides) >= CONSENSUS:
            part[part == part[shift + j]] = part[i]
            found.append((min(a, b), max(a, b)))
    return found


def _near(left: Block, i: int, right: Block, js: np.ndarray, held: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(place in `js`, left corner, right corner, distance) of the corners of image `i` and of each of `js` within `HAMMING`, by left corner, then right one."""
    begin, end = left.starts[i], left.starts[i + 1]
    n = right.starts[js + 1] - right.starts[js]
    b = np.repeat(right.starts[js] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    shape = end - begin, len(b)
    own, other = left.words[begin:end], np.ascontiguousarray(right.words[b].T)
    differing, bits = (x[: shape[0] * shape[1]].reshape(shape) for x in held)
    distance = np.zeros(shape, np.uint8)
    for w in range(BITS // 64):
        np.bitwise_xor(own[:, w, None], other[w], out=differing)
        np.bitwise_count(differing, out=bits)
        if w == 3:
            np.minimum(bits, 63, out=bits)  # 256 bits are one more than a byte holds, and 255 is no match either
        distance += bits
    at = np.flatnonzero(distance <= HAMMING)
    k, column = np.divmod(at, len(b))
    return np.repeat(np.arange(len(js)), n)[column], begin + k, b[column], distance.reshape(-1)[at]


def _mutual(pair: np.ndarray, a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What `agree` matches, by pair, then left corner: each other's nearest, the first of equal ones. `pair` ascends by left image."""
    wide = int(max(a.max(initial=0), b.max(initial=0))) + 1
    close = distance.astype(np.int64) * wide
    best = np.ones(len(pair), bool)
    for own, other in ((a, b), (b, a)):
        key = pair * wide + own
        order = np.argsort(key)
        run, _ = _runs(key[order])
        if len(order):
            least = np.minimum.reduceat((close + other)[order], np.flatnonzero(np.diff(run, prepend=-1)))
            best[order] &= (close + other)[order] == least[run]
    best = np.flatnonzero(best)
    best = best[np.lexsort((a[best], pair[best]))]
    return pair[best], a[best], b[best]


def _promising(left: Block, right: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of images (`i` ascending) `agree` may accept: `CONSENSUS` of their matches go with one of them. Chance is left to `agree`."""
    good = np.zeros(len(i), bool)
    corners = left.starts[i + 1] - left.starts[i], right.starts[j + 1] - right.starts[j]
    large = corners[0] * corners[1] > MATRIX
    good[large] = True  # `agree` takes them in pieces
    rest = np.flatnonzero(~large)
    if not len(rest):
        return good
    cells = np.cumsum(corners[0][rest] * corners[1][rest]) // MATRIX
    cuts = np.flatnonzero(np.append(True, (np.diff(i[rest]) > 0) | (np.diff(cells) > 0)))
    held = np.empty(2 * MATRIX, np.uint64), np.empty(2 * MATRIX, np.uint8)  # a cut may exceed MATRIX by one pair
    found = []
    for p, q in zip(cuts, [*cuts[1:], len(rest)], strict=True):
        place, a, b, distance = _near(left, int(i[rest[p]]), right, j[rest[p:q]], held)
        found.append((rest[p + place], a, b, distance))
    pair, a, b = _mutual(*(np.concatenate(x) for x in zip(*found, strict=True)))
    enough = np.bincount(pair, minlength=len(i))[pair] >= CONSENSUS
    pair, a, b = pair[enough], a[enough], b[enough]
    swapped = (left.nodes[i] > right.nodes[j])[pair, None]
    ga, gb = left.geometry[a].astype(np.float64), right.geometry[b].astype(np.float64)
    ga, gb = np.where(swapped, gb, ga), np.where(swapped, ga, gb)
    turn, ratio = gb[:, 3] - ga[:, 3], gb[:, 2] / ga[:, 2]
    cos, sin, size = np.cos(turn), np.sin(turn), np.log(ratio)
    c, s = ratio * cos, ratio * sin
    reach = 9 * np.maximum(1, gb[:, 2]) ** 2 + 1e-6  # a little more than `agree` allows, whose sums round otherwise
    with_it = np.ones(len(pair), np.int64)
    shift = 1
    while len(at := np.flatnonzero(pair[shift:] == pair[:-shift])):
        to = at + shift
        at = at[(cos[at] * cos[to] + sin[at] * sin[to] > ALIKE - 1e-9) & (np.abs(size[at] - size[to]) < 0.8 * np.log(2) + 1e-9)]
        for u, v in ((at, at + shift), (at + shift, at)):
            dx, dy = ga[v, 0] - ga[u, 0], ga[v, 1] - ga[u, 1]
            x, y = gb[u, 0] + c[u] * dx - s[u] * dy, gb[u, 1] + s[u] * dx + c[u] * dy
            with_it[u] += (x - gb[v, 0]) ** 2 + (y - gb[v, 1]) ** 2 <= reach[v]
        shift += 1
    good[pair[with_it >= CONSENSUS]] = True
    return good


def _stored(folder: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "block", "features", 1):
            blocks = table["block"].to_numpy()
            for block in np.unique(blocks).tolist():
                own = table.filter(pa.array(blocks == block)).select(["node", "features"]).combine_chunks()
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema) as out:
                    out.write_table(own)
                put_file(folder, f"block-{block}", sink.getvalue().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64())], ["block"])

    return work


def _met(folder: str, blocks: list[int]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch["id"].to_pylist():
                h = int((np.sqrt(8 * cell + 1) - 1) / 2)
                h += (h + 1) * (h + 2) // 2 <= cell
                g = cell - h * (h + 1) // 2
                left = Block.stored(get_file(f"{folder}/block-{blocks[g]}"))
                right = left if g == h else Block.stored(get_file(f"{folder}/block-{blocks[h]}"))
                found = copies(left, right)
                del left, right
                trim()
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])

    return work


def links(nodes: DataFrame, folder: str) -> DataFrame:
    """Links (a, b) that join copies among `nodes` (node, features)."""
    spark = nodes.sparkSession
    own = nodes.where("features is not null").select("node", "features")
    n, size = own.agg(F.count("*"), F.coalesce(F.sum(F.length("features")), F.lit(0))).first()
    count = max(1, -(-n // CELL), -(-size // CELL_BYTES))
    dealt = own.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(count)))
    stored = dealt.repartition(count, "block").sortWithinPartitions("block", "node").mapInArrow(_stored(f"{folder}/blocks"), "block long")
    blocks = sorted({r.block for r in written(stored, f"{folder}/stored").collect()})  # some may be empty
    cells = len(blocks) * (len(blocks) + 1) // 2
    return written(spark.range(0, cells, 1, max(1, min(cells, 5000))).mapInArrow(_met(f"{folder}/blocks", blocks), "a long, b long"), f"{folder}/links")


def classes(images: DataFrame) -> DataFrame:
    """image_id, class_id and n_corners of every row of `images` (image_id, image)."""
    spark = images.sparkSession
    small_batches(spark)
    folder = scratch(spark, "media")
    own = images.select(F.col("image_id").cast("long").alias("image_id"), "image").withColumn("digest", F.unhex(F.md5("image")))
    described = written(own.mapInArrow(_described, "image_id long, digest binary, features binary"), f"{folder}/described")
    nodes = written(described.where("image_id is not null and digest is not null").groupBy("digest").agg(F.min("image_id").alias("node"), F.min("features").alias("features")), f"{folder}/nodes")
    same = same_ids(described.where("features is not null"), nodes, "image_id")
    found = components(links(nodes, folder).unionByName(same), f"{folder}/all")
    named = nodes.select("digest", "node", F.coalesce(F.length("features") / (16 + BITS // 8), F.lit(0)).cast("long").alias("n_corners")).join(found, "node", "left").select(F.col("digest").alias("_d"), F.coalesce("label", "node").alias("class_id"), "n_corners")
    rows = described.select("image_id", "digest").join(named, F.col("digest") == F.col("_d"), "left")
    return rows.select("image_id", F.when(F.col("image_id").isNotNull(), F.coalesce("class_id", "image_id")).alias("class_id"), F.coalesce("n_corners", F.lit(0).cast("long")).alias("n_corners"))


SIDE = 64


def _texture() -> np.ndarray:
    """64 waves of several lengths and directions, as rows."""
    rng = np.random.default_rng(11)
    y, x = np.mgrid[0:SIDE, 0:SIDE] / SIDE
    waves = [np.cos(2 * np.pi * (u * x + v * y) + p) for u, v, p in zip(rng.uniform(-9, 9, 64), rng.uniform(-9, 9, 64), rng.uniform(0, 6.28, 64), strict=True)]
    return np.stack([w.reshape(-1) for w in waves])


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waves = _texture()
    for batch in batches:
        vectors = np.zeros((batch.num_rows, 64))
        for k, v in enumerate(batch["source"].to_pylist()):
            own = np.nan_to_num(np.array([0.0 if x is None else x for x in v or []], float))[:64]
            vectors[k, : len(own)] = own
        norm = np.linalg.norm(vectors, axis=1, keepdims=True)
        pixels = np.clip(128 + 100 * (vectors / np.where(norm > 0, norm, 1)) @ waves, 0, 255).reshape(-1, SIDE, SIDE)
        images = []
        for p, i in zip(pixels, batch["vec_id"].to_pylist(), strict=True):
            kind = -1 if i is None else i % 10
            p = p[7:59, 5:61] if kind == 1 else 20 + 0.8 * p if kind == 2 else np.rot90(p) if kind == 3 else p
            images.append(pgm(np.rint(p).astype(np.uint8)))
        yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(images, pa.binary())], ["image_id", "image"])


def rendered(embeddings: DataFrame) -> DataFrame:
    """(image_id, image) of each row of `embeddings` (vec_id, embedding)."""
    small_batches(embeddings.sparkSession)
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    copied = F.pmod("vec_id", F.lit(10)).isin(1, 2, 3)
    source = own.where("pmod(vec_id, 10) = 0").select(F.col("vec_id").alias("_s"), F.col("embedding").alias("_e")).dropDuplicates(["_s"])
    joined = own.join(source, copied & (F.col("vec_id") - F.pmod("vec_id", F.lit(10)) == F.col("_s")), "left")
    n = int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes become many: tasks must not be joined
    return joined.select("vec_id", F.coalesce("_e", "embedding").alias("source")).repartition(n).mapInArrow(_drawn, "image_id long, image binary")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(rendered(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))

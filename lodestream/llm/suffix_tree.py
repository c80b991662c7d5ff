"""Substring dedup of word sequences by prefix-partitioned suffix trees.

Suffixes that start the same are sent to one place: the prefix is the anchor gram, or the whole window where the gram
leaves more suffixes together than one task should hold. There prefixes grow by `STEP` words as long as more than `GROUP`
suffixes share one; a suffix that is alone with its prefix is a leaf of its own and goes no further. Each group's
suffix tree is made of its sorted suffixes and their common beginnings (`Tree`): an internal node is an interval of
suffixes with a depth, and its edge to its parent is the words between their depths. The internal nodes of depth
`length` and more are the repeats, the topmost of them the repeated windows; those whose occurrences differ in the word
before them are maximal repeats (`maximal_repeats`).

Words are runs of anything but space, tab, newline, vertical tab, form feed and return, unchanged. Null texts have no
words, and very long ones are one block of their own size. Windows do not cross documents and are judged on the input.
Rows with a null doc_id are returned as they are; repeated rows and rows with one doc_id are one document, which removes
nothing from itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.repeats import Block, Spec, U, mix, repeats

LENGTH, STEP = 50, 8
#: Suffixes of one set of trees, and of a group that its prefix leaves together.
SUFFIXES, GROUP = 1 << 18, 4096


def _prefix(codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A hash of the `n` words from each place on."""
    out = np.full(len(at), n, np.uint64)
    for i in range(n):
        out = mix(out * U(0x9E3779B97F4A7C15) + codes[at + i])
    return out


class Tree:
    """The suffix trees of groups of suffixes, below depth `length`.

    `order` has the suffixes of all groups in the order of the leaves; a node is a run of leaves (`first` to `last`, both
    in it), its `depth` in words, and its `parent` among the nodes (-1: the parent is less deep than `length`).
    """

    def __init__(self, codes: np.ndarray, ends: np.ndarray, group: np.ndarray, at: np.ndarray, length: int):
        """codes: words of all sequences, each followed by a place of its own; ends: that place, for every place."""
        # Ranks of all places by their next 1, 2, 4, ... words; the place behind a sequence is unlike any other.
        rank = np.unique(codes, return_inverse=True)[1] + len(codes)
        behind = np.flatnonzero(ends == np.arange(len(codes)))
        rank[behind] = np.arange(len(behind))
        ranks, width, longest = [rank], 1, int((ends[at] - at).max(initial=0))
        while 2 * width <= longest:
            following = np.minimum(np.arange(len(codes)) + width, ends)
            ranks.append(np.unique(ranks[-1].astype(np.int64) * (2 * len(codes)) + ranks[-1][following], return_inverse=True)[1])
            width *= 2
        following = np.minimum(at + width, ends[at])
        self.order = np.lexsort((ranks[-1][following], ranks[-1][at], group))
        a, b = at[self.order[:-1]].copy(), at[self.order[1:]].copy()
        common = np.zeros(max(0, len(at) - 1), np.int64)
        while True:  # the longest ranks that are equal, again and again: a common beginning may be up to twice as long
            before = common.copy()
            for k in reversed(range(len(ranks))):
                same = (ranks[k][a] == ranks[k][b]) & (a + (1 << k) <= ends[a]) & (b + (1 << k) <= ends[b])
                common += np.where(same, 1 << k, 0)
                a, b = np.where(same, np.minimum(a + (1 << k), ends[a]), a), np.where(same, np.minimum(b + (1 << k), ends[b]), b)
            if (common == before).all():
                break
        common[group[self.order[1:]] != group[self.order[:-1]]] = 0
        self.first, self.last, self.depth, self.parent = self._nodes(common, length)

    @staticmethod
    def _nodes(common: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
        first: list[int] = []
        last: list[int] = []
        depth: list[int] = []
        parent: list[int] = []
        deep = common >= length
        starts = np.flatnonzero(deep & ~np.append(False, deep[:-1])).tolist()
        stops = np.flatnonzero(deep & ~np.append(deep[1:], False)).tolist()
        for start, stop in zip(starts, stops, strict=True):
            opened: list[int] = []  # nodes that go on, the deepest last
            for i, d in enumerate([*common[start : stop + 1].tolist(), 0], start):
                low, below = i, -1
                while opened and depth[opened[-1]] > d:
                    below = opened.pop()
                    last[below], low = i, first[below]
                    parent[below] = opened[-1] if opened else -1
                if d >= length and (not opened or depth[opened[-1]] < d):
                    first.append(low)
                    last.append(-1)
                    depth.append(d)
                    parent.append(opened[-1] if opened else -1)
                    opened.append(len(first) - 1)
                    if below >= 0:
                        parent[below] = opened[-1]
        return tuple(np.array(x, np.int64) for x in (first, last, depth, parent))


def _trees(groups: np.ndarray, sequences: list[np.ndarray], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Tree | None, np.ndarray]]:
    """(sequence, offset, place, codes, tree, group) of sets of suffixes that are not alone; without a tree each group is one window throughout."""
    sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
    windows = np.maximum(0, sizes - length + 1)
    order = np.argsort(groups, kind="stable")
    cuts = np.flatnonzero(np.append(True, groups[order][1:] != groups[order][:-1])).tolist() + [len(order)]
    low = 0
    while low < len(cuts) - 1:
        high, total = low, 0
        while high < len(cuts) - 1 and (high == low or total < SUFFIXES):
            total += int(windows[order[cuts[high] : cuts[high + 1]]].sum())
            high += 1
        own = order[cuts[low] : cuts[high]]
        low = high
        codes = np.concatenate([x for i in own for x in (sequences[i], np.zeros(1, sequences[i].dtype))])
        starts = np.cumsum(sizes[own] + 1) - sizes[own] - 1
        ends = np.repeat(starts + sizes[own], sizes[own] + 1)
        n = windows[own]
        of = np.repeat(np.arange(len(own)), n)
        offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = starts[of] + offset
        prefix = mix(groups[own][of].astype(np.uint64))
        depth = 0
        while len(at):
            step = min(STEP, length - depth)
            prefix = mix(prefix ^ _prefix(codes, at + depth, step))
            depth += step
            _, group, times = np.unique(prefix, return_inverse=True, return_counts=True)
            ready = (times[group] > 1) & (times[group] <= GROUP)
            if ready.any():
                yield own[of[ready]], offset[ready], at[ready], codes, Tree(codes, ends, group[ready], at[ready], length), group[ready]
            more = times[group] > GROUP
            if depth == length and more.any():
                yield own[of[more]], offset[more], at[more], codes, None, group[more]
                break
            of, offset, at, prefix = of[more], offset[more], at[more], prefix[more]


def deep_nodes(groups: np.ndarray, sequences: list[np.ndarray], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes below topmost nodes of depth `length` or more: (sequence, offset, node)."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    nodes = 0
    for sequence, offset, _, _, tree, group in _trees(groups, sequences, length):
        if tree is None:
            cls = np.unique(group, return_inverse=True)[1]
            out.append((sequence, offset, cls + nodes))
            nodes += int(cls.max()) + 1
            continue
        top = np.flatnonzero(tree.parent < 0)
        n = tree.last[top] - tree.first[top] + 1
        leaf = tree.order[np.repeat(tree.first[top] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        out.append((sequence[leaf], offset[leaf], np.repeat(np.arange(len(top)), n) + nodes))
        nodes += len(top)
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def maximal_repeats(sequences: list[np.ndarray], length: int = LENGTH) -> list[tuple[tuple[int, ...], list[tuple[int, int]]]]:
    """(words, [(sequence, offset)]) of every repeat of `length` words or more that neither a word before nor one behind can extend at all of its places."""
    found = []
    for sequence, offset, at, codes, tree, group in _trees(np.zeros(len(sequences), np.int64), sequences, length):
        if tree is None:  # more than GROUP equal windows: their tree has to be made all the same
            ends = np.concatenate([np.full(len(x) + 1, e) for x, e in zip(sequences, np.cumsum([len(x) + 1 for x in sequences]) - 1, strict=True)])
            tree = Tree(codes, ends, group, at, length)
        for first, last, depth in zip(tree.first.tolist(), tree.last.tolist(), tree.depth.tolist(), strict=True):
            leaf = tree.order[first : last + 1]
            before = [-1 - k if o == 0 else int(codes[p - 1]) for k, (o, p) in enumerate(zip(offset[leaf].tolist(), at[leaf].tolist(), strict=True))]
            if len(set(before)) > 1:
                found.append((tuple(codes[at[leaf[0]] : at[leaf[0]] + depth].tolist()), sorted(zip(sequence[leaf].tolist(), offset[leaf].tolist(), strict=True))))
    return found


def spec(length: int = LENGTH, gram: int = 8, block_bytes: int = 8 << 20) -> Spec:
    if not 0 < gram <= length or length - gram + 1 > 63:
        raise ValueError("gram: at most length, and at least length - 62")
    return Spec("suffix-tree", True, length, gram, block_bytes, lambda groups, sequences: deep_nodes(groups, sequences, length))


def _kept(block: Block, covered: np.ndarray) -> list[bytes]:
    """What is left of each text. Words between two that go are cut from the text in one piece."""
    raw = block.raw.tobytes()
    edge = np.diff(covered.astype(np.int8), prepend=1, append=1)
    low, high = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)  # runs of kept words
    inner = np.setdiff1d(block.starts, np.append(low, high))  # texts that start within one
    inner = inner[(inner > 0) & (inner < block.n)]
    inner = inner[~covered[inner]]
    low, high = np.sort(np.append(low, inner)), np.sort(np.append(high, inner))
    first, last = block.first[low].tolist(), (block.first[high - 1] + block.size[high - 1]).tolist()
    bounds = np.searchsorted(low, block.starts).tolist()
    return [b" ".join([w for a, b in zip(first[i:j], last[i:j], strict=True) for w in raw[a:b].split()]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


def _digests(rows: pa.Table, block: Block, covered: np.ndarray) -> pa.Table:
    gone = np.concatenate(([0], np.cumsum(covered)))[block.starts]
    sums = [hashlib.sha256(t).hexdigest() for t in _kept(block, covered)]
    return pa.Table.from_arrays([rows["doc_id"], pa.array(np.diff(block.starts)), pa.array(np.diff(gone)), pa.array(sums, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def dedup(docs: DataFrame, own: Spec | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each of `docs` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return repeats(rows, own or spec(), _digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def kept_words(docs: DataFrame, own: Spec | None = None) -> DataFrame:
    """doc_id and the words that are left, joined by one space."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return repeats(rows, own or spec(), lambda r, block, covered: pa.table({"doc_id": r["doc_id"], "text": pa.array([t.decode() for t in _kept(block, covered)], pa.string())}), "doc_id long, text string")


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
b AS (SELECT k, doc_id, ws, unnest(range(len(ws))) AS i FROM d),
w AS (SELECT k, i, doc_id > min(doc_id) OVER (PARTITION BY array_to_string(ws[i + 1:i + 50], ' ')) AS again FROM b WHERE i + 50 <= len(ws) AND doc_id IS NOT NULL),
c AS (SELECT b.k, b.i, ws[i + 1] AS word, coalesce(bool_or(again) OVER (PARTITION BY b.k ORDER BY b.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone FROM b LEFT JOIN w USING (k, i)),
a AS (SELECT k, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY k)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (k)
"""

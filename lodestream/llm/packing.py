"""Sequences of at most `window` tokens out of documents of any length.

Each task packs the documents that it reads. Whole windows are cut off first. The remainders are counted by length
class; all combinations of up to `depth` classes that fill a window are the columns of a non-negative least-squares
problem whose right side is that histogram; its solution, rounded down, says how often each combination is laid out.
What the histogram leaves over is packed greedily, longest first. A sequence that a combination leaves a little short is
topped up with the start of the next leftover, so every sequence is full but for the task's last tokens, which go to
sequences whose lengths are powers of two and need no padding either.

Null texts count as empty: such a document is its end id alone. Null or repeated doc_ids are documents like any others.
Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from lodestream.llm._shared import gathered, small_batches, trim
from lodestream.llm._tokens import WordEncoder, encoder, table_path, with_end

CLASSES = 64
#: Bytes of text that are encoded at once.
ENCODED = 4 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=4)
def combinations(classes: int, depth: int) -> np.ndarray:
    """Columns: how many pieces of each class (1 to `classes`, in units of window / classes) fill one window."""
    found: list[list[int]] = []

    def fill(left: int, least: int, so_far: list[int]) -> None:
        if left == 0:
            found.append(so_far)
        elif len(so_far) < depth:
            for c in range(least, left + 1):
                fill(left - c, c, [*so_far, c])

    fill(classes, 1, [])
    out = np.zeros((classes, len(found)))
    for j, parts in enumerate(found):
        for c in parts:
            out[c - 1, j] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 60) -> np.ndarray:
    """min |ax - b| with x >= 0 by accelerated projected gradient steps."""
    gram, right = a.T @ a, a.T @ b
    step = 1 / max(np.linalg.norm(a @ a.T, 2), 1e-9)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * (gram @ y - right))
        later = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / later * (new - x), new, later
    return x


def pack(lengths: np.ndarray, window: int = 2048, depth: int = 3) -> tuple[np.ndarray, ...]:
    """(document, start, length, sequence, offset) of each piece, as arrays."""
    out: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    left: list[list[tuple[int, int]]] = [[] for _ in range(CLASSES + 1)]
    unit = window // CLASSES
    for d, n in enumerate(lengths.tolist()):
        whole = n // window
        for k in range(whole):
            out.append((d, k * window, window, sequence, 0))
            sequence += 1
        if rest := n - whole * window:
            left[-(-rest // unit)].append((d, whole * window))
    histogram = np.array([len(x) for x in left[1:]], float)
    plans: list[list[int]] = []
    if histogram.sum():
        columns = combinations(CLASSES, depth)
        columns = columns[:, (columns <= histogram[:, None]).all(axis=0)]
        if columns.shape[1]:
            stock = histogram.copy()
            times = np.floor(nnls(columns, histogram)).astype(int)
            for j in np.argsort(-times, kind="stable"):
                if times[j] <= 0:
                    break
                parts = np.flatnonzero(columns[:, j])
                n = int(min(times[j], (stock[parts] // columns[parts, j]).min()))
                stock[parts] -= n * columns[parts, j]
                plan = [int(c) + 1 for c in parts for _ in range(int(columns[c, j]))]
                plans.extend([plan] * n)
    fixed = [[left[c].pop() for c in plan] for plan in plans]
    loose = [x for c in range(CLASSES, 0, -1) for x in left[c]]  # longest first
    filler = loose[::-1]  # taken from the end: the longest that are left

    def lay(d: int, start: int, offset: int) -> int:
        n = int(min(lengths[d] - start, window - offset))
        out.append((d, start, n, sequence, offset))
        return n

    def top_up(offset: int) -> int:
        while offset < window and filler:
            d, start = filler.pop()
            n = lay(d, start, offset)
            offset += n
            if start + n < lengths[d]:
                filler.append((d, start + n))
        return offset

    short: list[list[tuple[int, int]]] = []
    for parts in fixed:
        if not filler and sum(int(lengths[d]) - s for d, s in parts) < window:
            short.append(parts)
            continue
        offset = 0
        for d, start in parts:
            offset += lay(d, start, offset)
        top_up(offset)
        sequence += 1
    filler.extend(x for parts in reversed(short) for x in parts)
    rest = sum(int(lengths[d]) - s for d, s in filler)
    sizes = [window] * (rest // window) + [1 << i for i in range(window.bit_length() - 2, -1, -1) if (rest % window) >> i & 1]
    for full in sizes:
        offset = 0
        while offset < full:
            d, start = filler.pop()
            n = int(min(lengths[d] - start, full - offset))
            out.append((d, start, n, sequence, offset))
            offset += n
            if start + n < lengths[d]:
                filler.append((d, start + n))
        sequence += 1
    return tuple(np.array(out, np.int64).reshape(-1, 5).T)


def encoded(own: WordEncoder, table: pa.Table, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts and where each text's start, made of about `limit` bytes of text at a time: their words take many times that."""
    ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
    for part in gathered(iter(table.select(["text"]).to_batches()), "text", limit):
        found, starts = own.encode(part["text"])
        ids.append(found)
        sizes.append(np.diff(starts))
    return np.concatenate(ids), np.cumsum(np.concatenate(sizes))


def pack_documents(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 1, window: int = 2048, task_bytes: int = 16 << 20) -> DataFrame:
    """One row for each piece of `docs` (doc_id, text). `window` is a power of two; sequence ids are unique, not dense."""
    if window & (window - 1) or window < CLASSES:
        raise ValueError("window: a power of two, 64 at least")
    small_batches(docs.sparkSession)
    path = table_path("word_bpe_49k.json", tokenizer)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, spaces_count=False)
        sequence = TaskContext.get().partitionId() << 33
        for table in gathered(batches, "text", task_bytes):
            ids, starts = with_end(*encoded(own, table, ENCODED), end_id)
            counts = np.diff(starts)
            d, start, length, seq, offset = pack(counts, window)
            view = memoryview(ids.astype("<u4").tobytes())
            low = 4 * (starts[d] + start)
            sums = [zlib.crc32(view[a : a + n]) for a, n in zip(low.tolist(), (4 * length).tolist(), strict=True)]
            doc_id = table["doc_id"].combine_chunks().take(pa.array(d))
            yield pa.RecordBatch.from_arrays([doc_id, *map(pa.array, (start, length, np.array(sums, np.int64), counts[d], sequence + seq, offset))], [x.split()[0] for x in PIECES.split(", ")])
            sequence += int(seq.max()) + 1 if len(seq) else 0
            del table, ids, starts, view
            trim()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(work, PIECES)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

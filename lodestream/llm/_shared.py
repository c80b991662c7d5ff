"""Scratch files in the folder that all executors share, and Arrow batch helpers."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on this machine, as in tests."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lodestream-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder for the files of one run of one operator."""
    return f"{shared_base(spark)}/lodestream-{name}-{uuid.uuid4().hex}"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def put_file(folder: str, name: str, data: bytes) -> str:
    """Write under another name, then move: a repeated attempt replaces the file with the same bytes."""
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(own, compression=None) as out:
        out.write(data)
    system.move(own, f"{path}/{name}")
    return f"{folder}/{name}"


def get_file(uri: str) -> bytes:
    system, path = _open(uri)
    with system.open_input_stream(path, compression=None) as source:
        return source.read()


def ranged(uri: str) -> Callable[[int, int], bytes]:
    """Reads of (place, size) from a file that stays open."""
    system, path = _open(uri)
    source = system.open_input_file(path)
    return lambda at, n: source.read_at(n, at)


def trim() -> None:
    """Give memory that arrays have freed back to the system; workers live on and share the executor's limit."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def written(df: DataFrame, path: str) -> DataFrame:
    """Cut the lineage: the rows as a Parquet table at `path`, read again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """Tables of whole rows with about `limit` bytes of `column` each; one row may exceed it."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        first = 0
        data = batch.column(column)
        if data.nbytes <= limit // 2:
            pieces = [batch] if batch.num_rows else []
        else:
            rows = max(1, int(batch.num_rows * (limit // 2) / data.nbytes))
            pieces = []
            while first < batch.num_rows:
                pieces.append(batch.slice(first, rows))
                first += rows
        for piece in pieces:
            held.append(piece)
            size += piece.column(column).nbytes
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Long texts must not meet in one Arrow batch by the ten thousand."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def per_table(work: Callable[[pa.Table], pa.Table], column: str, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`work` on tables of about `limit` bytes, for mapInArrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, column, limit):
            yield from work(table).to_batches()

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, column: str, limit: int) -> Iterator[pa.Table]:
    """Tables of whole groups, about `limit` bytes of `column` each; rows come sorted by the integer column `key`."""
    held: pa.Table | None = None
    for batch in batches:
        own = pa.Table.from_batches([batch])
        held = own if held is None else pa.concat_tables([held, own])
        if held[column].nbytes >= limit:
            keys = held[key].to_numpy()
            whole = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
            if whole:
                yield held.slice(0, whole).combine_chunks()
                held = held.slice(whole)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def linked(label: np.ndarray, lefts: Iterable[int], near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of places that join the components in `label`: `near` gives, of other places that it may look at, those near one.

    `near` gets each left place and a mask of the places of other components.
    """
    part = np.unique(label, return_inverse=True)[1]
    found = []
    for i in lefts:
        for j in near(i, part != part[i]).tolist():
            if part[j] != part[i]:
                part[part == part[j]] = part[i]
                found.append((i, j))
    return found

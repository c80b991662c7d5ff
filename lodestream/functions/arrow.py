"""Arrow batches of bounded size, so that a worker holds little at once however many rows a task has."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Rows and bytes of a batch that goes to a worker, and bytes of text of a slice that it works on.
ROWS, BYTES, SLICE = 1000, 8 << 20, 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Set the session's batches to at most ROWS rows and BYTES bytes; smaller settings stay."""
    for name, most in (("maxRecordsPerBatch", ROWS), ("maxBytesPerBatch", BYTES)):
        now = str(spark.conf.get(f"spark.sql.execution.arrow.{name}")).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def slices(batches: Iterable[pa.RecordBatch], column: int | str, limit: int = SLICE, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows and about `limit` bytes of `column` (strings or binary); a longer row is alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < batch.num_rows:
            before = int(ends[first - 1]) if first else 0
            last = min(first + rows, max(first + 1, int(np.searchsorted(ends, before + limit, "right"))))
            yield batch.slice(first, last - first)
            first = last

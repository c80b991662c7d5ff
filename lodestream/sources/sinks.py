"""Results to files that other tools read: one text file a document, and JSON lines that a later run adds to."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_files(documents: DataFrame, folder: str, *, name: str = "name", text: str = "text") -> DataFrame:
    """Write each document as ``<name>.txt`` below `folder`; returns (name, file). A name's odd characters become _, and names that then are equal get a hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        system.create_dir(path, recursive=True)
        for batch in batches:
            files = []
            for file, t in zip(batch[1].to_pylist(), batch[2].to_pylist(), strict=True):
                with system.open_output_stream(f"{path}/{file}", compression=None) as out:
                    out.write((t or "").encode())
                files.append(file)
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(files, pa.string())], ["name", "file"])

    plain = F.regexp_replace(F.coalesce(F.col(name).cast("string"), F.lit("document")), r"[^\w.-]+", "_")
    file = F.concat(F.when(plain == F.col(name), plain).otherwise(F.concat(plain, F.lit("-"), F.hex(F.xxhash64(F.col(name))))), F.lit(".txt"))
    return documents.select(F.col(name).cast("string").alias("name"), file.alias("file"), F.col(text).cast("string").alias("text")).mapInArrow(work, "name string, file string")


def json_lines(rows: DataFrame, path: str, *, key: str) -> int:
    """Append the rows whose `key` the JSON lines at `path` lack; how many there were."""
    spark, schema = rows.sparkSession, rows.schema
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    before = 0
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        done = spark.read.schema(schema).json(path)
        before = done.count()
        rows = rows.join(done.select(key), key, "left_anti")
    rows.write.mode("append").json(path)
    return spark.read.schema(schema).json(path).count() - before

"""Token-id files: every id in the least number of bits that holds the vocabulary.

One file holds whole documents in ascending doc_id order::

    magic "LDBP" | version u16 | bits u16 | ids a block u32 | documents u64 | ids u64 | blocks u64
    doc_id i64 x documents | null flag u8 x documents | ids u64 x documents | byte offset of each block u64 x (blocks + 1)
    blocks: ids packed from the least significant bit on, in little-endian 64-bit words

A block holds a multiple of 64 ids (the last is padded with zeros), so that it starts on a word boundary, and any block
can be read and unpacked by itself.

Null texts count as empty: such a document has the end id only. Documents with a null doc_id come first; repeated
doc_ids stand together, in the order of their texts. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.llm._shared import gathered, put_file, ranged, scratch, small_batches, written
from lodestream.llm._tokens import encoder, table_path, with_end

HEAD = struct.Struct("<4sHHIQQQ")
BLOCK = 65536


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """64 ids fill `bits` words exactly, so each of the 64 places has one fixed shift."""
    n = -(-len(ids) // 64) * 64
    if bits in (8, 16, 32):
        out = np.zeros(n, f"<u{bits // 8}")
        out[: len(ids)] = ids
        return out.tobytes()
    rows = np.zeros(n, np.uint64)
    rows[: len(ids)] = ids
    rows = rows.reshape(-1, 64)
    words = np.zeros((len(rows), bits), np.uint64)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        words[:, word] |= rows[:, i] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= rows[:, i] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack(data: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    rows = np.empty((len(words), 64), np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        rows[:, i] = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            rows[:, i] |= words[:, word + 1] << np.uint64(64 - shift)
    return (rows & mask).astype(np.uint32).reshape(-1)[:n]


def build(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    places = np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype("<u8")
    head = HEAD.pack(b"LDBP", 1, bits, block, len(doc_ids), len(ids), len(blocks))
    keys = np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes() + bytes(x is None for x in doc_ids)
    return b"".join([head, keys, counts.astype("<u8").tobytes(), places.tobytes(), *blocks])


class PackedFile:
    """Random access to the ids of one file: its bytes, or its path, of which only the index and the blocks asked for are read."""

    def __init__(self, source: bytes | str):
        self.read_at = ranged(source) if isinstance(source, str) else lambda at, n: source[at : at + n]
        magic, version, self.bits, self.block, n, self.n_ids, blocks = HEAD.unpack(self.read_at(0, HEAD.size))
        if magic != b"LDBP" or version != 1:
            raise ValueError("not a token-id file of version 1")
        self.body = HEAD.size + 17 * n + 8 * (blocks + 1)
        index = self.read_at(HEAD.size, self.body - HEAD.size)
        self.doc_ids = np.frombuffer(index, "<i8", n)
        self.nulls = np.frombuffer(index, np.uint8, n, 8 * n).astype(bool)
        self.counts = np.frombuffer(index, "<u8", n, 9 * n).astype(np.int64)
        self.places = np.frombuffer(index, "<u8", blocks + 1, 17 * n).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))

    @property
    def data(self) -> bytes:
        """All blocks."""
        return self.read_at(self.body, int(self.places[-1]))

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids from `first` up to `last`, reading only their blocks."""
        if first >= last:
            return np.zeros(0, np.uint32)
        low, high = first // self.block, (last - 1) // self.block
        held = min((high + 1) * self.block, self.n_ids) - low * self.block
        data = self.read_at(self.body + int(self.places[low]), int(self.places[high + 1] - self.places[low]))
        return unpack(data, self.bits, held)[first - low * self.block : last - low * self.block]


MANIFEST = "part int, piece int, file string, n_docs long, n_tokens long"


def write(docs: DataFrame, folder: str, *, tokenizer: str | None = None, end_id: int = 2, file_bytes: int = 12 << 20, partitions: int | None = None) -> DataFrame:
    """Encode `docs` (doc_id, text) into files under `folder`; returns the manifest, one row per file in id order by (part, piece)."""
    spark = docs.sparkSession
    small_batches(spark)
    path = table_path("byte_bpe_50k.json", tokenizer)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, spaces_count=True)
        bits = bits_for(own.tokenizer.get_vocab_size())
        part = TaskContext.get().partitionId()
        for piece, table in enumerate(gathered(batches, "text", file_bytes)):
            ids, starts = with_end(*own.encode(table["text"]), end_id)
            data = build(table["doc_id"].to_pylist(), np.diff(starts), ids, bits)
            name = put_file(folder, f"ids-{part:06d}-{piece:05d}.ldbp", data)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "piece": pa.array([piece], pa.int32()), "file": [name], "n_docs": [table.num_rows], "n_tokens": [len(ids)]})

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(work, MANIFEST), f"{folder}/manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    # Running sums within the parts of the write, and over the parts: a row for each of its partitions in one task.
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("first"))
    within = manifest.withColumn("base", before(Window.partitionBy("part").orderBy("piece")))
    files = within.join(parts, "part").select("file", (F.col("first") + F.col("base")).alias("base"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch["file"].to_pylist(), batch["base"].to_pylist(), strict=True):
                packed = PackedFile(name)
                sums = np.empty(len(packed.counts), np.int64)
                step = 1 << 20
                i = 0
                while i < len(sums):
                    j = max(i + 1, int(np.searchsorted(packed.starts, packed.starts[i] + step, "right")) - 1)
                    ids = packed.ids(int(packed.starts[i]), int(packed.starts[j])).astype("<u4")
                    view = memoryview(ids.tobytes())
                    for k in range(i, j):
                        a, b = packed.starts[k] - packed.starts[i], packed.starts[k + 1] - packed.starts[i]
                        sums[k] = zlib.crc32(view[4 * a : 4 * b])
                    i = j
                yield pa.RecordBatch.from_arrays(
                    [pa.array(packed.doc_ids, pa.int64(), mask=packed.nulls), pa.array(packed.starts[:-1] + start), pa.array(packed.counts), pa.array(sums)],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files.repartition(n).mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write the files of all documents, then read them back."""
    return read(write(docs, scratch(docs.sparkSession, "bitpack"), tokenizer=tokenizer, end_id=end_id))


def op2_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))

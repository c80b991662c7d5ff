"""WARC archives, one Zstandard frame a record, with a dictionary in a leading skippable frame.

The dictionary is trained once on a bounded sample of the pages (`SAMPLE` of them, at most the first `SAMPLE_CHARS`
characters of each, chosen by a hash of id and html; where that picks none, any) and stored compressed in the first frame of every file, so a file can be read without anything else.

Of pages with equal payloads of at least `min_bytes`, the one with the largest page_id is a response and the others are
revisits that refer to it; pages with smaller payloads are responses. Null html is an empty payload. A null page_id is
smaller than any other, and pages whose page_id is the largest or where all are null are all responses. Repeated rows
with the largest page_id are all responses, and share a record id. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm._shared import gathered, get_file, put_file, scratch, small_batches, written

SAMPLE, SAMPLE_CHARS, DICTIONARY_BYTES = 600, 32_768, 112_640
SKIPPABLE = struct.Struct("<II")
MAGIC = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None) -> str:
    """A version 8 UUID that holds the 64 bits of the page id, and whether it is null."""
    bits = (page_id or 0) & (1 << 64) - 1
    null = 0xFFF if page_id is None else 0
    return f"<urn:uuid:{uuid.UUID(int=(bits >> 16) << 80 | 0x8 << 76 | null << 64 | 0x2 << 62 | bits & 0xFFFF)}>"


def page_of(record: str) -> int | None:
    value = uuid.UUID(record.removeprefix("<urn:uuid:").removesuffix(">")).int
    if value >> 64 & 0xFFF:
        return None
    bits = (value >> 80) << 16 | value & 0xFFFF
    return bits - (1 << 64) if bits >> 63 else bits


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    target = "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page_id}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> bytes:
    """A dictionary from records; their plain contents where there are too few to train on."""
    import zstandard

    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


class Writer:
    def __init__(self, dictionary: bytes, level: int = 3):
        import zstandard

        self.out = io.BytesIO()
        if dictionary:
            held = zstandard.ZstdCompressor(19).compress(dictionary)
            self.out.write(SKIPPABLE.pack(MAGIC, len(held)) + held)
        self.compressor = zstandard.ZstdCompressor(level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        body = b"software: lodestream\r\nformat: WARC File Format 1.1\r\n"
        self.add(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.UUID(bytes=hashlib.sha1(dictionary).digest()[:16], version=5)}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n")

    def add(self, data: bytes) -> int:
        at = self.out.tell()
        self.out.write(self.compressor.compress(data))
        return at


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive."""
    import zstandard

    source = io.BytesIO(data)
    own = None
    if len(data) >= 8:
        magic, size = SKIPPABLE.unpack(source.read(8))
        if magic == MAGIC:
            held = source.read(size)
            own = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(held) if held[:4] == b"\x28\xb5\x2f\xfd" else held)
        else:
            source.seek(0)
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=own).stream_reader(source, read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should start")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield headers, block


def marked(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, html, revisit, refers_to."""
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("_digest", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    if min_bytes > 0:
        own = own.withColumn("_digest", F.when(F.octet_length("html") >= min_bytes, F.col("_digest")))
    several = own.where("_digest is not null").groupBy(F.col("_digest").alias("_d")).agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1 and _last is not null")
    revisit = F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return own.join(several, F.col("_digest") == F.col("_d"), "left").select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("_last")).alias("refers_to"))


def write(pages: DataFrame, folder: str, *, min_bytes: int = 0, file_bytes: int = 32 << 20) -> DataFrame:
    """Archives under `folder` of `pages` (page_id, url, html); returns their manifest (file, n_records)."""
    small_batches(pages.sparkSession)
    # Every task would send its SAMPLE best pages to the driver, so a hash leaves about twice SAMPLE of all of them first.
    share = min(1.0, 2 * SAMPLE / max(1, pages.count()))
    pieces = pages.select("page_id", F.substring("html", 1, SAMPLE_CHARS).alias("html"))
    hashed = F.xxhash64("page_id", "html")
    picked = pieces.where(F.pmod(hashed, F.lit(1_000_000_007)) < int(share * 1_000_000_007)).orderBy(hashed, "page_id", "html").limit(SAMPLE).collect()
    picked = picked or pieces.limit(SAMPLE).collect()
    dictionary = train([record(r.page_id, None, (r.html or "").encode(), None, False) for r in picked])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for piece, table in enumerate(gathered(batches, "html", file_bytes)):
            out = Writer(dictionary)
            for page_id, url, html, revisit, refers_to in zip(*(table[c].to_pylist() for c in ("page_id", "url", "html", "revisit", "refers_to")), strict=True):
                out.add(record(page_id, url, html.encode(), refers_to, revisit))
            name = put_file(folder, f"pages-{part:06d}-{piece:04d}.warc.zst", out.out.getvalue())
            yield pa.RecordBatch.from_pydict({"file": [name], "n_records": [table.num_rows]})

    return written(marked(pages, min_bytes).mapInArrow(work, "file string, n_records long"), f"{folder}/manifest")


def read(manifest: DataFrame) -> DataFrame:
    """One row for each record of the archives."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch["file"].to_pylist():
                rows: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
                for headers, block in records(get_file(name)):
                    kind = headers["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    said = headers["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (size != len(payload) or digest(payload) != said):
                        raise ValueError(f"a payload of {name} is not what was written")
                    for column, value in zip(rows, (page_of(headers["warc-record-id"]), size, said, kind, page_of(headers["warc-refers-to"]) if kind == "revisit" else None), strict=True):
                        rows[column].append(value)
                yield pa.RecordBatch.from_pydict(rows, pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file").repartition(n).mapInArrow(work, SCHEMA)


def archive(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Write the archives of all pages, then read them back."""
    return read(write(pages, scratch(pages.sparkSession, "warc"), min_bytes=min_bytes))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages
), h AS (
  SELECT *, unhex(sha1(html)) AS raw, last IS NOT NULL AND page_id IS DISTINCT FROM last AS again FROM p
), bits AS (
  SELECT *, lpad(bin(CAST('0x' || substr(hex(raw), 1, 10) AS UBIGINT)), 40, '0') || lpad(bin(CAST('0x' || substr(hex(raw), 11, 10) AS UBIGINT)), 40, '0')
    || lpad(bin(CAST('0x' || substr(hex(raw), 21, 10) AS UBIGINT)), 40, '0') || lpad(bin(CAST('0x' || substr(hex(raw), 31, 10) AS UBIGINT)), 40, '0') AS b
  FROM h
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(list_sum(list_transform(generate_series(0, 4), lambda j: CAST(substr(b, i * 5 + j + 1, 1) AS INT) * CAST(pow(2, 4 - j) AS INT))) AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to
FROM bits
"""

"""Finding every window of `length` units (words or bytes) that also starts in a document with a smaller doc_id.

The texts are never shuffled. Each task writes the documents that it reads as blocks into the shared folder, and what
travels are fingerprints, verdicts and the surroundings of the few places that repeat:

1. `_blocks`: in each window the `gram` with the least hash is an anchor, so equal windows have equal anchors at equal
   offsets. A block sends the 48-bit fingerprints of its distinct anchor grams, dealt over buckets.
2. `_repeated`: a bucket tells each block which grams other blocks have too, and which are hot.
3. `_surroundings`: a block sends the surroundings (all windows around the anchor) of those grams, equal ones once. Of hot
   grams it sends the hashes of whole windows instead, so that the longest prefix splits a group that a short one
   leaves too large for one task; equal windows are sent once a block.
4. `_resolved`: surroundings that are equal throughout need no more than their smallest doc_id. Where one gram has
   several surroundings, `resolve` (a suffix tree or a suffix array) finds the windows that they share.
5. `_applied`: each block turns the verdicts into covered units.

A repeated attempt of a task writes the same files. Rows with a null doc_id take no part: nothing is removed from them,
and nothing because of them. Rows with equal doc_ids count as one document, which removes nothing from itself.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lodestream.llm._shared import gathered, get_file, put_file, scratch, small_batches, trim

#: Units whose hashes are made at once; each takes a dozen arrays of eight bytes.
CHUNK = 1 << 18
#: More surroundings than this of one gram make it hot.
HOT = 2_000
#: Words or bytes of surroundings that `resolve` gets at once.
UNITS = 1 << 20
U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE_CODES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BASES = (U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def _tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The first `n` powers, or more, of each base and of its inverse modulo 2 ** 64; a worker keeps one set."""
    if not _TABLES or len(_TABLES[0][0]) < n:
        n = 1 << (n - 1).bit_length()
        _TABLES[:] = [(_powers(b, n), _powers(U(pow(int(b), -1, 1 << 64)), n)) for b in _BASES]
    return _TABLES


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


GOLDEN = _BASES[0]


def flattened(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after the other, and where each starts (one entry more than texts)."""
    flat = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(flat) or flat.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(flat) + 1, np.int64)
    ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    return np.frombuffer(flat.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def words(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of flattened texts: a 64-bit code, the first byte and the size of each, and where those of each text start."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = ends[:-1][ends[:-1] < len(raw)]
    tails = ends[1:][ends[1:] > 0] - 1
    first[heads], last[tails] = inside[heads], inside[tails]
    start = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - start
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(7, np.uint8)]), 8)
    masks = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
    code = size.astype(np.uint64)
    left, k = np.arange(len(start)), 0
    while len(left):
        part = np.ascontiguousarray(eights[start[left] + k]).view("<u8").reshape(-1) & masks[np.minimum(size[left] - k, 8)]
        code[left] = mix(code[left] * GOLDEN + part)
        k += 8
        left = left[size[left] > k]
    return code, start, size, np.searchsorted(start, ends)


def before(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of `mask` are set before each of the places `at`."""
    sums = np.zeros(len(mask) + 1, np.int32 if len(mask) < 1 << 31 else np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[at].astype(np.int64)


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(1).compress(data)


def loosen(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


@dataclass(frozen=True)
class Spec:
    name: str
    words: bool
    length: int
    gram: int
    block_bytes: int
    #: (group of each sequence, sequences) -> (sequence, offset, class) of windows that are not alone in their group.
    resolve: Callable[[np.ndarray, list[np.ndarray]], tuple[np.ndarray, np.ndarray, np.ndarray]]

    @property
    def reach(self) -> int:
        """Windows that hold a given anchor."""
        return self.length - self.gram + 1


class Block:
    """Documents of one block as a sequence of units with 64-bit codes."""

    def __init__(self, spec: Spec, texts: pa.Array, doc_ids: pa.Array):
        self.spec = spec
        self.raw, self.ends = flattened(texts)
        if spec.words:
            self.codes, self.first, self.size, self.starts = words(self.raw, self.ends)
        else:
            self.starts = self.ends
            self.codes = None  # by chunk: eight bytes a byte are too many to hold
        self.n = int(self.starts[-1])
        self.ids = pc.fill_null(doc_ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.nulls = pc.is_null(doc_ids).to_numpy(zero_copy_only=False)

    def code(self, a: int, b: int) -> np.ndarray:
        return self.codes[a:b] if self.spec.words else _BYTE_CODES[self.raw[a:b]]

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def around(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        doc = self.doc_of(at)
        return np.maximum(self.starts[doc], at - (self.spec.reach - 1)), np.minimum(self.starts[doc + 1], at + self.spec.length)

    def _sums(self, a: int, b: int) -> list[tuple[np.ndarray, np.ndarray]]:
        code = self.code(a, b)
        out = []
        for power, inverse in _tables(CHUNK + 4 * self.spec.length):
            sums = np.zeros(len(code) + 1, np.uint64)
            np.cumsum(code * power[: len(code)], out=sums[1:])
            out.append((sums, inverse))
        return out

    def hashes(self, at: np.ndarray, sums, a: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the gram, and of the surroundings with the place of the anchor in them.

        Anchors are the grams of least hash, so that hash lies near zero; the key is another one, spread evenly over buckets.
        """
        (s1, i1), (s2, i2) = sums
        low, high = self.around(at)
        key = mix(mix((s1[at - a + self.spec.gram] - s1[at - a]) * i1[at - a]) + _BASES[0])
        span = (s2[high - a] - s2[low - a]) * i2[low - a]
        return key, mix(span ^ mix((at - low).astype(np.uint64) << U(16) ^ (high - at).astype(np.uint64)))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, key, hash of the surroundings) of all anchors, by position."""
        length, gram, reach = self.spec.length, self.spec.gram, self.spec.reach
        found = []
        ends = self.starts[1:]
        for c in range(0, max(0, self.n - length + 1), CHUNK):
            a, b = max(0, c - length), min(self.n, c + CHUNK + 2 * length)
            sums = self._sums(a, b)
            last = min(c + CHUNK, self.n - length + 1)  # window starts c to last
            s1, i1 = sums[0]
            p = np.arange(c - a, last - a + reach - 1)
            hashed = mix((s1[p + gram] - s1[p]) * i1[p])
            least = hashed & ~U((1 << 22) - 1) | np.arange(len(p), dtype=np.uint64)
            width = 1
            while 2 * width <= reach:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < reach:
                least = np.minimum(least[: -(reach - width)], least[reach - width :])
            doc = self.doc_of(np.arange(c, last)) if len(ends) else np.zeros(0, np.int64)
            valid = (ends[doc] - np.arange(c, last) >= length) & ~self.nulls[doc]
            mark = np.zeros(len(p), bool)
            mark[(least[valid] & U((1 << 22) - 1)).astype(np.int64)] = True
            at = np.flatnonzero(mark) + c
            found.append((at, *self.hashes(at, sums, a)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        at, key, around = (np.concatenate(x) for x in zip(*found, strict=True))
        at, first = np.unique(at, return_index=True)
        return at, key[first], around[first]

    def rehash(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of given anchors, in their order."""
        order = np.argsort(at, kind="stable")
        key, around = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        ordered = at[order]
        for c in range(0, self.n, CHUNK):
            own = order[np.searchsorted(ordered, c) : np.searchsorted(ordered, c + CHUNK)]
            if len(own):
                a, b = max(0, c - self.spec.length), min(self.n, c + CHUNK + 2 * self.spec.length)
                key[own], around[own] = self.hashes(at[own], self._sums(a, b), a)
        return key, around

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into `at`, hash of the whole window) for every window around the anchors; the offset counts up in each."""
        length = self.spec.length
        low, high = self.around(at)
        n = high - low - length + 1
        of = np.repeat(np.arange(len(at)), n)
        start = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out = np.zeros(len(start), np.uint64)
        order = np.argsort(start, kind="stable")
        ordered = start[order]
        for c in range(0, self.n, CHUNK):
            own = order[np.searchsorted(ordered, c) : np.searchsorted(ordered, c + CHUNK)]
            if len(own):
                b = min(self.n, c + CHUNK + length)
                (s1, i1), (s2, i2) = self._sums(c, b)
                s = start[own] - c
                out[own] = mix((s1[s + length] - s1[s]) * i1[s]) + U(3) * mix((s2[s + length] - s2[s]) * i2[s])
        return of, out

    def content(self, low: np.ndarray, high: np.ndarray) -> list[bytes]:
        raw = self.raw.tobytes()
        if not self.spec.words:
            return [raw[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        last = self.first[high - 1] + self.size[high - 1]
        return [b" ".join(raw[a:b].split()) for a, b in zip(self.first[low].tolist(), last.tolist(), strict=True)]


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending with the key, so that a sorted list falls into consecutive parts."""
    return ((key >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def _rows(name: str, parts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """(bucket, kind, data) from block `name`."""
    return pa.RecordBatch.from_arrays(
        [pa.array([p[0] for p in parts], pa.int32()), pa.array([name] * len(parts), pa.string()), pa.array([p[1] for p in parts], pa.int32()), pa.array([p[2] for p in parts], pa.binary())], ["bucket", "block", "kind", "data"]
    )


#: Messages of one task to one slot lie in one row. Their number is that of the shuffle's own segments.
MESSAGES = "slot int, entries array<struct<bucket: int, block: string, kind: int, data: binary>>"
#: Bytes of messages that a task holds before it sends them.
HELD = 32 << 20


def block_slot(name: str, n: int) -> int:
    """The partition of a block; consecutive blocks of one task and blocks of consecutive tasks lie in different ones."""
    part, piece = name.split("-")
    return (5 * int(part) + int(piece)) % n


def _addressed(tables: list[pa.Table], slot_of: Callable[[pa.Table], np.ndarray]) -> pa.RecordBatch:
    table = pa.concat_tables(tables)
    slots = slot_of(table).astype(np.int32)
    order = np.argsort(slots, kind="stable")
    values, first = np.unique(slots[order], return_index=True)
    own = table.take(pa.array(order)).combine_chunks().to_batches()[0]
    entries = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.StructArray.from_arrays(own.columns, names=own.schema.names))
    return pa.RecordBatch.from_arrays([pa.array(values), entries], ["slot", "entries"])


def sent(tables: Iterator[pa.Table], slot_of: Callable[[pa.Table], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """MESSAGES of tables of (bucket, block, kind, data)."""
    held: list[pa.Table] = []
    size = 0
    for table in tables:
        held.append(table)
        size += table.nbytes
        if size >= HELD:
            yield _addressed(held, slot_of)
            held, size = [], 0
    if held:
        yield _addressed(held, slot_of)


def received(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The messages of one partition by bucket or by block."""
    held = [pa.Table.from_batches([pa.RecordBatch.from_struct_array(b.column("entries").flatten())]) for b in batches if b.num_rows]
    if held:
        table = pa.concat_tables(held)
        values = table[key].combine_chunks().dictionary_encode()
        for i in range(len(values.dictionary)):
            yield table.filter(pc.equal(values.indices, i)).combine_chunks()


def _save(folder: str, name: str, **arrays) -> None:
    put_file(folder, name, squeeze(pickle.dumps(arrays, protocol=5)))


def _load(folder: str, name: str) -> dict:
    return pickle.loads(loosen(get_file(f"{folder}/{name}")))  # written by `_save` in this run's own folder


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _block(spec: Spec, folder: str, name: str) -> tuple[pa.Table, Block]:
    rows = pa.ipc.open_stream(_load(folder, name)["rows"]).read_all().combine_chunks()
    return rows, Block(spec, rows["text"].combine_chunks() if rows.num_rows else pa.array([], pa.string()), rows["doc_id"].combine_chunks() if rows.num_rows else pa.array([], pa.int64()))


def _starts(changed: np.ndarray) -> np.ndarray:
    return np.flatnonzero(changed)


def _bounds(values: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(values, np.arange(buckets + 1))


def _blocks(spec: Spec, folder: str, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.Table]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        part = TaskContext.get().partitionId()
        for piece, table in enumerate(gathered(batches, "text", spec.block_bytes)):
            name = f"{part:06d}-{piece:05d}"
            table = table.combine_chunks()
            block = Block(spec, table["text"].combine_chunks(), table["doc_id"].combine_chunks())
            at, key, around = block.anchors()
            ids = block.ids[block.doc_of(at)]
            order = np.lexsort((ids, around, key))
            at, key, around = at[order], key[order], around[order]
            new_key = np.append(True, key[1:] != key[:-1])[: len(key)]
            new_entry = new_key | np.append(True, around[1:] != around[:-1])[: len(key)]
            _save(folder, name, rows=_ipc(table))
            _save(folder, f"{name}-anchors", at=at.astype(np.uint32 if block.n < 1 << 32 else np.int64), new_key=np.packbits(new_key), new_entry=np.packbits(new_entry))
            keys = key[new_key]
            counts = np.minimum(np.add.reduceat(new_entry, np.flatnonzero(new_key)), 65535).astype(np.uint16) if len(key) else np.zeros(0, np.uint16)
            bounds = _bounds(bucket_of(keys, buckets), buckets)
            prints = keys >> U(16)
            parts = [(i, 0, squeeze(np.diff(prints[a:b], prepend=U(0)).tobytes() + counts[a:b].tobytes())) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
            out = pa.Table.from_batches([_rows(name, parts or [(xxhash.xxh32_intdigest(name) % buckets, 0, squeeze(b""))])])
            del block, at, key, around, ids, order, table
            trim()
            yield out

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Of one bucket: for each print of each block 0 (in no other block), 1, or 2 (hot)."""
    table = table.sort_by("block")
    names, datas = table["block"].to_pylist(), table["data"].to_pylist()
    prints, counts = [], []
    for data in datas:
        data = loosen(data)
        n = len(data) // 10
        prints.append(np.cumsum(np.frombuffer(data, np.uint64, n), dtype=np.uint64))
        counts.append(np.frombuffer(data, np.uint16, n, 8 * n))
    joined = np.concatenate(prints)
    values, inverse, times = np.unique(joined, return_inverse=True, return_counts=True)
    total = np.bincount(inverse, np.concatenate(counts), minlength=len(values))
    verdict = np.where((times > 1) | (total > 1), 1, 0).astype(np.uint8)
    verdict[total > HOT] = 2
    at = np.cumsum([0, *map(len, prints)])
    return pa.Table.from_batches([_rows(name, [(table["bucket"][0].as_py(), 0, squeeze(verdict[inverse[a:b]].tobytes()))]) for name, a, b in zip(names, at[:-1], at[1:], strict=True)])


class Entries:
    """What a block knows of its anchors: occurrences sorted by (key, surroundings, doc_id)."""

    def __init__(self, block: Block, saved: dict):
        n = len(saved["at"])
        self.at = saved["at"].astype(np.int64)
        new_entry = np.unpackbits(saved["new_entry"], count=n).astype(bool)
        new_key = np.unpackbits(saved["new_key"], count=n).astype(bool)
        self.first = np.flatnonzero(new_entry)
        self.key_of = np.cumsum(new_key)[self.first] - 1 if n else np.zeros(0, np.int64)
        self.entry_of = np.cumsum(new_entry) - 1
        self.ids = block.ids[block.doc_of(self.at)] if n else np.zeros(0, np.int64)

    def least(self) -> np.ndarray:
        return self.ids[self.first]


def _joined(table: pa.Table, kind: int, dtype) -> np.ndarray:
    rows = table.filter(pc.equal(table["kind"], kind)).sort_by("bucket")
    return np.concatenate([np.zeros(0, dtype), *(np.frombuffer(loosen(d), dtype) for d in rows["data"].to_pylist())])


def _unique_windows(block: Block, at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """(index into `at`, its window's place in the unique hashes, unique hashes, least doc_id of each)."""
    of, hashed = block.windows(at)
    values, place = np.unique(hashed, return_inverse=True)
    least = np.full(len(values), np.iinfo(np.int64).max)
    np.minimum.at(least, place, ids[of])
    return of, place, values, least


def _surroundings(spec: Spec, folder: str, buckets: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        name = table["block"][0].as_py()
        _, block = _block(spec, folder, name)
        entries = Entries(block, _load(folder, f"{name}-anchors"))
        verdict = _joined(table, 0, np.uint8)[entries.key_of] if len(entries.at) else np.zeros(0, np.uint8)
        sent, hot = np.flatnonzero(verdict == 1), np.flatnonzero(verdict == 2)
        _save(folder, f"{name}-sent", sent=sent, hot=hot)
        parts: list[tuple[int, int, bytes]] = []
        at, least = entries.at[entries.first[sent]], entries.least()[sent]
        key, around = block.rehash(at)
        low, high = block.around(at)
        content = block.content(low, high)
        sizes = np.fromiter(map(len, content), np.uint32, len(content))
        bounds = _bounds(bucket_of(key, buckets), buckets)
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if b > a:
                arrays = (key[a:b], around[a:b], least[a:b], sizes[a:b], (high - low)[a:b].astype(np.uint32))
                parts.append((i, 0, squeeze(np.uint32(b - a).tobytes() + b"".join(x.tobytes() for x in arrays) + b"".join(content[a:b]))))
        if len(hot):
            _, _, values, least = _unique_windows(block, entries.at[entries.first[hot]], entries.least()[hot])
            bounds = _bounds(bucket_of(values, buckets), buckets)
            parts += [(i, 1, squeeze(values[a:b].tobytes() + least[a:b].tobytes())) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
        return pa.Table.from_batches([_rows(name, parts or [(xxhash.xxh32_intdigest(name) % buckets, 2, squeeze(b""))])])

    return run


def _variants(spec: Spec, content: list[bytes]) -> list[np.ndarray]:
    if not spec.words:
        return [np.frombuffer(c, np.uint8) for c in content]
    raw = np.frombuffer(b"".join(content), np.uint8)
    code, _, _, starts = words(raw, np.cumsum([0, *map(len, content)]))
    return np.split(code, starts[1:-1])


def _resolved(spec: Spec) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        out = [_rows(n, [(bucket, 2, squeeze(b""))]) for n in table.filter(pc.equal(table["kind"], 2))["block"].to_pylist()]
        own = table.filter(pc.equal(table["kind"], 0))
        if own.num_rows:
            keys, arounds, ids, contents, units = [], [], [], [], []
            for data in own["data"].to_pylist():
                data = loosen(data)
                n = int(np.frombuffer(data, np.uint32, 1)[0])
                at = 4
                for held, kind in ((keys, np.uint64), (arounds, np.uint64), (ids, np.int64)):
                    held.append(np.frombuffer(data, kind, n, at))
                    at += 8 * n
                sizes, count = np.frombuffer(data, np.uint32, n, at), np.frombuffer(data, np.uint32, n, at + 4 * n)
                units.append(count)
                ends = np.cumsum(sizes, dtype=np.int64) + at + 8 * n
                contents.append((data, ends - sizes, ends))
            sizes = [len(k) for k in keys]
            source = np.repeat(np.arange(len(sizes)), sizes)
            key, around, doc, unit = (np.concatenate(x) for x in (keys, arounds, ids, units))
            within = np.concatenate([np.arange(n) for n in sizes])
            order = np.lexsort((doc, around, key))
            k, r, d = key[order], around[order], doc[order]
            new_key = np.append(True, k[1:] != k[:-1])
            new = new_key | np.append(True, r[1:] != r[:-1])
            first = np.flatnonzero(new)
            variant = np.cumsum(new) - 1
            group = np.cumsum(new_key)[first] - 1
            least = d[first]
            n_windows = unit[order][first].astype(np.int64) - spec.length + 1
            full = (U(1) << n_windows.astype(np.uint64)) - U(1)
            mask = np.zeros(len(first), np.uint64)
            several = np.flatnonzero(np.bincount(group)[group] > 1)
            used = np.cumsum(unit[order][first[several]], dtype=np.int64)
            low = 0
            while low < len(several):  # whole groups, about UNITS at a time
                high = int(np.searchsorted(used, (used[low - 1] if low else 0) + UNITS))
                high = int(np.searchsorted(group[several], group[several[min(high, len(several) - 1)]], "right"))
                own_part = several[low:high]
                low = high
                pick = order[first[own_part]]
                texts = [contents[s][0][contents[s][1][w] : contents[s][2][w]] for s, w in zip(source[pick].tolist(), within[pick].tolist(), strict=True)]
                v, offset, cls = spec.resolve(group[own_part], _variants(spec, texts))
                if len(v):
                    best = np.full(int(cls.max()) + 1, np.iinfo(np.int64).max)
                    np.minimum.at(best, cls, least[own_part[v]])
                    covered = best[cls] < least[own_part[v]]
                    np.bitwise_or.at(mask, own_part[v[covered]], U(1) << offset[covered].astype(np.uint64))
            verdict = np.empty(len(key), np.uint64)
            verdict[order] = np.where(d > least[variant], full[variant], mask[variant])
            at = np.cumsum([0, *sizes])
            out += [_rows(n, [(bucket, 0, squeeze(verdict[a:b].tobytes()))]) for n, a, b in zip(own["block"].to_pylist(), at[:-1], at[1:], strict=True)]
        own = table.filter(pc.equal(table["kind"], 1))
        if own.num_rows:
            pairs = [np.frombuffer(loosen(d), np.uint64).reshape(2, -1) for d in own["data"].to_pylist()]
            hashed, doc = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]).view(np.int64)
            values, place = np.unique(hashed, return_inverse=True)
            least = np.full(len(values), np.iinfo(np.int64).max)
            np.minimum.at(least, place, doc)
            covered = (least[place] < doc).astype(np.uint8)
            at = np.cumsum([0, *(p.shape[1] for p in pairs)])
            out += [_rows(n, [(bucket, 1, squeeze(covered[a:b].tobytes()))]) for n, a, b in zip(own["block"].to_pylist(), at[:-1], at[1:], strict=True)]
        return pa.Table.from_batches(out)

    return run


def covered_units(block: Block, entries: Entries, sent: np.ndarray, hot: np.ndarray, masks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Whether each unit of the block lies in a window that also starts in a smaller document."""
    length = block.spec.length
    edge = np.zeros(block.n + 1, np.int32)
    if len(entries.at):
        n_entries = len(entries.first)
        verdict = np.zeros(n_entries, np.uint64)
        verdict[sent] = masks
        if len(hot):
            of, place, _, least = _unique_windows(block, entries.at[entries.first[hot]], entries.least()[hot])
            start = np.searchsorted(of, np.arange(len(hot)))
            offset = np.arange(len(of)) - start[of]
            yes = windows[place].astype(bool) | (least[place] < entries.least()[hot][of])
            np.bitwise_or.at(verdict, hot[of[yes]], U(1) << offset[yes].astype(np.uint64))
        low, high = block.around(entries.at)
        whole = entries.ids > entries.least()[entries.entry_of]
        np.add.at(edge, low[whole], 1)
        np.add.at(edge, high[whole], -1)
        part = np.flatnonzero(~whole & (verdict[entries.entry_of] != 0))
        bits, low = verdict[entries.entry_of[part]], low[part]
        for a in range(block.spec.reach):
            on = low[(bits >> U(a) & U(1)) == 1] + a
            np.add.at(edge, on, 1)
            np.add.at(edge, on + length, -1)
    return np.cumsum(edge[:-1], out=edge[:-1]) > 0


def _applied(spec: Spec, folder: str, finish: Callable[[pa.Table, Block, np.ndarray], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        name = table["block"][0].as_py()
        rows, block = _block(spec, folder, name)
        entries = Entries(block, _load(folder, f"{name}-anchors"))
        sent = _load(folder, f"{name}-sent")
        covered = covered_units(block, entries, sent["sent"], sent["hot"], _joined(table, 0, np.uint64), _joined(table, 1, np.uint8))
        return finish(rows, block, covered)

    return run


def repeats(docs: DataFrame, spec: Spec, finish: Callable[[pa.Table, Block, np.ndarray], pa.Table], schema) -> DataFrame:
    """`finish` turns the rows of a block and their covered units into the result with `schema`."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = scratch(spark, spec.name)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def to_bucket(table: pa.Table) -> np.ndarray:
        return table["bucket"].to_numpy()

    def to_block(table: pa.Table) -> np.ndarray:
        names = table["block"].combine_chunks().dictionary_encode()
        return np.array([block_slot(x, n) for x in names.dictionary.to_pylist()], np.int32)[names.indices.to_numpy()]

    def each(work: Callable[[pa.Table], pa.Table], batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
        for table in received(batches, key):
            yield work(table)
            trim()

    def hop(messages: DataFrame, work: Callable[[pa.Table], pa.Table], key: str, slot_of: Callable[[pa.Table], np.ndarray]) -> DataFrame:
        return messages.repartitionById(n, "slot").mapInArrow(lambda batches: sent(each(work, batches, key), slot_of), MESSAGES)

    blocks = _blocks(spec, folder, n)
    first = docs.mapInArrow(lambda batches: sent(blocks(batches), to_bucket), MESSAGES)
    told = hop(first, _repeated, "bucket", to_block)
    around = hop(told, _surroundings(spec, folder, n), "block", to_bucket)
    resolved = hop(around, _resolved(spec), "bucket", to_block)
    work = _applied(spec, folder, finish)
    last = resolved.repartitionById(n, "slot")
    return last.mapInArrow(lambda batches: (b for t in each(work, batches, "block") for b in t.to_batches()), schema)

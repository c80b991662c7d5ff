"""Byte-level BPE by a pair occurrence index.

The distinct pre-tokens of a batch are laid one after the other as symbols of a linked list. An index maps each pair to
all the positions where it occurs; the ranks that are active are applied in ascending order, each to all its positions
at once, and the lists of the pairs that come and go around a merge are updated. Within a word that is the order in
which BPE applies its merges, because a merge only makes pairs of higher rank; where a vocabulary breaks that rule,
the rank goes back into the queue and is still the least.

Null texts count as empty. Null and repeated doc_ids are passed through; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from lodestream.llm._shared import gathered, small_batches
from lodestream.llm._tokens import _LETTERS, KEPT, Pieces, table_path

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_BYTES = {chr(v): k for k, v in _LETTERS.items()}
_CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PairIndex:
    """Merges of a vocabulary, and their application to many words at once."""

    def __init__(self, merges: list[tuple[int, int, int]], base: np.ndarray):
        """merges: (left, right, result) in rank order; base: the id of each of the 256 bytes."""
        left, right, self.result = (np.array(x, np.int64) for x in zip(*merges, strict=True)) if merges else (np.zeros(0, np.int64),) * 3
        self.left, self.right = left, right
        keys = left << 32 | right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.base = base

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1 where the pair has no merge."""
        if not len(self.keys):
            return np.full(len(a), -1)
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (a >= 0) & (b >= 0), self.order[at], -1)

    def apply(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and where each word starts."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1)
        total = int(ends[-1]) + 1 if len(words) else 1
        sym = np.full(total, -1, np.int64)  # -1: between words
        places = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(words)) + 1, sizes)
        sym[places] = self.base[np.frombuffer(b"".join(words), np.uint8)]
        after = np.arange(1, total + 1)
        before = np.arange(-1, total - 1)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def add(at: np.ndarray, rank: np.ndarray) -> None:
            keep = rank >= 0
            at, rank = at[keep], rank[keep]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            low = 0
            for high, r in zip([*cuts.tolist(), len(at)], rank[[0, *cuts]].tolist(), strict=True):
                if r in index:
                    index[r].append(at[low:high])
                else:
                    index[r] = [at[low:high]]
                    heapq.heappush(queue, r)
                low = high

        if total > 1:
            add(np.arange(total - 1), self.ranks(sym[:-1], sym[1:]))
        while queue:
            r = heapq.heappop(queue)
            lists = index.pop(r)
            a, b, new = int(self.left[r]), int(self.right[r]), int(self.result[r])
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[sym[at] == a]
            at = at[sym[after[at]] == b]
            if a == b and len(at) > 1:  # of a run of the same symbol, every second pair from the left
                linked = np.flatnonzero(np.concatenate(([False], after[at[:-1]] == at[1:])))
                if len(linked):
                    heads = np.ones(len(at), bool)
                    heads[linked] = False
                    first = np.maximum.accumulate(np.where(heads, np.arange(len(at)), 0))
                    at = at[(np.arange(len(at)) - first) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            right = after[gone]
            sym[at] = new
            sym[gone] = -2
            after[at] = right
            before[right] = at
            prior = before[at]
            add(prior, self.ranks(sym[prior], sym[at]))
            add(at, self.ranks(sym[at], sym[right]))
        kept = sym >= 0
        counts = np.concatenate(([0], np.cumsum(kept)))
        return sym[kept], counts[np.concatenate(([0], ends))]


class ByteBpe:
    """Encoding and decoding with a byte-level vocabulary file, by the pair index."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.index = PairIndex([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.array([vocab[chr(_LETTERS[i])] for i in range(256)], np.int64))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(_BYTES[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.split = regex.compile(_CONTRACTIONS)
        self.marks = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.new: dict[str, tuple[int, bytes, bytes]] = {}
        self.old: dict[str, tuple[int, bytes, bytes]] = {}

    def _learn(self, words: list[str]) -> None:
        """Encode words not met before, all pre-tokens of all of them together."""
        distinct: dict[str, int] = {}
        split = self.split.findall
        parts = [[distinct.setdefault(p, len(distinct)) for p in (([w] if w.isalpha() and w.isascii() else split(w)))] for w in words]
        raw = [p.encode() for p in distinct]
        ids, starts = self.index.apply(raw)
        each = [ids[a:b].tolist() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        bytes_of = self.bytes_of
        for word, ps in zip(words, parts, strict=True):
            own = each[ps[0]] if len(ps) == 1 else [i for p in ps for i in each[p]]
            self.new[word] = (len(own), ",".join(map(str, own)).encode(), b"".join([bytes_of[i] for i in own]))

    def pieces(self, values: list[str]) -> list[tuple[int, bytes, bytes]]:
        """(ids, the ids in decimal, the bytes they decode to) of each piece."""
        if len(self.new) >= KEPT:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        missing = []
        for value in values:
            if value not in new:
                if (found := old.get(value)) is not None:
                    new[value] = found
                else:
                    missing.append(value)
        if missing:
            self._learn(list(dict.fromkeys(missing)))
        return [new[value] for value in values]

    def special_text(self, text: str) -> tuple[int, bytes, bytes]:
        """A text that holds special tokens: they are ids of their own, and what is between them is encoded apart."""
        parts: list[tuple[int, bytes, bytes]] = []
        at = 0
        for m in [*self.marks.finditer(text), None]:
            if between := text[at : m.start() if m else len(text)]:
                parts.extend(self.pieces([between]))
            if m:
                i = self.special[m[0]]
                parts.append((1, str(i).encode(), self.bytes_of[i]))
                at = m.end()
        return sum(p[0] for p in parts), b",".join(p[1] for p in parts), b"".join(p[2] for p in parts)

    def documents(self, texts: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, bytes, bytes]]:
        batch = Pieces(texts, spaces_count=True)
        codes = batch.codes
        heads, first = np.unique(codes[batch.firsts], return_inverse=True)
        table = self.pieces([" " + v for v in batch.values]) + [(0, b"", b"")]
        opening = self.pieces([batch.values[i] for i in heads if batch.values[i]] or ["."])
        spot, k = [], 0
        for i in heads:
            spot.append(k if batch.values[i] else -1)
            k += bool(batch.values[i])
        special = np.zeros(len(batch.firsts), bool)
        for mark in self.special:
            special |= pc.match_substring(batch.texts, mark).to_numpy(zero_copy_only=False)
        flat, starts = codes.tolist(), batch.starts.tolist()
        for d in range(len(starts) - 1):
            if special[d]:
                yield self.special_text(batch.texts[d].as_py())
                continue
            own = [table[c] for c in flat[starts[d] + 1 : starts[d + 1]]]
            if (head := spot[first[d]]) >= 0:
                own.insert(0, opening[head])
            yield sum([p[0] for p in own]), b",".join([p[1] for p in own]), b"".join([p[2] for p in own])


_LOADED: dict[str, ByteBpe] = {}


def encode_decode(docs: DataFrame, *, tokenizer: str | None = None, batch_bytes: int = 16 << 20) -> DataFrame:
    """Per document of `docs` (doc_id, text): the number of ids, a digest of them, and a digest of the text they decode to."""
    small_batches(docs.sparkSession)
    path = table_path("byte_bpe_50k.json", tokenizer)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = ByteBpe(path)
        own = _LOADED[path]
        for table in gathered(batches, "text", batch_bytes):
            n, ids, back = [], [], []
            for count, listed, raw in own.documents(table["text"]):
                n.append(count)
                ids.append(hashlib.sha256(listed).hexdigest())
                back.append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(work, SCHEMA)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))

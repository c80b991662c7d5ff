"""Texts to token ids: every distinct piece of a batch goes through the model once.

A text is cut before each space that a non-space follows. Both public vocabularies start a new pre-token there, so
encoding the pieces apart gives the ids of the whole text. Pieces that are plain Latin words with trailing signs go
straight to the model; the rest go through the tokenizer's own normaliser and pre-tokenizer; texts that hold the
string of a special token are encoded whole.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A worker keeps the ids of this many to twice as many distinct pieces between batches.
KEPT = 400_000

_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)?([.,;:!?%*$#&|()\-]+)?\Z")
_CUT = re.compile(r" (?=\S)")
_ODD = r" ([\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]|$)"


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(plain))}


_LETTERS = _byte_letters()


def letters(text: str) -> str:
    return (text if text.isascii() else text.encode().decode("latin-1")).translate(_LETTERS)


def table_path(name: str, path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """A batch cut into pieces: `codes` index `values` (strings, the space before a piece left out); `starts` are the pieces of each text."""

    def __init__(self, texts: pa.ChunkedArray | pa.Array, *, spaces_count: bool):
        flat = pc.fill_null(texts, "").cast(pa.large_string())
        flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
        if not spaces_count:
            flat = pc.replace_substring(flat, "\n", " ")
        lists = pc.split_pattern(flat, " ")
        if spaces_count and (odd := np.flatnonzero(pc.match_substring_regex(flat, _ODD).to_numpy(zero_copy_only=False))).size:
            cut = pa.array([_CUT.split(flat[int(i)].as_py()) for i in odd], lists.type)
            order = np.arange(len(flat))
            order[odd] = len(flat) + np.arange(odd.size)
            lists = pa.concat_arrays([lists, cut]).take(pa.array(order))
        self.texts = flat
        self.starts = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values if lists.offset == 0 and self.starts[0] == 0 else lists.flatten()
        self.starts = self.starts - self.starts[0]
        coded = words.dictionary_encode()
        self.codes = coded.indices.to_numpy()
        self.values = coded.dictionary.to_pylist()
        self.firsts = self.starts[:-1]


class WordEncoder:
    """Ids of texts by the tokenizers library, without added special tokens."""

    def __init__(self, path: str, *, spaces_count: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.spaces_count = spaces_count
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.normal = self.tokenizer.normalizer
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 65536 else "I"
        self.cache: dict[str, tuple[dict[str, bytes], dict[str, bytes]]] = {"": ({}, {}), " ": ({}, {})}
        self.signs: dict[str, list[int]] = {}
        self.line = self._library("\n")

    def _model(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(letters(word))]

    def _library(self, text: str) -> list[int]:
        if self.normal is not None:
            text = self.normal.normalize_str(text)
        return [t.id for part, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text) for t in self.model.tokenize(part)]

    def piece(self, text: str) -> list[int]:
        """Ids of one piece, with its space where spaces count."""
        if not text:
            return []
        bare = text[1:] if self.spaces_count and text[0] == " " else text
        if bare and (found := _PLAIN.match(bare)):
            word, sign = found.groups()
            if self.spaces_count:
                if text is not bare:
                    if word:
                        word = " " + word
                    elif sign:
                        sign = " " + sign
            elif word:
                word = word.lower()
            ids = self._model(word) if word else []
            if sign:
                if (more := self.signs.get(sign)) is None:
                    more = self.signs[sign] = self._model(sign)
                ids = ids + more
            return ids
        lines = bare.split("\n") if self.spaces_count else []
        if len(lines) > 1 and all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
            lines[0] = text[: len(text) - len(bare)] + lines[0]
            ids = self.piece(lines[0])
            for line in lines[1:]:
                ids = ids + self.line + self.piece(line)
            return ids
        return self._library(text)

    def known(self, values: list[str], space: str) -> list[bytes]:
        """Packed ids of each piece. Pieces not seen in the last `KEPT` or so go through the model."""
        new, old = self.cache[space]
        tokenize, kind, head = self.model.tokenize, self.kind, "\u0120" if space else ""
        out = []
        for value in values:
            if (ids := new.get(value)) is None:
                if (ids := old.get(value)) is None:
                    if value.isascii() and value.isalpha():
                        found = [t.id for t in tokenize(head + value if self.spaces_count else value.lower())]
                    else:
                        found = self.piece(space + value)
                    ids = array(kind, found).tobytes()
                new[value] = ids
                if len(new) >= KEPT:
                    old, new = new, {}
                    self.cache[space] = (new, old)
            out.append(ids)
        return out

    def encode(self, texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's ids start (one entry more than texts)."""
        batch = Pieces(texts, spaces_count=self.spaces_count)
        n = len(batch.firsts)
        space = " " if self.spaces_count else ""
        found = self.known(batch.values, space)
        codes = batch.codes
        if self.spaces_count and n:
            heads, codes_of = np.unique(codes[batch.firsts], return_inverse=True)
            found = found + self.known([batch.values[i] for i in heads], "")
            codes = codes.copy()
            codes[batch.firsts] = len(batch.values) + codes_of
        special = np.zeros(n, bool)
        for mark in self.specials:
            special |= pc.match_substring(batch.texts, mark).to_numpy(zero_copy_only=False)
        kind = np.dtype(np.uint16 if self.kind == "H" else np.uint32)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // kind.itemsize
        table = np.frombuffer(b"".join(found), kind)
        at = np.concatenate(([0], np.cumsum(sizes)))
        each = sizes[codes]
        ends = np.cumsum(each)
        starts = np.concatenate(([0], ends))[batch.starts] if n else np.zeros(1, np.int64)
        total = int(starts[-1])
        ids = table[np.repeat(at[codes] - (ends - each), each) + np.arange(total)].astype(np.uint32)
        if special.any():
            parts = [ids[starts[i] : starts[i + 1]] for i in range(n)]
            for i in np.flatnonzero(special):
                parts[i] = np.array(self.tokenizer.encode(batch.texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
            ids = np.concatenate(parts)
            starts = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        return ids, starts


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, *, spaces_count: bool) -> WordEncoder:
    """One encoder for each Python worker, kept while the worker lives."""
    key = (path, spaces_count)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path, spaces_count=spaces_count)
    return _ENCODERS[key]


def with_end(ids: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with id `end` after each text."""
    n = len(starts) - 1
    if not n:
        return ids, starts
    return np.insert(ids, starts[1:], np.uint32(end)), starts + np.arange(n + 1)

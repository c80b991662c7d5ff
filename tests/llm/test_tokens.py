"""Bit-packed files, packing and BPE against the tokenizers library, one text at a time."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers
from tokenizers import Tokenizer

from lodestream.llm import bitpack, bpe, packing


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def docs(texts, odd_texts):
    rows = [(i, t) for i, t in texts.items()] + [(10_000 + i, t) for i, t in enumerate(odd_texts)]
    return rows


@pytest.fixture(scope="module")
def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", t) for i, t in docs], "doc_id long, text string, ids string, start string").repartition(3)


def test_bit_packed_files(frame, docs):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected, start = {}, 0
    for i, t in sorted(docs, key=lambda x: x[0]):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        expected[i] = (start, len(ids), crc(ids))
        start += len(ids)
    got = bitpack.token_files(frame).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == expected


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 31, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64).astype(np.uint32)
    assert (bitpack.unpack(bitpack.pack(ids, bits), bits, 1000) == ids).all()
    file = bitpack.PackedFile(bitpack.build([5, None], np.array([400, 600]), ids, bits, block=128))
    assert (file.ids(100, 777) == ids[100:777]).all()
    assert file.ids(3, 3).size == 0
    assert len(file.data) <= (1000 + 64) * bits / 8


def test_only_the_blocks_asked_for_are_read(tmp_path, monkeypatch):
    ids = np.random.default_rng(0).integers(0, 1 << 13, 100_000, dtype=np.uint64).astype(np.uint32)
    (tmp_path / "f").write_bytes(bitpack.build([1, 2], np.array([40_000, 60_000]), ids, 13, block=1024))
    sizes = []
    real = bitpack.ranged

    def counted(uri):
        own = real(uri)
        return lambda at, n: (sizes.append(n), own(at, n))[1]

    monkeypatch.setattr(bitpack, "ranged", counted)
    file = bitpack.PackedFile(f"file://{tmp_path}/f")
    sizes.clear()
    assert (file.ids(50_000, 50_100) == ids[50_000:50_100]).all()
    assert sizes and sum(sizes) <= 2 * 1024 * 13 / 8


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bitpack.token_files(empty).count() == 0
    assert packing.pack_documents(empty).count() == 0
    assert bpe.encode_decode(empty).count() == 0


def test_null_and_repeated_ids(spark):
    rows = [(None, "b"), (3, "z"), (3, "a"), (None, None), (3, "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.start, r.n_tokens) for r in bitpack.token_files(frame).collect())
    assert got == [(0, 1), (1, 2), (3, 2), (5, 2), (7, 2)]
    assert packing.pack_documents(frame).count() >= 5
    assert bpe.encode_decode(frame).count() == 5


def test_packing(frame, docs):
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*own.encode(t or "", add_special_tokens=False).ids, 1] for i, t in docs}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in packing.pack_documents(frame).collect():
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length])
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for spans, total in [(v, len(ids[k])) for k, v in by_doc.items()] + [(v, None) for v in by_sequence.values()]:
        at = 0
        for start, n in sorted(spans):
            assert start == at and n > 0
            at += n
        if total is None:
            assert at == 2048 or at & (at - 1) == 0
        else:
            assert at == total
    assert len(by_doc) == len(docs)


@pytest.mark.parametrize("seed", range(5))
def test_pack_plan(seed):
    lengths = np.random.default_rng(seed).geometric(1 / 700, 500)
    d, start, length, seq, offset = packing.pack(lengths)
    assert length.sum() == lengths.sum()
    totals = np.bincount(seq, length)
    assert all(t == 2048 or int(t) & (int(t) - 1) == 0 for t in totals if t)
    assert (totals > 0).all() and (totals < 2048).sum() <= 11
    assert len(d) < 2 * len(lengths) + lengths.sum() // 2048


def test_nnls():
    a = np.array([[1.0, 0, 1], [0, 1, 1]])
    x = packing.nnls(a, np.array([3.0, 5.0]), 500)
    assert (x >= 0).all() and np.allclose(a @ x, [3, 5], atol=1e-3)


def test_bpe(frame, docs):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in bpe.encode_decode(frame).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        ids = own.encode(t or "", add_special_tokens=False).ids
        r = got[i]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()

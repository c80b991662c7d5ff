"""What one worker holds for a block of full size; two of them share an executor with its heap."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("xxhash")
pytest.importorskip("public_tokenizers")
import public_tokenizers

from lodestream.llm import packing, repeats, suffix_array
from lodestream.llm._tokens import WordEncoder


def peak(work):
    """MB allocated at most while `work` runs, and its result."""
    tracemalloc.start()
    try:
        out = work()
        return tracemalloc.get_traced_memory()[1] / (1 << 20), out
    finally:
        tracemalloc.stop()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(20_000)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(4500)]
    return pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})


def test_block(rows):
    spec = suffix_array.spec()
    rows = rows.slice(0, 4300)
    block = repeats.Block(spec, rows["text"].combine_chunks(), rows["doc_id"].combine_chunks())
    assert 7 << 20 < block.n <= spec.block_bytes
    most, (at, key, around) = peak(block.anchors)
    assert most < 100 and len(at) == len(key) == len(around) > block.n // 30
    covered = np.random.default_rng(1).random(block.n) < 0.5
    most, out = peak(lambda: suffix_array._digests(rows, block, covered))
    assert most < 100
    assert out["n_removed"].to_pylist() == [int(covered[a:b].sum()) for a, b in zip(block.starts[:-1], block.starts[1:], strict=True)]


def test_one_set_of_tables():
    most, _ = peak(lambda: [repeats._tables((1 << 20) + k) for k in range(8)])
    assert most < 130
    own = repeats._tables(100)[0]
    assert len(own[0]) >= 100 and (own[0] * own[1] == 1).all()


def test_packing(rows):
    own = WordEncoder(public_tokenizers.path("word_bpe_49k.json"), spaces_count=False)
    ids, starts = own.encode(rows["text"])
    most, (parts, at) = peak(lambda: packing.encoded(own, rows, 1 << 20))
    assert (parts == ids).all() and (at == starts).all() and parts.dtype == ids.dtype
    assert most < 60
    empty = packing.encoded(own, rows.slice(0, 0), 1 << 20)
    assert len(empty[0]) == 0 and empty[1].tolist() == [0]

"""Each stage of the corpus pipeline against brute force over what the stage before it kept."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers
import test_near
import test_quality
import test_repeats
from tokenizers import Tokenizer

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, texts):
    """The smallest driver table with rows of every odd kind, and labels of a larger table's kind."""
    path = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts.items()]
    long = "".join(f"word{i} and some more text that goes on. " for i in range(60))
    rows += [(None, "no id " * 30 + long, None, None, None), (50_000, None, None, None, None), (50_001, "", "", "", 0), (50_002, long, "en", "s", len(long)), (50_003, long, "en", "s", len(long)), (50_003, long, "en", "s", len(long)), (50_004, long + "é" * 30 + " tail of a text that differs", "en", "s", 7)]
    insult = "you are a worthless stupid clown and pathetic trash you idiot "
    rows += [(60_000 + i, insult + f"n{i} " * 5 + " ".join(f"q{i * k}" for k in range(40)), "en", "s", 9) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in texts] + [(60_000 + i, 0, 1) for i in range(40) if i % 4]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept = [tuple(r) for r in docs.collect()]
        if name != "packing":
            assert docs.columns == COLUMNS
        if name == "toxicity":
            gone = set(before) - set(kept)
            assert {r[0] for r in gone} >= {60_000 + i for i in range(40)} and all(r[0] is None or r[0] < 50_000 or r[0] >= 60_000 for r in gone)
            assert len(kept) >= 0.85 * (len(before) - 40)
        elif name == "quality":
            assert sorted(kept, key=repr) == sorted((r for r in before if not test_quality.expected(r[1])[-1]), key=repr)
        elif name == "near_dedup":
            classes = test_near.brute([r[:2] for r in before])
            named = [r for r in kept if r[0] is not None]
            assert sorted(r[0] for r in named) == sorted(set(classes.values()))
            assert set(named) <= set(before) and sum(r[0] is None for r in kept) == sum(r[0] is None for r in before)
        elif name == "substring_dedup":
            expected = []
            by_id = {(r[0], r[1]): r for r in before}
            for (i, units, gone), row in zip(test_repeats.brute([r[:2] for r in before], 50, lambda t: (t or "").encode()), before, strict=True):
                text = bytes(b for b, x in zip(units, gone, strict=True) if not x).decode("utf-8", "ignore")
                expected.append((i, text, row[2], row[3], len(text)))
            assert len(by_id) == len(before) and sorted(kept, key=repr) == sorted(expected, key=repr)
        else:
            own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            ids = {r[0]: [*own.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in before}
            pieces = defaultdict(list)
            for doc, start, length, crc, total, _, _ in kept:
                assert total == len(ids[doc]) and crc == zlib.crc32(np.array(ids[doc][start : start + length], "<u4").tobytes())
                pieces[doc].append((start, length))
            assert set(pieces) == set(ids)
            for doc, spans in pieces.items():
                ends = [0, *(a + n for a, n in sorted(spans))]
                assert [a for a, _ in sorted(spans)] == ends[:-1] and ends[-1] == len(ids[doc])


def test_run_is_the_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.count() > 50


def test_empty(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

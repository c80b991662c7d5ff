"""The quality ledger against brute force, and WARC archives against the records they were made of."""

import base64
import hashlib
import re

import pytest

from lodestream.llm import quality, warc


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)


def expected(text):
    n, chars, symbols, dup, repeat, lines = measured(text)
    failed = [n < 20, 100 * repeat > 30 * n, 10 * symbols > n, chars < 3 * n, chars > 10 * n, 2 * dup > lines]
    return (*measured(text), sum(1 << i for i, f in enumerate(failed) if f))


@pytest.fixture(scope="module")
def docs(odd_texts, texts):
    own = [*odd_texts, "a b c d e f g h " * 3, "one two three four five six seven eight nine " * 2 + "x " * 30, "l\n l\nl\n\n \nl", "# * $ % & | < >" * 4, "é" * 40, "w " * 20 + "last", "a b c d e f g h a b c d e f g h a"]
    return [(i, t) for i, t in enumerate(own)] + [(1000 + i, t) for i, t in list(texts.items())[:80]] + [(None, "null id"), (3, "again"), (3, "again")]


def test_ledger(spark, docs):
    frame = spark.createDataFrame([(i, t, 5, "clash") for i, t in docs], "doc_id long, text string, n_words long, w string").repartition(3)
    got = quality.ledger(frame, keep=("w",)).collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "fail_bits")
    assert sorted(((r.doc_id, *(r[c] for c in columns)) for r in got), key=repr) == sorted(((i, *expected(t)) for i, t in docs), key=repr)
    kept = quality.filtered(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted((i, t) for i, t in docs if not expected(t)[-1])


def test_no_python_on_the_main_path(spark, docs):
    plan = quality.ledger(spark.createDataFrame(docs, "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_ablation(spark, docs):
    bits = [expected(t)[-1] for _, t in docs]
    got = {r.rule: (r.failed, r.failed_only) for r in quality.ablation(quality.ledger(spark.createDataFrame(docs, "doc_id long, text string")), "2").collect()}
    used = {"few_words": 1, "repeated_windows": 2, "many_symbols": 4}
    assert got == {name: (sum(bool(x & b) for x in bits), sum(x & 7 == b for x in bits)) for name, b in used.items()}


def test_empty(spark):
    assert quality.ledger(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


PAGES = [(1, "http://a/", "x" * 300), (2, "http://b/", "x" * 300), (9, "http://c/ d", "x" * 300), (3, None, None), (4, "http://e/", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n"), (None, "n", "only"), (None, "n", "y"), (8, "n", "y"), (-7, "n", "neg"), (6, "r", "twin"), (6, "r", "twin")]


@pytest.mark.parametrize("least", [0, 100])
def test_archives(spark, least):
    frame = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, _digest string").repartition(3)
    got = sorted((tuple(r) for r in warc.archive(frame, min_bytes=least).collect()), key=repr)
    out = []
    for i, _, html in PAGES:
        payload = (html or "").encode()
        ids = [k for k, _, h in PAGES if (h or "") == (html or "") and k is not None]
        last = max(ids, default=None)
        again = len(payload) >= least and last is not None and i != last
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", last if again else None))
    assert got == sorted(out, key=repr)


def test_archive_files():
    out = warc.Writer(b"the quick brown fox " * 30)
    body = [warc.record(i, "http://x/", b"payload %d" % i, None, False) for i in range(3)]
    places = [out.add(r) for r in body]
    data = out.out.getvalue()
    assert data[:4] == b"\x5d\x2a\x4d\x18" and len(set(places)) == 3
    found = list(warc.records(data))
    assert [h["warc-type"] for h, _ in found] == ["warcinfo", "response", "response", "response"]
    assert [b.partition(b"\r\n\r\n")[2] for _, b in found[1:]] == [b"payload 0", b"payload 1", b"payload 2"]
    assert [b for _, b in warc.records(warc.Writer(b"").out.getvalue())]
    with pytest.raises(ValueError):
        import zstandard

        list(warc.records(zstandard.ZstdCompressor().compress(b"no record\r\n")))


@pytest.mark.parametrize("i", [None, 0, 1, -1, 2**63 - 1, -(2**63), 65536])
def test_record_ids(i):
    assert warc.page_of(warc.record_id(i)) == i


@pytest.mark.parametrize("ids", [range(3000), [None] * 3000, [7] * 3000])
def test_every_archive_has_a_dictionary(spark, tmp_path, ids):
    """Also of large pages only, and where all ids are null or equal."""
    page = "<p>" + "some words that all pages have " * 1500
    frame = spark.createDataFrame([(i, "http://x/", f"{page}{k}") for k, i in enumerate(ids)][:700], "page_id long, url string, html string").repartition(3)
    files = warc.write(frame, f"file://{tmp_path}/w").collect()
    assert sum(r.n_records for r in files) == 700
    for r in files:
        data = (tmp_path / "w" / r.file.rsplit("/", 1)[-1]).read_bytes()
        magic, size = warc.SKIPPABLE.unpack(data[:8])
        assert magic == warc.MAGIC and size > 0

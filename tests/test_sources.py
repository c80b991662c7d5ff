import email.message
import io
import json
import time
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestream.functions import extract, filings, records
from lodestream.operators.store import Store
from lodestream.plans.loader import Loader
from lodestream.sources import crawl, links, mime, sinks, transports
from lodestream.streaming import ingest


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_types():
    assert mime.detect_type("a/b.PDF?x=1", None) == "pdf" and mime.detect_type(None, None) == "text"
    assert mime.detect_type("x.html", "application/vnd.api+json; charset=utf-8") == "json"
    assert mime.normalize_type("text/html; x") == "html" and mime.normalize_type("md") == "markdown" and mime.normalize_type("") == "auto"
    with pytest.raises(ValueError):
        mime.normalize_type("nonsense")
    assert mime.is_binary("docx") and not mime.is_binary("html") and mime.is_loadable("text/x") and mime.is_loadable("image/png") and mime.is_loadable(None) and not mime.is_loadable("font/woff")
    assert [mime.normalize_type(t) for t in ("file", "tsv", "image", "audio/x-wav", "TSV")] == ["auto", "tsv", "image", "audio", "tsv"]
    assert [mime.detect_type(p, None) for p in ("a.msg", "a.tsv", "a.jpeg", "a.m4a", "a.rst")] == ["email", "tsv", "image", "audio", "text"]


@pytest.mark.parametrize(
    ("kind", "data", "expected"),
    [
        ("text", "é".encode("latin-1"), "é"),
        ("markdown", b"---\na: b\n---\n\n# T\n", "# T\n"),
        ("html", b"<nav>x</nav><h2>T</h2><p>a <b>b</b> <a href='/u'>c</a></p><ul><li>i<ul><li>j</li></ul></li></ul><table><tr><th>h</th><td>d</td></tr></table>", "## T\n\na **b** [c](/u)\n\n- i\n  - j\n\n| h | d |"),
        ("json", b'{"a": {"b": [1, {"c": null}]}}', "# a\n\n## a > b\n\n1\n\n### a > b[1]\n\n#### a > b[1] > c\n\nNone"),
        ("json", b"{bad", "{bad"),
        ("xml", b"<r xmlns='u'><x>1</x>t</r>", "# r\n\n## r > x\n\n1\n\nt"),
        ("csv", b"a;b\n1;x|y\n\n", "| a | b |\n| --- | --- |\n| 1 | x\\|y |"),
        ("docx", zipped(**{"word/document.xml": "<w xmlns:w='u'><w:body><w:p><w:pPr><w:pStyle w:val='Heading2'/></w:pPr><w:r><w:t>H</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>end</w:t></w:r></w:p></w:body></w>"}), "## H\n\nend\n\na | b"),
        ("xlsx", zipped(**{"xl/workbook.xml": "<workbook><sheets><sheet name='S'/></sheets></workbook>", "xl/sharedStrings.xml": "<sst><si><t>one</t></si></sst>", "xl/worksheets/sheet1.xml": "<worksheet><sheetData><row><c r='A1' t='s'><v>0</v></c><c r='C1'><v>2</v></c></row><row/></sheetData></worksheet>"}), "[Sheet: S]\n\none |  | 2"),
        ("pptx", zipped(**{"ppt/slides/slide1.xml": "<s><sp><p><t>hi</t></p></sp></s>"}), "[Slide 1]\nhi"),
        ("odt", zipped(mimetype="application/vnd.oasis.opendocument.text", **{"content.xml": "<c><h outline-level='2'>T</h><p>x</p></c>"}), "## T\n\nx"),
    ],
)
def test_extractors(kind, data, expected):
    assert extract.extractor(kind)(data, "f") == expected


def test_yaml_and_lines():
    pytest.importorskip("yaml")
    assert extract.extractor("yaml")(b"a: 1\n---\nb: 2\n") == "# a\n\n1\n\n---\n\n# b\n\n2"
    assert extract.extractor("jsonl")(b'{"a": 1}\n{"b": 2}\n') == "# a\n\n1\n\n---\n\n# b\n\n2"


def message():
    m = email.message.EmailMessage()
    m["From"], m["Subject"] = "a@example.com", "Grüße"
    m.set_content("hello\n")
    m.add_attachment(b"x,y\n1,2\n", maintype="text", subtype="csv", filename="t.csv")
    return m.as_bytes()


def test_mail():
    assert extract.mail(message()) == "From: a@example.com\nSubject: Grüße\n\nhello"
    assert extract.mail(message(), attachments=True).endswith("[Attachment: t.csv]\n| x | y |\n| --- | --- |\n| 1 | 2 |")


def test_entities_in_xml_are_not_expanded():
    data = b'<!DOCTYPE r [<!ENTITY a "b">]><r>&a;</r>'
    assert extract.xml_text(data) == data.decode()


def test_filings():
    toc = "".join(f"<a href='#i{n}'>Item {n}.</a>" for n in ("1", "8", "9C"))
    page = f"<html xmlns:ix='x'>{toc}<div id='i1'>Item 1 <p><b>Who we are</b></p> We make things.</div><div id='i8'>numbers</div><div id='i9C'>none</div></html>"
    assert filings.is_filing(page.encode())
    got = extract.filing(page.encode())
    assert got.startswith("# Item 1.  Business\n\n") and "We make things." in got and "numbers" not in got
    assert filings.filing_text("<p>a</p><script>b</script><p>c</p>", extract.html_text) == "a\n\nc" or "b" not in filings.filing_text("<p>a</p><script>b</script>", extract.html_text)


def test_extracted_keeps_bad_files(spark):
    files = spark.createDataFrame([("a.txt", bytearray(b"x"), "text"), ("b.docx", bytearray(b"x"), "docx"), ("c", None, "text"), ("d", bytearray(b""), "odd")], "path string, data binary, doc_type string")
    got = {r.path: (r.text, r.error) for r in extract.extracted(files).collect()}
    assert got["a.txt"] == ("x", None) and got["c"] == ("", None)
    assert got["b.docx"][0] is None and "BadZipFile" in got["b.docx"][1] and "no extractor" in got["d"][1]


def test_directory_and_loader(spark, tmp_path):
    (tmp_path / "in/.hidden").mkdir(parents=True)
    (tmp_path / "in/node_modules").mkdir()
    for name, text in (("b.md", "# T\n\nbody"), ("a.txt", "plain"), ("c.bin", "x"), (".hidden/d.txt", "x"), ("node_modules/e.txt", "x"), ("bad.docx", "x")):
        (tmp_path / "in" / name).write_text(text)
    own = Loader(spark)
    got = own.load_directory(str(tmp_path / "in")).collect()
    assert sorted((r.document_name, r.section, r.body) for r in got) == [("a", None, "plain"), ("b", "T", "# T\n\nbody")]
    failed = own.documents(transports.directory(spark, str(tmp_path / "in"))).where("error is not null").collect()
    assert [r.name for r in failed] == ["bad"]
    assert [r.document_name for r in own.load(str(tmp_path / "in/a.txt")).collect()] == ["a"]
    assert [r.document_name for r in own.load(f"file://{tmp_path}/in/a.txt", "named").collect()] == ["named"]
    with pytest.raises(PySparkException):
        own.load(str(tmp_path / "in/bad.docx")).collect()
    assert own.load_bytes(b"<h1>T</h1>", "x", doc_type="text/html").first().section == "T"
    assert own.load_text("abc", "n").first().content == "[n]\n\nabc"
    spark.createDataFrame([(2, "b"), (1, "a")], "k int, name string").createOrReplaceTempView("loader_rows")
    assert own.load_query("select k, name from loader_rows where k < :most", "q", params={"most": 9}).first().body == "| k | name |\n| --- | --- |\n| 1 | a |\n| 2 | b |"
    with pytest.raises(ValueError):
        own.load_bytes(b"", "x", doc_type="nonsense")


class Mailbox:
    def __init__(self, host, port):
        self.at = (host, port)

    def login(self, user, password):
        assert (user, password) == ("me@x", "p/w")

    def select(self, box, readonly):
        assert readonly and box == "Some Box"

    def search(self, charset, what):
        return "OK", [b"1 2 3"]

    def fetch(self, number, what):
        return ("NO", [None]) if number == b"2" else ("OK", [(b"", message())])

    def logout(self):
        pass


def test_mailboxes(spark):
    uri = "imaps://me%40x:p%2Fw@host/Some%20Box?limit=3"
    assert len(list(transports.imap_messages(uri, connect=Mailbox))) == 2
    assert len(list(transports.imap_messages(uri, limit=1, connect=Mailbox))) == 1
    got = Loader(spark).load_imap(uri, connect=Mailbox).collect()
    assert len(got) == 2 and all("hello" in r.body for r in got)


def test_schemes(spark):
    assert transports.scheme("C:\\x") == "file" or transports.scheme("x/y") == "file"
    with pytest.raises(ValueError):
        transports.read(spark, "gopher://x")
    with pytest.raises(ValueError):
        transports.fetcher("gopher://x")
    bad = transports.fetched(spark.createDataFrame([("ftp://127.0.0.1:1/x",)], "uri string")).first()
    assert bad.data is None and bad.error


PAGES = {
    "http://h/?x": "<a href='/a?q=1'>a</a><a href='/a?q=2'>a</a><a href='b#x'>b</a><a href='http://other/'>o</a><a href='/f.zip'>z</a><a href='/api/x'>l</a><a href='mailto:x'>m</a>",
    "http://h/a?q=1": "<a href='/c'>c</a><a href='/report.pdf'>r</a><a href='/wiki/x?action=edit'>e</a>",
    "http://h/b#x": "<a href='/'>home</a>",
    "http://h/report.pdf": "a document",
    "http://h/c": "<a href='/d'>d</a>",
}


def serve(uri):
    return PAGES[uri].encode(), "text/html"


def test_site(spark, tmp_path, monkeypatch):
    pages = PAGES | {"http://h/": PAGES["http://h/?x"]}

    def fetch(uri):
        return pages[uri].encode(), "text/html"

    monkeypatch.setattr(transports, "_FETCHERS", [(lambda u: True, fetch)])
    got = crawl.site(spark, "http://h/?x", folder=str(tmp_path / "w1"), depth=2, wiki=True).collect()
    assert {(r.path, r.depth) for r in got} == {("http://h/?x", 0), ("http://h/a?q=1", 1), ("http://h/b#x", 1), ("http://h/c", 2), ("http://h/report.pdf", 2)}
    assert all(r.error is None for r in got)
    assert crawl.site(spark, "http://h/", folder=str(tmp_path / "w2"), most=2).count() == 2
    other = crawl.site(spark, "http://h/", folder=str(tmp_path / "w3"), same_host=False, depth=1, exclude=("/a[?]",)).collect()
    assert {r.path: r.error is None for r in other} == {"http://h/": True, "http://h/b#x": True, "http://other/": False}
    missing = crawl.site(spark, "http://none/", folder=str(tmp_path / "w4")).collect()
    assert len(missing) == 1 and missing[0].error
    chunks = Loader(spark).load_site("http://h/", folder=str(tmp_path / "w5"), depth=1)
    assert chunks.count() == 3


def test_links(spark):
    urls = spark.createDataFrame([("http://h",), ("http://h/a/?b#c",), ("http://h/wiki/Special:X",)], "u string")
    assert [r[0] for r in urls.select(links.normalized(F.col("u"))).collect()] == ["http://h/", "http://h/a", "http://h/wiki/Special:X"]
    assert [r[0] for r in urls.select(links.visitable(F.col("u"), "h", wiki=True, include="h/")).collect()] == [False, True, False]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x"), ("b/c", "é"), ("b:c", None)], "name string, text string")
    got = sinks.text_files(docs, str(tmp_path / "t")).collect()
    assert len({r.file for r in got}) == 3
    assert {(tmp_path / "t" / r.file).read_text() for r in got} == {"x", "é", ""}
    path = str(tmp_path / "lines")
    assert sinks.json_lines(docs, path, key="name") == 3
    assert sinks.json_lines(docs.unionByName(spark.createDataFrame([("d", "y")], docs.schema)), path, key="name") == 1
    assert spark.read.json(path).count() == 4


def test_records(spark):
    trial = {"protocolSection": {"identificationModule": {"nctId": "N1", "briefTitle": "T"}, "descriptionModule": {"briefSummary": "S"}, "designModule": {"phases": ["PHASE2"]}, "outcomesModule": {"primaryOutcomes": [{"measure": "m", "timeFrame": "1 y"}]}}}
    df = spark.createDataFrame([(json.dumps(trial),)], "d string")
    r = df.select(records.trial_markdown(F.col("d")).alias("t"), records.late_phase(F.col("d")).alias("p")).first()
    assert r.t == "# N1 T\n\n## Summary\n\nS\n\n## Primary Outcomes\n\n- m: 1 y" and r.p
    xml = "<A><ArticleTitle>T</ArticleTitle><AbstractText Label='AIM'>x</AbstractText></A>"
    assert spark.createDataFrame([(xml,)], "x string").select(records.article_markdown(F.col("x"))).first()[0] == "# T\n\n## AIM\n\nx"
    one = spark.range(1).select(records.latest(F.array(F.lit("8-K"), F.lit("10-K"), F.lit("10-K")), F.array(F.lit("3"), F.lit("1"), F.lit("2")), F.array(F.lit("a"), F.lit("b"), F.lit("c")), "10-K"))
    assert one.first()[0] == "c"


def test_streamed_ingest(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), width=2)
    docs = spark.createDataFrame([("a", "one"), ("b", "two")], "name string, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "arriving"))
    for _ in range(2):
        ingest.ingest(spark, str(tmp_path / "arriving"), store, str(tmp_path / "checkpoint")).awaitTermination()
    assert store.count() == 2
    spark.createDataFrame([("c", "three")], docs.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "arriving"))
    ingest.ingest(spark, str(tmp_path / "arriving"), store, str(tmp_path / "checkpoint")).awaitTermination()
    assert {r.document_name for r in store.chunks().collect()} == {"a", "b", "c"}


def test_streamed_windows(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "x", 1.0), ("2024-01-01 00:20:00", "x", 2.0), ("2024-01-01 05:00:00", "x", 4.0), ("2024-01-01 05:10:00", "x", 5.0), ("2024-01-01 00:30:00", "x", 8.0)]
    for i, r in enumerate(rows):  # one file a batch; the last comes after the watermark has passed its window
        spark.createDataFrame([r], "ts string, event_type string, value double").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    own = ingest.windowed(stream, width="1 hour", late="1 hour")
    q = own.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [tuple(r) for r in spark.sql("select cast(start as string), event_type, n, total from windows").collect()]
    assert got == [("2024-01-01 00:00:00", "x", 2, 3.0)]

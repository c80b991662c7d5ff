"""Bytes of a format to markdown-like text. Each extractor is (bytes, path) -> str; a registry picks it by type.

`extracted` runs them where the bytes are; a document that fails has its message in the column `error`, and no text.
"""

from __future__ import annotations

import csv
import email
import email.header
import email.policy
import html
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.functions.arrow import slices, small_batches
from lodestream.functions.filings import filing_text

Extractor = Callable[[bytes, str | None], str]


class MissingDependency(RuntimeError):
    """A format needs a library that is not installed."""


def plain(data: bytes, path: str | None = None) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def markdown(data: bytes, path: str | None = None) -> str:
    return re.sub(r"\A---[ \t]*\n.*?\n---[ \t]*(?:\n|\Z)", "", plain(data).removeprefix("\ufeff"), flags=re.S).lstrip("\n")


# Parts of the names of blocks that are no content.
_CHROME = (
    r"sidebar|navbox|navbar|navigation|toc\b|catlinks|mw-panel|mw-head|mw-editsection|menu|breadcrumb|noprint|portal|sister-?project|interlanguage|authority-control|"
    r"reflist|references|footnotes|mw-references-wrap|citation"
)
# End of fixed values.


def without_chrome(text: str) -> str:
    """The page without navigation, scripts and blocks that are named like them."""
    text = re.sub(r"<(nav|aside|header|footer|noscript|script|style)\b[^>]*>.*?</\1\s*>", "", text, flags=re.I | re.S)
    text = re.sub(rf"<(div|section|ul|table)\b[^>]*\b(?:class|id|role)\s*=\s*[\"'][^\"']*?(?:{_CHROME})[^\"']*?[\"'][^>]*>.*?</\1\s*>", "", text, flags=re.I | re.S)
    return re.sub(r"<sup\b[^>]*\breference\b[^>]*>.*?</sup\s*>", "", text, flags=re.I | re.S)


class _Markdown(HTMLParser):
    """Headings, paragraphs, lists, emphasis, links, code and table rows; the text of all other tags as it stands."""

    AROUND = {"p": ("\n\n", "\n"), "pre": ("\n\n```\n", "\n```\n\n"), "br": ("\n", ""), "strong": ("**", "**"), "b": ("**", "**"), "em": ("*", "*"), "i": ("*", "*"), "tr": ("\n|", ""), "td": (" ", " |"), "th": (" ", " |"), "thead": ("", "\n|---|"), "ul": ("", "\n"), "ol": ("", "\n")}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.numbers: list[int | None] = []  # of the lists that are open: the last item's number, None in plain ones
        self.opened: list[tuple[str, int]] = []  # links and headings: what they are, and where their text starts

    def handle_starttag(self, tag, attrs):
        if re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")
            self.opened.append((tag, len(self.out)))
        elif tag == "a":
            self.opened.append((dict(attrs).get("href") or "", len(self.out)))
        elif tag == "li":
            mark = "-"
            if self.numbers and self.numbers[-1] is not None:
                self.numbers[-1] += 1
                mark = f"{self.numbers[-1]}."
            self.out.append(f"\n{'  ' * (len(self.numbers) - 1)}{mark} ")
        else:
            if tag in ("ul", "ol"):
                self.numbers.append(0 if tag == "ol" else None)
            self.out.append(self.AROUND.get(tag, ("", ""))[0])

    def handle_endtag(self, tag):
        if (tag == "a" or re.fullmatch("h[1-6]", tag)) and self.opened:
            what, at = self.opened.pop()
            inner = "".join(self.out[at:]).strip()
            del self.out[at:]
            if tag == "a":
                self.out.append(f"[{inner}]({what})" if what and inner else inner)
            else:
                self.out.append(f"{'#' * int(tag[1])} {inner}\n\n")
        else:
            if tag in ("ul", "ol") and self.numbers:
                self.numbers.pop()
            self.out.append(self.AROUND.get(tag, ("", ""))[1])

    def handle_data(self, data):
        self.out.append(data)


def html_text(text: str) -> str:
    parser = _Markdown()
    parser.feed(without_chrome(text))
    parser.close()
    return re.sub(r"\n{3,}", "\n\n", "".join(parser.out)).strip()


def html_page(data: bytes, path: str | None = None) -> str:
    return html_text(data.decode("utf-8", "replace"))


def _outline(value: object, out: list[str], path: str, depth: int) -> None:
    if isinstance(value, dict | list):
        for key, own in value.items() if isinstance(value, dict) else enumerate(value):
            name = (f"{path} > {key}" if path else str(key)) if isinstance(value, dict) else f"{path}[{key}]"
            if isinstance(own, dict | list):
                out.append(f"{'#' * min(6, depth)} {name}")
                _outline(own, out, name, depth + 1)
            elif isinstance(value, dict):
                out += [f"{'#' * min(6, depth)} {name}", str(own)]
            else:
                out.append(str(own))
    elif value is not None:
        out.append(str(value))


def outlined(value: object) -> str:
    out: list[str] = []
    _outline(value, out, "", 1)
    return "\n\n".join(out)


def json_text(data: bytes, path: str | None = None) -> str:
    text = plain(data)
    if (path or "").lower().endswith((".jsonl", ".ndjson")):
        return json_lines(data, path)
    try:
        return outlined(json.loads(text))
    except ValueError:
        return text


def json_lines(data: bytes, path: str | None = None) -> str:
    text = plain(data)
    try:
        return "\n\n---\n\n".join(outlined(json.loads(x)) for x in text.splitlines() if x.strip())
    except ValueError:
        return text


def yaml_text(data: bytes, path: str | None = None) -> str:
    try:
        import yaml
    except ImportError as e:
        raise MissingDependency("YAML needs pyyaml") from e
    text = plain(data)
    try:
        return "\n\n---\n\n".join(outlined(x) for x in yaml.safe_load_all(text) if x is not None)
    except yaml.YAMLError:
        return text


def _tree(data: bytes) -> ElementTree.Element:
    if re.search(rb"<!ENTITY", data, re.I):
        raise ElementTree.ParseError("documents that define entities are not expanded")
    return ElementTree.fromstring(data)


def _local(tag: object) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def xml_text(data: bytes, path: str | None = None) -> str:
    def walk(node: ElementTree.Element, above: str, depth: int) -> Iterator[str]:
        name = f"{above} > {_local(node.tag)}" if above else _local(node.tag)
        yield f"{'#' * min(6, depth)} {name}"
        if node.text and node.text.strip():
            yield node.text.strip()
        for child in node:
            yield from walk(child, name, depth + 1)
            if child.tail and child.tail.strip():
                yield child.tail.strip()

    try:
        return "\n\n".join(walk(_tree(data), "", 1))
    except ElementTree.ParseError:
        return plain(data)


def table_text(rows: list[list[str]]) -> str:
    """A markdown table of rows of cells, the first as its head."""
    rows = [[str(c).replace("|", "\\|").replace("\r", "").replace("\n", " ").strip() for c in r] for r in rows if any(str(c).strip() for c in r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = [f"| {' | '.join(r + [''] * (width - len(r)))} |" for r in rows]
    return "\n".join([lines[0], f"|{' --- |' * width}", *lines[1:]])


def csv_text(data: bytes, path: str | None = None) -> str:
    text = plain(data).removeprefix("\ufeff")
    try:
        dialect = csv.Sniffer().sniff(text[:4096], ",\t|;")
    except csv.Error:
        dialect = csv.excel
    return table_text(list(csv.reader(io.StringIO(text), dialect)))


def pdf(data: bytes, path: str | None = None) -> str:
    try:
        import pypdf
    except ImportError as e:
        raise MissingDependency("PDF needs pypdf") from e
    pages = [(p.extract_text() or "").strip() for p in pypdf.PdfReader(io.BytesIO(data)).pages]
    return "\n\n".join(f"[Page {i}]\n{t}" for i, t in enumerate(pages, 1) if t)


def _zipped(data: bytes, name: str) -> ElementTree.Element | None:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return _tree(z.read(name)) if name in z.namelist() else None


def _names(data: bytes, pattern: str) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        found = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def _all(node: ElementTree.Element, *names: str) -> Iterator[ElementTree.Element]:
    return (x for x in node.iter() if _local(x.tag) in names)


def _get(node: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if _local(k) == name), None)


def _joined(node: ElementTree.Element) -> str:
    return "".join(x.text or "" if _local(x.tag) == "t" else "\t" if _local(x.tag) == "tab" else "\n" if _local(x.tag) == "br" else "" for x in node.iter())


def _bars(rows: list[list[str]]) -> str:
    return "\n".join(" | ".join(r) for r in rows if any(c.strip() for c in r))


def docx(data: bytes, path: str | None = None) -> str:
    """Paragraphs, headings by their style, then the tables."""
    body = next(_all(_zipped(data, "word/document.xml"), "body"))
    out = []
    for p in (x for x in body if _local(x.tag) == "p"):
        if text := _joined(p).strip():
            style = next((_get(s, "val") or "" for s in _all(p, "pStyle")), "")
            m = re.fullmatch(r"Heading ?(\d)", style)
            out.append(f"{'#' * int(m[1])} {text}" if m else text)
    for t in (x for x in body if _local(x.tag) == "tbl"):
        out.append(_bars([[" ".join(_joined(c).split()) for c in _all(r, "tc")] for r in _all(t, "tr")]))
    return "\n\n".join(x for x in out if x)


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def xlsx(data: bytes, path: str | None = None) -> str:
    """Each sheet after a marker paragraph; values, not formulas; blank rows left out."""
    shared_part = _zipped(data, "xl/sharedStrings.xml")
    shared = [_joined(s) for s in _all(shared_part, "si")] if shared_part is not None else []
    book, relations = _zipped(data, "xl/workbook.xml"), _zipped(data, "xl/_rels/workbook.xml.rels")
    target = {_get(r, "Id"): _get(r, "Target") for r in relations} if relations is not None else {}
    out = []
    for i, sheet in enumerate(_all(book, "sheet"), 1):
        name = target.get(next((v for k, v in sheet.attrib.items() if k.endswith("}id")), None)) or f"worksheets/sheet{i}.xml"
        root = _zipped(data, name.lstrip("/") if name.startswith("/") else f"xl/{name}")
        rows = []
        for row in _all(root, "row") if root is not None else ():
            cells: list[str] = []
            for c in _all(row, "c"):
                value = next((v.text or "" for v in _all(c, "v")), "")
                kind = _get(c, "t")
                value = shared[int(value)] if kind == "s" and value else _joined(c) if kind == "inlineStr" else value
                at = _column(_get(c, "r") or "")
                cells += [""] * (at - len(cells)) if at >= 0 else []
                cells.append(value)
            rows.append(cells)
        out.append(f"[Sheet: {sheet.get('name')}]\n\n{_bars(rows)}".strip())
    return "\n\n".join(out)


def pptx(data: bytes, path: str | None = None) -> str:
    out = []
    for i, name in enumerate(_names(data, r"ppt/slides/slide(\d+)\.xml"), 1):
        root = _zipped(data, name)
        parts = []
        for shape in _all(root, "sp", "graphicFrame"):
            if _local(shape.tag) == "sp":
                parts += [t for p in _all(shape, "p") if (t := _joined(p).strip())]
            else:
                parts.append(_bars([[" ".join(_joined(c).split()) for c in _all(r, "tc")] for r in _all(shape, "tr")]))
        out.append(f"[Slide {i}]\n" + "\n".join(p for p in parts if p))
    return "\n\n".join(out)


def odf(data: bytes, path: str | None = None) -> str:
    """Text, sheets or slides, as the package's media type says."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        kind = z.read("mimetype").decode().strip() if "mimetype" in z.namelist() else ""
    root = _zipped(data, "content.xml")
    text = lambda n: "".join(n.itertext()).strip()
    if "spreadsheet" in kind:
        sheets = []
        for t in _all(root, "table"):
            rows = [[text(c) for c in _all(r, "table-cell") for _ in range(min(64, int(_get(c, "number-columns-repeated") or 1)) if text(c) else 1)] for r in _all(t, "table-row")]
            sheets.append(f"[Sheet: {_get(t, 'name')}]\n\n{_bars(rows)}".strip())
        return "\n\n".join(sheets)
    if "presentation" in kind:
        return "\n\n".join(f"[Slide {i}]\n" + "\n".join(t for p in _all(page, "p") if (t := text(p))) for i, page in enumerate(_all(root, "page"), 1))
    return "\n\n".join(f"{'#' * int(_get(n, 'outline-level') or 1)} {t}" if _local(n.tag) == "h" else t for n in _all(root, "h", "p") if (t := text(n)))


def _header(value: str | None) -> str:
    try:
        return str(email.header.make_header(email.header.decode_header(value or "")))
    except (LookupError, UnicodeDecodeError, ValueError):
        return value or ""


def mail(data: bytes, path: str | None = None, *, attachments: bool = False) -> str:
    message = email.message_from_bytes(data, policy=email.policy.compat32)
    head = [f"{name}: {_header(message[name])}" for name in ("From", "To", "Cc", "Date", "Subject") if message[name]]
    bodies: dict[str, str] = {}
    attached = []
    for part in message.walk():
        if part.is_multipart():
            continue
        content = part.get_payload(decode=True) or b""
        if part.get_content_disposition() == "attachment":
            attached.append((_header(part.get_filename()) or "attachment", part.get_content_type(), content))
        elif part.get_content_type() not in bodies:
            try:
                bodies[part.get_content_type()] = content.decode(part.get_content_charset() or "utf-8", "replace")
            except LookupError:
                bodies[part.get_content_type()] = content.decode("utf-8", "replace")
    body = bodies["text/plain"] if bodies.get("text/plain", "").strip() else html_text(bodies.get("text/html", ""))
    out = ["\n".join(head), body.strip()]
    if attachments:
        from lodestream.sources.mime import detect_type

        for name, mime, content in attached:
            try:
                out.append(f"[Attachment: {name}]\n{extractor(detect_type(name, mime))(content, name)}")
            except (MissingDependency, ValueError, zipfile.BadZipFile, ElementTree.ParseError):
                continue
    return "\n\n".join(x for x in out if x)


def filing(data: bytes, path: str | None = None) -> str:
    return filing_text(data.decode("utf-8", "replace"), html_text)


_REGISTRY: list[tuple[frozenset[str], Extractor]] = [
    (frozenset({"edgar", "edgar-html", "edgar-xbrl"}), filing), (frozenset({"pdf"}), pdf), (frozenset({"docx"}), docx), (frozenset({"xlsx"}), xlsx), (frozenset({"pptx"}), pptx), (frozenset({"html"}), html_page),
    (frozenset({"jsonl"}), json_lines), (frozenset({"json"}), json_text), (frozenset({"yaml"}), yaml_text), (frozenset({"markdown"}), markdown), (frozenset({"csv", "tsv"}), csv_text), (frozenset({"odt", "ods", "odp"}), odf), (frozenset({"email"}), mail), (frozenset({"xml"}), xml_text), (frozenset({"text", "txt"}), plain),
]


def register(types: set[str], own: Extractor, *, first: bool = True) -> None:
    _REGISTRY.insert(0 if first else len(_REGISTRY), (frozenset(types), own))


def extractor(kind: str) -> Extractor:
    for types, own in _REGISTRY:
        if kind in types:
            return own
    raise ValueError(f"no extractor for {kind}")


def extracted(files: DataFrame, *, kind: str = "doc_type", data: str = "data", path: str = "path") -> DataFrame:
    """`files` without their bytes, with ``text`` and ``error``."""
    rest = [c for c in files.columns if c not in (data, "text", "error")]
    registry = list(_REGISTRY)  # goes to the tasks, so that extractors registered here count there

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, data):
            texts: list[str | None] = []
            errors: list[str | None] = []
            for k, d, p in zip(batch[kind].to_pylist(), batch[data].to_pylist(), batch[path].to_pylist(), strict=True):
                try:
                    own = next((f for types, f in registry if k in types), None)
                    if own is None:
                        raise ValueError(f"no extractor for {k}")
                    texts.append(own(d or b"", p))
                    errors.append(None)
                except Exception as e:  # one bad file is a row with its message, not a failed job
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), pa.array(texts, pa.string()), pa.array(errors, pa.string())], [*rest, "text", "error"])

    small_batches(files.sparkSession)
    schema = files.select(*rest).withColumn("text", F.lit(None).cast("string")).withColumn("error", F.lit(None).cast("string")).schema
    return files.select(*rest, data).mapInArrow(work, schema)


def unescaped(text: str) -> str:
    return html.unescape(text)

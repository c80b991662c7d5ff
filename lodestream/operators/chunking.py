"""Documents to chunks along paragraphs, lists, tables, sheets and headings.

The chunker is a left fold over the paragraphs of one document, so it runs in Arrow batches wherever the documents
lie and needs no shuffle. What is no fold (line classes, block merging, sections, windows) is made of DataFrame functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.arrow import slices, small_batches
from lodestream.functions.headings import SENTENCE, Promotion, promote

CHUNKS = (
    "document_name string, chunk_index int, section string, section_path array<string>, breadcrumb string, body string, content string, "
    "embedding_content string, chunk_type string, block_type string, source_offset long, source_length long"
)
_TYPES = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
_ITEM = re.compile(r"\s*(?:[-*+] |[0-9]{1,4}\. )")


@dataclass(frozen=True)
class ChunkOptions:
    """Sizes in characters, breadcrumbs excluded. `margin` is how far a chunk may grow over `most`."""

    least: int = 600
    most: int = 1500
    margin: float = 0.15
    breadcrumb: bool = True
    promotion: Promotion | None = None
    #: A heading is only the first line of its paragraph (off: the whole paragraph).
    first_line_headings: bool = False
    #: Offsets of repeated paragraphs go on from the last one (off: all have that of the first).
    running_offsets: bool = False

    def __post_init__(self):
        if self.most < 1 or self.least < 0 or self.least > self.most or self.margin < 0:
            raise ValueError("chunk sizes: 0 <= least <= most, most >= 1, margin >= 0")


def is_table_line(line: str) -> bool:
    return line.count("|") >= 2


def is_list_line(line: str) -> bool:
    return bool(_ITEM.match(line))


def _kind(paragraph: str) -> str:
    """What all lines of a paragraph that have text are: table, list or prose."""
    lines = [x for x in paragraph.split("\n") if x.strip()]
    if lines and any(map(is_table_line, lines)):
        return "table"
    return "list" if lines and any(map(is_list_line, lines)) else "prose"


def merge_blocks(paragraphs: list[str], separator: str) -> list[str]:
    """Neighbouring table paragraphs become one, and neighbouring list paragraphs; blank ones part them."""
    out: list[str] = []
    kind = ""
    for p in paragraphs:
        own = _kind(p) if p.strip() else ""
        if own in ("table", "list") and own == kind:
            out[-1] += separator + p
        else:
            out.append(p)
        kind = own
    return out


def packed(parts: list[str], glue: str, most: int) -> list[str]:
    """Greedy runs of parts of at most `most` characters; a longer part stays whole."""
    out: list[str] = []
    for part in parts:
        if out and len(out[-1]) + len(glue) + len(part) <= most:
            out[-1] += glue + part
        else:
            out.append(part)
    return [x for x in out if x]


def split_paragraph(text: str, kind: str, most: int) -> list[str]:
    if len(text) <= most:
        return [text]
    parts = packed(SENTENCE.split(text), " ", most) if kind == "prose" else packed(text.split("\n"), "\n", most)
    return parts or [text]


def common_path(paths: list[list[str]]) -> list[str]:
    """The common beginning of the paths that are not empty; of paths that have none, the last."""
    full = [p for p in paths if p]
    shared: list[str] = []
    for level in zip(*full, strict=False):
        if len(set(level)) > 1:
            break
        shared.append(level[0])
    return shared or (full[-1] if full else [])


@dataclass
class _Fold:
    name: str
    options: ChunkOptions
    rows: list[tuple] = field(default_factory=list)
    stack: list[tuple[int, str]] = field(default_factory=list)
    held: str = ""
    start: int | None = None
    paths: list[list[str]] = field(default_factory=lambda: [[]])

    @property
    def path(self) -> list[str]:
        return [t for _, t in self.stack]

    def see(self) -> None:
        if not self.paths or self.paths[-1] != self.path:
            self.paths.append(self.path)

    def emit(self, text: str, offset: int | None, kind: str) -> None:
        path = common_path(self.paths)
        crumb = f"[{' > '.join([self.name, *path])}]" if self.options.breadcrumb and text else None
        content = f"{crumb}\n\n{text}" if crumb else text
        self.rows.append((self.name, len(self.rows), " > ".join(path) or None, path, crumb, text, content, content if self.options.breadcrumb else None, "document", kind, offset, len(content.encode())))
        self.held, self.start, self.paths = "", None, []
        self.see()

    def flush(self) -> None:
        if self.held:
            self.emit(self.held, self.start, "text")


def chunk_text(name: str, text: str, options: ChunkOptions = ChunkOptions()) -> list[tuple]:
    """Rows of CHUNKS of one document."""
    if options.promotion:
        text = promote(text, options.promotion)
    glue = "\n\n" if "\n\n" in text else "\n"
    fold = _Fold(name, options)
    ceiling = int(options.most * (1.0 + options.margin))
    plain = text.isascii()
    cursor = 0
    for paragraph in merge_blocks(text.split(glue), glue):
        paragraph = paragraph.strip()
        if not paragraph:
            continue
        at = text.find(paragraph, cursor if options.running_offsets else 0)
        if options.running_offsets and at >= 0:
            cursor = at + len(paragraph)
        offset = None if at < 0 else at if plain else len(text[:at].encode())
        if paragraph[0] == "#":
            head = paragraph.split("\n", 1)[0] if options.first_line_headings else paragraph
            title = head.lstrip("#")
            level = len(head) - len(title)
            if fold.held and len(fold.held) >= options.least:
                fold.flush()
                fold.paths = []
            fold.stack = [x for x in _above(fold.stack, level)] + [(level, title.strip())]
            fold.see()
        elif paragraph.startswith("[Sheet:") and paragraph[-1] == "]":
            fold.flush()
            fold.stack = [(0, paragraph[7:-1].strip())]
            fold.see()
        grown = (fold.held + glue + paragraph).strip() if fold.held else paragraph
        if len(grown) <= ceiling:
            if not fold.held:
                fold.start = offset
            fold.held = grown
            continue
        fold.flush()
        kind = _kind(paragraph)
        pieces = split_paragraph(paragraph, kind, options.most)
        mark = {"table": "TABLE", "list": "LIST", "prose": "PARA"}[kind]
        for i, piece in enumerate(pieces):
            if len(pieces) > 1:
                piece = f"[{mark}:{'cont' if i else 'start'}]\n{piece}\n[{mark}:{'cont' if i < len(pieces) - 1 else 'end'}]"
            fold.emit(piece, offset, kind)
    fold.flush()
    return fold.rows


def _above(stack: list[tuple[int, str]], level: int) -> list[tuple[int, str]]:
    keep = len(stack)
    while keep and stack[keep - 1][0] >= level:
        keep -= 1
    return stack[:keep]


def chunk(documents: DataFrame, options: ChunkOptions = ChunkOptions(), *, name: str = "name", text: str = "text") -> DataFrame:
    """The chunks of `documents`; null texts have none, null names are empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = [r for n, t in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True) if t for r in chunk_text(n or "", t, options)]
            columns = list(zip(*rows, strict=True)) or [()] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], [x.split()[0] for x in CHUNKS.split(", ")])

    small_batches(documents.sparkSession)
    return documents.select(F.col(name).cast("string"), F.col(text).cast("string")).mapInArrow(work, CHUNKS)


def without_markers(text: Column) -> Column:
    """Take the lines that mark split paragraphs out again."""
    return F.regexp_replace(text, r"(?m)^\[(TABLE|LIST|PARA):(start|cont|end)\]\n?|\n\[(TABLE|LIST|PARA):(start|cont|end)\]$", "")


def table_line(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit("|"))) >= 2


def list_line(line: Column) -> Column:
    return line.rlike(r"^\s*([-*+] |[0-9]{1,4}\. )")


def lines(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, line) of every line."""
    return documents.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))


def line_classes(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, kind): table, list, blank or prose."""
    kind = F.when(F.trim("line") == "", "blank").when(table_line(F.col("line")), "table").when(list_line(F.col("line")), "list").otherwise("prose")
    return lines(documents, key, text).select(key, "pos", kind.alias("kind"))


def merged_lines(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Blocks of neighbouring table or list lines as (key, block, kind, n_lines, first_pos), by gaps and islands."""
    w = Window.partitionBy(key).orderBy("pos")
    before = F.lag("kind").over(w)
    starts = F.when(F.col("kind").isin("table", "list") & (before == F.col("kind")), 0).otherwise(1)
    marked = line_classes(documents, key, text).withColumn("starts", starts).withColumn("block", F.sum("starts").over(w))
    return marked.groupBy(key, "block").agg(F.first("kind").alias("kind"), F.count("*").alias("n_lines"), F.min("pos").alias("first_pos"))


def sections(text: Column, doc_type: Column) -> Column:
    """Lines that start with # of markdown; none of other types."""
    return F.when(doc_type.isin("md", "markdown"), F.filter(F.split(text, "\n"), lambda x: x.startswith("#"))).otherwise(F.array().cast("array<string>"))


def token_windows(documents: DataFrame, key: str, text: str = "text", size: int = 256, overlap: int = 32) -> DataFrame:
    """(key, window, n_tokens, content): fixed windows of blank-separated tokens."""
    step = max(1, size - overlap)
    tokens = documents.select(key, F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ").alias("tokens")).where("tokens[0] <> ''")
    starts = F.sequence(F.lit(0), F.size("tokens") - 1, F.lit(step))
    cut = tokens.select(key, F.posexplode(F.transform(starts, lambda s: F.slice("tokens", s + 1, size))).alias("window", "own"))
    return cut.select(key, "window", F.size("own").alias("n_tokens"), F.array_join("own", " ").alias("content"))

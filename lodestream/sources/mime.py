"""Document types from names that people give, media types and paths, as Python functions and as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of types, registered media types and extensions.
BY_MIME = {
    "application/pdf": "pdf", "text/html": "html", "text/markdown": "markdown", "text/plain": "text", "text/csv": "csv", "application/json": "json", "application/x-ndjson": "jsonl",
    "application/x-yaml": "yaml", "text/yaml": "yaml", "application/xml": "xml", "text/xml": "xml",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx", "application/vnd.oasis.opendocument.text": "odt",
    "application/vnd.oasis.opendocument.spreadsheet": "ods", "application/vnd.oasis.opendocument.presentation": "odp", "message/rfc822": "email",
    "image/png": "image", "image/jpeg": "image", "image/tiff": "image", "image/webp": "image", "image/bmp": "image", "image/gif": "image", "image/svg+xml": "image",
    "audio/mpeg": "audio", "audio/mp4": "audio", "audio/wav": "audio", "audio/x-wav": "audio", "audio/ogg": "audio", "audio/flac": "audio", "audio/webm": "audio",
    "video/mp4": "audio", "video/webm": "audio", "video/x-matroska": "audio", "application/xhtml+xml": "html", "application/yaml": "yaml",
}
BY_EXTENSION = {
    "pdf": "pdf", "html": "html", "htm": "html", "md": "markdown", "markdown": "markdown", "txt": "text", "csv": "csv", "tsv": "tsv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl",
    "yaml": "yaml", "yml": "yaml", "xml": "xml", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx", "odt": "odt", "ods": "ods", "odp": "odp", "eml": "email", "msg": "email",
    "png": "image", "jpg": "image", "jpeg": "image", "tiff": "image", "tif": "image", "webp": "image", "bmp": "image", "gif": "image", "svg": "image",
    "mp3": "audio", "mp4": "audio", "m4a": "audio", "wav": "audio", "ogg": "audio", "flac": "audio", "webm": "audio", "mkv": "audio", "aac": "audio",
    "rst": "text", "text": "text", "log": "text", "xhtml": "html", "xbrl": "xml",
}
#: Parts of media types, tried in this order when the whole is not known.
PARTS = (("pdf", "pdf"), ("html", "html"), ("markdown", "markdown"), ("wordprocessingml", "docx"), ("spreadsheetml", "xlsx"), ("presentationml", "pptx"), ("opendocument.text", "odt"), ("opendocument.spreadsheet", "ods"), ("opendocument.presentation", "odp"), ("json", "json"), ("yaml", "yaml"), ("csv", "csv"), ("rfc822", "email"), ("xml", "xml"))
#: Names that once said how a document comes: now its type is found out.
TRANSPORTS = ("file", "http", "inline", "confluence", "notion")
ALIASES = {"auto": "auto", "": "auto", "md": "markdown", "yml": "yaml", "ndjson": "jsonl", "eml": "email", "mail": "email", "plain": "text", "word": "docx", "excel": "xlsx", "powerpoint": "pptx", "edgar": "edgar", "edgar-html": "edgar", "edgar-xbrl": "edgar"} | dict.fromkeys(TRANSPORTS, "auto")
BINARY = frozenset({"pdf", "docx", "xlsx", "pptx", "odt", "ods", "odp", "image", "audio"})
LOADABLE = (
    "text/", "application/json", "application/xml", "application/pdf", "application/x-yaml", "application/x-ndjson", "application/vnd.openxmlformats", "application/vnd.oasis.opendocument",
    "message/rfc822", "application/msword", "application/vnd.ms-excel", "application/vnd.ms-powerpoint", "application/octet-stream", "image/", "audio/", "video/",
)
# End of fixed values.
TYPES = frozenset(BY_EXTENSION.values()) | {"edgar"}


def normalize_type(given: str | None) -> str:
    """The short type of an alias, a media type or a type; empty is auto; anything else is a ValueError."""
    name = (given or "").strip().lower()
    found = ALIASES.get(name) or (name if name in TYPES else BY_MIME.get(name.split(";")[0].strip()))
    if not found:
        raise ValueError(f"unknown document type: {given}")
    return found


def detect_type(path: str | None, mime: str | None) -> str:
    """By the media type, by a part of it, by the extension; else text."""
    bare = (mime or "").split(";")[0].strip().lower()
    if bare in BY_MIME and bare != "text/plain":
        return BY_MIME[bare]
    for part, kind in PARTS:
        if part in bare:
            return kind
    name = (path or "").split("?")[0].split("#")[0].rsplit("/", 1)[-1].lower()
    return BY_EXTENSION.get(name.rsplit(".", 1)[-1], "text") if "." in name else "text"


def is_binary(kind: str) -> bool:
    return kind in BINARY


def is_loadable(mime: str | None) -> bool:
    """Whether a media type may be read; an unknown one may. Images and sound have a type and no extractor yet."""
    bare = (mime or "").split(";")[0].strip().lower()
    return mime is None or bare.startswith(LOADABLE) or bare in BY_MIME or any(p in bare for p, _ in PARTS)


def detected(path: Column, mime: Column) -> Column:
    """`detect_type` as a column."""
    bare = F.lower(F.trim(F.substring_index(F.coalesce(mime, F.lit("")), ";", 1)))
    exact = F.create_map(*[F.lit(x) for kv in BY_MIME.items() if kv[0] != "text/plain" for x in kv])
    by_part = F.coalesce(*[F.when(F.contains(bare, F.lit(p)), F.lit(k)) for p, k in PARTS])
    name = F.lower(F.substring_index(F.regexp_replace(F.coalesce(path, F.lit("")), r"[?#].*$", ""), "/", -1))
    extension = F.create_map(*[F.lit(x) for kv in BY_EXTENSION.items() for x in kv])
    return F.coalesce(F.try_element_at(exact, bare), by_part, F.when(F.contains(name, F.lit(".")), F.try_element_at(extension, F.substring_index(name, ".", -1))), F.lit("text"))

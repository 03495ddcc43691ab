"""Document containers: which kinds a fetched body is, and the text in it."""

from __future__ import annotations

import io
import re
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteatlas.functions import url

MAX_DECODED = 16 << 20
KIND_ORDER = ["pdf", "zip", "legacy", "text"]
# Extensions and media types of each kind.
EXTENSIONS = {
    "pdf": "pdf",
    "legacy": "doc dot xls ppt rtf",
    "text": "txt text log csv tsv md markdown rst adoc asciidoc json jsonl ndjson xml rss atom yaml yml toml ini cfg conf "
    "config env properties sql srt vtt sub tex bib eml vcf ics",
    "zip": "docx docm dotx dotm odt ott ods ots odp otp odg otg xlsx xlsm pptx pptm",
}
MEDIA_TYPES = {
    "pdf": "application/pdf application/x-pdf",
    "legacy": "application/msword application/vnd.ms-word application/rtf text/rtf application/vnd.ms-excel application/vnd.ms-powerpoint",
    "zip": "application/zip application/x-zip-compressed "
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document "
    "application/vnd.openxmlformats-officedocument.wordprocessingml.template "
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet "
    "application/vnd.openxmlformats-officedocument.presentationml.presentation application/vnd.oasis.opendocument.text "
    "application/vnd.oasis.opendocument.spreadsheet application/vnd.oasis.opendocument.presentation "
    "application/vnd.oasis.opendocument.graphics",
    "text": "application/json application/xml application/javascript application/x-javascript application/x-httpd-php "
    "application/x-sh application/x-yaml application/x-ndjson application/ld+json",
}
MAGIC = {"255044462D": "pdf", "7B5C727466": "legacy", "D0CF11E0A1B11AE1": "legacy", "504B03": "zip", "504B05": "zip", "504B07": "zip"}
CODE_HINTS = [
    "function", "=>", "const ", "let ", "var ", "fetch(", "XMLHttpRequest", "require(", "import ", "export ", "document.",
    "window.", ".then(", "async ", "await ",
]
MARKUP_STARTS = "<!doctype|<html|<head|<body|<div|<script|<a |<meta|<\\?xml|<svg|<table|<form"
URL_TAGS = {"pdf": "pdf-url", "zip": "doc-url", "legacy": "doc-url", "text": "text-url"}


def kind_by_extension(u: Column) -> Column:
    """The kind an extension names, empty if none."""
    ext, found = F.lower(F.regexp_extract(url.cut_at(u, "?#"), r"\.([^.]+)$", 1)), F
    for kind, names in EXTENSIONS.items():
        found = found.when(ext.isin(names.split()), kind)
    return found.otherwise("")


def media_type(c: Column) -> Column:
    return url.trimmed(F.substring_index(F.lower(url.trimmed(c)), ";", 1))


def kind_by_media_type(c: Column) -> Column:
    ct, found = media_type(c), F
    for kind, names in MEDIA_TYPES.items():
        found = found.when(ct.isin(names.split()), kind)
    return found.when(ct.startswith("text/") | ct.endswith("+xml") | ct.endswith("+json"), "text").otherwise("")


def kind_by_magic(body: Column) -> Column:
    head, found = F.hex(F.substring(body, 1, 8)), F
    for magic, kind in MAGIC.items():
        found = found.when(head.startswith(magic), kind)
    return found.otherwise("")


def is_textual(body: Column) -> Column:
    """No NUL, and at least 90 of 100 of the first 4 096 bytes printable; bytes beyond ASCII count as such."""
    head = F.decode(F.substring(body, 1, 4096), "ISO-8859-1")  # one character for each byte
    n = F.char_length(head)
    control = n - F.char_length(F.regexp_replace(head, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]+", ""))
    return (n > 0) & ~head.rlike(r"\x00") & (F.floor((n - control) * 100 / n) >= 90)


def kinds(body: Column, u: Column, content_type: Column) -> Column:
    """The kinds of a body in a fixed order: by name and type unless it is HTML, by magic number, by its bytes."""
    html = media_type(content_type).isin("text/html", "application/xhtml+xml")
    named = [F.when(html, "").otherwise(k) for k in (kind_by_extension(u), kind_by_media_type(content_type))]
    text = F.when(~html & is_textual(body), "text").otherwise("")
    found = F.array(*named, kind_by_magic(body), text)
    return F.array_intersect(F.array(*map(F.lit, KIND_ORDER)), found)  # in the order of the first


def is_document_url(u: Column) -> Column:
    return kind_by_extension(u) != ""


def looks_like_markup(text: Column) -> Column:
    """Opens with a tag of a page, comments before it skipped."""
    t = F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), r"^(?:\s*<!--[\s\S]*?-->)*\s*", "")
    return t.rlike(f"(?i)^(?:{MARKUP_STARTS}|<!--)")


def looks_like_code(text: Column) -> Column:
    """Two hints of JavaScript in the first 8 192 characters, and no markup."""
    head = F.left(text, F.lit(8192))
    hits = sum((head.contains(h).cast("int") for h in CODE_HINTS[1:]), head.contains(CODE_HINTS[0]).cast("int"))
    return ~looks_like_markup(text) & (hits >= 2)


def inflate(raw: bytes) -> bytes:
    raw = raw.rstrip(b"\r\n")
    for wbits in (zlib.MAX_WBITS, -zlib.MAX_WBITS):
        try:
            return zlib.decompressobj(wbits).decompress(raw, MAX_DECODED)
        except zlib.error:
            continue
    return b""


ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}
ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|[\s\S])")


def pdf_literal(raw: bytes) -> bytes:
    """The bytes of a parenthesised string."""

    def one(m: re.Match) -> bytes:
        e = m[1]
        return bytes([int(e, 8) & 255]) if e[:1].isdigit() and e[:1] < b"8" else ESCAPES.get(e, e)

    return ESCAPE.sub(one, raw)


def pdf_strings(data: bytes) -> list[bytes]:
    """String literals, balanced parentheses and hexadecimal, in order."""
    out, i, n = [], 0, len(data)
    while i < n:
        if data[i] == 40:
            depth, j = 0, i
            while j < n:
                c = data[j]
                if c == 92:
                    j += 1
                elif c == 40:
                    depth += 1
                elif c == 41:
                    depth -= 1
                    if depth == 0:
                        break
                j += 1
            if j >= n:
                break
            out.append(pdf_literal(data[i + 1 : j]))
            i = j
        elif data[i] == 60 and data[i + 1 : i + 2] != b"<":
            j = data.find(b">", i)
            if j > 0 and re.fullmatch(rb"[0-9A-Fa-f\s]+", data[i + 1 : j]):
                digits = b"".join(data[i + 1 : j].split())
                out.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
                i = j
        i += 1
    return out


def pdf_text(body: bytes) -> str:
    """What a PDF shows of addresses: its own bytes, inflated streams, and string literals of both."""
    streams, total = [], 0
    for m in re.finditer(rb"(?<!end)stream\r?\n?(.*?)endstream", body, re.S):
        text = inflate(m[1])[: MAX_DECODED - total]
        if text:
            streams.append(text)
            total += len(text)
    parts = [body, *streams, b" ".join(pdf_strings(body)), *(b" ".join(pdf_strings(s)) for s in streams)]
    return b"\n".join(parts).decode("utf-8", "replace")


ZIP_PARTS = (".xml", ".rels", ".txt", ".json", ".csv", ".md", ".html", ".htm")


def zip_text(body: bytes) -> str:
    """Text and relation parts of a zipped document, up to 16 MiB."""
    out, left = [], MAX_DECODED
    try:
        with zipfile.ZipFile(io.BytesIO(body)) as z:
            for info in z.infolist():
                if info.filename.lower().endswith(ZIP_PARTS) and left > 0:
                    try:
                        with z.open(info) as f:
                            out.append(f.read(left))
                    except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError):
                        continue
                    left -= len(out[-1])
    except (zipfile.BadZipFile, ValueError, OSError):
        return ""
    return b"\n".join(out).decode("utf-8", "replace")


def legacy_text(body: bytes) -> str:
    """Both readings of a binary office file: its bytes, and as UTF-16."""
    half = body[: MAX_DECODED - MAX_DECODED % 2]
    wide = half[: len(half) // 2 * 2].decode("utf-16-le", "replace")
    return body.decode("utf-8", "replace") + "\n" + wide


DECODERS = {"text": lambda b: b.decode("utf-8", "replace"), "pdf": pdf_text, "zip": zip_text, "legacy": legacy_text}


def decode_bodies(body: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([DECODERS[k](bytes(b or b"")) for b, k in zip(body, kind, strict=True)], dtype=object)


def document_texts(responses: DataFrame) -> DataFrame:
    """(url, kind, nth, body): the text of each kind of each response with url, content_type and a binary body."""
    k = kinds(F.col("body"), F.col("url"), F.coalesce("content_type", F.lit("")))
    rows = responses.select("url", "body", F.posexplode(k).alias("nth", "kind"))
    return rows.select("url", "kind", "nth", F.pandas_udf(decode_bodies, "string")("body", "kind").alias("body"))


def document_links(responses: DataFrame, rules=None) -> DataFrame:
    """URLs that documents carry as text, the first of each href in a document."""
    from siteatlas.operators.extract import first_of, text_urls
    from siteatlas.rules import CLI_RULES

    texts = document_texts(responses)
    found = None
    for nth, kind in enumerate(KIND_ORDER):
        part = text_urls(texts.where(F.col("kind") == kind), URL_TAGS[kind], rules or CLI_RULES).withColumn("nth", F.lit(nth))
        found = part if found is None else found.unionByName(part)
    return first_of(found, ["source_url", "href"], ["nth", "pos"]).drop("nth")

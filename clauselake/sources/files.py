"""Files as rows: plain text, word-processor and PDF files, and checks of uploads."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File kinds with their first bytes.
MAGIC = {"pdf": ["25504446"], "docx": ["504B0304", "504B0506"], "doc": ["D0CF11E0"], "txt": []}
LARGEST = 50 * 1024 * 1024
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_name, extension, length, modified_at, content)."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.when(name.contains("."), F.element_at(F.split(name, r"\."), -1)).otherwise(""))
    return b.select("path", name.alias("file_name"), ext.alias("extension"), "length", F.col("modificationTime").alias("modified_at"), "content")


def checked(files: DataFrame, largest: int = LARGEST, mime: str | None = None) -> DataFrame:
    """files with upload_error: the first of too_large, empty, bad_type, bad_mime, bad_content that applies, else null.

    mime: a column with the declared type, which must hold the extension; null and text files are not judged by it."""
    head = F.hex(F.substring("content", 1, 4))
    good = F.lit(False)
    for ext, magic in MAGIC.items():
        good = good | ((F.col("extension") == ext) & (head.isin(magic) if magic else F.lit(True)))
    other = ~F.contains(F.col(mime), F.col("extension")) & (F.col("extension") != "txt") if mime else F.lit(False)
    return files.withColumn(
        "upload_error",
        F.when(F.col("length") > largest, "too_large").when(F.col("length") == 0, "empty").when(~F.col("extension").isin(list(MAGIC)), "bad_type")
        .when(other, "bad_mime").when(~good, "bad_content"))


def docx_text(content: bytes | None) -> str | None:
    """Paragraphs of a word-processor file, one a line; None if it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    lines = []
    for p in root.iter(f"{_W}p"):
        parts = []
        for e in p.iter():
            if e.tag == f"{_W}t":
                parts.append(e.text or "")
            elif e.tag == f"{_W}tab":
                parts.append("\t")
            elif e.tag in (f"{_W}br", f"{_W}cr"):
                parts.append("\n")
        lines.append("".join(parts))
    return "\n".join(lines)


_STREAM = re.compile(rb"<<(?P<head>(?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n(?P<body>.*?)\r?\nendstream", re.S)
_SHOW = re.compile(rb"\((?P<text>(?:\\.|[^()\\])*)\)|<(?P<hex>[0-9A-Fa-f\s]+)>|(?P<gap>-?\d+(?:\.\d+)?)(?=[\s\(<\]])|(?P<op>Tj|TJ|T\*|Td|TD|Tm|'|\"|ET)", re.S)
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}


def _plain(raw: bytes) -> str:
    out = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPED.get(m[1], b"" if m[1][-1:] == b"\n" else m[1]), raw, flags=re.S)
    return out[2:].decode("utf-16-be", "replace") if out[:2] == b"\xfe\xff" else out.decode("cp1252", "replace")


def page_text(content: bytes) -> str:
    """Text shown by one page's drawing operators: strings in order, a line for each move to a new one. Fonts of their own encodings are not decoded."""
    lines, line = [], []
    for block in re.findall(rb"\bBT\b(.*?\bET)\b", content, re.S):
        for m in _SHOW.finditer(block):
            if m["text"] is not None:
                line.append(_plain(m["text"]))
            elif m["hex"] is not None:
                line.append(_plain(bytes.fromhex(re.sub(rb"\s", b"", m["hex"]).decode() + "0" * (len(re.sub(rb"\s", b"", m["hex"])) % 2))))
            elif m["gap"] is not None:
                if float(m["gap"]) < -200 and line and not line[-1].endswith(" "):  # a wide gap inside one string array is a blank
                    line.append(" ")
            elif m["op"] in (b"T*", b"Td", b"TD", b"Tm", b"'", b'"', b"ET") and line:
                new, line = ("".join(line), []) if m["op"] not in (b"'", b'"') else ("".join(line[:-1]), line[-1:])
                if new:
                    lines.append(new)
    return "\n".join(lines + (["".join(line)] if line else []))


def pdf_text(content: bytes | None) -> str | None:
    """Text of the pages in the file's order, by a PDF library where one is installed, else from plain and deflated content streams; None if there is none."""
    try:
        from pypdf import PdfReader

        return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content or b"")).pages)
    except ImportError:
        pass
    except Exception:
        return None
    pages = []
    for m in _STREAM.finditer(content or b""):
        body = m["body"]
        if b"FlateDecode" in m["head"]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        if b"BT" in body and (text := page_text(body)):
            pages.append(text)
    return "\n".join(pages) or None


def packed(extension: str, text: str) -> bytes:
    """A minimal file of a kind that holds the lines of a text: txt, docx or pdf (one page, deflated)."""
    if extension == "docx":
        out = io.BytesIO()
        lines = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in text.split("\n"))
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="{_W[1:-1]}"><w:body>{lines}</w:body></w:document>')
        return out.getvalue()
    if extension == "pdf":
        show = b" T* ".join(b"(" + re.sub(rb"([()\\])", rb"\\\1", x.encode("cp1252", "replace")) + b") Tj" for x in text.split("\n"))
        body = zlib.compress(b"BT /F1 11 Tf 72 720 Td " + show + b" ET")
        return b"%PDF-1.7\n1 0 obj\n<< /Length " + str(len(body)).encode() + b" /Filter /FlateDecode >>\nstream\n" + body + b"\nendstream\nendobj\n%%EOF"
    return text.encode("utf-8")


def extracted(files: DataFrame, min_chars: int = 100, ocr=None) -> DataFrame:
    """files with file_text. Text shorter than min_chars goes to ``ocr(extension, content) -> str | None`` where one is given; its failure changes nothing."""

    @F.pandas_udf("string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ext, content in batches:
            out = []
            for e, c in zip(ext, content):
                t = docx_text(c) if e == "docx" else pdf_text(c) if e == "pdf" else (c or b"").decode("utf-8", "replace") if e == "txt" else None
                if ocr is not None and len((t or "").strip()) < min_chars:
                    try:
                        t = ocr(e, c) or t
                    except Exception:
                        pass
                out.append(t)
            yield pd.Series(out, dtype=object)

    return files.withColumn("file_text", read("extension", "content"))


def acceptable_name(name: str) -> bool:
    return re.search(r"\.(pdf|docx|doc|txt)$", name, re.I) is not None


def export_csv(df: DataFrame, path: str) -> None:
    """Delimited export with a header; arrays are joined with '; '."""
    cols = [F.array_join(F.col(f"`{c}`").cast("array<string>"), "; ").alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)

"""Texts and metadata from the bytes of files."""

from __future__ import annotations

import contextlib
import errno
import hashlib
import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.sources.pdf import read_pdf

#: Extractors by extension (fixed values).
EXTENSIONS = {".pdf": "pdf", ".docx": "docx", ".html": "html", ".htm": "html", ".md": "markdown", ".txt": "text"}
EXTRACTORS = ("pdf", "docx", "html", "markdown", "text")

Extracted = tuple[str, str | None, int | None]


def clean(text: str) -> str:
    return re.sub("\r\n?", "\n", text).replace("\0", "").strip()


#: Other spellings of dates than ISO, day and time apart (fixed values: common forms).
_DAYS = ("%d %B %Y", "%d %b %Y", "%B %d %Y", "%b %d %Y", "%Y/%m/%d", "%m/%d/%Y", "%d.%m.%Y")
_TIMES = ("", " %H:%M", " %H:%M:%S", " %I:%M %p", " %H:%M %z", " %H:%M:%S %z")


def timestamp(value: str | None) -> int | None:
    """Milliseconds of a date in ISO form, of a mail or web header, of a PDF, or written out in English; without a zone it is UTC. Else null."""
    text = (value or "").strip()
    d = None
    try:
        d = datetime.fromisoformat(text)
    except ValueError:
        pdf = re.fullmatch(r"(?:D:)?(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?(?:Z|([-+]\d\d)'?(\d\d)?'?)?[Z0']*", text)
        if pdf:
            zone = timezone(timedelta(hours=int(pdf[7]), minutes=int(pdf[8] or 0) * (-1 if pdf[7][0] == "-" else 1))) if pdf[7] else timezone.utc
            with contextlib.suppress(ValueError):
                d = datetime(*[int(pdf[i] or least) for i, least in ((1, 1), (2, 1), (3, 1), (4, 0), (5, 0), (6, 0))], tzinfo=zone)
        else:
            plain = re.sub(r"^(?:mon|tue|wed|thu|fri|sat|sun)\w*\.?,?\s+", "", re.sub(r"\b(?:GMT|UTC|Z)\b", "+0000", text), flags=re.IGNORECASE)
            plain = re.sub(r"\s+", " ", re.sub(r"(?<=\d)(?:st|nd|rd|th)\b|,", " ", plain)).strip()
            for form in (a + b for a in _DAYS for b in _TIMES):
                with contextlib.suppress(ValueError):
                    d = datetime.strptime(plain, form)
                    break
    if d is None:
        return None
    return int((d if d.tzinfo else d.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def from_text(data: bytes) -> Extracted:
    return clean(data.decode("utf-8", "replace").removeprefix("﻿")), None, None


class _Page(HTMLParser):
    SKIPPED = {"script", "style", "nav", "footer"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip: list[str] = []
        self.body, self.head, self.meta = False, False, {}

    def handle_starttag(self, tag, attrs):
        if tag == "meta":
            a = dict(attrs)
            if a.get("name") and a.get("content"):
                self.meta.setdefault(a["name"], a["content"])
        if tag == "head":
            self.head = True
        elif tag == "body":
            self.body, self.head = True, False
        elif tag in self.SKIPPED:
            self.skip.append(tag)

    def handle_endtag(self, tag):
        if tag == "head":
            self.head = False
        elif tag in self.SKIPPED and tag in self.skip:
            while self.skip.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.skip and not self.head:
            self.parts.append(data)


def from_html(data: bytes) -> Extracted:
    page = _Page()
    page.feed(data.decode("utf-8", "replace"))
    page.close()
    m = page.meta
    return clean("".join(page.parts)), m.get("author") or m.get("Author"), timestamp(m.get("date") or m.get("DC.date"))


def from_docx(data: bytes) -> Extracted:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
        text = "\n\n".join("".join(t.text or "" if t.tag == f"{w}t" else "\t" if t.tag == f"{w}tab" else "\n" if t.tag == f"{w}br" else "" for t in p.iter()) for p in root.iter(f"{w}p"))
        core = z.read("docProps/core.xml").decode("utf-8", "replace") if "docProps/core.xml" in z.namelist() else ""
    author, made = re.search(r"<dc:creator[^>]*>([^<]*)", core), re.search(r"<dcterms:created[^>]*>([^<]*)", core)
    return clean(text), (html.unescape(author[1]).strip() or None) if author else None, timestamp(made[1]) if made else None


def from_pdf(data: bytes) -> Extracted:
    text, info = read_pdf(data)
    return clean(text), info.get("Author", "").strip() or None, timestamp(info.get("CreationDate"))


#: By extractor, a function from bytes to (text, author, created_at); register() puts another in its place.
_FUNCTIONS: dict[str, Callable[[bytes], Extracted]] = {"pdf": from_pdf, "text": from_text, "markdown": from_text, "html": from_html, "docx": from_docx}


def register(name: str, function: Callable[[bytes], Extracted], extensions: tuple[str, ...] = ()) -> None:
    _FUNCTIONS[name] = function
    EXTENSIONS.update({e: name for e in extensions})


def extract_py(extension: str, data: bytes | None) -> tuple[str | None, str | None, int | None, str | None]:
    """text, author, created_at, error: one of text and error is null."""
    name = EXTENSIONS.get((extension or "").lower())
    if name not in _FUNCTIONS:
        return None, None, None, f"Unsupported file type: {extension}"
    try:
        return (*_FUNCTIONS[name](data or b""), None)
    except Exception as e:  # noqa: BLE001 - any broken file is a row of its own, not the end of the job
        return None, None, None, f"Invalid or corrupt file: {e}"


#: A batch of extracted texts has so many rows and characters, or a little more.
BATCH_ROWS, BATCH_CHARS = 2000, 8_000_000


def _read(path: str) -> tuple[bytes | None, str | None]:
    """Bytes and error of a file."""
    try:
        with open(path, "rb") as f:
            return f.read(), None
    except OSError as e:
        return None, f"{errno.errorcode.get(e.errno, 'EIO')}: {e.strerror}"


def extracted(files: DataFrame, also: tuple[str, ...] = (), hashed: bool = False) -> DataFrame:
    """path, text, author, created_at, error of (path, extension, content). Broken files give an error, never a failure.

    Without a column content files are opened by their paths, on a disk that workers have; those that are gone are left out. `also` names further
    columns to be kept, and `hashed` adds content_hash, the SHA-256 of the bytes.
    """
    given = "content" in files.columns
    names = ["path", *also, *(["content_hash"] if hashed else []), "text", "author", "created_at", "error"]
    kept = [f"`{c}` {files.schema[c].dataType.simpleString()}" for c in also]
    schema = ", ".join(["path string", *kept, *(["content_hash string"] if hashed else []), "text string, author string, created_at long, error string"])
    types = [*([pa.string()] if hashed else []), pa.string(), pa.string(), pa.int64(), pa.string()]
    first = 3 if given else 2

    def rows(b: pa.RecordBatch) -> Iterator[tuple[int, list]]:
        for i in range(b.num_rows):
            kind, error = b.column(1)[i].as_py(), None
            if given:
                data = b.column(2)[i].as_py()
            else:
                data, error = _read(b.column(0)[i].as_py())
                if error and error.startswith("ENOENT"):
                    continue
            got = (None, None, None, error) if error else extract_py(kind, data)
            yield i, [*([None if data is None else hashlib.sha256(data).hexdigest()] if hashed else []), *got]

    def batch(b: pa.RecordBatch, at: list[int], out: list[list]) -> pa.RecordBatch:
        at_ = pa.array(at, pa.int64())
        same = [b.column(k).take(at_) for k in (0, *range(first, first + len(also)))]
        return pa.RecordBatch.from_arrays([*same, *[pa.array(list(c), t) for c, t in zip(zip(*out), types)]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out, n = [], [], 0
            for i, row in rows(b):
                at.append(i)
                out.append(row)
                n += len(row[-4] or "")
                if len(at) >= BATCH_ROWS or n >= BATCH_CHARS:
                    yield batch(b, at, out)
                    at, out, n = [], [], 0
            if at:
                yield batch(b, at, out)

    return files.select("path", F.lower("extension").alias("_kind"), *(["content"] if given else []), *also).mapInArrow(run, schema)

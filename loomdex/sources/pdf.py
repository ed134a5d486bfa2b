"""Text of PDF files whose text is stored as text: plain or Flate streams, simple fonts and fonts with a ToUnicode table.

Scanned pages hold no text and give none. Encrypted files and files without a PDF header are errors.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)(?:endobj|(?=\d+\s+\d+\s+obj\b)|\Z)", re.DOTALL)
_STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
_REFERENCE = re.compile(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R")
#: Strings, hex strings, numbers, names, array signs and operators of a content stream.
_PART = re.compile(rb"(?P<text>\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\))|<(?P<hex>[0-9A-Fa-f\s]*)>(?!>)|(?P<number>[-+]?\d*\.?\d+)|/(?P<name>[^\s/<>\[\]()]+)|(?P<sign>[\[\]])|(?P<op>[A-Za-z'\"*]+)", re.DOTALL)
_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(\r\n|[\s\S]))")
_CONTROL = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}
#: A step back of so many thousandths of the font's size between two strings is a space.
SPACE = -180.0


def literal(raw: bytes) -> bytes:
    """Bytes of a string in parentheses."""
    return _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1] else _CONTROL.get(m[2], m[2]), raw[1:-1])


def plain_string(raw: bytes) -> str:
    """A string outside of pages: UTF-16 with a mark, else one byte a letter."""
    return raw.decode("utf-16", "replace") if raw[:2] in (b"\xfe\xff", b"\xff\xfe") else raw.decode("cp1252", "replace")


def _inflated(head: bytes, body: bytes) -> bytes | None:
    if b"/Filter" not in head:
        return body
    if b"/FlateDecode" not in head or re.search(rb"/(DCT|JPX|CCITTFax|JBIG2|LZW|ASCII85|ASCIIHex|RunLength)Decode", head):
        return None
    try:
        return zlib.decompressobj().decompress(body)
    except zlib.error:
        return None


def _to_unicode(table: bytes) -> tuple[dict[int, str], int]:
    """Letters by code, and the bytes of a code."""
    out, width = {}, 1
    letters = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", table, re.DOTALL):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[int(a, 16)], width = letters(b), len(a) // 2
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", table, re.DOTALL):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            first, width = int(c, 16), len(a) // 2
            for i in range(min(int(b, 16) - int(a, 16), 0xFFFF) + 1):
                out[int(a, 16) + i] = chr(first + i) if first + i < 0x110000 else ""
    return out, max(1, width)


def _page_text(content: bytes, fonts: dict[bytes, tuple[dict[int, str], int]]) -> str:
    out: list[str] = []
    held: list = []  # operands
    font = None

    def shown(raw: bytes) -> str:
        if font is None:
            return plain_string(raw)
        table, width = font
        return "".join(table.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))

    def newline() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    for m in _PART.finditer(content):
        if m["text"] is not None:
            held.append(literal(m["text"]))
        elif m["hex"] is not None:
            h = re.sub(rb"\s", b"", m["hex"])
            held.append(bytes.fromhex((h + b"0" * (len(h) % 2)).decode()))
        elif m["number"] is not None:
            held.append(float(m["number"]))
        elif m["name"] is not None:
            held.append(("name", m["name"]))
        elif m["op"] is not None:
            op = m["op"]
            if op == b"Tf":
                names = [x[1] for x in held if isinstance(x, tuple)]
                font = fonts.get(names[-1]) if names else None
            elif op in (b"Td", b"TD"):
                numbers = [x for x in held if isinstance(x, float)]
                if len(numbers) >= 2 and numbers[-1]:
                    newline()
                elif out and not out[-1].endswith((" ", "\n")):
                    out.append(" ")
            elif op in (b"T*", b"Tm", b"ET"):
                newline()
            elif op in (b"Tj", b"TJ", b"'", b'"'):
                if op in (b"'", b'"'):
                    newline()
                for x in held:
                    if isinstance(x, bytes):
                        out.append(shown(x))
                    elif isinstance(x, float) and op == b"TJ" and x < SPACE:
                        out.append(" ")
            held = []
    return "".join(out)


def read_pdf(data: bytes) -> tuple[str, dict[str, str]]:
    """The text of the pages in the order of the file, and the strings of the document's information."""
    if b"%PDF-" not in data[:1024]:
        raise ValueError("no PDF header")
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
        raise ValueError("file is encrypted")
    heads: dict[int, bytes] = {}
    streams: dict[int, bytes] = {}
    for m in _OBJECT.finditer(data):
        number, body = int(m[1]), m[2]
        if s := _STREAM.match(body):
            heads[number] = s[1]
            if (got := _inflated(s[1], s[2])) is not None:
                streams[number] = got
        else:
            heads[number] = body
    for number in [k for k, h in heads.items() if b"/ObjStm" in h and k in streams]:  # objects packed into a stream
        first = re.search(rb"/First\s+(\d+)", heads[number])
        inner = streams.pop(number)
        at = [int(x) for x in inner[: int(first[1])].split()] if first else []
        places = list(zip(at[::2], at[1::2]))
        for (k, begin), (_, end) in zip(places, [*places[1:], (0, len(inner))]):
            heads[k] = inner[int(first[1]) + begin : int(first[1]) + end if end != len(inner) else len(inner)]
    tables = {k: _to_unicode(streams[k]) for k in streams if b"begincmap" in streams[k]}
    by_font = {k: tables.get(int(t[1])) for k, h in heads.items() if (t := re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", h))}
    fonts = {name: by_font[int(k)] for h in heads.values() for name, k in _REFERENCE.findall(h) if by_font.get(int(k))}
    pages = [_page_text(c, fonts) for k, c in streams.items() if k not in tables and re.search(rb"\bBT\b", c) and not re.search(rb"/(XRef|Metadata|FontFile)", heads[k])]
    info = {}
    if m := re.search(rb"/Info\s+(\d+)\s+\d+\s+R", data):
        for name, raw in re.findall(rb"/(\w+)\s*(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]+>)", heads.get(int(m[1]), b"")):
            info[name.decode()] = plain_string(literal(raw) if raw[:1] == b"(" else bytes.fromhex(re.sub(rb"\s", b"", raw[1:-1]).decode()))
    return "\n".join(p.strip() for p in pages if p.strip()), info

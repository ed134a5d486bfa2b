"""Snippets around the hits of a text, and marks on them. For the few texts of a result page."""

from __future__ import annotations

import re

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.functions.text import normalise_py

#: Snippets a text, characters to each side of a hit, and the largest gap within a cluster (fixed values).
MOST, SIDE, GAP = 3, 80, 200

_WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")


def _cut(text: str, begin: int, end: int) -> str:
    while begin > 0 and not text[begin - 1].isspace():
        begin -= 1
    while end < len(text) and not text[end].isspace():
        end += 1
    return ("…" if begin else "") + re.sub(r"\s+", " ", text[begin:end]).strip() + ("…" if end < len(text) else "")


def hits_py(text: str, terms: list[str], phrase_starts: list[int] = ()) -> list[int]:
    """Where the words of the text begin that are one of the terms, and those numbered in phrase_starts; in order."""
    wanted, words = {normalise_py(t) for t in terms}, list(_WORD.finditer(text))
    return sorted({m.start() for m in words if normalise_py(m[0]) in wanted} | {words[i].start() for i in phrase_starts if i < len(words)})


def clusters_py(hits: list[int], gap: int = GAP) -> list[list[int]]:
    """Runs of hits of which each is at most `gap` behind the one before it."""
    out: list[list[int]] = []
    for h in hits:
        if out and h - out[-1][-1] <= gap:
            out[-1].append(h)
        else:
            out.append([h])
    return out


def snippets_py(text: str | None, terms: list[str], phrase_starts: list[int] = (), most: int = MOST) -> list[str]:
    """Offsets are in code points. A text without hits gives its begin; a null or empty one gives none."""
    if not text:
        return []
    hits = hits_py(text, terms, phrase_starts)
    if not hits:
        return [_cut(text, 0, min(len(text), 2 * SIDE))]
    centres = [c[len(c) // 2] for c in clusters_py(hits)[:most]]
    return [_cut(text, max(0, c - SIDE), min(len(text), c + SIDE)) for c in centres]


def snippets(text: Column, terms: Column, phrase_starts: Column) -> Column:
    def run(t: pa.Array, w: pa.Array, p: pa.Array) -> pa.Array:
        return pa.array([snippets_py(a, b or [], c or []) for a, b, c in zip(t.to_pylist(), w.to_pylist(), p.to_pylist())], pa.list_(pa.string()))

    return F.arrow_udf(run, T.ArrayType(T.StringType()))(text, terms, phrase_starts)


def highlight_py(snippet: str, phrase_terms: list[str], terms: list[str]) -> list[tuple[str, str]]:
    """Parts (text, type) with type 'text', 'term' or 'phrase'. The earliest match wins, then the longer, then the phrase."""
    forms = [(kind, re.compile(r"\b(?:" + "|".join(map(re.escape, ws)) + r")\b", re.IGNORECASE | re.ASCII)) for kind, ws in (("phrase", phrase_terms), ("term", terms)) if ws]
    out, at = [], 0
    while at < len(snippet):
        found = [(m.start(), -len(m[0]), i, m, kind) for i, (kind, f) in enumerate(forms) if (m := f.search(snippet, at)) and m[0]]
        if not found:
            break
        _, _, _, m, kind = min(found, key=lambda x: x[:3])
        if m.start() > at:
            out.append((snippet[at : m.start()], "text"))
        out.append((m[0], kind))
        at = m.end()
    if at < len(snippet):
        out.append((snippet[at:], "text"))
    return out


def highlight(snippet: Column, phrase_terms: Column, terms: Column) -> Column:
    kind = pa.list_(pa.struct([("text", pa.string()), ("type", pa.string())]))

    def run(s: pa.Array, p: pa.Array, t: pa.Array) -> pa.Array:
        return pa.array([[{"text": a, "type": b} for a, b in highlight_py(x or "", y or [], z or [])] for x, y, z in zip(s.to_pylist(), p.to_pylist(), t.to_pylist())], kind)

    return F.arrow_udf(run, T.ArrayType(T.StructType.fromDDL("text string, type string")))(snippet, phrase_terms, terms)


def hit_clusters(text: Column, terms: Column) -> Column:
    """Of each cluster of hits in a text its number of hits, the first and the last; those that snippets are made of."""
    kind = pa.list_(pa.struct([("n_hits", pa.int32()), ("first", pa.int32()), ("last", pa.int32())]))

    def run(t: pa.Array, w: pa.Array) -> pa.Array:
        rows = ((a or "", b or []) for a, b in zip(t.to_pylist(), w.to_pylist()))
        return pa.array([[{"n_hits": len(c), "first": c[0], "last": c[-1]} for c in clusters_py(hits_py(a, b))] for a, b in rows], kind)

    return F.arrow_udf(run, T.ArrayType(T.StructType.fromDDL("n_hits int, first int, last int")))(text, terms)

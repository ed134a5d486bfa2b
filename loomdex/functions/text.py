"""Text normalisation and tokenisation as Columns.

Normalisation is NFKD, removal of U+0300–U+036F, lower case, and trimming of white space. Spark has no NFKD, so characters whose
decomposition is at most one character go through `translate` inside the JVM; texts with others (Hangul, ligatures, fractions,
mathematical letters, marks that must be put in order) go through an Arrow UDF, which sees only those texts.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKS = "̀-ͯ"
_MARKS = re.compile(f"[{MARKS}]")

#: White space that is trimmed (fixed values: the space separators, line ends and the byte order mark).
SPACE = "\\t\\n\\x0b\\f\\r \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}"
_SPACE_PY = "\t\n\x0b\f\r \xa0                　﻿"

#: What separates tokens (fixed value).
SEPARATOR = r"[^\p{L}\p{N}\p{M}]+"


def normalise_py(text: str | None) -> str | None:
    return None if text is None else _MARKS.sub("", unicodedata.normalize("NFKD", text)).lower().strip(_SPACE_PY)


@functools.cache
def _tables() -> tuple[str, str, str, str]:
    """From the Unicode data of this Python: source and target of translate, common characters that it can do, and an expression for all
    that it can't (slow, as its class is long, so it is asked of few characters only)."""
    kept, to, removed, other = [], [], [], []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        if 0x300 <= cp <= 0x36F:
            removed.append(c)
            continue
        d = _MARKS.sub("", unicodedata.normalize("NFKD", c))
        if d == c:
            continue
        if cp < 0x10000 and len(d) == 1 and ord(d) < 0x10000:
            kept.append(c)
            to.append(d)
        elif cp < 0x10000 and not d:
            removed.append(c)
        else:
            other.append(cp)
    marks = [cp for cp in range(0x370, sys.maxunicode + 1) if not 0xD800 <= cp < 0xE000 and unicodedata.combining(chr(cp))]
    # characters of the commonest blocks that translate can do: what is left of most texts without them is nothing
    hard = set(other)
    common = [*range(0x250), *range(0x300, 0x370), *range(0x900, 0x980), *range(0x2010, 0x2060), 0x20AC, *range(0x2190, 0x2200), *range(0x2500, 0x27C0)]
    easy = "".join(chr(p) for p in common if p not in hard)
    return "".join(kept + removed), "".join(to), easy, f"[{_ranges(other)}]|[{_ranges(marks)}]{{2}}"


def _ranges(points: list[int]) -> str:
    """A few ranges that hold all the points; what lies between near ones may be in, since the UDF is right for every text."""
    points = points or [0xFFFFF]
    out = [[points[0], points[0]]]
    for p in points[1:]:
        if p - out[-1][1] <= (1 if p < 0x1000 else 200):
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


@functools.cache
def _normalise_udf():
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([normalise_py(t) for t in texts.to_pylist()], pa.string())

    # not deterministic for the planner only: else filters on the result run the function again
    return F.arrow_udf(run, T.StringType()).asNondeterministic()


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def normalise(c: Column) -> Column:
    """NFKD, marks removed, lower case, trimmed. Null stays null, blank becomes empty."""
    src, dst, easy, hard = _tables()
    wide = c.rlike("[^\\x00-\\x7f]")
    needs = wide & (c.rlike(_DEVANAGARI_MARKS) | F.translate(c, easy, "").rlike(hard))
    plain = F.when(wide, F.lower(F.translate(c, src, dst))).otherwise(F.lower(c))
    return F.coalesce(_normalise_udf()(F.when(needs, c)), trim_space(plain))


#: Marks that may have to be put in order; of other scripts' marks, two that are only parted by common characters count as neighbours.
_DEVANAGARI_MARKS = "[\\x{93c}\\x{94d}\\x{951}-\\x{954}]{2}"


def tokens(normal: Column) -> Column:
    """Tokens of a normalised text, in order. Null and blank texts have none."""
    return F.filter(F.split(F.coalesce(normal, F.lit("")), SEPARATOR), lambda t: t != "")

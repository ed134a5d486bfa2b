"""Metadata filters as predicates on the files table; they reach the scan."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timezone, tzinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdex.functions.values import extension, parse_dates, parse_size
from loomdex.plans.query import Filter


def compare(c: Column, operator: str, value: int) -> Column:
    test: dict[str, Callable[[Column], Column]] = {
        ":": lambda x: x == value, "=": lambda x: x == value, "<": lambda x: x < value, ">": lambda x: x > value, "<=": lambda x: x <= value, ">=": lambda x: x >= value,
    }
    return test[operator](c) if operator in test else F.lit(True)


def _within(c: Column, f: Filter, now_ms: int, zone: tzinfo) -> Column:
    span = parse_dates(f.value, now_ms, zone)
    if span is None:
        return F.lit(True)
    if f.operator in (":", "=") and span.start != span.end:
        return (c >= span.start) & (c < span.end)
    return compare(c, f.operator, span.start)


def _edge(c: Column, f: Filter, now_ms: int, zone: tzinfo, operator: str) -> Column:
    span = parse_dates(f.value, now_ms, zone)
    return F.lit(True) if span is None else compare(c, operator, span.start)


def predicate(f: Filter, now_ms: int, zone: tzinfo = timezone.utc) -> Column:
    """True or false for every file, never null. Unknown keys and values that can't be read let every file pass; a null author or language none."""
    value = f.value.lower()
    if f.key in ("type", "ext", "extension"):
        out = F.lower(F.coalesce(F.col("extension"), extension(F.col("path")))) == (value if value.startswith(".") else f".{value}")
    elif f.key == "folder":
        out = F.lower("path").contains(value)
    elif f.key in ("before", "after"):
        out = _edge(F.col("modified_time"), f, now_ms, zone, "<" if f.key == "before" else ">")
    elif f.key == "modified":
        out = _within(F.col("modified_time"), f, now_ms, zone)
    elif f.key == "created":
        out = _within(F.coalesce("created_at", "modified_time"), f, now_ms, zone)
    elif f.key == "size":
        n = parse_size(f.value)
        out = F.lit(True) if n is None else compare(F.col("size"), f.operator, n)
    elif f.key == "author":
        out = F.lower("author").contains(value)
    elif f.key == "language":
        out = F.lower("language") == value
    else:
        return F.lit(True)
    return F.coalesce(out, F.lit(False))


def in_scope(path: Column, prefixes: list[str]) -> Column:
    """Whether the path begins with one of the folders, case aside; without folders every path is in scope."""
    if not prefixes:
        return F.lit(True)
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(F.lower(path), F.lit(p.lower()))
    return F.coalesce(out, F.lit(False))

"""Literals of the query language, and values written for people."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone, tzinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400000

#: Powers of 1024 by unit (fixed values).
UNITS = ("b", "kb", "mb", "gb", "tb")

#: Categories of files by extension (fixed values).
CATEGORIES = {
    "text": ".txt .md .docx .doc .rtf",
    "code": ".html .htm .xml .json .js .ts .jsx .tsx .css .scss .py .java .cpp .c .h .go .rs .php .rb",
    "pdf": ".pdf",
    "image": ".png .jpg .jpeg .gif .svg .webp .bmp .ico",
    "video": ".mp4 .mov .avi .mkv .webm",
    "audio": ".mp3 .wav .flac .aac .ogg .m4a",
    "spreadsheet": ".xls .xlsx .csv",
    "archive": ".zip .rar .7z .tar .gz .bz2",
}

#: Categories of failures by what the message contains, the first that fits (fixed values).
FAILURES = {
    "permission_denied": ("permission", "eacces", "access denied"),
    "encrypted": ("password", "encrypted"),
    "corrupted": ("corrupt", "invalid", "unable to deserialize"),
    "locked": ("locked", "eminuse", "resource busy"),
    "unsupported": ("unsupported", "not supported"),
}


@dataclass(frozen=True)
class Span:
    """From start to before end; a point if both are equal."""

    start: int
    end: int


def parse_size(value: str) -> int | None:
    m = re.fullmatch(r"([0-9]+(?:\.[0-9]+)?)\s*(b|kb|mb|gb|tb)?", value.strip().lower())
    return math.floor(float(m[1]) * 1024 ** UNITS.index(m[2] or "b") + 0.5) if m else None


def size_of(c: Column) -> Column:
    """parse_size of a column of literals."""
    pattern = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*(b|kb|mb|gb|tb)?\s*$"
    text = F.lower(c)
    unit = F.regexp_extract(text, pattern, 2)
    power = F.coalesce(F.array_position(F.array(*[F.lit(u) for u in UNITS]), unit), F.lit(0)) - 1
    return F.when(text.rlike(pattern), F.floor(F.regexp_extract(text, pattern, 1).cast("double") * F.pow(F.lit(1024.0), F.greatest(power, F.lit(0))) + 0.5))


def _months_back(day: datetime, months: int) -> datetime:
    """The same day of an earlier month; days that it lacks run over into the next."""
    at = day.year * 12 + day.month - 1 - months
    return datetime(at // 12, at % 12 + 1, 1, tzinfo=day.tzinfo) + timedelta(days=day.day - 1)


def parse_dates(value: str, now_ms: int, zone: tzinfo = timezone.utc) -> Span | None:
    """`today`, `yesterday`, `last<N>(day|week|month|year)[s]` as whole days, else a date or time as a point, else None.

    A date alone is midnight UTC; a time without zone is in `zone`.
    """
    text = value.strip()
    ms = lambda d: int(d.timestamp() * 1000)
    today = datetime.fromtimestamp(now_ms / 1000, zone).replace(hour=0, minute=0, second=0, microsecond=0)
    tomorrow, word = today + timedelta(days=1), text.lower()
    if word == "today":
        return Span(ms(today), ms(tomorrow))
    if word == "yesterday":
        return Span(ms(today - timedelta(days=1)), ms(today))
    if m := re.fullmatch(r"last([0-9]+)(day|week|month|year)s?", word):
        n = int(m[1])
        start = {"day": lambda: today - timedelta(days=n), "week": lambda: today - timedelta(days=7 * n), "month": lambda: _months_back(today, n), "year": lambda: _months_back(today, 12 * n)}[m[2]]()
        return Span(ms(start), ms(tomorrow))
    for form in ("%Y-%m-%d", "%Y-%m", "%Y"):
        try:
            at = ms(datetime.strptime(text, form).replace(tzinfo=timezone.utc))
            return Span(at, at)
        except ValueError:
            pass
    for form in ("%Y/%m/%d", "%m/%d/%Y", "%d %B %Y", "%B %d, %Y", "%d %b %Y", "%b %d, %Y"):
        try:
            at = ms(datetime.strptime(text, form).replace(tzinfo=zone))
            return Span(at, at)
        except ValueError:
            pass
    try:
        d = datetime.fromisoformat(text)
    except ValueError:
        return None
    at = ms(d if d.tzinfo else d.replace(tzinfo=zone))
    return Span(at, at)


def parse_flag(c: Column) -> Column:
    """A stored setting as boolean: '1' and 'true' are true, null is null, all else is false."""
    return F.lower(c).isin("1", "true")


def file_category(extension: Column) -> Column:
    out = None
    for name, members in CATEGORIES.items():
        test = extension.isin(members.split())
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("default")


def failure_category(message: Column) -> Column:
    text, out = F.lower(F.coalesce(message, F.lit(""))), None
    for name, parts in FAILURES.items():
        test = text.rlike("|".join(parts))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("extraction_failed")


def _power(c: Column, most: int) -> Column:
    """How often 1024 goes into a size, at most so often; comparisons, since logarithms round."""
    out = F.lit(0)
    for i in range(1, most + 1):
        out = F.when(c >= 1024**i, i).otherwise(out) if i == 1 else F.when(c >= 1024**i, F.lit(i)).otherwise(out)
    return out


def format_bytes(c: Column, units: int = 5, trim: bool = False) -> Column:
    """'0 B', '17 B', '1.5 KB'; trim drops a zero after the point. Null stays null."""
    names = F.array(*[F.lit(u.upper()) for u in UNITS[:units]])
    p = _power(c, units - 1)
    value = F.format_string("%.1f", c.cast("double") / F.pow(F.lit(1024.0), p))
    if trim:
        value = F.regexp_replace(value, r"\.0$", "")
    return F.when(c.isNull(), None).otherwise(F.concat(F.when(p == 0, c.cast("long").cast("string")).otherwise(value), F.lit(" "), F.element_at(names, p + 1)))


def format_relative(c: Column, now_ms: int) -> Column:
    s = F.floor((F.lit(now_ms) - c) / 1000)
    m, h = F.floor(s / 60), F.floor(s / 3600)
    d, mo = F.floor(s / 86400), F.floor(s / 86400 / 30)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    mo = F.floor(d / 30)
    return F.when(s < 60, "just now").when(m < 60, text(m, "m")).when(h < 24, text(h, "h")).when(d < 30, text(d, "d")).when(mo < 12, text(mo, "mo")).otherwise(text(F.floor(mo / 12), "y"))


def format_duration(c: Column) -> Column:
    return F.when(c < 1000, F.concat(c.cast("string"), F.lit("ms"))).otherwise(F.concat(F.format_string("%.1f", c / F.lit(1000.0)), F.lit("s")))


def hash_preview(c: Column) -> Column:
    return F.concat(F.substring(c, 1, 12), F.lit("…"), F.right(c, F.lit(8)))


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(done / total * 100 + 0.5).cast("int")).otherwise(0)


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def basename(path: Column) -> Column:
    return F.substring_index(slashed(path), "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(slashed(path), "^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension with its point, '' if the name has none or only a leading one."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def millis(c: Column) -> Column:
    """A date or time in text as milliseconds, null if it is none."""
    return F.unix_millis(F.try_to_timestamp(c))

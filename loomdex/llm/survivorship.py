"""The best representative of each group of duplicate records."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.llm.labels import filled

#: Times before 1980 are those of file systems that had none.
EARLIEST_MS = 315532800000


@dataclass(frozen=True)
class Field:
    """An attribute of the surviving record: its column, and when it holds a value."""

    name: str
    is_filled: Callable[[Column], Column] = lambda c: c.isNotNull()


def survivors(df: DataFrame, group: str, record: str, fields: list[Field], standing: Column, stamp: Column, carried: list[str] = ()) -> DataFrame:
    """One surviving record for each group of two or more different records, built and chosen field by field.

    group, record: columns of the group and of the record's id. standing: source priority, higher is better. stamp: time, null if none.
    Of each field the value comes from the record that is best in this order: it fills the field, its standing, its stamp, how many fields
    it fills, the greater id; a field that nobody fills is null. `record` is the one that wins the most filled fields; of equal ones the
    one of the greatest standing, then stamp, fields filled and id. If no field is filled at all, it is the best in that order.
    carried: further columns, each of the record that is best in that order. Rows with a null group or id belong to none.
    Repeated rows count once. One aggregation, the maximum of a composite struct for each field, with partial results on the mappers: a
    group of any size arrives as one row per task. Result: group, record, fields, carried.
    """
    d = df.select(F.col(group).alias("_g"), F.col(record).alias("_r"), standing.alias("_s"), F.coalesce(stamp, F.lit(-(2**62))).alias("_t"), *[F.col(f.name).alias(f"_f_{f.name}") for f in fields], *[F.col(c).alias(f"_c_{c}") for c in carried])
    d = d.filter("_g is not null and _r is not null")
    has = {f.name: f.is_filled(F.col(f"_f_{f.name}")) for f in fields}
    d = d.withColumn("_n", sum((F.when(h, 1).otherwise(0) for h in has.values()), F.lit(0)))
    best = [F.max(F.struct(h.alias("h"), "_s", "_t", "_n", "_r", F.when(h, F.col(f"_f_{f}")).alias("v"))).alias(f"_b_{f}") for f, h in has.items()]
    any_ = F.max(F.struct(F.lit(True).alias("h"), "_s", "_t", "_n", "_r")).alias("_any")
    own = [F.max(F.struct("_s", "_t", "_n", "_r", F.col(f"_c_{c}").alias("v"))).alias(f"_o_{c}") for c in carried]
    g = d.groupBy("_g").agg(F.min("_r").alias("_lo"), F.max("_r").alias("_hi"), any_, *best, *own).filter("_lo != _hi")
    winners = F.array(*[F.struct(*[F.col(f"_b_{f.name}.{x}") for x in ("h", "_s", "_t", "_n", "_r")]) for f in fields])
    g = g.withColumn("_w", F.filter(winners, lambda w: w["h"]))
    # fields won by a record: at most one winner a field, so the arrays are as short as the list of fields
    won = lambda r: F.size(F.filter("_w", lambda w: w["_r"] == r))
    candidates = F.concat(F.array("_any"), F.col("_w"))
    g = g.withColumn("_b", F.array_max(F.transform(candidates, lambda w: F.struct(won(w["_r"]).alias("won"), w["_s"], w["_t"], w["_n"], w["_r"]))))
    return g.select(F.col("_g").alias(group), F.col("_b._r").alias(record), *[F.col(f"_b_{f.name}.v").alias(f.name) for f in fields], *[F.col(f"_o_{c}.v").alias(c) for c in carried])


def hex_digest(c: Column, digits: int = 64) -> Column:
    """The digest as lower-case hexadecimal digits, without prefix, white space or separators; null if it isn't one of so many digits."""
    s = F.regexp_replace(F.lower(c), r"(?U)^[\s'\"\\]*(?:(?:urn:)?sha-?256[:=\s]|0x)\s*", "")
    s = F.regexp_replace(s, r"(?U)[\s:\-'\"]", "")
    return F.when(s.rlike(f"^[0-9a-f]{{{digits}}}$"), s)


#: Segments of a path that are places for backups, trash, caches or temporary files, and names of copies (fixed values).
SIDE_PLACE = (
    r"(?i)(^|/)[.$_]*("
    r"([^/]*[-_ .])?back-?ups?([-_ .][^/]*)?|time ?machine|trash([-_. ][^/]*)?|trashes|recycle[-_. ]?(bin|d)|recycled|recycler|papierkorb|corbeille|papelera"
    r"|([^/]*[-_ .])?caches?|__pycache__|te?mp([-_. ]?files)?|temporary([-_ ]?files)?|lost\+found)/"
)
COPY_NAME = (
    r"(?i)(^|/)(copy( *\(?\d+\)?)? of |kopie( \d+)? von |copie( \d+)? de |copia( \d+)? de |~\$|#[^/]*#$)[^/]*$"
    r"|( \(\d+\)|[-_ ]+(copy|kopie|copie|copia)[-_ ]*\(?\d*\)?)(\.[^./]*)?$"
    r"|\.(bak|backup|old|orig|tmp|temp|swp|save|autosave)(\.?\d+)?$|~$"
)


def path_standing(c: Column) -> Column:
    """1 for an original, 0 for a copy or a file in a place for backups, trash, caches or temporary files, or without a path."""
    p = F.translate(c, "\\", "/")
    return F.when(p.isNull() | p.rlike(SIDE_PLACE) | p.rlike(COPY_NAME), 0).otherwise(1)


def valid_time(c: Column, written: Column) -> Column:
    """The time, or null where it cannot be true: after the row was written, or before 1980."""
    return F.when((c >= EARLIEST_MS) & (written.isNull() | (c <= written)), c)


FILE_FIELDS = [Field("language", filled), Field("author", filled), Field("created_at"), Field("extension", filled)]


def surviving_files(files: DataFrame) -> DataFrame:
    """content_hash (64 lower-case digits), file_id, language, author, created_at, extension, path, modified_time of each group of equal content.

    modified_time is null where the surviving record's own cannot be true. Files without a digest are in no group.
    """
    d = files.withColumn("_hash", hex_digest(F.col("content_hash"))).withColumn("_time", valid_time(F.col("modified_time"), F.col("indexed_at")))
    d = d.select(F.col("_hash").alias("content_hash"), "file_id", "language", "author", "created_at", "extension", "path", F.col("_time").alias("modified_time"))
    return survivors(d, "content_hash", "file_id", FILE_FIELDS, path_standing(F.col("path")), F.col("modified_time"), ["path", "modified_time"])

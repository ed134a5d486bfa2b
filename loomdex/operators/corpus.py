"""Operations on the tables of an index: sync, ignore rules, duplicates, integrity, recovery, health, failures and runs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.functions.values import basename, failure_category, slashed

#: Rules of a new index (fixed values).
DEFAULT_RULES = (("node_modules/", "folder"), (".git/", "folder"), ("dist/", "folder"), ("build/", "folder"), ("*.tmp", "glob"), ("*.log", "glob"))
#: Bounds of health (fixed values).
FAILED_SHARE, STALE_MS = 0.1, 24 * 3600000
RUNS_AVERAGED = 19

HIDDEN = r"(^|/)\.[^/]"


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression: * and ? stay within a segment, ** crosses, [..] and {..,..} as usual; dots are ordinary."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[i + 2 :]:
            j = pattern.index("]", i + 2)
            body = pattern[i + 1 : j].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", j
        elif c == "{" and "}" in pattern[i:]:
            j = pattern.index("}", i)
            out, i = out + "(?:" + "|".join(glob_regex(p) for p in pattern[i + 1 : j].split(",")) + ")", j
        else:
            out += re.escape(c)
        i += 1
    return out


def ignored(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Whether any rule hides the path. Folder rules name a segment; globs fit the whole path or its last segment. Rules become one regex each at plan time."""
    p, out = slashed(path), F.lit(False)
    for pattern, kind in rules:
        if kind == "folder":
            name = pattern.replace("\\", "/").rstrip("/")
            out = out | F.array_contains(F.split(p, "/"), F.lit(name))
        else:
            r = f"^(?:{glob_regex(pattern)})$"
            out = out | p.rlike(r) | basename(p).rlike(r)
    return F.coalesce(out, F.lit(False))


def watch_ignored(path: Column, rules: list[tuple[str, str]]) -> Column:
    return slashed(path).rlike(HIDDEN) | ignored(path, rules)


def sync_tasks(disk: DataFrame, known: DataFrame) -> DataFrame:
    """(path, task): 'index' where a file is new or differs in size or time, 'delete' where it is gone; one full outer join on the path.

    A null size or time differs from any value. Repeated paths give one task.
    """
    a = disk.groupBy("path").agg(F.max(F.struct("modified_time", "size")).alias("d")).select("path", "d.*", F.lit(1).alias("here"))
    b = known.groupBy("path").agg(F.max(F.struct("modified_time", "size")).alias("k")).select("path", F.col("k.size").alias("k_size"), F.col("k.modified_time").alias("k_time"), F.lit(1).alias("there"))
    j = a.join(b, "path", "full_outer")
    same = F.col("size").eqNullSafe(F.col("k_size")) & F.col("modified_time").eqNullSafe(F.col("k_time"))
    task = F.when(F.col("here").isNull(), "delete").when(F.col("there").isNull() | ~same, "index")
    return j.select("path", task.alias("task")).filter("task is not null")


def sync_summary(tasks: DataFrame) -> DataFrame:
    return tasks.agg(F.count_if(F.col("task") == "index").alias("to_index"), F.count_if(F.col("task") == "delete").alias("to_delete"))


def duplicate_groups(files: DataFrame) -> DataFrame:
    """(content_hash, n_files, total_size, wasted): files that share a hash; null and empty hashes share nothing. Sums are partial on the mappers.

    duplicate_members() lists the files of the groups.
    """
    d = files.filter("content_hash is not null and content_hash != ''").select("content_hash", "path", "size")
    g = d.groupBy("content_hash").agg(F.count("*").alias("n_files"), F.sum("size").alias("total_size"), F.max("size").alias("m"))
    return g.filter("n_files > 1").select("content_hash", "n_files", "total_size", F.greatest(F.lit(0), F.col("total_size") - F.col("m")).alias("wasted"))


def duplicate_members(files: DataFrame) -> DataFrame:
    """(content_hash, file_id, path): one row per member, so that a group of any size is no single value. Ordered by hash and path within the
    partitions, which are ranges of both: read one after another the members of a group come in order of path, and a large group is several tasks."""
    d = files.filter("content_hash is not null and content_hash != ''").select("content_hash", "file_id", "path")
    d = d.join(duplicate_groups(files).select("content_hash"), "content_hash", "left_semi")
    return d.repartitionByRange("content_hash", "path").sortWithinPartitions("content_hash", "path")


def wasted_total(files: DataFrame) -> DataFrame:
    return duplicate_groups(files).agg(F.coalesce(F.sum("wasted"), F.lit(0)).alias("wasted"))


def orphan_terms(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """Terms without postings. The ids of the postings are made distinct on the mappers first, so no hot id travels."""
    return terms.join(postings.select("term_id").distinct(), "term_id", "left_anti")


def orphan_postings(postings: DataFrame, files: DataFrame, terms: DataFrame) -> DataFrame:
    """(term_id, file_id) of postings whose file or term is absent; null ids refer to nothing."""
    p = postings.select("term_id", "file_id")
    p = p.distinct()
    a = p.join(files.select("file_id").distinct(), "file_id", "left_anti").select("term_id", "file_id")
    return a.unionByName(p.join(terms.select("term_id").distinct(), "term_id", "left_anti").select("term_id", "file_id")).distinct()


def partial_files(files: DataFrame, postings: DataFrame) -> DataFrame:
    return files.join(postings.select("file_id").distinct(), "file_id", "left_anti")


def integrity_report(files: DataFrame, terms: DataFrame, postings: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """(type, n): number of issues of each kind; a sound index has no rows. metadata: total_indexed_files and total_indexed_terms, if kept."""
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("type"), "n")
    out = count(orphan_terms(terms, postings), "orphan_term")
    out = out.unionByName(count(orphan_postings(postings, files, terms), "orphan_posting"))
    out = out.unionByName(count(partial_files(files.filter("size > 0"), postings), "missing_file"))
    out = out.unionByName(count(files.groupBy("path").count().filter("count > 1 and path is not null"), "duplicate_metadata"))
    if metadata is not None:
        real = count(files, "f").unionByName(count(terms, "t")).groupBy().pivot("type", ["f", "t"]).agg(F.first("n"))
        m = metadata.select("total_indexed_files", "total_indexed_terms").join(F.broadcast(real))  # one row each
        wrong = (F.col("total_indexed_files") != F.col("f")).cast("int") + (F.col("total_indexed_terms") != F.col("t")).cast("int")
        out = out.unionByName(m.select(F.lit("invalid_metadata").alias("type"), wrong.cast("long").alias("n")))
    return out.filter("n > 0")


def repaired(files: DataFrame, terms: DataFrame, postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms and postings without orphans. Files without postings stay; they are indexed again, not repaired."""
    p = postings.join(files.select("file_id").distinct(), "file_id", "left_semi").join(terms.select("term_id").distinct(), "term_id", "left_semi")
    return terms.join(p.select("term_id").distinct(), "term_id", "left_semi"), p


def failure_rows(events: DataFrame) -> DataFrame:
    """(path, category, message, occurred_at, retry_count) from (path, message, ts): the last failure of each path, and how many came before it."""
    d = events.select("path", "message", "ts")
    g = d.groupBy("path").agg(F.max(F.struct("ts", "message")).alias("l"), (F.count("*") - 1).cast("int").alias("retry_count"))
    return g.select("path", failure_category(F.col("l.message")).alias("category"), F.col("l.message").alias("message"), F.col("l.ts").alias("occurred_at"), "retry_count")


def average_durations(runs: DataFrame, part: str | None = None) -> DataFrame:
    """(id, average_ms): at each completed run the mean of the last durations with the current one counted once more, rounded.

    part: a column that keeps the runs of one index apart; without it the log is taken as of one index, and ordered in one task, as it is short.
    """
    done = runs.filter("completed_at is not null and duration_ms is not null")
    w = (Window.partitionBy(part) if part else Window.partitionBy(F.lit(0))).orderBy("completed_at", "id").rowsBetween(1 - RUNS_AVERAGED, 0)
    mean = (F.sum("duration_ms").over(w) + F.col("duration_ms")) / (F.count("*").over(w) + 1)
    return done.select("id", F.floor(mean + 0.5).alias("average_ms"))


def health(n_files: Column, n_failed: Column, n_pending: Column, status: Column, last_synced: Column, now_ms: int) -> Column:
    """'error', 'warning' or 'healthy'. The share of failures is taken of the indexed files, and only if there are some. Nulls count as none."""
    n_files, n_failed, n_pending = [F.coalesce(c, F.lit(0)) for c in (n_files, n_failed, n_pending)]
    error = (status == "error") | ((n_files > 0) & (n_failed > 0) & (n_failed / F.when(n_files > 0, n_files) > FAILED_SHARE))
    warn = (n_failed > 0) | (n_pending > 0) | (F.lit(now_ms) - last_synced > STALE_MS)
    return F.when(F.coalesce(error, F.lit(False)), "error").when(F.coalesce(warn, F.lit(False)), "warning").otherwise("healthy")


def interrupted(runs: DataFrame, now_ms: int) -> DataFrame:
    """The run log with runs still in progress marked failed."""
    open_ = F.col("status") == "in_progress"
    return runs.withColumns(
        {
            "completed_at": F.when(open_, F.lit(now_ms)).otherwise(F.col("completed_at")),
            "duration_ms": F.when(open_, F.coalesce("duration_ms", F.lit(0))).otherwise(F.col("duration_ms")),
            "error_message": F.when(open_, F.lit("Interrupted")).otherwise(F.col("error_message")),
            "status": F.when(open_, F.lit("failed")).otherwise(F.col("status")),
        }
    )


def under_folder(path: Column, folder: str, semantics: str = "strict") -> Column:
    """Files of a folder by prefix with separator. 'reference': case aside, and _ and % of the folder's name fit anything."""
    prefix = folder.rstrip("/\\") + ("\\" if "\\" in folder and "/" not in folder else "/")
    return path.ilike(prefix.replace("\\", "\\\\") + "%") if semantics == "reference" else F.startswith(path, F.lit(prefix))


def by_metadata(files: DataFrame, **values: str | None) -> DataFrame:
    """Files whose language, author and extension equal the values given; a value of None fits none. Without values all files."""
    for name, value in values.items():
        if name not in ("language", "author", "extension"):
            raise ValueError(name)
        files = files.filter(F.col(name) == F.lit(value).cast("string"))
    return files


def upsert_files(files: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of `new` in place of those with the same path."""
    return files.join(new.select("path").distinct(), "path", "left_anti").select(*files.columns).unionByName(new.select(*files.columns))


def without_files(files: DataFrame, postings: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files and postings without the paths of `gone`."""
    dead = files.join(gone.select("path").distinct(), "path", "left_semi").select("file_id")
    return files.join(gone.select("path").distinct(), "path", "left_anti").select(*files.columns), postings.join(dead, "file_id", "left_anti").select(*postings.columns)

"""Crawling folders."""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.values import extension
from loomdex.operators.corpus import HIDDEN, ignored
from loomdex.operators.signed_counts import HadoopFiles
from loomdex.sources.extractors import EXTENSIONS, EXTRACTORS


@dataclass(frozen=True)
class CrawlConfig:
    rules: tuple[tuple[str, str], ...] = ()
    enabled: tuple[str, ...] = EXTRACTORS
    max_bytes: int = 0
    skip_hidden: bool = True


def _plain(root: str) -> str:
    return root.removeprefix("file://").rstrip("/")


def _kept(d: DataFrame, roots: list[str], config: CrawlConfig, content: bool) -> DataFrame:
    """Of files as the source gives them, those that are indexed. Order of tests: ignore rules, hidden names, extractor, size."""
    if config.max_bytes > 0:
        d = d.filter(F.col("length") <= config.max_bytes)
    d = d.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_time"), *(["content"] if content else []))
    kinds = [e for e, name in EXTENSIONS.items() if name in config.enabled]
    d = d.withColumn("extension", extension(F.col("path"))).filter(~ignored(F.col("path"), list(config.rules)))
    if config.skip_hidden:
        inner = F.regexp_replace("path", "^(" + "|".join(re.escape(_plain(r)) for r in roots) + ")/", "")
        d = d.filter(~inner.rlike(HIDDEN))
    return d.filter(F.col("extension").isin(kinds))


def _source(spark: SparkSession):
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")


# Folders of mounted disks are walked and read where the rows are. Spark's own source lists every file to the driver and takes a task for four files.

_LISTED = "path string, length long, modificationTime timestamp"
#: Folders that the driver looks for to deal out a walk, for each core, and in one folder at most.
WALKS, WIDEST = 8, 10_000
#: Files of a task that reads them.
READ_FILES = 5000


def _local(path: str) -> str:
    return re.sub("^file:/+", "/", path).rstrip("/") or "/"


def mounted(spark: SparkSession, roots: list[str]) -> bool:
    """Whether all folders are on a disk that workers open by path."""
    return all(HadoopFiles(spark, r).mounted for r in roots)


def _unlisted(name: str) -> bool:
    """The names that Spark's file sources do not list, and those that are no text."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_") or name.encode(errors="ignore").decode() != name


def _stated(paths: Iterable[str]) -> Iterator[tuple[str, os.stat_result]]:
    for p in paths:
        try:
            yield p, os.stat(p)
        except FileNotFoundError:  # gone by now, or a link to nothing
            continue


def _inside(folder: str) -> Iterator[os.DirEntry]:
    try:
        with os.scandir(folder) as entries:
            yield from (e for e in entries if not _unlisted(e.name))
    except FileNotFoundError:
        return


def _file_rows(found: Iterable[tuple[str, os.stat_result]], most: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Rows of the regular files among them."""
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modificationTime", pa.timestamp("us", "UTC"))])
    rows: list[tuple] = []
    for p, s in found:
        if stat.S_ISREG(s.st_mode):
            rows.append((p, s.st_size, s.st_mtime_ns // 1_000_000 * 1000))
        if len(rows) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _tree(folder: str, deep: bool) -> Iterator[tuple[str, os.stat_result]]:
    """The files of a folder, and if deep of those in it."""
    todo = [folder]
    while todo:
        for p, s in _stated(e.path for e in _inside(todo.pop())):
            if not stat.S_ISDIR(s.st_mode):
                yield p, s
            elif deep:
                todo.append(p)


def _walked(spark: SparkSession, roots: list[str]) -> DataFrame:
    """What Spark's source lists of the folders. The driver looks for enough folders to deal out, and sees no files."""
    tops = sorted({_local(r) for r in roots})
    for r in tops:
        if not os.path.isdir(r):
            raise FileNotFoundError(f"Folder does not exist: {r}")
    enough, todo, shallow = WALKS * spark.sparkContext.defaultParallelism, tops, []
    while todo and len(todo) + len(shallow) < enough:
        deeper, stuck = [], []
        for folder in todo:
            subs = []
            for e in _inside(folder):
                if e.is_dir():
                    subs.append(e.path)
                    if len(subs) > WIDEST:
                        break
            if len(subs) > WIDEST:
                stuck.append(folder)
            else:
                deeper += subs
                shallow.append(folder)
        if stuck:
            todo = deeper + stuck
            break
        todo = deeper
    items = [(f, True) for f in todo] + [(f, False) for f in shallow]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder, deep in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield from _file_rows(_tree(folder, deep))

    n = max(1, min(len(items), enough // 2))
    d = spark.createDataFrame(items, "folder string, deep boolean").repartition(n).mapInArrow(run, _LISTED)
    # of a folder within another, what both have counts once
    return d.dropDuplicates(["path"]) if any(b.startswith(a.rstrip("/") + "/") for a in tops for b in tops) else d


def _named(wanted: DataFrame, roots: list[str]) -> DataFrame:
    """Of the wanted paths those that are files below the roots with names that are listed."""
    below = F.lit(False)
    for r in roots:
        top = _local(r).rstrip("/") + "/"
        below = below | (F.startswith("path", F.lit(top)) & ~F.substr("path", F.lit(len(top) + 1)).rlike(r"(^|/)(\.|_(?![^/]*=))|\._COPYING_(/|$)"))
    d = wanted.select("path").filter(below)
    n = max(wanted.sparkSession.sparkContext.defaultParallelism, -(-wanted.count() // READ_FILES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _file_rows(_stated(b.column(0).to_pylist()))

    return d.repartition(n, "path").distinct().mapInArrow(run, _LISTED)


def listed(spark: SparkSession, roots: list[str], config: CrawlConfig = CrawlConfig(), content: bool = False) -> DataFrame:
    """(path, size, modified_time, extension[, content]) of the files that are indexed, from all folders at once.

    Spark's file sources never list names that begin with a point or an underscore, nor does the walk of mounted folders, so hidden files stay out
    whatever `skip_hidden` says; it decides on files in hidden folders given as roots. Without `content` the bytes are never read.
    """
    return _kept(_source(spark).load(roots) if content or not mounted(spark, roots) else _walked(spark, roots), roots, config, content)


#: Files that are named to the source one by one, of mounted folders and of others; of more, mounted files are opened where their rows are, and other folders read whole.
NAMED_MOUNTED, NAMED_PATHS = 32, 20_000


def contents(spark: SparkSession, roots: list[str], wanted: DataFrame, config: CrawlConfig = CrawlConfig()) -> DataFrame | None:
    """listed() with content of the wanted paths (path) alone, or None if there are none. Nothing else is read or even listed of mounted folders, and
    of others up to NAMED_PATHS files; paths outside of the roots and files that are gone are left out. Of many mounted files there is no column
    content: extracted() opens them by their paths."""
    near = mounted(spark, roots)
    most = NAMED_MOUNTED if near else NAMED_PATHS
    few = [r[0] for r in wanted.select("path").filter("path is not null").distinct().limit(most + 1).collect()]
    if len(few) > most and near:
        return _kept(_named(wanted, roots), roots, config, False)
    if len(few) > most:
        return listed(spark, roots, config, True).join(wanted.select("path").distinct(), "path", "left_semi")
    files = HadoopFiles(spark, roots[0])
    few = [p for p in few if any(p.startswith(_plain(r) + "/") for r in roots) and files.exists(p)]
    if not few:
        return None
    # what a name has of the signs of patterns stands for itself
    return _kept(_source(spark).load([re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in few]), roots, config, True)


def ignored_count(spark: SparkSession, roots: list[str], config: CrawlConfig) -> int:
    """Files and folders that rules hide, each folder once, whatever is in it."""
    d = (_walked(spark, roots) if mounted(spark, roots) else _source(spark).load(roots)).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    inner = F.regexp_extract("path", "^(?:" + "|".join(re.escape(_plain(r)) for r in roots) + ")/(.*)$", 1)
    parts = F.split(inner, "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    base = F.expr("substring(path, 1, length(path) - length(inner))")
    # the first part of the path that a rule hides: nothing below it counts
    d = d.select("path", inner.alias("inner")).select(base.alias("base"), F.posexplode(ups).alias("k", "up"), "path").filter(ignored(F.concat("base", "up"), list(config.rules)))
    return d.groupBy("path").agg(F.min(F.struct("k", F.concat("base", "up").alias("at"))).alias("m")).select("m.at").distinct().count()

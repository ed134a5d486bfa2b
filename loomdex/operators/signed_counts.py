"""Persistent counts that are kept up to date by signed changes.

The stores of a folder share one manifest, so a change to several of them is valid whole or not at all. A change is written as one
segment a store: its signed sums by key, and nothing else. What a merge writes is therefore a small multiple of the change, never of the
store; a reader adds up the segments. Segments of like size are compacted, so that their number grows with the logarithm of what was
written. A reader of an older manifest is never disturbed.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class HadoopFiles:
    """Small text files through Hadoop's file systems, so that any shared folder will do."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self._jvm = jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    @property
    def mounted(self) -> bool:
        """Whether paths are those of a disk that every process can open."""
        return self._fs.getUri().getScheme() == "file"

    def exists(self, p: str) -> bool:
        return self._fs.exists(self._path(p))

    def names(self, p: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(p))) if self.exists(p) else []

    def read(self, p: str) -> str:
        stream = self._fs.open(self._path(p))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, p: str, text: str) -> None:
        """Written under another name first: a reader sees the whole file or none."""
        part = self._path(p + ".part")
        stream = self._fs.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self._fs.rename(part, self._path(p)):
            raise FileExistsError(f"{p} was written by another writer")

    def replace(self, p: str, text: str) -> None:
        """Write over what is there."""
        stream = self._fs.create(self._path(p), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def is_folder(self, p: str) -> bool:
        return self.exists(p) and self._fs.getFileStatus(self._path(p)).isDirectory()

    def size(self, p: str) -> int:
        """Bytes of everything under a path."""
        return self._fs.getContentSummary(self._path(p)).getLength() if self.exists(p) else 0

    def delete(self, p: str) -> None:
        self._fs.delete(self._path(p), True)


@dataclass(frozen=True)
class Counts:
    """A store: keys (name: type; nulls are keys like any other), sums (long columns that changes are added to), maxes (long columns of
    which the largest is kept), lead (the key that segments are sorted by, so that a lookup reads only the row groups it may need)."""

    keys: dict[str, str]
    sums: list[str]
    maxes: list[str] = field(default_factory=list)
    lead: str | None = None

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(", ".join([f"`{k}` {t}" for k, t in self.keys.items()] + [f"`{m}` bigint" for m in [*self.sums, *self.maxes]]))

    def added_up(self, df: DataFrame) -> DataFrame:
        """One row a key; Spark adds up on the mappers first, so a key of any number of rows is shuffled once a task."""
        value = [F.coalesce(F.col(s).cast("bigint"), F.lit(0)).alias(s) for s in self.sums]
        d = df.select(*[F.col(k).cast(t).alias(k) for k, t in self.keys.items()], *value, *[F.col(x).cast("bigint").alias(x) for x in self.maxes])
        return d.groupBy(*self.keys).agg(*[F.sum(s).alias(s) for s in self.sums], *[F.max(x).alias(x) for x in self.maxes])

    def live(self, df: DataFrame) -> DataFrame:
        """Without keys whose sums are all zero: they are gone."""
        return df.filter(" or ".join(f"`{s}` != 0" for s in self.sums))


#: A segment is merged with the one before it if that is at most so many times as long.
COMPACT_RATIO = 2
#: A lookup of at most so many distinct lead keys names them to the scan; of more it names the least and the greatest.
LOOKUP_KEYS = 1000


class CountStores:
    """Stores by name in one folder."""

    def __init__(self, spark: SparkSession, path: str, stores: dict[str, Counts]):
        self.spark, self.path, self.stores = spark, path.rstrip("/"), stores
        self.files = HadoopFiles(spark, self.path)
        self._pending: dict[str, list[list]] | None = None

    def manifest(self) -> dict:
        """generation, and of each store its segments [folder, rows], oldest first."""
        names = [n for n in self.files.names(f"{self.path}/_manifest") if n.endswith(".json")]
        return json.loads(self.files.read(f"{self.path}/_manifest/{names[-1]}")) if names else {"generation": 0, "segments": {}}

    def _commit(self, segments: dict[str, list[list]], generation: int) -> None:
        target = f"{self.path}/_manifest/{generation:08d}.json"
        if self.files.exists(target):
            raise FileExistsError(f"generation {generation} was written by another writer")
        self.files.write(target, json.dumps({"generation": generation, "segments": segments}))

    def segments(self, name: str) -> list[list]:
        return self.manifest()["segments"].get(name, []) + (self._pending or {}).get(name, [])

    def _load(self, name: str, segments: list[list]) -> DataFrame:
        schema = self.stores[name].schema
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{s[0]}" for s in segments])

    def read(self, name: str, touched: DataFrame | None = None) -> DataFrame:
        """Keys with their sums and maxes, those of an open change too. touched: only keys whose lead is in this one-column frame."""
        spec, segments = self.stores[name], self.segments(name)
        d = self._load(name, segments)
        if touched is not None:
            column = touched.columns[0]
            few = [r[0] for r in touched.distinct().limit(LOOKUP_KEYS + 1).collect()]
            if len(few) <= LOOKUP_KEYS:
                d = d.filter(F.col(spec.lead).isin([k for k in few if k is not None]))
            else:
                low, high = touched.agg(F.min(column), F.max(column)).first()
                d = d.filter(F.col(spec.lead).between(low, high)).join(touched.distinct().withColumnRenamed(column, spec.lead), spec.lead, "left_semi").select(*d.columns)
        return spec.live(d if len(segments) < 2 else spec.added_up(d))  # the keys of one segment are distinct

    @contextlib.contextmanager
    def change(self) -> Iterator[CountStores]:
        """What is added inside becomes valid when the block ends, and is deleted if it fails. One writer at a time: a second one fails."""
        m = self.manifest()
        self._pending = {}
        try:
            yield self
            new = {k: v for k, v in self._pending.items() if v}
            if new:
                self._commit({k: m["segments"].get(k, []) + new.get(k, []) for k in {*m["segments"], *new}}, m["generation"] + 1)
        except BaseException:
            for parts in self._pending.values():
                for s in parts:
                    self.files.delete(f"{self.path}/{s[0]}")
            raise
        finally:
            self._pending = None
        self.compact()

    def add(self, name: str, change: DataFrame, distinct: bool = False) -> DataFrame:
        """Write a signed change as a segment and return it as written. Repeated keys add up; distinct says that there are none.

        An empty change makes no segment. This runs when called, not when the result is used.
        """
        spec = self.stores[name]
        d = change.select(*spec.schema.names) if distinct else spec.added_up(change)
        segment = self._write(name, d)
        if not segment[1]:
            self.files.delete(f"{self.path}/{segment[0]}")
            return self._load(name, [])
        self._pending.setdefault(name, []).append(segment)
        return self._load(name, [segment])

    def _write(self, name: str, d: DataFrame) -> list:
        folder, spec = f"{name}-{uuid.uuid4().hex}", self.stores[name]
        (d.sortWithinPartitions(spec.lead) if spec.lead else d).write.parquet(f"{self.path}/{folder}")
        return [folder, self._load(name, [[folder]]).count()]  # from the footers

    def compact(self) -> None:
        """Merge the last segments of each store while the one before them isn't much longer than they are together."""
        m = self.manifest()
        segments, done = dict(m["segments"]), False
        for name, parts in segments.items():
            first, total = len(parts) - 1, parts[-1][1]
            while first > 0 and parts[first - 1][1] <= COMPACT_RATIO * total:
                first -= 1
                total += parts[first][1]
            if first < len(parts) - 1:
                spec = self.stores[name]
                d = spec.added_up(self._load(name, parts[first:]))
                segments[name], done = parts[:first] + [self._write(name, spec.live(d) if first == 0 else d)], True
        if done:
            self._commit(segments, m["generation"] + 1)

    def vacuum(self) -> int:
        """Delete segments that the newest manifest doesn't name; only when nobody reads older ones. Returns how many."""
        used = {s[0] for parts in self.manifest()["segments"].values() for s in parts}
        gone = [n for n in self.files.names(self.path) if n != "_manifest" and n not in used]
        for n in gone:
            self.files.delete(f"{self.path}/{n}")
        return len(gone)

"""Change streams: finding changes, quiet periods, last write wins, coalescing, and applying flushes to the index.

Events closer together than the quiet time, of whatever path, make one flush. Two events in the same slot of that length are closer, so the
flushes follow from the first and last time in each slot: only slots next to each other have to be compared, and no task ever holds a flush.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomdex.operators.signed_counts import HadoopFiles

QUIET = "300 milliseconds"
EVENTS = "ts timestamp, path string, event string"
#: Slots that one task puts in order.
CHUNK = 10_000
_MICROS = {"microsecond": 1, "millisecond": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6}


def micros(quiet: str) -> int:
    """'300 milliseconds', '2 minutes', … in microseconds."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", quiet)
    if not m or m[2] not in _MICROS or int(m[1]) == 0:
        raise ValueError(quiet)
    return int(m[1]) * _MICROS[m[2]]


def _rows(events: DataFrame) -> DataFrame:
    """Events with a time, as rows that stand for n of them: of each slot and path the last, of equal times the one that comes last by name."""
    return events.filter("ts is not null").select("path", "event", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.lit(1).cast("long").alias("n"))


def _slots(rows: DataFrame, width: int) -> DataFrame:
    return rows.groupBy(F.floor(F.col("t") / F.lit(width)).alias("slot")).agg(F.min("t").alias("first"), F.max("t").alias("last"))


def _flushes(slots: DataFrame, width: int) -> DataFrame:
    """(slot, flush, flush_at, first, last): the flush is named by its first slot. Slots are ordered within chunks; over all, one row a chunk is."""
    before = slots.select((F.col("slot") + 1).alias("slot"), F.col("last").alias("before"))
    d = slots.join(before, "slot", "left").withColumn("chunk", F.floor(F.col("slot") / F.lit(CHUNK)))
    d = d.withColumn("begins", F.when(F.col("before").isNull() | (F.col("first") - F.col("before") >= width), F.col("slot")))
    carry = d.groupBy("chunk").agg(F.max("begins").alias("b"))
    carry = carry.select("chunk", F.max("b").over(Window.partitionBy(F.lit(0)).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    d = d.withColumn("flush", F.max("begins").over(Window.partitionBy("chunk").orderBy("slot"))).join(carry, "chunk").withColumn("flush", F.coalesce("flush", "carry"))
    ends = d.groupBy("flush").agg((F.max("last") + width).alias("flush_at"))
    return d.select("slot", "flush", "first", "last").join(ends, "flush")


def _flushed(rows: DataFrame, flushes: DataFrame, width: int) -> DataFrame:
    """(flush_at, path, t, event, n): the last event of each path in each flush. Added up by slot and path first, on the mappers."""
    last = [F.max(F.struct("t", "event")).alias("e"), F.sum("n").alias("n")]
    d = rows.withColumn("slot", F.floor(F.col("t") / F.lit(width))).groupBy("slot", "path").agg(*last).select("slot", "path", "e.t", "e.event", "n")
    d = d.join(flushes.select("slot", "flush", "flush_at"), "slot").groupBy("flush", "flush_at", "path").agg(*last)
    return d.select("flush_at", "path", "e.t", "e.event", "n")


def debounced(events: DataFrame, quiet: str = QUIET) -> DataFrame:
    """(flush_at, path, event, n_events) of events (ts timestamp, path, event) in a table: of each path in a flush the last event holds.

    Events without a time are left out; a null path is a path.
    """
    width, rows = micros(quiet), _rows(events)
    d = _flushed(rows, _flushes(_slots(rows, width), width), width)
    return d.select(F.timestamp_micros("flush_at").cast(events.schema["ts"].dataType).alias("flush_at"), "path", "event", F.col("n").alias("n_events"))


class Pending:
    """What a stream has seen of flushes that may still grow: a row a path, and the slots, as tables in a folder, by batch.

    A batch that is run again after a failure starts from the same tables as before, so it gives the same flushes.
    """

    def __init__(self, spark: SparkSession, path: str, quiet: str = QUIET):
        self.spark, self.path, self.width = spark, path.rstrip("/"), micros(quiet)
        self.files = HadoopFiles(spark, self.path)

    def _read(self, batch: int, name: str, schema: str) -> DataFrame:
        done = [int(n) for n in self.files.names(self.path) if n.isdigit() and int(n) < batch and self.files.exists(f"{self.path}/{n}/_done")]
        return self.spark.read.schema(schema).parquet(f"{self.path}/{max(done)}/{name}") if done else self.spark.createDataFrame([], schema)

    def add(self, events: DataFrame, batch: int, delay: str = "1 microsecond", now: int | None = None) -> DataFrame:
        """Tasks (path, event) of the flushes that are over: their quiet time ended before the newest time seen, less `delay` for late events, or
        before `now` (microseconds), where the clock of the events is at hand. Runs when called."""
        rows = _rows(events).unionByName(self._read(batch, "rows", "path string, event string, t bigint, n bigint"))
        slots = _slots(_rows(events), self.width).unionByName(self._read(batch, "slots", "slot bigint, first bigint, last bigint"))
        slots = slots.groupBy("slot").agg(F.min("first").alias("first"), F.max("last").alias("last"))
        home = f"{self.path}/{batch}"
        self.files.delete(home)
        _flushes(slots, self.width).write.parquet(f"{home}/flushes")
        flushes = self.spark.read.parquet(f"{home}/flushes")
        newest = flushes.agg(F.max("last")).first()[0]
        until = max(x for x in (now, None if newest is None else newest - micros(delay), -(2**62)) if x is not None)
        _flushed(rows, flushes, self.width).write.parquet(f"{home}/flushed")
        flushed = self.spark.read.parquet(f"{home}/flushed")
        flushed.filter(F.col("flush_at") > until).select("path", "event", "t", "n").write.parquet(f"{home}/rows")
        flushes.filter(F.col("flush_at") > until).select("slot", "first", "last").write.parquet(f"{home}/slots")
        self.files.replace(f"{home}/_done", "")
        for n in self.files.names(self.path):
            if n.isdigit() and int(n) < batch - 1:
                self.files.delete(f"{self.path}/{n}")
        return flushed.filter(F.col("flush_at") <= until).select("path", "event", F.col("n").alias("n_events"))


def coalesced(tasks: DataFrame) -> DataFrame:
    """(path, task): one task a path; where both are asked for, 'index' wins over 'delete'."""
    return tasks.groupBy("path").agg(F.when(F.bool_or(F.col("task") == "index"), "index").otherwise("delete").alias("task"))


def queue_progress(tasks: DataFrame) -> DataFrame:
    """One row: processed, total, indexed_files and percent of tasks (path, task, done)."""
    from loomdex.functions.values import percent

    c = tasks.agg(F.count_if("done").alias("processed"), F.count("*").alias("total"), F.count_if(F.col("done") & (F.col("task") == "index")).alias("indexed_files"))
    return c.withColumn("percent", percent(F.col("processed"), F.col("total")))


def apply_changes(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, quiet: str = QUIET, trigger: dict | None = None, delay: str = "1 microsecond", clock: Callable[[], int] | None = None) -> StreamingQuery:
    """Start the stream: flushes that are over go, coalesced, to `apply(tasks, batch_id)`; a batch repeated after a failure has the same id and tasks.

    The open flush is kept as tables beside the checkpoint. clock: microseconds by which a flush is over though no later event has come.
    """
    pending = Pending(events.sparkSession, f"{checkpoint.rstrip('/')}-pending", quiet)

    def batch(df: DataFrame, batch_id: int) -> None:
        tasks = pending.add(df, batch_id, delay, clock() if clock else None)
        apply(coalesced(tasks.select("path", F.col("event").alias("task"))), batch_id)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class Watcher:
    """A source of change events: listings of the folders of an index, compared one after another.

    The events of each poll are written as a file of a folder, which a stream can read with the schema EVENTS. Where whole folders have gone,
    single deletions may have been missed, so the index is asked for a full comparison instead.
    """

    def __init__(self, index, folder: str):
        self.index, self.spark, self.folder = index, index.spark, folder.rstrip("/")
        self.files, self.seen = HadoopFiles(self.spark, self.folder), None

    def _listing(self) -> DataFrame:
        from loomdex.sources.crawl import listed

        roots = [r["path"] for r in self.index.folders() if r["enabled"]]
        path = f"{self.folder}-listings/{uuid.uuid4().hex}"
        d = listed(self.spark, roots, self.index.crawl_config()).select("path", "size", "modified_time") if roots else self.spark.createDataFrame([], "path string, size long, modified_time long")
        d.write.parquet(path)
        return self.spark.read.schema(d.schema).parquet(path)

    def poll(self, on_bulk_change: Callable[[], object] | None = None) -> int:
        """Write the changes since the last poll and return their number; the first poll only looks. Nothing happens while the index isn't watched."""
        from loomdex.functions.values import dirname
        from loomdex.operators.corpus import sync_tasks

        if not self.index.watches():
            return 0
        last, now = self.seen, self._listing()
        self.seen = now
        if last is None:
            return 0
        gone = last.select(dirname(F.col("path")).alias("d")).distinct().join(now.select(dirname(F.col("path")).alias("d")).distinct(), "d", "left_anti")
        if not gone.isEmpty():
            (on_bulk_change or (lambda: self.index.start_indexing("bulk")))()
            return 0
        events = sync_tasks(now, last).select(F.timestamp_millis(F.lit(self.index.clock())).alias("ts"), "path", F.col("task").alias("event"))
        n = events.count()
        if n:
            events.write.mode("append").parquet(self.folder)
        return n


#: Triggers by mode of indexing: how often the stream of changes is read.
TRIGGERS = {"hourly": {"processingTime": "1 hour"}, "daily": {"processingTime": "24 hours"}, "immediate": {"processingTime": "2 seconds"}, "manual": {"availableNow": True}}


def watch(index, folder: str, checkpoint: str, quiet: str = QUIET, trigger: dict | None = None, clock: Callable[[], int] | None = None) -> StreamingQuery:
    """Apply the events that a Watcher writes to the index, as often as its mode says."""
    mode = index.mode()
    every = trigger or TRIGGERS[index.settings()["scheduleInterval"] if mode == "scheduled" else "immediate" if mode == "immediate" else "manual"]
    events = index.spark.readStream.schema(EVENTS).parquet(folder)
    return apply_changes(events, lambda tasks, _: None if tasks.isEmpty() else index.apply_tasks(tasks), checkpoint, quiet, every, clock=clock)

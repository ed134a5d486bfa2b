"""An index on disk: tables in generations, and everything that is done with it from outside.

A change writes under a new generation and then one manifest that names for each table the generations that are valid. The manifest appears
whole or not at all, so a failed change leaves the index as it was, and readers keep what they opened. The large tables (files, texts, postings,
terms, runs) take what is new as another segment; files that went away are named in the table `dead`, and their terms are counted down. What a
change writes is therefore as large as the change. compact() makes one segment of many again.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.analysis import detect_language
from loomdex.log import Logs
from loomdex.operators import corpus
from loomdex.operators.postings import AnalyzerConfig, build_postings, by_term, document_frequency, document_length, encoded
from loomdex.operators.signed_counts import HadoopFiles
from loomdex.plans.search import Search, SearchIndex, suggestions
from loomdex.schemas import REQUIRED, SCHEMAS, conform, struct
from loomdex.sources.crawl import CrawlConfig, contents, ignored_count, listed
from loomdex.sources.extractors import EXTRACTORS, extracted

#: Defaults of the settings (fixed values).
SETTINGS = {
    "removeStopWords": "false", "enableStemming": "false", "enableLanguageDetection": "true", "indexMetadata": "true", "maxFileSizeBytes": "0", "enabledExtractors": json.dumps(list(EXTRACTORS)),
    "indexingMode": "immediate", "scheduleInterval": "daily", "autoRecovery": "true", "enableIntegrityCheckOnStartup": "true", "automaticMaintenance": "false", "migrationBehavior": "auto",
    "recoveryBehavior": "auto", "transactionLogging": "false", "enableIndexLogging": "true", "enableWatcherLogging": "true", "enableErrorLogging": "true", "enableDebugLogging": "false",
}
#: Settings that make indexed texts stale.
REBUILDING = {"removeStopWords", "enableLanguageDetection", "indexMetadata", "enabledExtractors"}
#: Settings that turn logs on and off, by category.
LOG_SETTINGS = {"enableIndexLogging": "index", "enableWatcherLogging": "watcher", "enableErrorLogging": "error", "enableDebugLogging": "debug"}
LOCK_MS, SCHEMA_VERSION = 300_000, 2
#: Modes of indexing and times between scheduled runs (fixed values).
MODES, INTERVALS_MS = ("immediate", "startup", "scheduled", "manual"), {"hourly": 3600_000, "daily": 24 * 3600_000}
#: A table of more segments is compacted at the end of a run; so many dead files are named to a scan.
MAX_SEGMENTS, NAMED_FILES = 16, 1000

#: Tables beside those of the schemas: texts for snippets, postings by term, and ids of files that went away.
_MORE = {"dead": "file_id long", "texts": "file_id long, text string", "index_postings": "term string, file_id long, term_frequency int, positions array<int>", "index_terms": "term string, document_frequency long"}


#: Tables of which the rows of dead files are left out.
_BY_FILE = ("files", "texts", "index_postings")


class Locked(RuntimeError):
    pass


class Stopped(RuntimeError):
    pass


class Index:
    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], int] = lambda: int(time.time() * 1000), logs: Logs | None = None):
        self.spark, self.path, self.clock, self.logs = spark, path.rstrip("/"), clock, logs
        self.files = HadoopFiles(spark, self.path)
        self.owner = uuid.uuid4().hex
        self.recovery: dict | None = None

    def _log(self, level: str, category: str, message: str) -> None:
        if self.logs:
            getattr(self.logs, level)(category, "Index", message)

    # tables

    def manifest(self) -> dict:
        names = [n for n in self.files.names(f"{self.path}/_manifest") if n.endswith(".json")]
        return json.loads(self.files.read(f"{self.path}/_manifest/{names[-1]}")) if names else {"generation": 0, "schema_version": SCHEMA_VERSION, "tables": {}}

    def _schema(self, name: str):
        return SCHEMAS[name] if name in SCHEMAS else struct(_MORE[name])

    def segments(self, name: str) -> list[int]:
        g = self.manifest()["tables"].get(name, [])
        return [g] if isinstance(g, int) else g

    def _raw(self, name: str) -> DataFrame:
        parts = self.segments(name)
        if not parts:
            return self.spark.createDataFrame([], self._schema(name))
        return self.spark.read.schema(self._schema(name)).parquet(*[f"{self.path}/gen={g:08d}/{name}" for g in parts])

    def table(self, name: str) -> DataFrame:
        """The valid rows. Filters on it reach the scan."""
        d = self._raw(name)
        if name in _BY_FILE and self.segments("dead"):
            return d.join(self._raw("dead").distinct(), "file_id", "left_anti")
        if len(self.segments(name)) > 1:
            if name == "index_terms":
                return d.groupBy("term").agg(F.sum("document_frequency").alias("document_frequency")).filter("document_frequency > 0")
            if name == "runs":  # a run is written when it begins and when it ends
                row = F.struct(*d.columns)
                return d.groupBy(F.col("id").alias("_id")).agg(F.max_by(row, F.col("status") != "in_progress").alias("r")).select("r.*")
        return d

    def commit(self, tables: dict[str, DataFrame], append: dict[str, DataFrame] | None = None, **entries) -> int:
        """Write tables as a whole and segments of others, and make them valid at once. A second writer of the same generation fails."""
        m = self.manifest()
        g = m["generation"] + 1
        append = append or {}
        for name, df in [*tables.items(), *append.items()]:
            df.write.mode("overwrite").parquet(f"{self.path}/gen={g:08d}/{name}")
        m |= {"generation": g, "tables": m["tables"] | {n: [g] for n in tables} | {n: [*self.segments(n), g] for n in append}} | entries
        target = f"{self.path}/_manifest/{g:08d}.json"
        if self.files.exists(target):
            raise Locked(f"generation {g} was written by another writer")
        self.files.write(target, json.dumps(m))
        return g

    @contextlib.contextmanager
    def transaction(self) -> Iterator[dict[str, DataFrame]]:
        """Tables put into the dictionary become valid together when the block ends, and not at all if it fails."""
        staged: dict[str, DataFrame] = {}
        yield staged
        if staged:
            self.commit(staged)

    def _rows(self, name: str, rows: list[dict]) -> DataFrame:
        s = self._schema(name)
        return self.spark.createDataFrame([tuple(r.get(f) for f in s.names) for r in rows], s)

    def _small(self, name: str) -> list[dict]:
        """Rows of a table that people fill by hand."""
        return [r.asDict(recursive=True) for r in self.table(name).collect()]

    # settings, folders, rules: tables of a few rows

    def settings(self) -> dict[str, str]:
        return SETTINGS | {r["key"]: r["value"] for r in self._small("settings")}

    def flag(self, key: str) -> bool:
        return self.settings().get(key, "").lower() in ("1", "true")

    def set_setting(self, key: str, value: str) -> bool:
        """Returns whether the index has to be built again; unchanged files are then not skipped."""
        now = {r["key"]: r["value"] for r in self._small("settings")} | {key: value}
        self.commit({"settings": self._rows("settings", [{"key": k, "value": v} for k, v in now.items()])})
        if key in LOG_SETTINGS and self.logs:
            s = self.settings()
            self.logs.set_enabled(tuple(c for k, c in LOG_SETTINGS.items() if s[k].lower() in ("1", "true")))
        return key in REBUILDING

    def add_folder(self, path: str) -> dict:
        """Add a folder, which must exist, or return it if it is there already."""
        if not self.files.exists(path):
            raise FileNotFoundError(f"Folder does not exist: {path}")
        if not self.files.is_folder(path):
            raise NotADirectoryError(f"Path is not a directory: {path}")
        rows = self._small("folders")
        for r in rows:
            if r["path"] == path:
                return r
        new = {"id": max([r["id"] for r in rows], default=0) + 1, "path": path, "enabled": True}
        self.commit({"folders": self._rows("folders", [*rows, new])})
        return new

    def remove_folder(self, folder_id: int) -> None:
        rows = self._small("folders")
        gone = [r["path"] for r in rows if r["id"] == folder_id]
        staged = {"folders": self._rows("folders", [r for r in rows if r["id"] != folder_id])}
        self.commit(staged, self._removal(self.table("files").filter(corpus.under_folder(F.col("path"), gone[0]))) if gone else None)

    def set_folder_enabled(self, folder_id: int, enabled: bool) -> None:
        self.commit({"folders": self._rows("folders", [r | {"enabled": enabled} if r["id"] == folder_id else r for r in self._small("folders")])})

    def folders(self) -> list[dict]:
        return sorted(self._small("folders"), key=lambda r: r["id"])

    def ignore_rules(self) -> list[dict]:
        """Newest first; a new index has the default rules."""
        rows = self._small("ignore_rules")
        if not rows and "ignore_rules" not in self.manifest()["tables"]:
            rows = [{"id": i + 1, "pattern": p, "type": t, "enabled": True, "created_at": self.clock()} for i, (p, t) in enumerate(corpus.DEFAULT_RULES)]
            self.commit({"ignore_rules": self._rows("ignore_rules", rows)})
        return sorted(rows, key=lambda r: -r["id"])

    def add_ignore_rule(self, pattern: str, kind: str = "glob") -> dict:
        rows = self.ignore_rules()
        new = {"id": max([r["id"] for r in rows], default=0) + 1, "pattern": pattern, "type": kind, "enabled": True, "created_at": self.clock()}
        self.commit({"ignore_rules": self._rows("ignore_rules", [*rows, new])})
        return new

    def set_ignore_rule_enabled(self, rule_id: int, enabled: bool) -> None:
        self.commit({"ignore_rules": self._rows("ignore_rules", [r | {"enabled": enabled} if r["id"] == rule_id else r for r in self.ignore_rules()])})

    def delete_ignore_rule(self, rule_id: int) -> None:
        self.commit({"ignore_rules": self._rows("ignore_rules", [r for r in self.ignore_rules() if r["id"] != rule_id])})

    # lock: one file, created by one writer only

    def lock(self) -> dict | None:
        p = f"{self.path}/_lock.json"
        return json.loads(self.files.read(p)) if self.files.exists(p) else None

    def acquire(self, owner: str | None = None, ttl_ms: int = LOCK_MS, context: dict | None = None) -> bool:
        self.recover_stale_lock()
        now = self.clock()
        try:
            self.files.write(f"{self.path}/_lock.json", json.dumps({"owner": owner or self.owner, "acquired_at": now, "expires_at": now + ttl_ms, "context": context}))
        except Exception:  # noqa: BLE001 - it exists
            return False
        return True

    def release(self, owner: str | None = None) -> bool:
        held = self.lock()
        if held is None:
            return True
        if held["owner"] != (owner or self.owner):
            return False
        self.force_release()
        return True

    def renew(self, owner: str | None = None, ttl_ms: int = LOCK_MS) -> bool:
        held = self.lock()
        if held is None or held["owner"] != (owner or self.owner):
            return False
        # written over, so that no other can take it in between
        self.files.replace(f"{self.path}/_lock.json", json.dumps(held | {"expires_at": self.clock() + ttl_ms}))
        return (self.lock() or {}).get("owner") == held["owner"]

    def is_locked(self) -> bool:
        held = self.lock()
        return held is not None and held["expires_at"] > self.clock()

    def recover_stale_lock(self) -> bool:
        held = self.lock()
        if held is not None and held["expires_at"] <= self.clock():
            self.force_release()
            return True
        return False

    def force_release(self) -> None:
        self.files.delete(f"{self.path}/_lock.json")

    # indexing

    def analyzer(self) -> AnalyzerConfig:
        s = self.settings()
        on = [s.get(k, "").lower() in ("1", "true") for k in ("removeStopWords", "enableLanguageDetection", "enableStemming", "indexMetadata")]
        return AnalyzerConfig(*on)

    def crawl_config(self) -> CrawlConfig:
        s = self.settings()
        rules = tuple((r["pattern"], r["type"]) for r in self.ignore_rules() if r["enabled"])
        size = s["maxFileSizeBytes"]
        return CrawlConfig(rules, tuple(e for e in json.loads(s["enabledExtractors"]) if e in EXTRACTORS), int(size) if size.isdigit() else 0)

    def _removal(self, gone: DataFrame) -> dict[str, DataFrame]:
        """Segments that take away the files of the paths: their ids, and their terms counted down."""
        ids = self.table("files").join(gone.select("path").distinct(), "path", "left_semi").select("file_id")
        few = [r[0] for r in ids.limit(NAMED_FILES + 1).collect()]
        if not few:
            return {}
        postings = self.table("index_postings").select("term", "file_id")
        lost = postings.filter(F.col("file_id").isin(few)) if len(few) <= NAMED_FILES else postings.join(ids, "file_id", "left_semi")
        return {"dead": ids, "index_terms": document_frequency(lost).withColumn("document_frequency", -F.col("document_frequency"))}

    def _staged(self, df: DataFrame, stage: str, name: str) -> DataFrame:
        df.write.parquet(f"{stage}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{stage}/{name}")

    def _stop_if_asked(self) -> None:
        if self.files.exists(f"{self.path}/_stop"):
            raise Stopped("Indexing was stopped")

    def stop_indexing(self) -> None:
        """Ask a running start_indexing, of whatever process, to end before its next step; what it has not committed is lost."""
        self.files.replace(f"{self.path}/_stop", "")

    def apply_tasks(self, tasks: DataFrame) -> int:
        """Index and delete paths (path, task) as one generation. Returns how many files were indexed.

        Only the bytes of the paths to index are read, and what is written is as large as the change. An index that gets nothing new from
        the tasks stays as it is.
        """
        now, config, crawl, stage = self.clock(), self.analyzer(), self.crawl_config(), f"{self.path}/_stage/{uuid.uuid4().hex}"
        roots = [r["path"] for r in self.folders() if r["enabled"]]
        try:
            tasks = self._staged(tasks.select("path", "task").distinct(), stage, "tasks")
            total = tasks.count()
            self._progress(0, total, 0)
            wanted = tasks.filter("task = 'index'").select("path").distinct()
            new = contents(self.spark, roots, wanted, crawl) if roots else None
            append = self._removal(tasks)
            if new is None:
                if append:
                    self.commit({}, append)
                self._progress(total, total, 0)
                return 0
            self._stop_if_asked()
            got = extracted(new, ("size", "modified_time", "extension"), hashed=True)
            # written once: extraction is not repeated for each table that is made of it. The generation makes the ids of a path differ
            got = self._staged(got.withColumn("file_id", F.xxhash64("path", F.lit(self.manifest()["generation"]))), stage, "files")
            good = got.filter("error is null")
            postings = self._staged(build_postings(good.select("file_id", "text"), config, unique_ids=True).select("term", "file_id", "term_frequency", "positions"), stage, "postings")
            self._stop_if_asked()
            meta = config.index_metadata
            language = detect_language(F.col("text")) if config.detect_language else F.lit(None)
            rows = good.join(document_length(good, postings), "file_id").select(
                "file_id", "path", "size", "modified_time", "doc_length", F.lit(now).alias("indexed_at"), language.alias("language"),
                "content_hash", *[(F.col(c) if meta else F.lit(None)).alias(c) for c in ("author", "created_at")], "extension",
            )
            terms = document_frequency(postings)
            append |= {
                "files": conform(rows, "files"), "index_postings": by_term(postings), "texts": good.select("file_id", "text").repartitionByRange("file_id").sortWithinPartitions("file_id"),
                "index_terms": append["index_terms"].unionByName(terms) if append else terms,
            }
            self.commit(self._failures_after(got, wanted, now), append, analyzer=config.key())
            n, bad = good.count(), got.filter("error is not null").count()
            self._progress(total, total, n)
            self._log("info", "index", f"{n} files indexed, {bad} failed")
            return n
        finally:
            self.files.delete(stage)

    def _failures_after(self, got: DataFrame, wanted: DataFrame, now: int) -> dict[str, DataFrame]:
        """The table of failures, if the files read change it: what was read again without error has none any more."""
        bad, held = got.filter("error is not null").select("path", F.col("error").alias("message"), F.lit(now).alias("ts")), self.table("failures")
        if bad.isEmpty() and held.join(wanted, "path", "left_semi").isEmpty():
            return {}
        failed = corpus.failure_rows(bad).drop("retry_count").join(held.select("path", "retry_count", "ignored"), "path", "left")
        failed = failed.select(F.xxhash64("path").alias("id"), "path", "category", "message", "occurred_at", F.coalesce(F.col("retry_count") + 1, F.lit(0)).cast("int").alias("retry_count"), F.coalesce("ignored", F.lit(False)).alias("ignored"))
        return {"failures": held.join(wanted, "path", "left_anti").unionByName(failed)}

    def _counted(self) -> dict[str, int]:
        return {"total_indexed_files": self.table("files").count(), "total_indexed_terms": self.table("index_terms").count()}

    def start_indexing(self, trigger: str = "manual") -> dict:
        """Compare the enabled folders with the index and apply what differs. Without differences the run ends as well.

        The run is logged when it begins and when it ends, and the counters of the metadata are set: its time, the mean time of the last runs, the
        number of runs, files and terms.
        """
        if not self.acquire(context={"trigger": trigger}):
            raise Locked("another indexing run holds the lock")
        began, m = self.clock(), self.manifest()
        self.files.delete(f"{self.path}/_stop")
        run = {"id": m.get("last_run_id", 0) + 1, "started_at": began, "files_indexed": 0, "status": "in_progress"}
        try:
            self.commit({}, {"runs": self._rows("runs", [run])}, status="indexing", last_run_id=run["id"])
            self._log("info", "index", f"run {run['id']} started ({trigger})")
            roots = [r["path"] for r in self.folders() if r["enabled"]]
            crawl = self.crawl_config()
            known = self.table("files").select("path", "size", "modified_time")
            if m.get("analyzer") not in (None, self.analyzer().key()):
                known = known.withColumn("size", F.lit(-1).cast("long"))  # other settings: nothing is unchanged
            disk = listed(self.spark, roots, crawl).select("path", "size", "modified_time") if roots else known.limit(0)
            n = self.apply_tasks(corpus.sync_tasks(disk, known))
            end = self.clock()
            run |= {"completed_at": end, "duration_ms": end - began, "files_indexed": n, "status": "completed"}
            last = [r[0] for r in self.table("runs").filter("status = 'completed' and duration_ms is not null").orderBy(F.desc("completed_at")).limit(corpus.RUNS_AVERAGED).select("duration_ms").collect()]
            mean = (sum(last) + run["duration_ms"]) / (len(last) + 1)
            self.commit(
                {}, {"runs": self._rows("runs", [run])}, status="indexed", error_message=None, ignored_files_count=ignored_count(self.spark, roots, crawl) if roots else 0, last_indexed_at=end, last_synced_at=end,
                last_index_duration_ms=run["duration_ms"], average_index_duration_ms=int(mean + 0.5), total_indexing_runs=m.get("total_indexing_runs", 0) + 1, **self._counted(),
            )
            self._log("info", "index", f"run {run['id']} completed: {n} files in {run['duration_ms']} ms")
            if max(len(self.segments(t)) for t in (*_BY_FILE, "index_terms", "runs")) > MAX_SEGMENTS:
                self.compact()
            return run
        except Exception as e:
            run |= {"completed_at": self.clock(), "duration_ms": self.clock() - began, "status": "failed", "error_message": str(e)[:500]}
            self.commit({}, {"runs": self._rows("runs", [run])}, status="indexed" if isinstance(e, Stopped) else "error", error_message=str(e)[:500])
            self._log("error", "error", f"run {run['id']} failed: {str(e)[:300]}")
            raise
        finally:
            self.files.delete(f"{self.path}/_stop")
            self.release()

    def _progress(self, processed: int, total: int, indexed: int) -> None:
        self.files.replace(f"{self.path}/_progress.json", json.dumps({"processed": processed, "total": total, "indexed_files": indexed, "percent": round(100 * processed / total) if total else 0}))

    def progress(self) -> dict | None:
        """Of the tasks that are or were last applied: processed, total, indexed_files, percent. Tasks of one change become valid together."""
        p = f"{self.path}/_progress.json"
        return json.loads(self.files.read(p)) if self.files.exists(p) else None

    def retry_failure(self, path: str) -> int:
        """Index one file that failed again; returns 1 if it worked now."""
        return self.apply_tasks(self.spark.createDataFrame([(path, "index")], "path string, task string"))

    def reconcile(self) -> dict[str, int]:
        """Set the counters of the metadata by the tables."""
        counted = self._counted()
        self.commit({}, **counted)
        return counted

    def compact(self) -> None:
        """One segment a table: dead rows go, terms are added up, postings lie in order of terms and texts of files."""
        t = self.table
        self.commit(
            {
                "files": t("files"), "texts": t("texts").repartitionByRange("file_id").sortWithinPartitions("file_id"), "index_postings": by_term(t("index_postings")),
                "index_terms": t("index_terms").repartitionByRange("term").sortWithinPartitions("term"), "runs": t("runs"), "dead": self.spark.createDataFrame([], self._schema("dead")),
            }
        )

    # schedule

    def mode(self) -> str:
        m = self.settings()["indexingMode"]
        return m if m in MODES else "immediate"

    def watches(self) -> bool:
        return self.mode() == "immediate"

    def syncs_at_start(self) -> bool:
        return self.mode() in ("immediate", "startup")

    def sync_due(self) -> bool:
        """Whether a scheduled run is due: the mode is 'scheduled', and the last one is an interval or more ago."""
        every = INTERVALS_MS.get(self.settings()["scheduleInterval"], INTERVALS_MS["daily"])
        return self.mode() == "scheduled" and self.clock() - (self.manifest().get("last_scheduled_at") or 0) >= every

    def run_schedule(self) -> dict | None:
        """To be called from time to time: runs what is due, else nothing."""
        if not self.sync_due():
            return None
        self.commit({}, last_scheduled_at=self.clock())
        return self.start_indexing("scheduled")

    def start(self) -> dict:
        """What is done when the index is opened, in order: a stale lock is freed, older tables are brought to this version, an interrupted run is
        recovered, the index is verified, and files are synchronised, each if its setting says so. Returns what was found."""
        flag, out = self.flag, {"lock_recovered": self.recover_stale_lock(), "migrated": self.migrate() if self.settings()["migrationBehavior"] == "auto" else []}
        self.recovery = self.recover() if flag("autoRecovery") else None
        issues = {r["type"]: r["n"] for r in self.verify().collect()} if flag("enableIntegrityCheckOnStartup") else {}
        return out | {"recovery": self.recovery, "issues": issues, "run": self.start_indexing("startup") if self.syncs_at_start() and self.folders() else None}

    def delete_index(self) -> None:
        """Files, postings, terms and texts go; runs, failures, folders, rules and settings stay."""
        empty = {n: self.spark.createDataFrame([], self._schema(n)) for n in ("files", "index_postings", "index_terms", "texts", "dead")}
        self.commit(empty, status="never_indexed", last_indexed_at=None, last_synced_at=None, ignored_files_count=0, total_indexed_files=0, total_indexed_terms=0)

    # queries

    def search_index(self) -> SearchIndex:
        return SearchIndex(self.table("files"), self.table("index_terms"), self.table("index_postings"), self.table("texts"))

    def search(self, query: str, folder_ids: list[int] = (), **options) -> Search:
        scope = [r["path"] for r in self.folders() if r["id"] in folder_ids]
        return Search(self.search_index(), query, scope=scope, stemming=self.flag("enableStemming"), now_ms=self.clock(), **options)

    def suggest(self, prefix: str, limit: int = 10) -> list[str]:
        return [r.suggestion for r in suggestions(self.table("index_terms"), prefix, limit).orderBy("rank").collect()]

    def duplicates(self) -> DataFrame:
        return corpus.duplicate_groups(self.table("files"))

    def failures(self, include_ignored: bool = False) -> DataFrame:
        f = self.table("failures")
        return (f if include_ignored else f.filter("not ignored")).orderBy(F.desc("occurred_at"))

    def ignore_failure(self, path: str, value: bool = True) -> None:
        f = self.table("failures")
        self.commit({"failures": f.withColumn("ignored", F.when(F.col("path") == path, F.lit(value)).otherwise(F.col("ignored")))})

    def delete_failures(self, path: str | None = None) -> None:
        """The failure of one path, or all."""
        f = self.table("failures")
        self.commit({"failures": f.limit(0) if path is None else f.filter(~F.col("path").eqNullSafe(F.lit(path)))})

    def recent_runs(self, limit: int = 20) -> DataFrame:
        return self.table("runs").orderBy(F.desc("started_at")).limit(limit)

    def file(self, path: str) -> dict | None:
        """The file of a path; the filter reaches the scan."""
        found = self.table("files").filter(F.col("path") == path).limit(1).collect()
        return found[0].asDict() if found else None

    def files_by(self, **values: str | None) -> DataFrame:
        """Files whose language, author and extension equal the values given; a value of None fits none. Without values all files."""
        return corpus.by_metadata(self.table("files"), **values)

    def update_file(self, path: str, **values) -> bool:
        """Set columns of a file's row; its postings stay. Rewrites the table of files, which holds no texts. False if there is no such file."""
        names = [f for f in SCHEMAS["files"].names if f not in ("file_id", "path")]
        if not set(values) <= set(names):
            raise ValueError(sorted(set(values) - set(names)))
        if self.file(path) is None:
            return False
        d = self.table("files")
        self.commit({"files": d.withColumns({k: F.when(F.col("path") == path, F.lit(v).cast(d.schema[k].dataType)).otherwise(F.col(k)) for k, v in values.items()})})
        return True

    def metadata(self) -> dict:
        """The row of the table `metadata`."""
        m = self.manifest()
        return {n: m.get(n) for n in SCHEMAS["metadata"].names} | {"status": m.get("status", "never_indexed"), "index_version": m["generation"]}

    def statistics(self, pending: int = 0) -> dict:
        m = self.manifest()
        keys = ("last_indexed_at", "last_synced_at", "last_index_duration_ms", "average_index_duration_ms")
        return {
            "files": self.table("files").count(), "terms": self.table("index_terms").count(), "failures": self.failures().count(), "folders": len(self.folders()), "pending": pending, "status": m.get("status", "never_indexed"),
            "ignored_files": m.get("ignored_files_count", 0), "size_bytes": self.files.size(self.path), "total_indexing_runs": m.get("total_indexing_runs", 0), **{k: m.get(k) for k in keys},
        }

    def health(self, pending: int = 0) -> str:
        return self.health_statistics(pending)["health"]

    def health_statistics(self, pending: int = 0) -> dict:
        """statistics() with health: 'error', 'warning' or 'healthy'."""
        s = self.statistics(pending)
        one = self.spark.range(1).select(corpus.health(F.lit(s["files"]), F.lit(s["failures"]), F.lit(pending), F.lit(s["status"]), F.lit(s["last_synced_at"]).cast("long"), self.clock()).alias("h"))
        return s | {"health": one.first()[0]}

    # upkeep

    def verify(self) -> DataFrame:
        p = self.table("index_postings").withColumnRenamed("term", "term_id")
        return corpus.integrity_report(self.table("files"), self.table("index_terms").withColumnRenamed("term", "term_id"), p)

    def repair(self) -> None:
        p = self.table("index_postings").withColumnRenamed("term", "term_id")
        _, p = corpus.repaired(self.table("files"), self.table("index_terms").withColumnRenamed("term", "term_id"), p)
        p = p.withColumnRenamed("term_id", "term").select("term", "file_id", "term_frequency", "positions")
        self.commit({"index_postings": p, "index_terms": document_frequency(p)})

    def recover(self) -> dict:
        """After a crash: open runs are failed, files without postings are recorded as failures, the status is set right."""
        runs = self.table("runs")
        n = runs.filter("status = 'in_progress'").count()
        partial = corpus.partial_files(self.table("files").filter("size > 0"), self.table("index_postings"))
        k = partial.count()
        if n or k or self.manifest().get("status") == "indexing":
            bad = corpus.failure_rows(partial.select("path", F.lit("Indexing was interrupted").alias("message"), F.lit(self.clock()).alias("ts")))
            bad = bad.select(F.xxhash64("path").alias("id"), "path", "category", "message", "occurred_at", "retry_count", F.lit(False).alias("ignored"))
            old = self.table("failures").join(bad.select("path"), "path", "left_anti").select(*SCHEMAS["failures"].names)
            self.commit({"runs": corpus.interrupted(runs, self.clock()), "failures": old.unionByName(bad)}, status="indexed")
            self._log("info", "index", f"recovered: {n} runs marked failed, {k} files without postings")
        return {"interrupted_runs": n, "partial_files": k, "recovered": bool(n or k)}

    def check_storage(self) -> dict[str, str]:
        """Tables that cannot be read whole, with the reason; every file of every table is opened."""
        bad = {}
        for name in self.manifest()["tables"]:
            try:
                self.table(name).write.format("noop").mode("overwrite").save()
            except Exception as e:  # noqa: BLE001 - reported
                bad[name] = str(e)[:300]
        return bad

    def maintain(self, analyze: bool = True, vacuum: bool = False) -> list[dict]:
        """Ordered operations with their times: integrity_check, optimize, analyze, vacuum. all(x["success"]) tells whether all worked."""
        out = []

        def step(name: str, run: Callable[[], object]) -> None:
            began = time.time()
            try:
                run()
                out.append({"operation": name, "success": True, "duration_ms": int((time.time() - began) * 1000)})
            except Exception as e:  # noqa: BLE001 - reported
                out.append({"operation": name, "success": False, "duration_ms": int((time.time() - began) * 1000), "error": str(e)[:300]})

        def sound() -> None:
            if bad := self.check_storage():
                raise RuntimeError(json.dumps(bad))

        step("integrity_check", sound)
        step("optimize", self.compact)
        if analyze:
            step("analyze", lambda: self.commit({}, statistics={t: self.table(t).count() for t in self.manifest()["tables"]}))
        if vacuum:
            step("vacuum", self.vacuum)
        return out

    def vacuum(self) -> int:
        m = self.manifest()
        used = {f"gen={g:08d}" for t in m["tables"] for g in self.segments(t)}
        gone = [n for n in self.files.names(self.path) if n.startswith("gen=") and n not in used]
        for n in gone:
            self.files.delete(f"{self.path}/{n}")
        return len(gone)

    def migrate(self) -> list[int]:
        """Bring an older manifest to this version, one version at a time; what is done is not done again."""
        m, done = self.manifest(), []
        for v in range(m.get("schema_version", 1) + 1, SCHEMA_VERSION + 1):
            files = conform(self.table("files"), "files")
            row = {"version": v, "name": f"columns of version {v}", "applied_at": self.clock()}
            self.commit({"files": files, "migrations": self._rows("migrations", [*self._small("migrations"), row])}, schema_version=v)
            done.append(v)
        return done

    def export_backup(self, target: str) -> None:
        """All tables and the settings in one folder; terms and postings by id, too, and the metadata."""
        terms, postings = encoded(self.table("index_postings"))
        made = {"terms": terms, "postings": postings, "metadata": self._rows("metadata", [self.metadata()])}
        for name in [*SCHEMAS, *_MORE]:
            (conform(made[name], name) if name in made else self.table(name)).write.mode("overwrite").parquet(f"{target.rstrip('/')}/{name}")
        self.files.delete(f"{target.rstrip('/')}/settings.json")
        self.files.write(f"{target.rstrip('/')}/settings.json", json.dumps(self.settings()))

    def validate_backup(self, source: str) -> tuple[bool, str | None]:
        names = self.files.names(source)
        if not names:
            return False, "Backup not found"
        missing = [t for t in REQUIRED if t not in names]
        if missing:
            return False, f"Missing tables: {', '.join(missing)}"
        try:
            if "settings.json" in names:
                json.loads(self.files.read(f"{source.rstrip('/')}/settings.json"))
            for t in REQUIRED:
                self.spark.read.schema(self._schema(t)).parquet(f"{source.rstrip('/')}/{t}").limit(1).count()
        except Exception as e:  # noqa: BLE001 - whatever is wrong with it
            return False, f"Invalid backup: {str(e)[:200]}"
        return True, None

    def import_backup(self, source: str) -> None:
        ok, why = self.validate_backup(source)
        if not ok:
            raise ValueError(why)
        names = [n for n in self.files.names(source) if n in SCHEMAS or n in _MORE]
        kept = self.spark.read.schema(self._schema("metadata")).parquet(f"{source.rstrip('/')}/metadata").first()
        held = {k: v for k, v in (kept.asDict() if kept else {}).items() if k not in ("index_version", "schema_version")}
        self.commit({n: self.spark.read.schema(self._schema(n)).parquet(f"{source.rstrip('/')}/{n}") for n in names}, **held)

"""Crawling, extraction, the catalog, and change streams."""

import datetime as dt
import io
import os
import random
import re
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from loomdex.catalog import Index, Locked, Stopped
from loomdex.log import Logs
from loomdex.sources.crawl import CrawlConfig, contents, ignored_count, listed
from loomdex.sources.extractors import extract_py, timestamp
from loomdex.streaming import changes
from loomdex.streaming.changes import Pending, Watcher, apply_changes, coalesced, debounced, queue_progress, watch


def docx(text: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {w}><w:body>" + "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in text.split("\n")) + "</w:body></w:document>")
        z.writestr("docProps/core.xml", "<x><dc:creator> Ada </dc:creator><dcterms:created xsi:type='d'>2024-01-01T00:00:00Z</dcterms:created></x>")
    return out.getvalue()


def test_extractors():
    assert extract_py(".txt", b"a\r\nb\0c \n")[0] == "a\nbc"
    page = b"<html><head><title>t</title><meta name='author' content='Bo'><meta name='date' content='2024-01-01'></head><body><nav>n</nav>x &amp; y<script>var a='</p>';</script><p>z</p><footer>f</footer></body></html>"
    assert extract_py(".HTML", page) == ("x & yz", "Bo", 1704067200000, None)
    assert extract_py(".docx", docx("one\ntwo")) == ("one\n\ntwo", "Ada", 1704067200000, None)
    assert "corrupt" in extract_py(".docx", b"no zip")[3] and "Unsupported" in extract_py(".xyz", b"")[3] and extract_py(".txt", None)[0] == ""


def pdf(packed: bool = False) -> bytes:
    page = b"BT /F1 12 Tf 72 700 Td (Hello \\(wide\\) w\\157rld) Tj 0 -14 Td [(Sec) -20 (ond) -250 (line)] TJ T* /F2 12 Tf <00410042> Tj ET"
    table = b"begincmap 1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0041> <0915> endbfchar 1 beginbfrange <0042> <0043> <0916> endbfrange endcmap"
    squeeze = lambda b: (zlib.compress(b), b" /Filter /FlateDecode") if packed else (b, b"")
    out = [b"%PDF-1.4\n1 0 obj\n<< /Type /Page /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Contents 5 0 R >>\nendobj\n3 0 obj\n<< /Type /Font /BaseFont /Helvetica >>\nendobj\n4 0 obj\n<< /Type /Font /ToUnicode 6 0 R >>\nendobj\n"]
    for number, content in ((5, page), (6, table)):
        data, how = squeeze(content)
        out.append(b"%d 0 obj\n<< /Length %d%s >>\nstream\n" % (number, len(data), how) + data + b"\nendstream\nendobj\n")
    out.append(b"7 0 obj\n<< /Author (Ada \\(B.\\)) /CreationDate (D:20240101020000+02'00') >>\nendobj\ntrailer << /Info 7 0 R >>\n%%EOF")
    return b"".join(out)


@pytest.mark.parametrize("packed", [False, True])
def test_pdf(packed):
    assert extract_py(".PDF", pdf(packed)) == ("Hello (wide) world\nSecond line\nकख", "Ada (B.)", 1704067200000, None)
    assert "header" in extract_py(".pdf", b"nothing")[3] and "encrypted" in extract_py(".pdf", pdf().replace(b"/Info 7 0 R", b"/Encrypt 9 0 R"))[3]


def test_dates():
    for t in ("2024-01-01", "2024-01-01T00:00:00Z", "Mon, 01 Jan 2024 00:00:00 GMT", "January 1, 2024", "1 January 2024", "Jan 1st, 2024", "2024/01/01", "01/01/2024", "D:20240101000000Z", "D:20240101", "1 Jan 2024 01:00 +0100"):
        assert timestamp(t) == 1704067200000, t
    assert [timestamp(t) for t in (None, "", "soon", "32 January 2024", "D:20241399")] == [None] * 5


def test_an_extractor_can_be_replaced():
    from loomdex.sources import extractors

    before = dict(extractors._FUNCTIONS), dict(extractors.EXTENSIONS)
    extractors.register("upper", lambda b: (b.decode().upper(), None, None), (".up",))
    assert extract_py(".up", b"x")[0] == "X"
    extractors._FUNCTIONS.pop("upper"), extractors.EXTENSIONS.pop(".up")
    assert before == (extractors._FUNCTIONS, extractors.EXTENSIONS)


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "docs"
    (d / "sub" / "node_modules").mkdir(parents=True)
    (d / "a.txt").write_text("backup schedule of the week")
    (d / "sub" / "b.md").write_text("travel budget and backup")
    (d / "sub" / "node_modules" / "c.txt").write_text("ignored")
    (d / ".hidden.txt").write_text("hidden")
    (d / "x.bin").write_bytes(b"\0")
    (d / "broken.docx").write_bytes(b"broken")
    (d / "big.txt").write_text("x" * 5000)
    return d


def test_crawl(spark, folder):
    names = lambda c: sorted(os.path.basename(r.path) for r in listed(spark, [str(folder)], c).collect())
    assert names(CrawlConfig(rules=(("node_modules/", "folder"),), max_bytes=4000)) == ["a.txt", "b.md", "broken.docx"]
    assert names(CrawlConfig(enabled=("text",), rules=(("b*", "glob"),), skip_hidden=False)) == ["a.txt", "c.txt"]


def test_a_walk_lists_what_the_source_lists(spark, folder, tmp_path):
    from loomdex.sources.crawl import _source

    for name in ("_left/x.txt", ".out/x.txt", "k=1/_m=2/x.txt", "k=1/a b%20é.txt", "deep/er/still/x.txt", "x._COPYING_"):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(name)
    (folder / "link.txt").symlink_to(folder / "a.txt")
    (folder / "nowhere.txt").symlink_to(folder / "none")
    (folder / "far").symlink_to(tmp_path / "far")
    (tmp_path / "far").mkdir()
    (tmp_path / "far" / "y.txt").write_text("y")
    roots = [f"file://{folder}", str(folder / "sub")]
    want = _source(spark).load(roots).select(F.regexp_replace("path", "^file:/+", "/"), "length", F.unix_millis("modificationTime"))
    got = listed(spark, roots, CrawlConfig(enabled=("text", "markdown", "docx"))).select("path", "size", "modified_time")
    want = sorted(tuple(r) for r in want.collect() if not r[0].endswith(".bin"))
    assert len(want) == 10 and sorted(map(tuple, got.collect())) == want


def test_many_files_are_few_tasks(spark, tmp_path, monkeypatch):
    from loomdex.sources import crawl, extractors

    monkeypatch.setattr(crawl, "NAMED_MOUNTED", 20)
    d = tmp_path / "many"
    for i in range(100):
        (d / f"k={i % 5}").mkdir(parents=True, exist_ok=True)
        (d / f"k={i % 5}" / f"{i}.txt").write_text(f"number w{i}")
    names = [str(p) for p in d.rglob("*.txt")]
    (d / "k=0" / "0.txt").unlink()
    (tmp_path / "out.txt").write_text("outside")
    wanted = spark.createDataFrame([(p,) for p in [*names, names[0], str(tmp_path / "out.txt"), None]], "path string")
    new = contents(spark, [str(d)], wanted)
    assert new.rdd.getNumPartitions() <= 4 and listed(spark, [str(d)]).rdd.getNumPartitions() <= 16
    got = {os.path.basename(r.path): r for r in extractors.extracted(new, ("size",), hashed=True).collect()}
    assert len(got) == 99 and all(r.error is None and r.text == f"number w{n[:-4]}" and r.size == len(r.text) and len(r.content_hash) == 64 for n, r in got.items())
    index = Index(spark, f"file://{tmp_path}/index", clock=lambda: 1_735_689_600_000)
    index.add_folder(str(d))
    assert index.start_indexing()["files_indexed"] == 99
    (d / "k=1" / "1.txt").write_text("other")
    for i in range(2, 100, 2):
        (d / f"k={i % 5}" / f"{i}.txt").unlink()
    assert index.start_indexing()["files_indexed"] == 1 and index.table("files").count() == 50 and index.verify().count() == 0


def test_index_lifecycle(spark, folder, tmp_path):
    now = [1_735_689_600_000]
    index = Index(spark, f"file://{tmp_path}/index", clock=lambda: now[0])
    index.add_folder(str(folder))
    assert index.add_folder(str(folder))["id"] == 1
    run = index.start_indexing()
    assert run["status"] == "completed" and run["files_indexed"] == 3
    assert [os.path.basename(r.path) for r in index.search("backup").top().collect()] and index.search("travel").total().first()[0] == 1
    assert [r.category for r in index.failures().collect()] == ["corrupted"] and index.health() in ("warning", "error")
    assert index.suggest("sche") == ["schedule"] and index.statistics()["files"] == 3 and index.verify().count() == 0
    (folder / "a.txt").write_text("nothing of the kind")
    (folder / "sub" / "b.md").unlink()
    assert index.start_indexing()["files_indexed"] >= 1
    assert index.search("travel").total().first()[0] == 0 and index.search("kind").total().first()[0] == 1
    assert index.start_indexing()["status"] == "completed"
    index.export_backup(f"file://{tmp_path}/backup")
    assert index.validate_backup(f"file://{tmp_path}/backup") == (True, None) and not index.validate_backup(f"file://{tmp_path}/none")[0]
    index.delete_index()
    assert index.search("kind").total().first()[0] == 0 and index.statistics()["folders"] == 1
    index.import_backup(f"file://{tmp_path}/backup")
    assert index.search("kind").total().first()[0] == 1
    assert all(x["success"] for x in index.maintain(vacuum=True)) and index.search("kind").total().first()[0] == 1
    assert index.recover()["recovered"] is False and index.migrate() == []
    m = index.metadata()
    assert m["total_indexing_runs"] == 3 and m["total_indexed_files"] == 2 and m["average_index_duration_ms"] == 0 and len(index.segments("files")) == 1
    assert index.table("runs").count() == 3 and [r.status for r in index.recent_runs(1).collect()] == ["completed"]
    assert index.file(str(folder / "a.txt"))["extension"] == ".txt" and index.files_by(extension=".txt").count() == 2 and index.files_by(author=None).count() == 0
    assert index.update_file(str(folder / "a.txt"), author="Ada") and index.files_by(author="Ada").count() == 1 and not index.update_file("/none", author="x")
    assert index.retry_failure(str(folder / "broken.docx")) == 0 and index.failures().first().retry_count >= 1
    index.delete_failures(str(folder / "broken.docx"))
    assert index.failures(True).count() == 0 and index.reconcile()["total_indexed_files"] == 2 and index.health_statistics()["health"] == "healthy"


def test_one_changed_file_costs_one_file(spark, folder, tmp_path, monkeypatch):
    from loomdex import catalog

    index = Index(spark, f"file://{tmp_path}/index", clock=lambda: 1_735_689_600_000)
    index.add_folder(str(folder))
    (folder / "broken.docx").unlink()  # files that failed are tried at each run
    index.start_indexing()
    before = index.table("index_terms").collect()
    read = []

    def spy(*a, **kw):
        d = contents(*a, **kw)
        read.extend(d.inputFiles())
        return d

    monkeypatch.setattr(catalog, "contents", spy)
    (folder / "a.txt").write_text("an altogether other schedule")
    run = index.start_indexing()
    assert run["files_indexed"] == 1 and [os.path.basename(p) for p in read] == ["a.txt"]
    g = index.segments("files")[-1]
    new = spark.read.parquet(f"{tmp_path}/index/gen={g:08d}/index_postings")
    assert new.count() == 4 and spark.read.parquet(f"{tmp_path}/index/gen={g:08d}/texts").count() == 1
    plan = index.search("schedule").ranked()._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^\]]*(In|EqualTo)\(term,", plan)
    terms = {r.term: r.document_frequency for r in index.table("index_terms").collect()}
    assert terms["schedule"] == 1 and "week" not in terms and terms["backup"] == {r.term: r.document_frequency for r in before}["backup"] - 1
    rows = {r["term"]: r.document_frequency for r in index.table("index_terms").collect()}
    index.compact()
    assert rows == {r["term"]: r.document_frequency for r in index.table("index_terms").collect()} and index.table("files").count() == 3 and index.verify().count() == 0
    assert re.search(r"PushedFilters: \[[^\]]*(In|EqualTo)\(file_id,", index.search("schedule").with_snippets()._jdf.queryExecution().toString())


def test_stop_schedule_and_start(spark, folder, tmp_path):
    now = [1_735_689_600_000]
    index = Index(spark, f"file://{tmp_path}/index", clock=lambda: now[0], logs=Logs(str(tmp_path / "logs")))
    with pytest.raises(FileNotFoundError):
        index.add_folder(str(folder / "none"))
    with pytest.raises(NotADirectoryError):
        index.add_folder(str(folder / "a.txt"))
    index.add_folder(str(folder))
    index.set_setting("indexingMode", "scheduled")
    index.set_setting("scheduleInterval", "hourly")
    assert not index.watches() and not index.syncs_at_start() and index.sync_due()
    assert index.run_schedule()["status"] == "completed" and index.run_schedule() is None
    assert "run 1 started (scheduled)" in (tmp_path / "logs" / "index.log").read_text()
    index.set_setting("enableIndexLogging", "false")
    assert index.logs.enabled == ("watcher", "error")
    now[0] += 3_600_000
    assert index.sync_due()
    first = index._log
    index._log = lambda level, category, message: (index.stop_indexing() if "started" in message else None, first(level, category, message))
    (folder / "new.txt").write_text("fresh")
    with pytest.raises(Stopped):
        index.start_indexing()
    assert index.recent_runs(1).first().status == "failed" and not index.is_locked() and index.search("fresh").total().first()[0] == 0
    index._log = first
    index.set_setting("indexingMode", "startup")
    index.commit({}, {"runs": index._rows("runs", [{"id": 9, "started_at": now[0], "status": "in_progress"}])}, status="indexing", last_run_id=9)
    got = index.start()
    assert got["recovery"] == {"interrupted_runs": 1, "partial_files": 0, "recovered": True} and got["issues"] == {} and got["run"]["files_indexed"] == 1
    assert index.search("fresh").total().first()[0] == 1


def test_ignored_folders_count_once(spark, folder):
    (folder / "sub" / "node_modules" / "d.txt").write_text("ignored too")
    assert ignored_count(spark, [str(folder)], CrawlConfig(rules=(("node_modules/", "folder"), ("a*", "glob")))) == 2


def test_rules_settings_lock(spark, tmp_path):
    now = [1000]
    index = Index(spark, f"file://{tmp_path}/index", clock=lambda: now[0])
    assert len(index.ignore_rules()) == 6
    r = index.add_ignore_rule("*.bak")
    index.set_ignore_rule_enabled(r["id"], False)
    assert index.ignore_rules()[0] == r | {"enabled": False}
    index.delete_ignore_rule(r["id"])
    assert len(index.ignore_rules()) == 6
    assert index.set_setting("removeStopWords", "true") and not index.set_setting("enableStemming", "1") and index.flag("removeStopWords") and index.flag("enableStemming")
    assert index.acquire("a", 60_000) and not index.acquire("b", 60_000) and not index.release("b") and index.is_locked() and index.renew("a", 60_000)
    assert index.release("a") and index.release("a") and not index.is_locked()
    assert index.acquire("a", -1) and index.acquire("b", 60_000)
    with pytest.raises(Locked):
        index.start_indexing()
    before = index.manifest()["generation"]
    with pytest.raises(RuntimeError), index.transaction() as staged:
        staged["folders"] = index.table("folders")
        raise RuntimeError
    assert index.manifest()["generation"] == before


EVENTS = [(0, "a", "index"), (100, "b", "index"), (250, "a", "delete"), (1000, "a", "index"), (1100, "a", "index"), (5000, "c", "delete")]


@pytest.fixture
def events(spark):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(t0 + dt.timedelta(milliseconds=t), p, e) for t, p, e in EVENTS], "ts timestamp, path string, event string")


def plain_sessions(rows, quiet):
    out, last = [], None
    for t, p, e in sorted(r for r in rows if r[0] is not None):
        if last is None or t - last >= quiet:
            out.append({})
        last = t
        n = out[-1].get(p, (0, 0, 0))[2]
        out[-1][p] = (t, e, n + 1)
    return sorted((max(v[0] for v in s.values()) + quiet, p, e, n) for s in out for p, (_, e, n) in s.items())


@pytest.mark.parametrize("chunk", [2, 10_000])
def test_debounce(spark, events, monkeypatch, chunk):
    monkeypatch.setattr(changes, "CHUNK", chunk)
    got = sorted(map(tuple, debounced(events).collect()))
    assert [(p, e, n) for _, p, e, n in got] == [("a", "delete", 2), ("b", "index", 1), ("a", "index", 2), ("c", "delete", 1)]
    assert debounced(events.limit(0)).count() == 0
    rng = random.Random(chunk)
    rows = [(rng.randrange(0, 20000), rng.choice("abc"), rng.choice(["index", "delete"])) for _ in range(120)]
    df = spark.createDataFrame(rows, "t long, path string, event string").select(F.timestamp_millis("t").alias("ts"), "path", "event").unionByName(spark.createDataFrame([(None, "a", "index")], changes.EVENTS))
    got = sorted((r.x, r.path, r.event, r.n_events) for r in debounced(df).select(F.unix_millis("flush_at").alias("x"), "path", "event", "n_events").collect())
    assert got == plain_sessions(rows, 300)


def test_pending_flushes_equal_the_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = sorted((rng.randrange(0, 9000), rng.choice("abc"), rng.choice(["index", "delete"])) for _ in range(40))
    frame = lambda part: spark.createDataFrame(part, "t long, path string, event string").select(F.timestamp_millis("t").alias("ts"), "path", "event")
    pending, seen = Pending(spark, f"file://{tmp_path}/p"), []
    for i in range(4):
        part = rows[i * 10 : i * 10 + 10]
        first = sorted(map(tuple, pending.add(frame(part), i).collect()))
        assert sorted(map(tuple, pending.add(frame(part), i).collect())) == first  # run again after a failure
        seen += first
    seen += map(tuple, pending.add(frame([(99999, "z", "index")]), 4).collect())
    assert sorted(seen) == sorted((p, e, n) for _, p, e, n in plain_sessions(rows, 300))
    assert [tuple(r) for r in pending.add(frame([(99999, "z", "index")]).limit(0), 5, now=2 * 10**8).collect()] == [("z", "index", 1)]


def test_watcher_feeds_the_index(spark, folder, tmp_path):
    now = [1_735_689_600_000]
    index = Index(spark, f"file://{tmp_path}/index", clock=lambda: now[0])
    index.add_folder(str(folder))
    index.start_indexing()
    w = Watcher(index, f"file://{tmp_path}/events")
    assert w.poll() == 0 and w.poll() == 0
    (folder / "a.txt").write_text("entirely fresh words")
    (folder / "more.txt").write_text("further words")
    assert w.poll() == 2
    q = watch(index, f"file://{tmp_path}/events", f"{tmp_path}/cp", trigger={"availableNow": True}, clock=lambda: (now[0] + 1000) * 1000)
    q.awaitTermination(120)
    assert q.exception() is None and index.search("fresh").total().first()[0] == 1 and index.search("further").total().first()[0] == 1 and index.progress()["percent"] == 100
    (folder / "sub" / "b.md").unlink()  # the last of its folder
    called = []
    assert w.poll(lambda: called.append(1)) == 0 and called == [1]
    index.set_setting("indexingMode", "manual")
    assert w.poll() == 0


def test_queue(spark):
    t = spark.createDataFrame([("a", "delete", True), ("a", "index", False), ("b", "delete", True)], "path string, task string, done boolean")
    assert sorted(map(tuple, coalesced(t).collect())) == [("a", "index"), ("b", "delete")]
    assert tuple(queue_progress(t).first()) == (2, 3, 0, 67)


def test_stream(spark, events, tmp_path):
    for i in range(2):
        part = events if i == 0 else events.withColumn("ts", F.col("ts") + F.expr("interval 1 hour")).limit(1)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = {}
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = apply_changes(source, lambda df, i: seen.update({(i, r.path): r.task for r in df.collect()}), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert {p: t for (_, p), t in sorted(seen.items())} == {"a": "index", "b": "index", "c": "delete"}

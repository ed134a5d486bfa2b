"""Index building, search, and the operations on tables."""

import math
import random

import pytest
import regex
from pyspark.sql import functions as F

from loomdex.functions import values as V
from loomdex.functions.analysis import detect_language, language_profiles
from loomdex.functions.text import normalise, normalise_py, tokens
from loomdex.operators import corpus as C
from loomdex.operators import postings as P
from loomdex.plans import search as S
from loomdex.plans.filters import predicate
from loomdex.plans.query import parse

NOW = 1735689600000
TEXTS = ["Hello world, hello again.", "Run-time: 100% fast!!!", "Café résumé naïve", "नमस्ते दुनिया १२३", "the quick brown fox", "The quick brown fox jumps over the lazy dog.", "", None, "  \n\t ", "ﬁne ½ 한국 ｆｕｌｌ"]


def words(t):
    return [w for w in regex.split(r"[^\p{L}\p{N}\p{M}]+", normalise_py(t or "")) if w]


def test_tokens_equal_plain_python(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "file_id long, text string")
    for r in df.select("text", tokens(normalise(F.col("text"))).alias("t")).collect():
        assert r.t == words(r.text)


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(5)
    vocab = "backup backups schedule report travel plan plans budget the a of restore café".split()
    texts = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 25))) or None) for i in range(60)]
    files = [(i, rng.choice(["/home/u/Documents/", "/tmp/", "C:\\x\\Desktop\\"]) + rng.choice(["backup.txt", "plan.pdf", "report.md"]), i * 100, NOW - i * 86400000 * 2, rng.choice(["eng", "HIN", None]), rng.choice(["Ada", None]), None, None) for i in range(60)]
    t = spark.createDataFrame(texts, "file_id long, text string")
    f = spark.createDataFrame(files, "file_id long, path string, size long, modified_time long, language string, author string, created_at long, extension string")
    p = P.build_postings(t).cache()
    return S.SearchIndex(f.join(P.document_length(f, p), "file_id"), P.document_frequency(p), p, t), dict(texts), {x[0]: x for x in files}


def test_repeated_ids_add_up_and_no_text_is_shuffled(spark):
    rows = [(1, "a b a", "x"), (1, "c a", "x"), (None, "d", "x"), (None, "d e", "x"), (2, None, "x"), (3, " \n", "x"), (4, "z" * 30000 + " z", "x")]
    df = spark.createDataFrame(rows, "file_id long, text string, term string")
    got = {(r.file_id, r.term[:3]): (r.term_frequency, r.positions) for r in P.build_postings(df).collect()}
    assert got == {(1, "a"): (3, [0, 1, 2]), (1, "b"): (1, [1]), (1, "c"): (1, [0]), (None, "d"): (2, [0, 0]), (None, "e"): (1, [1]), (4, "zzz"): (1, [0]), (4, "z"): (1, [1])}
    assert "Exchange" not in P.build_postings(df, unique_ids=True)._jdf.queryExecution().executedPlan().toString() and P.build_postings(df.limit(0)).count() == 0
    stop = P.build_postings(spark.createDataFrame([(1, "the fox and the dog ran")], "file_id long, text string"), P.AnalyzerConfig(remove_stop_words=True))
    assert {r.term: r.positions for r in stop.collect()} == {"fox": [1], "dog": [4], "ran": [5]}


def test_many_terms_are_joined_instead_of_named(index, monkeypatch):
    want = {r.file_id: r.score for r in S.Search(index[0], "plan travel", now_ms=NOW).ranked().collect()}
    monkeypatch.setattr(S, "NAMED_TERMS", 1)
    assert {r.file_id: r.score for r in S.Search(index[0], "plan travel", now_ms=NOW).ranked().collect()} == want


def test_languages_by_profiles(spark):
    s = spark.read.parquet("/root/testdata/sf0.001/lang_samples.parquet")
    p = language_profiles(s)
    assert p.detect("The quick brown fox jumps over the lazy dog.") == "eng" and p.detect("मुझे यह किताब बहुत अच्छी लगी और मैं इसे फिर से पढ़ूँगा।") == "hin" and p.detect("मला हे पुस्तक खूप आवडले आणि मी ते पुन्हा वाचणार आहे.") == "mar"
    assert [p.detect(t) for t in (None, "", " 12 ", "日本語の文章です", "Wir haben gestern das Protokoll geschrieben.")] == [None] * 5
    df = spark.createDataFrame([("The report was archived by the team.",), (None,)], "t string")
    assert [r.x for r in df.select(detect_language(F.col("t"), p).alias("x")).collect()] == ["eng", None] and language_profiles(s.limit(0)).detect("some text") is None


def test_positions(index):
    got = {(r.file_id, r.term): r.positions for r in index[0].postings.collect()}
    want = {}
    for i, t in index[1].items():
        for k, w in enumerate(words(t)):
            want.setdefault((i, w), []).append(k)
    assert got == want


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, last = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(d[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return d[-1]


def brute(index, query_words, phrase):
    """Scores of files with a word of the query, in reference semantics, for words joined with a phrase by OR."""
    idx, texts, files = index
    toks = {i: words(t) for i, t in texts.items()}
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    mean = sum(map(len, toks.values())) / len(toks)
    out = {}
    for i, t in toks.items():
        hits, score = set(), 0.0
        for q in query_words:
            for w in df:
                if (w == q or (len(q) >= 2 and w.startswith(q)) or edits(w, q) <= 1) and w in t:
                    tf = t.count(w)
                    score += math.log(1 + (len(toks) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
                    hits.add(w)
        if not hits:
            continue
        starts = sum(t[k : k + len(phrase)] == phrase for k in range(len(t))) if phrase else 0
        path, age = files[i][1].lower(), NOW - files[i][3]
        name = path.replace("\\", "/").rsplit("/", 1)[-1]
        fn = sum(3 if name == w else 2 if name.startswith(w + ".") else 1 if w in name else 0 for w in hits)
        day = 86400000
        out[i] = 1000 * starts + 80 * fn + score + 10 * any(x in path for x in S.FOLDERS) + 5 * (3 if age < day else 2 if age < 7 * day else 1 if age < 30 * day else 0)
    return out


@pytest.mark.parametrize("text, ws, phrase", [("backup", ["backup"], []), ("plan travel", ["plan", "travel"], []), ('budge OR "travel plan"', ["budge"], ["travel", "plan"]), ("a a", ["a", "a"], [])])
def test_search_equals_brute_force(index, text, ws, phrase):
    want = brute(index, ws, phrase)
    got = S.Search(index[0], text, now_ms=NOW).ranked().collect()
    assert {r.file_id: round(r.score, 6) for r in got} == {k: round(v, 6) for k, v in want.items()}
    top = [r.file_id for r in S.Search(index[0], text, now_ms=NOW).top(10).collect()]
    assert top == sorted(want, key=lambda k: (-want[k], k))[:10]


def test_semantics(index):
    idx = index[0]
    ids = lambda q, **kw: {r.file_id for r in S.Search(idx, q, now_ms=NOW, **kw).ranked().collect()}
    assert ids("backup NOT travel") == set() and ids("backup AND travel") == ids("backup OR travel")
    strict = ids("backup AND travel", semantics="strict")
    assert strict == {i for i, t in index[1].items() if any(w.startswith("backup") for w in words(t)) and "travel" in words(t)}
    assert ids('"travel plan"') == set() and S.Search(idx, '"travel plan"').total().first()[0] == len(ids('"travel plan"', semantics="strict")) > 0
    assert ids("type:pdf") == set() and ids("type:pdf", semantics="strict") == {i for i, f in index[2].items() if f[1].endswith(".pdf")}
    assert ids("") == set() and ids("backup", scope=["/home/u"]) == {i for i in ids("backup") if index[2][i][1].startswith("/home/u")}
    assert '"unknownword backup"' and S.Search(idx, '"unknownword backup"', semantics="strict").total().first()[0] == 0


def test_snippets_orders_and_signals(index):
    s = S.Search(index[0], "travel", now_ms=NOW, weights={"mine": 2.0}, signals={"mine": lambda d: F.lit(1.5)})
    rows = s.with_snippets(5).collect()
    assert len(rows) == 5 and all("travel" in " ".join(r.snippets) for r in rows)
    plain = S.Search(index[0], "travel", now_ms=NOW).ranked().select("file_id", F.col("score").alias("plain"))
    assert {round(r.score - r.plain, 6) for r in s.ranked().join(plain, "file_id").collect()} == {3.0}
    sizes = [r.size for r in s.top(6, "largest").collect()]
    assert sizes == sorted(sizes, reverse=True)


def test_stem_expansion(spark):
    t = spark.createDataFrame([("run", 1), ("runs", 1), ("running", 1), ("ran", 1)], "term string, document_frequency long")
    assert {r.term for r in S.expand(t, ["running"], stemming=True).collect()} == {"running", "runs"}
    assert {r.term for r in S.expand(t, ["running"], stemming=True, strict=True).collect()} == {"running", "runs", "run"}
    assert S.expand(t, []).count() == 0


def test_suggestions(index):
    got = [(r.rank, r.suggestion) for r in S.suggestions(index[0].terms, "a", 3).collect()]
    assert got == [(1, "author:"), (2, "a")]
    assert [r.suggestion for r in S.suggestions(index[0].terms, "", 3).collect()] == []


def test_filters(spark):
    f = spark.createDataFrame(
        [(1, "C:\\test\\doc.pdf", 1048576, NOW + 1000, "eng", "Ada Byron", NOW - 3 * V.DAY, None), (2, None, None, None, None, None, None, None)],
        "file_id long, path string, size long, modified_time long, language string, author string, created_at long, extension string",
    )
    for text, want in {
        "extension:pdf": True, "type:PDF": True, "type:.pdf": True, "ext:.PDF": True, "extension:txt": False, "author:ada": True, "author:nobody": False, "language:ENG": True, "language:hin": False, "modified:today": True, "created:last7days": True,
        "size>500KB": True, "size<500KB": False, "size:1mb": True, "size:zz": True, "modified:soon": True, "before:2020-01-01": False, "after:2020-01-01": True, "folder:TEST": True, "http:x": True,
    }.items():
        got = [r.x for r in f.orderBy("file_id").select(predicate(parse(text).root, NOW).alias("x")).collect()]
        assert got[0] is want and got[1] is not None, text


def test_ignore_rules(spark):
    rules = [*C.DEFAULT_RULES, ("*.bak", "glob")]
    paths = {"C:/project/node_modules/foo/bar.js": True, "/project/.git/HEAD": True, "C:\\project\\debug.log": True, "/tmp/cache.tmp": True, "C:/project/src/index.ts": False, "/docs/readme.md": False, "/data/archive.bak": True, None: False}
    df = spark.createDataFrame([(k,) for k in paths], "p string")
    assert {r.p: r.x for r in df.select("p", C.ignored(F.col("p"), rules).alias("x")).collect()} == paths


def test_sync_and_duplicates(spark):
    disk = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 3, None), ("c", 3, None)], "path string, size long, modified_time long")
    known = spark.createDataFrame([("a", 1, 1), ("b", 2, 9), ("d", 1, 1)], "path string, size long, modified_time long")
    tasks = C.sync_tasks(disk, known)
    assert sorted(map(tuple, tasks.collect())) == [("b", "index"), ("c", "index"), ("d", "delete")]
    assert tuple(C.sync_summary(tasks).first()) == (2, 1) and C.sync_tasks(disk.limit(0), known.limit(0)).count() == 0
    f = spark.createDataFrame([(1, "b", 5, "h"), (2, "a", 7, "h"), (3, "c", 9, "k"), (4, "d", 1, None), (5, "e", 1, ""), (6, "f", 1, "")], "file_id long, path string, size long, content_hash string")
    assert [tuple(r) for r in C.duplicate_groups(f).collect()] == [("h", 2, 12, 5)]
    assert sorted(r.path for r in C.duplicate_members(f).collect()) == ["a", "b"] and C.wasted_total(f.limit(0)).first()[0] == 0


def test_integrity_and_recovery(spark):
    f = spark.createDataFrame([(1, "/a", 10), (2, "/tmp/partial.txt", 100), (3, "/a", 0)], "file_id long, path string, size long")
    t = spark.createDataFrame([(1, "x"), (2, "orphan")], "term_id long, term string")
    p = spark.createDataFrame([(1, 1), (1, 9), (7, 1)], "term_id long, file_id long")
    r = {x.type: x.n for x in C.integrity_report(f, t, p).collect()}
    assert r == {"orphan_term": 1, "orphan_posting": 2, "missing_file": 1, "duplicate_metadata": 1}
    t2, p2 = C.repaired(f, t, p)
    assert [tuple(x) for x in p2.select("term_id", "file_id").collect()] == [(1, 1)] and [x.term for x in t2.collect()] == ["x"]
    assert C.integrity_report(f.limit(0), t.limit(0), p.limit(0)).count() == 0


def test_failures_health_runs(spark):
    e = spark.createDataFrame([("a", "Permission denied", 1), ("a", "corrupt zip", 2), ("b", None, 1)], "path string, message string, ts long")
    assert sorted(map(tuple, C.failure_rows(e).collect())) == [("a", "corrupted", "corrupt zip", 2, 1), ("b", "extraction_failed", None, 1, 0)]
    h = lambda n, bad, pend=0, status="indexed", sync=NOW: spark.range(1).select(C.health(F.lit(n), F.lit(bad), F.lit(pend), F.lit(status), F.lit(sync), NOW)).first()[0]
    assert h(95, 10) == "error" and h(0, 1) == "warning" and h(100, 10) == "warning" and h(None, None, None) == "healthy"
    assert h(10, 5) == "error" and h(100, 1) == "warning" and h(10, 0, 3) == "warning" and h(10, 0) == "healthy" and h(1, 0, status="error") == "error" and h(1, 0, sync=0) == "warning" and h(0, 0, sync=None) == "healthy"
    runs = spark.createDataFrame([(i, 1, i, 100 * i) for i in range(1, 25)], "id long, started_at long, completed_at long, duration_ms long")
    got = {r.id: r.average_ms for r in C.average_durations(runs).collect()}
    want = lambda k: math.floor((sum(100 * i for i in range(max(1, k - 18), k + 1)) + 100 * k) / (min(k, 19) + 1) + 0.5)
    assert got == {k: want(k) for k in range(1, 25)}


def test_formats(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(V.format_bytes(F.lit(0))) == "0 B" and one(V.format_bytes(F.lit(1536))) == "1.5 KB" and one(V.format_bytes(F.lit(2**20), trim=True)) == "1 MB" and one(V.format_bytes(F.lit(None).cast("long"))) is None
    assert one(V.format_relative(F.lit(NOW - 90_000), NOW)) == "1m ago" and one(V.format_relative(F.lit(NOW - 400 * V.DAY), NOW)) == "1y ago"
    assert one(V.percent(F.lit(1), F.lit(3))) == 33 and one(V.percent(F.lit(0), F.lit(0))) == 0
    assert one(V.extension(F.lit("a\\b.tar.GZ"))) == ".gz" and one(V.extension(F.lit("/x/.hidden"))) == "" and one(V.dirname(F.lit("a\\b\\c"))) == "a/b"
    assert one(V.parse_flag(F.lit("TRUE"))) is True and one(V.parse_flag(F.lit("no"))) is False
    assert one(V.millis(F.lit("2024-01-01T00:00:00Z"))) == 1704067200000 and one(V.millis(F.lit("never"))) is None

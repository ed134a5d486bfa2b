"""Term statistics and survivorship, against plain Python."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from loomdex.functions.text import normalise_py
from loomdex.llm import labels, survivorship, term_stats

P = "term_id long, file_id long, term_frequency int, positions array<int>, written_at long"


def brute(postings, terms):
    last = {}
    for t, f, tf, pos, at in postings:
        if t is None or f is None:
            continue
        v = (-1 if at is None else at, max(1, len(pos) if pos else (tf if tf is not None else 1)))
        last[t, f] = max(last.get((t, f), v), v)
    names = defaultdict(set)
    for i, t in terms:
        if normalise_py(t):
            names[i].add(normalise_py(t))
    files, occ = defaultdict(set), defaultdict(int)
    for (t, f), (_, o) in last.items():
        for n in names[t]:
            files[n].add(f)
            occ[n] += o
    total = len({f for _, f in last})
    every = set().union(*names.values()) if names else set()
    return {n: (occ[n], len(files[n]), "rare" if len(files[n]) < 3 else "common" if len(files[n]) > 0.2 * total else None) for n in every}


def make(rng, n):
    return [(rng.choice([None, 1, 1, 1, 2, 3, 4, 5, 6, 9]), rng.choice([None, *range(15)]), rng.choice([None, -2, 0, 3]), rng.choice([None, [], [1, 2]]), rng.choice([None, 5, 50, 5 * 10**9])) for _ in range(n)]


TERMS = [(1, "Common"), (1, "Common"), (2, "Café"), (3, "cafe"), (4, None), (5, "  "), (6, "ｗｉｄｅ"), (7, "unused"), (None, "idless"), (8, "common ")]


def test_counts_equal_brute_force(spark):
    data = make(random.Random(1), 300)
    p = spark.createDataFrame(data, P).withColumn("term", F.lit("clash"))
    names = term_stats.term_names(spark.createDataFrame(TERMS, "term_id long, term string"))
    got = {r.term: (r.occurrences, r.files, r.mark) for r in term_stats.marked(term_stats.counts_of(p, names), names).collect()}
    assert got == brute(data, TERMS)


def test_changes_and_deletions(spark):
    names = term_stats.term_names(spark.createDataFrame(TERMS, "term_id long, term string"))
    c = term_stats.TermCounts(spark)
    frame = lambda rows: spark.createDataFrame(rows, P)
    c.apply(frame([(1, 1, 2, None, 10), (8, 1, 1, None, 10), (2, 1, 1, None, 10)]), names)
    c.apply(frame([(1, 1, 9, None, 5), (1, 1, 4, None, 20), (3, 2, 1, None, 20)]), names)  # an older version changes nothing
    at = lambda: {r.term: (r.files, r.occurrences) for r in c.terms().collect()}
    assert at() == {"common": (1, 5), "cafe": (2, 2)}
    c.apply(frame([(8, 1, 1, None, 30), (2, 1, 1, None, 30)]), names, deleted=True)
    assert at() == {"common": (1, 4), "cafe": (1, 1)} and c.n_files() == 2
    c.apply(frame([(1, 1, 4, None, 40)]), names, deleted=True)
    assert at() == {"cafe": (1, 1)} and c.n_files() == 1
    before = c.stores.manifest()
    c.apply(frame([(3, 2, 1, None, 20), (3, 2, 1, None, 1)]), names)  # nothing new
    assert c.stores.manifest() == before


def test_random_changes_equal_a_recount(spark):
    rng, c, held = random.Random(8), term_stats.TermCounts(spark), {}
    names = term_stats.term_names(spark.createDataFrame(TERMS, "term_id long, term string"))
    for at in range(4):
        batch = [(rng.choice([1, 2, 3, 7, 8]), rng.randrange(5), rng.randrange(1, 4), None, at) for _ in range(8)]
        gone = at == 2
        for t, f, tf, _, _ in sorted(batch, key=lambda r: r[2]):
            held[t, f] = 0 if gone else tf
        c.apply(spark.createDataFrame(batch, P), names, deleted=gone)
        want = brute([(t, f, n, None, 1) for (t, f), n in held.items() if n], TERMS)
        assert {r.term: (r.occurrences, r.files) for r in c.terms().collect()} == {k: v[:2] for k, v in want.items() if v[1]}


def test_empty(spark):
    names = term_stats.term_names(spark.createDataFrame([], "term_id long, term string"))
    assert term_stats.marked(term_stats.counts_of(spark.createDataFrame([], P), names), names).count() == 0


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("ENG", "en-US", "English", " हिन्दी ", "mr_IN", "Deutsch", "fre", "zxx", "", None, "??", "klingon")], "l string")
    got = [r.c for r in df.select(labels.language_code(F.col("l")).alias("c")).collect()]
    assert got == ["eng", "eng", "eng", "hin", "mar", "deu", "fra", None, None, None, None, None]
    full = [r.f for r in df.select(labels.filled(F.col("l")).alias("f")).collect()]
    assert full == [True] * 7 + [False, False, False, False, True]


def test_digests_and_paths(spark):
    h = "ab" * 32
    one = lambda c: spark.range(1).select(c).first()[0]
    for s in (h, h.upper(), f"sha256:{h}", f"SHA-256={h.upper()}", f"0X{h.upper()}", f" {h}\n", ":".join(["AB"] * 32)):
        assert one(survivorship.hex_digest(F.lit(s))) == h
    for s in ("", "-", "pending", h[:-1], h + "0", "sha256:", "z" * 64):
        assert one(survivorship.hex_digest(F.lit(s))) is None
    standing = {
        "/home/u/Documents/backup-strategy_1.pdf": 1, "/home/u/archive/2023/copy-editing_3.md": 1, "/home/u/x/photocopier-manual_2.txt": 1, "/home/u/x/temporary-staff_2_5.txt": 1, "/home/u/old-town/trash-collection-days_3.md": 1,
        "/home/u/x/a (2).pdf": 0, "/home/u/x/a - Copy 3.pdf": 0, "/home/u/x/Copy 2 of a.pdf": 0, "/home/u/x/a.pdf~": 0, "/home/u/x/a.pdf.bak": 0, "/tmp/u-1/a.md": 0, "C:\\Users\\u\\AppData\\Local\\Temp\\a.md": 0,
        "/home/u/.cache/p/a.md": 0, "/home/u/Backups/2023-01/a.md": 0, "/media/backup-disk/u/a.md": 0, "/home/u/.local/share/Trash/files/a.1.md": 0,
    }
    df = spark.createDataFrame([(p,) for p in standing], "p string")
    assert {r.p: r.s for r in df.select("p", survivorship.path_standing(F.col("p")).alias("s")).collect()} == standing
    assert one(survivorship.path_standing(F.lit(None).cast("string"))) == 0


F_DDL = "file_id long, path string, modified_time long, indexed_at long, language string, content_hash string, author string, created_at long, extension string"


def test_survivors_field_by_field(spark):
    h, now = "ab" * 32, 1_700_000_000_000
    rows = [
        (1, "/tmp/a.txt", now, now, "eng", h, "Ada", None, ".txt"), (2, "/home/a.txt", now - 5, now, None, h.upper(), " ", 7, ".txt"), (3, "/home/a (1).txt", now + 1, now, "xx", f"0x{h}", None, None, None),
        (3, "/home/a (1).txt", now + 1, now, "xx", f"0x{h}", None, None, None), (4, "/home/b.txt", now, now, "eng", "cd" * 32, None, None, None), (4, "/home/b.txt", now, now, "eng", "cd" * 32, None, None, None),
        (None, "/home/c", now, now, "eng", h, None, None, None), (5, None, None, None, None, None, None, None, None),
    ]
    got = [r.asDict() for r in survivorship.surviving_files(spark.createDataFrame(rows, F_DDL)).collect()]
    assert got == [{"content_hash": h, "file_id": 2, "language": "eng", "author": "Ada", "created_at": 7, "extension": ".txt", "path": "/home/a.txt", "modified_time": now - 5}]
    bare = [(i, f"/tmp/{i}", now - i, now, None, h, None, None, None) for i in (1, 2)]  # nothing filled: the later one
    assert [r.file_id for r in survivorship.surviving_files(spark.createDataFrame(bare, F_DDL).withColumn("_g", F.lit("clash"))).collect()] == [1]
    assert survivorship.surviving_files(spark.createDataFrame([], F_DDL)).count() == 0


def test_survivor_beats_all_others(spark, data):
    from loomdex.llm.registry import p5_found

    files = spark.read.parquet(f"{data}/files.parquet")
    d = files.select("file_id", survivorship.hex_digest(F.col("content_hash")).alias("h"), survivorship.path_standing(F.col("path")).alias("s"), survivorship.valid_time(F.col("modified_time"), F.col("indexed_at")).alias("t"), labels.filled(F.col("language")).alias("a"), labels.filled(F.col("author")).alias("b"), F.col("created_at").isNotNull().alias("c"), labels.filled(F.col("extension")).alias("e")).distinct().collect()
    groups = defaultdict(dict)
    for r in d:
        if r.h:
            groups[r.h][r.file_id] = ({k for k in "abce" if r[k]}, r.s, r.t if r.t is not None else -1)
    want = {}
    for h, g in groups.items():
        if len(g) > 1:
            best = [i for i, x in g.items() if all(x[0] >= y[0] and x[1] >= y[1] and x[2] >= y[2] for y in g.values())]
            assert len(best) == 1
            want[h] = best[0]
    assert {r.content_hash: r.file_id for r in p5_found(spark, data).collect()} == want

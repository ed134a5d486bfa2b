"""Signed counts, references and dense counts, against plain Python."""

import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomdex.operators.dense_counts import dense_key_counts, hot_keys
from loomdex.operators.references import ReferenceLedger, deletion_changes, existence_changes, ledger_of, reference_changes
from loomdex.operators.signed_counts import Counts, CountStores
from loomdex.session import new_path

P = "term_id long, file_id long, term_frequency int, written_at long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def store(spark, keys="bigint", sums=("n",), **kw):
    return CountStores(spark, new_path(spark, "t"), {"s": Counts({"k": keys}, list(sums), **kw)})


def add(s, rows, ddl="k long, n long"):
    with s.change() as c:
        return rows_of(c.add("s", s.spark.createDataFrame(rows, ddl)))


rows_of = rows


def test_store_adds_up_and_retracts(spark):
    s = store(spark, "string", ["n", "m"], maxes=["at"])
    ddl = "k string, n long, m long, at long"
    assert rows(s.read("s")) == []
    assert add(s, [("a", 1, 2, 5), ("a", 1, 1, 3), ("b", 1, None, None), (None, 2, 0, 1)], ddl) == [("a", 2, 3, 5), ("b", 1, 0, None), (None, 2, 0, 1)]
    assert add(s, [], ddl) == [] and s.manifest()["generation"] == 1
    add(s, [("a", -2, -3, 9), ("c", 1, 0, 0), ("b", 0, 0, 7)], ddl)
    assert rows(s.read("s")) == [("b", 1, 0, 7), ("c", 1, 0, 0), (None, 2, 0, 1)]
    add(s, [("a", 1, 1, 1)], ddl)
    before = rows(s.read("s"))
    assert ("a", 1, 1, 1) in [(k, n, m, min(at, 1)) for k, n, m, at in before if k]
    s.vacuum()
    assert rows(s.read("s")) == before


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path.removeprefix("file://")) for f in fs if f.endswith(".parquet"))


def test_a_change_writes_a_small_multiple_of_itself(spark):
    s, n = store(spark, lead="k"), 200_000
    with s.change() as c:
        c.add("s", spark.range(n).select(F.col("id").alias("k"), (F.hash("id") % 1000).alias("n")))
    base = size_of(s.path)
    for i in range(1, 4):  # changes of 1 % of the keys, all over the key space
        with s.change() as c:
            c.add("s", spark.range(0, n, 100).select(F.col("id").alias("k"), F.lit(i).cast("long").alias("n")))
    s.vacuum()
    assert size_of(s.path) - base < 4 * 3 * base / 100 and s.segments("s")[0][1] >= n * 0.99
    want = spark.range(n).select((F.hash("id") % 1000 + F.when(F.col("id") % 100 == 0, 6).otherwise(0)).alias("n"))
    assert s.read("s").agg(F.sum("n")).first() == want.agg(F.sum("n")).first()


def test_segments_stay_few_and_a_failed_change_leaves_nothing(spark):
    s = store(spark)
    for i in range(9):
        add(s, [(i, 1), (0, -1 if i else 1)])
    assert len(s.segments("s")) <= 4 and rows(s.read("s")) == sorted([(0, -6), *[(i, 1) for i in range(1, 9)]], key=str)
    before = s.manifest()
    with pytest.raises(RuntimeError), s.change() as c:
        c.add("s", spark.createDataFrame([(1, 1)], "k long, n long"))
        raise RuntimeError
    assert s.manifest() == before
    s.vacuum()
    assert {p for p in s.files.names(s.path) if p != "_manifest"} == {x[0] for x in s.segments("s")}


def test_lookup_names_few_keys_to_the_scan(spark, monkeypatch):
    s = store(spark, lead="k")
    add(s, [(i, 1) for i in range(50)])
    keys = spark.createDataFrame([(3,), (4,), (4,), (None,)], "x long")
    got = s.read("s", keys)
    assert rows(got) == [(3, 1), (4, 1)] and "In(k" in got._jdf.queryExecution().toString()
    monkeypatch.setattr("loomdex.operators.signed_counts.LOOKUP_KEYS", 1)
    assert rows(s.read("s", keys)) == [(3, 1), (4, 1)]


def test_random_changes_equal_a_dictionary(spark):
    rng, want, s = random.Random(3), defaultdict(int), store(spark)
    for _ in range(3):
        change = [(rng.randrange(12), rng.choice([-1, 1, 2])) for _ in range(40)]
        for k, n in change:
            want[k] += n
        add(s, change)
    assert rows(s.read("s")) == sorted([(k, n) for k, n in want.items() if n], key=str)


@pytest.fixture(scope="module")
def tables(spark):
    postings = [(1, 1, 1, 100), (1, 1, 1, 100), (1, 2, 1, 100), (2, 1, 1, 50), (2, 1, 1, 300), (9, 1, 1, 100), (1, 8, None, 100), (9, 8, 1, 40), (None, 1, 1, 5), (1, None, 1, 5), (1, 3, 1, None), (1, 4, 1, 500)]
    terms = [(1, "a", 10), (1, "a", 10), (2, "b", 60), (None, "x", 1)]
    files = [(1, 10), (1, 10), (2, 200), (3, 20), (4, 400), (None, 1)]
    deleted = [(3, 30), (3, 25), (4, 300), (None, 9), (77, 1)]
    return (
        spark.createDataFrame(postings, P).withColumn("n", F.lit("clash")), spark.createDataFrame(terms, "term_id long, term string, added_at long"),
        spark.createDataFrame(files, "file_id long, indexed_at long").withColumn("deleted_at", F.lit(1)), spark.createDataFrame(deleted, "file_id long, deleted_at long"),
    )


def brute(postings, terms, files, deleted):
    gone = defaultdict(int)
    for f, t in deleted:
        gone[f] = max(gone[f], t)
    out = set()
    for t, f, _, at in postings:
        if t is None or f is None:
            continue
        late = lambda since: at is not None and since > at
        if not any(i == t and not late(a) for i, a in terms):
            out.add((t, f, "terms"))
        if not any(i == f and not gone[f] > a and not late(a) for i, a in files):
            out.add((t, f, "files"))
    return sorted(out, key=str)


def test_orphans_equal_brute_force(spark, tables):
    p, t, f, d = tables
    want = brute([tuple(r)[:4] for r in p.collect()], [(r.term_id, r.added_at) for r in t.collect()], [(r.file_id, r.indexed_at) for r in f.collect()], [tuple(r) for r in d.collect()])
    assert rows(ledger_of(p, t, f, d).pairs()) == want


def test_orphans_appear_and_vanish_with_changes(spark, tables):
    p, t, f, _ = tables
    ledger = ReferenceLedger(spark)
    one = p.filter("term_id = 1 and file_id = 2")
    ledger.apply(reference_changes(one))
    assert rows(ledger.pairs()) == [(1, 2, "files"), (1, 2, "terms")]
    ledger.apply(existence=existence_changes(t, f.withColumn("indexed_at", F.lit(0))))
    assert rows(ledger.pairs()) == []
    ledger.apply(existence=deletion_changes(f.withColumn("indexed_at", F.lit(0)), spark.createDataFrame([(2, 5)], "file_id long, deleted_at long")))
    assert rows(ledger.pairs()) == [(1, 2, "files")]
    ledger.apply(reference_changes(one).withColumn("n", F.lit(-1)))
    assert rows(ledger.pairs()) == []


def test_report_and_empty_tables(spark, tables):
    p, t, f, d = tables
    r = {(x.target, x.period): (x.n_references, x.n_keys) for x in ledger_of(p, t, f, d).report().collect()}
    assert r["terms", "1970-01"] == (3, 2) and r["files", None] == (1, 1)
    empty = [x.limit(0) for x in tables]
    assert rows(ledger_of(*empty).pairs()) == []


@pytest.mark.parametrize("block, salts", [(2, 3), (1000, 1)])
def test_dense_counts_equal_brute_force(spark, block, salts):
    rng = random.Random(block)
    data = [(rng.choice([7, 7, 7, 7, None, *range(-3, 20)]), rng.choice([None, *range(6)]), rng.choice([None, -4, 1, 5])) for _ in range(600)]
    df = spark.createDataFrame(data, "k int, m long, w int").withColumns({"key": F.lit("clash"), "block": F.lit(1)})
    want = defaultdict(lambda: [0, set(), 0])
    for k, m, w in data:
        x = want[k]
        x[0] += 1
        x[1] |= {m} - {None}
        x[2] += max(w or 0, 0)
    got = rows(dense_key_counts(df, "k", "m", "w", block_keys=block, salts=salts))
    assert got == sorted([(k, n, len(s), t) for k, (n, s, t) in want.items()], key=str)


def test_dense_counts_of_nothing_and_of_nulls(spark):
    df = spark.createDataFrame([(None, 1, 2), (None, None, None)], "k long, m long, w long")
    assert rows(dense_key_counts(df.limit(0), "k", "m", "w")) == []
    assert rows(dense_key_counts(df, "k", "m", "w")) == [(None, 2, 1, 2)] and rows(dense_key_counts(df, "k")) == [(None, 2, 0, 0)]
    assert rows(hot_keys(dense_key_counts(df, "k", "m", "w"))) == []


def test_hot_keys(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, 5).otherwise(F.col("id")).alias("k"), F.col("id").alias("m"), F.lit(1).alias("w"))
    assert [r.key for r in hot_keys(dense_key_counts(df, "k", "m", "w"), 0.01).collect()] == [5]

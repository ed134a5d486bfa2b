"""The entry points, on the smallest tables."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from loomdex import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and {"p2_found", "p4_found"} <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_core_stands_without_the_subpackage():
    code = "import sys; sys.modules['loomdex.llm'] = None; import loomdex.catalog, loomdex.registry, loomdex.streaming.changes, loomdex.sources.crawl; print(len(loomdex.registry.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout) == len(registry.queries())


def test_core_stands_without_what_the_subpackage_needs():
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), 'p3_found' in q, set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert out.returncode == 0 and out.stdout.split() == [str(len(registry.queries())), "False", "True"]


def test_no_local_folder_off_local_mode(spark):
    from types import SimpleNamespace

    from loomdex import session

    class Conf:
        def get(self, *_):
            return None

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        session.shared_dir(SimpleNamespace(conf=Conf(), sparkContext=context))
    with session.scratch(spark):
        path = session.new_path(spark, "x")
        spark.range(3).write.parquet(path)
    assert not os.path.exists(path.removeprefix("file://")) and session.sweep(spark, 0) >= 0


@pytest.mark.parametrize("name", ["t2_postings", "q_any_word", "q_strict_phrase", "j7_phrase", "f1_filters", "q_reference_not", "t6_held_out", "a14_health", "w4_sync", "a11_integrity", "w2_debounce", "p2_term_counts", "p4_report"])
def test_queries_equal_their_sql(spark, data, name):
    import duckdb

    db = duckdb.connect()
    for t in os.listdir(data):
        db.sql(f"create view {t.removesuffix('.parquet')} as select * from '{data}/{t}'")
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    df = registry.queries()[name](spark, data)
    cols = sorted(df.columns)
    want = db.sql(registry.oracle_sql()[name])
    at = [want.columns.index(c) for c in cols]
    assert sorted(map(str, ([plain(r[c]) for c in cols] for r in df.collect()))) == sorted(map(str, ([plain(r[i]) for i in at] for r in want.fetchall())))


def same_as_sql(spark, data, name):
    import duckdb

    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{data}/documents.parquet'")
    df = registry.queries()[name](spark, data)
    want = db.sql(registry.oracle_sql()[name])
    return sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())


def test_resynced_files_are_deleted_where_the_rows_are(spark, data, monkeypatch):
    from loomdex.operators.signed_counts import HadoopFiles

    gone = []
    delete = HadoopFiles.delete
    monkeypatch.setattr(HadoopFiles, "delete", lambda self, p: (gone.append(p), delete(self, p)))
    assert same_as_sql(spark, data, "c9_resynced") and not [p for p in gone if "doc_id=" in p]


def test_restored_has_no_task_a_file(spark, data):
    from loomdex import queries

    queries._disk.clear()
    spark.sparkContext.setJobGroup("restored", "")
    try:
        assert same_as_sql(spark, data, "k18_restored")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    t = spark.sparkContext.statusTracker()
    stages = [t.getStageInfo(s) for j in t.getJobIdsForGroup("restored") for s in t.getJobInfo(j).stageIds]
    # 100 documents; a folder or file each would be as many tasks
    assert stages and max(s.numTasks for s in stages if s) <= 40

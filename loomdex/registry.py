"""Registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex import queries as engine
from loomdex.operators.dense_counts import dense_key_counts, hot_keys
from loomdex.operators.references import ledger_of
from loomdex.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_term_counts(spark: SparkSession, d: str) -> DataFrame:
    return dense_key_counts(table(spark, d, "postings"), "term_id", "file_id", "term_frequency").select(F.col("key").alias("term_id"), "n_rows", F.col("n_members").alias("n_files"), F.col("total").alias("total_frequency"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys(dense_key_counts(table(spark, d, "postings"), "term_id"), 0.01).select(F.col("key").alias("term_id"))


def _ledger(spark: SparkSession, d: str):
    return ledger_of(*[table(spark, d, t) for t in ("postings", "terms", "files", "deleted_files")])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d).pairs()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d).report()


P2_COUNTS_SQL = """
select term_id, count(*) as n_rows, count(distinct file_id) as n_files,
  cast(sum(greatest(coalesce(term_frequency, 0), 0)) as bigint) as total_frequency
from postings group by term_id"""

P2_FOUND_SQL = """
select term_id from postings where term_id is not null group by term_id
having count(*) > 0.01 * (select count(*) from postings)"""

_P4_BASE = """
with t as (select term_id, min(added_at) as since from terms where term_id is not null group by term_id),
d as (select file_id, max(deleted_at) as deleted_at from deleted_files group by file_id),
f as (select file_id, min(indexed_at) as since from files left join d using (file_id)
      where file_id is not null and (d.deleted_at is null or d.deleted_at <= indexed_at) group by file_id),
r as (select p.term_id, p.file_id, p.written_at, t.since as ts, f.since as fs from postings p
      left join t on p.term_id = t.term_id left join f on p.file_id = f.file_id
      where p.term_id is not null and p.file_id is not null),
o as (select term_id, file_id, written_at, 'terms' as target from r where ts is null or ts > written_at
      union all select term_id, file_id, written_at, 'files' as target from r where fs is null or fs > written_at)"""

P4_FOUND_SQL = _P4_BASE + " select distinct term_id, file_id, target from o"
P4_REPORT_SQL = _P4_BASE + """
select target, strftime(make_timestamp(written_at * 1000), '%Y-%m') as period, count(*) as n_references,
  count(distinct case target when 'terms' then term_id else file_id end) as n_keys
from o group by 1, 2"""


def queries() -> dict[str, Query]:
    return engine.QUERIES | {"p2_found": p2_found, "p2_term_counts": p2_term_counts, "p4_found": p4_found, "p4_report": p4_report}


def oracle_sql() -> dict[str, str]:
    return engine.SQL | {"p2_found": P2_FOUND_SQL, "p2_term_counts": P2_COUNTS_SQL, "p4_found": P4_FOUND_SQL, "p4_report": P4_REPORT_SQL}

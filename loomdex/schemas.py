"""Tables of the index. Every time is a long: milliseconds since 1970, UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DDL = {
    "files": "file_id long, path string, size long, modified_time long, doc_length int, indexed_at long, language string, content_hash string, author string, created_at long, extension string",
    "terms": "term_id long, term string, document_frequency long",
    "postings": "term_id long, file_id long, term_frequency int, positions array<int>",
    "folders": "id long, path string, enabled boolean",
    "metadata": "status string, last_indexed_at long, last_synced_at long, last_index_duration_ms long, average_index_duration_ms long, total_indexing_runs long, total_indexed_files long, total_indexed_terms long, ignored_files_count long, schema_version int, index_version int, app_version string, created_at long, last_migration_at long, error_message string",
    "runs": "id long, started_at long, completed_at long, duration_ms long, files_indexed long, status string, error_message string",
    "settings": "key string, value string",
    "failures": "id long, path string, category string, message string, occurred_at long, retry_count int, ignored boolean",
    "ignore_rules": "id long, pattern string, type string, enabled boolean, created_at long",
    "migrations": "version int, name string, applied_at long, checksum string",
    "lock": "owner string, acquired_at long, expires_at long, context struct<trigger:string,runId:long>",
}

_TYPES = {
    "long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "array<int>": T.ArrayType(T.IntegerType()),
    "struct<trigger:string,runId:long>": T.StructType([T.StructField("trigger", T.StringType()), T.StructField("runId", T.LongType())]),
}


def struct(ddl: str) -> T.StructType:
    """Without a session, unlike Spark's own parser."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.strip().split(" ") for f in ddl.split(", "))])


SCHEMAS: dict[str, T.StructType] = {k: struct(v) for k, v in _DDL.items()}

#: Tables that a backup must hold.
REQUIRED = ("files", "terms", "postings", "folders", "metadata", "settings", "ignore_rules")


def conform(df: DataFrame, name: str) -> DataFrame:
    """The table's columns in order and type; absent ones are null, others are dropped."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields])

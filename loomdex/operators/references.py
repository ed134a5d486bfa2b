"""References to records that do not exist: signed reference and existence counts, and the report drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.operators.signed_counts import Counts, CountStores
from loomdex.session import new_path

FAR_PAST = -(2**62)


class ReferenceLedger:
    """Keeps, under signed changes, how often each (term_id, file_id, written_at) refers and which versions of each key exist.

    references: term_id, file_id, written_at, n — n rows more (or fewer, if negative) that hold this reference. Rows with a null
    id refer to nothing and are left out.
    existence: target ('terms' or 'files'), id, since, n — n versions of the key more or fewer, valid from `since` on. A null
    `since` counts as always; a null id is no key.
    A reference is an orphan if no version of its key exists, or all begin after it was written. Of a null written_at only the
    first is asked. Repeated rows count once for existence (any positive count exists) and each for references.
    Hot keys: changes are added up by whole keys, on the mappers first; the joins of the report are left to adaptive skew handling, and
    the key side has one row per key.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.stores = CountStores(
            spark, path or new_path(spark, "ledger"),
            {
                "references": Counts({"term_id": "bigint", "file_id": "bigint", "written_at": "bigint"}, ["n"]),
                "existence": Counts({"target": "string", "id": "bigint", "since": "bigint"}, ["n"]),
            },
        )

    def apply(self, references: DataFrame | None = None, existence: DataFrame | None = None) -> None:
        """Both changes become valid together. Runs when called. Rows of one key are added up on the mappers."""
        with self.stores.change() as c:
            if references is not None:
                c.add("references", references.filter("term_id is not null and file_id is not null"))
            if existence is not None:
                c.add("existence", existence.filter("id is not null").select("target", "id", F.coalesce("since", F.lit(FAR_PAST)).alias("since"), "n"))

    def _exists(self, target: str) -> DataFrame:
        return self.stores.read("existence").filter((F.col("target") == target) & (F.col("n") > 0)).groupBy("id").agg(F.min("since").alias("since"))

    def orphans(self) -> DataFrame:
        """term_id, file_id, written_at, n, target: every broken reference now."""
        refs = self.stores.read("references").filter("n > 0")
        for target, key in (("terms", "term_id"), ("files", "file_id")):
            side = self._exists(target).select(F.col("id").alias(key), F.col("since").alias(f"since_{target}"))
            refs = refs.join(side, key, "left")
        broken = [F.when(F.col(f"since_{t}").isNull() | (F.col(f"since_{t}") > F.col("written_at")), F.lit(t)) for t in ("terms", "files")]
        return refs.select("term_id", "file_id", "written_at", "n", F.explode(F.array_compact(F.array(*broken))).alias("target"))

    def pairs(self) -> DataFrame:
        """One row per distinct pair and broken target."""
        return self.orphans().groupBy("term_id", "file_id", "target").agg(F.lit(1).alias("_")).drop("_")

    def report(self) -> DataFrame:
        """target, period (UTC month of written_at, null if unknown), n_references, n_keys."""
        o = self.orphans().withColumn("period", F.date_format(F.timestamp_millis("written_at"), "yyyy-MM"))
        key = F.when(F.col("target") == "terms", F.col("term_id")).otherwise(F.col("file_id"))
        by_key = o.groupBy("target", "period", key.alias("key")).agg(F.sum("n").alias("n"))
        return by_key.groupBy("target", "period").agg(F.sum("n").alias("n_references"), F.count("key").alias("n_keys"))


def reference_changes(postings: DataFrame) -> DataFrame:
    """Each row of postings as one reference more."""
    return postings.select("term_id", "file_id", "written_at", F.lit(1).alias("n"))


def existence_changes(terms: DataFrame, files: DataFrame) -> DataFrame:
    """Each row of terms and files as one existing version more."""
    return terms.select(F.lit("terms").alias("target"), F.col("term_id").alias("id"), F.col("added_at").alias("since"), F.lit(1).alias("n")).unionByName(
        files.select(F.lit("files").alias("target"), F.col("file_id").alias("id"), F.col("indexed_at").alias("since"), F.lit(1).alias("n"))
    )


def deletion_changes(files: DataFrame, deleted_files: DataFrame) -> DataFrame:
    """Each row of files that was deleted after it was indexed as one version less. Files indexed again later stay."""
    last = deleted_files.filter("file_id is not null").groupBy("file_id").agg(F.max("deleted_at").alias("deleted_at"))
    gone = files.select("file_id", "indexed_at").join(last, "file_id").filter(F.col("deleted_at") > F.col("indexed_at"))
    return gone.select(F.lit("files").alias("target"), F.col("file_id").alias("id"), F.col("indexed_at").alias("since"), F.lit(-1).alias("n"))


def ledger_of(postings: DataFrame, terms: DataFrame, files: DataFrame, deleted_files: DataFrame) -> ReferenceLedger:
    """The ledger of whole tables: all rows as the first change, deletions as the second. Written when called."""
    ledger = ReferenceLedger(postings.sparkSession)
    ledger.apply(reference_changes(postings), existence_changes(terms, files))
    ledger.apply(existence=deletion_changes(files, deleted_files))
    return ledger

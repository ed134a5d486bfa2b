"""How often every distinct term occurs and in how many files, kept up to date by signed changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.text import normalise
from loomdex.operators.signed_counts import Counts, CountStores
from loomdex.session import new_path

#: A term in fewer files than this is rare.
RARE_BELOW = 3
#: A term in more than this share of all files is common.
COMMON_ABOVE = 0.2


def occurrences(frequency: Column, positions: Column) -> Column:
    """Occurrences that a posting stands for: the number of its positions; without positions its frequency; at least one."""
    return F.greatest(F.coalesce(F.when(F.size(positions) > 0, F.size(positions)), frequency, F.lit(1)), F.lit(1)).cast("long")


#: Times and occurrences are compared as one number: time * _SHIFT + occurrences.
_SHIFT = 2**31


class TermCounts:
    """Counts by term in three stores that only ever take signed changes, valid together under one manifest.

    records: (term_id, file_id) -> live, occurrences, written_at. terms: term -> files, occurrences. files: file_id -> live records.
    A batch of postings is compared with the records that it touches; what differs is added to records as a segment, and goes on, added
    up, to files and terms. Unchanged records are neither aggregated nor written. The files of a term with one id are its live records;
    of a term with several ids the records of the touched (term, file) pairs are counted before and after.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.stores = CountStores(
            spark, path or new_path(spark, "terms"),
            {
                "records": Counts({"term_id": "bigint", "file_id": "bigint"}, ["live", "occurrences"], ["written_at"], "file_id"),
                "terms": Counts({"term": "string"}, ["files", "occurrences"]), "files": Counts({"file_id": "bigint"}, ["live"]),
            },
        )

    def apply(self, postings: DataFrame, names: DataFrame, deleted: bool = False) -> None:
        """Add or change the records of `postings`, or take them away. Runs when called.

        postings: term_id, file_id, term_frequency, positions, written_at. Rows with a null id don't count. Of several rows of a record
        the one written last holds (a null time is earlier than any; of equal times the most occurrences); a row written before the one
        already held changes nothing. names: term_id, term (normalised, distinct); it may grow between calls. A term_id without name counts
        for files only, until its postings are applied again.
        """
        rows = postings.filter("term_id is not null and file_id is not null").select(
            "term_id", "file_id", (F.coalesce("written_at", F.lit(-1)).cast("decimal(20,0)") * F.lit(_SHIFT) + occurrences(F.col("term_frequency"), F.col("positions"))).alias("v")
        )
        # one decimal keeps the aggregate in the hash table, where a struct would be sorted
        last = rows.groupBy("term_id", "file_id").agg(F.max("v").alias("v"))
        last = last.withColumn("occurrences", F.pmod("v", F.lit(_SHIFT)).cast("long")).withColumn("written_at", ((F.col("v") - F.col("occurrences")) / F.lit(_SHIFT)).cast("long")).drop("v")
        with self.stores.change() as c:
            if c.segments("records"):
                now = c.read("records", rows.select("file_id")).select("term_id", "file_id", F.col("live").alias("l"), F.col("occurrences").alias("o"), F.col("written_at").alias("w"))
                last = last.join(now, ["term_id", "file_id"], "left").filter(F.col("w").isNull() | (F.col("written_at") >= F.col("w")))
            else:
                last = last.withColumns({x: F.lit(None).cast("long") for x in ("l", "o", "w")})
            alive = F.lit(0 if deleted else 1)
            change = last.select(
                "term_id", "file_id", (alive - F.coalesce("l", F.lit(0))).cast("long").alias("live"), (alive * F.col("occurrences") - F.coalesce("o", F.lit(0))).alias("occurrences"), "written_at",
                (F.coalesce(F.col("written_at") > F.col("w"), F.lit(False))).alias("later"),
            ).filter("live != 0 or occurrences != 0 or later").drop("later")
            moved = c.add("records", change, distinct=True)
            c.add("files", moved.filter("live != 0").select("file_id", "live"))
            # a hot id is added up before it meets its name
            by_id = moved.groupBy("term_id").agg(F.sum("live").alias("live"), F.sum("occurrences").alias("occurrences"))
            several = names.filter("term_id is not null").groupBy("term").agg(F.count("*").alias("k")).filter("k > 1").select("term", F.lit(True).alias("several"))
            named = names.join(several, "term", "left").select("term_id", "term", F.coalesce("several", F.lit(False)).alias("several"))
            ones = by_id.join(named, "term_id").select("term", F.when(F.col("several"), F.lit(0)).otherwise(F.col("live")).alias("files"), "occurrences")
            shared = named.filter("several").select("term_id", "term")
            now = c.read("records").join(shared, "term_id").select("term", "file_id", F.col("live").alias("after"), F.lit(0).alias("added"), F.lit(False).alias("touched"))
            new = moved.join(shared, "term_id").select("term", "file_id", F.lit(0).alias("after"), F.col("live").alias("added"), F.lit(True).alias("touched"))
            pairs = now.unionByName(new).groupBy("term", "file_id").agg(F.sum("after").alias("after"), F.sum("added").alias("added"), F.bool_or("touched").alias("touched")).filter("touched")
            came = (F.col("after") > 0).cast("long") - (F.col("after") - F.col("added") > 0).cast("long")
            c.add("terms", ones.unionByName(pairs.select("term", came.alias("files"), F.lit(0).cast("long").alias("occurrences"))))

    def terms(self) -> DataFrame:
        """term, files, occurrences of terms that occur."""
        return self.stores.read("terms")

    def n_files(self) -> int:
        return self.stores.read("files").count()


def term_names(terms: DataFrame) -> DataFrame:
    """Distinct (term_id, term) with normalised terms; null and blank terms are left out. An id with several terms stands for each."""
    return terms.select("term_id", normalise(F.col("term")).alias("term")).filter("term is not null and term != ''").groupBy("term_id", "term").agg(F.lit(1).alias("_")).drop("_")


def marked(counts: TermCounts, names: DataFrame, rare_below: int = RARE_BELOW, common_above: float = COMMON_ABOVE) -> DataFrame:
    """term, occurrences, files, mark of every distinct term of `names`: 'rare', 'common' or null; a term without postings has zeros."""
    limit = counts.n_files() * common_above  # one number
    c = names.select("term").distinct().join(counts.terms(), "term", "left")
    files = F.coalesce("files", F.lit(0))
    # a term both in too few files and in too large a share of them is rare
    return c.select("term", F.coalesce("occurrences", F.lit(0)).alias("occurrences"), files.alias("files"), F.when(files < rare_below, "rare").when(files > F.lit(limit), "common").alias("mark"))


def counts_of(postings: DataFrame, names: DataFrame, late_ms: int = 30 * 86400000) -> TermCounts:
    """Counts of a whole table: all but its last days as the first change, the rows of its last `late_ms` as the next. Written when called."""
    counts = TermCounts(postings.sparkSession)
    newest = postings.agg(F.max("written_at")).first()[0]
    if newest is None:
        counts.apply(postings, names)
        return counts
    cut = newest - late_ms
    counts.apply(postings.filter(F.col("written_at").isNull() | (F.col("written_at") < cut)), names)
    counts.apply(postings.filter(F.col("written_at") >= cut), names)
    return counts

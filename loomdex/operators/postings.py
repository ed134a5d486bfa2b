"""Building the positional inverted index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions.analysis import detect_language, is_stop_word
from loomdex.functions.text import normalise, tokens
from loomdex.session import written


@dataclass(frozen=True)
class AnalyzerConfig:
    remove_stop_words: bool = False
    detect_language: bool = True
    stemming: bool = False
    index_metadata: bool = True

    def key(self) -> str:
        """What must be the same for files to count as indexed in the same way; stemming works at query time only."""
        return f"stop={self.remove_stop_words},detect={self.detect_language},meta={self.index_metadata}"


def build_postings(texts: DataFrame, config: AnalyzerConfig = AnalyzerConfig(detect_language=False), unique_ids: bool = False) -> DataFrame:
    """(file_id, term, term_frequency, positions) of texts (file_id, text).

    Positions count all tokens of the text from 0, removed stop words too. A null or blank text has no postings. Rows with the same
    file_id are taken as one text each and their postings added up. A text is one row: its tokens are put in order and cut into postings
    within the row, so that neither texts nor tokens are shuffled. Only the postings of rows that may share an id are, added up on the
    mappers; unique_ids says that no two rows do (no null id twice either), and then there is no shuffle at all.
    """
    d = texts.select("file_id", normalise(F.col("text")).alias("normal"))
    words = F.transform(tokens(F.col("normal")), lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
    if config.remove_stop_words:
        d = d.withColumn("language", detect_language(F.col("normal")) if config.detect_language else F.lit(None).cast("string"))
        words = F.filter(words, lambda w: ~is_stop_word(w["term"], F.col("language")))
    d = d.select("file_id", F.sort_array(words).alias("words")).filter(F.size("words") > 0)
    # each of these is used more than once above it, so the planner keeps it as a column instead of repeating it for every element
    d = d.select("file_id", F.transform("words", lambda w: w["term"]).alias("term"), F.transform("words", lambda w: w["pos"]).alias("pos"))
    first = F.filter(F.sequence(F.lit(0), F.size("term") - 1), lambda i: (i == 0) | (F.get("term", i) != F.get("term", i - 1)))
    d = d.select("file_id", "term", "pos", first.alias("first"))
    length = lambda a, k: F.coalesce(F.get("first", k + 1), F.size("term")) - a
    parts = F.transform("first", lambda a, k: F.struct(F.get("term", a).alias("term"), length(a, k).alias("term_frequency"), F.slice("pos", a + 1, length(a, k)).alias("positions")))
    out = d.select("file_id", F.inline(parts))
    if unique_ids:
        return out
    merged = out.groupBy("file_id", "term").agg(F.sum("term_frequency").cast("int").alias("term_frequency"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    return merged


def by_term(postings: DataFrame) -> DataFrame:
    """Postings in order of terms, as an index holds them: cut by term and file, so that no word, however common, is one task or one file."""
    return postings.repartitionByRange("term", "file_id").sortWithinPartitions("term", "file_id")


def document_frequency(postings: DataFrame) -> DataFrame:
    """(term, document_frequency)"""
    return postings.groupBy("term").agg(F.count("*").alias("document_frequency"))


def document_length(files: DataFrame, postings: DataFrame) -> DataFrame:
    """(file_id, doc_length) of every file, 0 without postings."""
    n = postings.groupBy("file_id").agg(F.sum("term_frequency").alias("n"))
    return files.select("file_id").join(n, "file_id", "left").select("file_id", F.coalesce("n", F.lit(0)).cast("int").alias("doc_length"))


def numbered(df: DataFrame, column: str, id_name: str) -> DataFrame:
    """Distinct values with ids from 1 in their order; the driver sees one number per partition."""
    d = df.select(column).filter(F.col(column).isNotNull()).distinct().repartitionByRange(column).sortWithinPartitions(column)
    d = written(d.select(column, F.spark_partition_id().alias("_p")).withColumn("_at", F.monotonically_increasing_id() % F.lit(1 << 33)), "numbered")
    sizes, at, start = d.groupBy("_p").count().orderBy("_p").collect(), 1, {}
    for r in sizes:
        start[r[0]], at = at, at + r[1]
    if not start:
        return d.select(F.lit(None).cast("long").alias(id_name), column)
    offsets = F.create_map(*[F.lit(x) for kv in start.items() for x in kv])
    return d.select((F.element_at(offsets, F.col("_p")) + F.col("_at")).cast("long").alias(id_name), column)


def encoded(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """terms (term_id, term, document_frequency) and postings by term_id, with ids in the order of the terms."""
    df = document_frequency(postings)
    terms = numbered(df, "term", "term_id").join(df, "term").select("term_id", "term", "document_frequency")
    return terms, postings.join(terms.select("term_id", "term"), "term").select("term_id", "file_id", "term_frequency", "positions")


def corpus_stats(files: DataFrame) -> tuple[int, float]:
    """Number of files and mean length; a mean of zero counts as one."""
    n, mean = files.agg(F.count("*"), F.avg("doc_length")).first()
    return n, mean or 1.0


def phrase_positions(per_word: list[Column]) -> Column:
    """Starts of a phrase, from the positions of its words in a file; null lists make it null."""
    out = per_word[0]
    for i, p in enumerate(per_word[1:], 1):
        out = F.array_intersect(out, F.transform(p, _less(i)))
    return out


def _less(n: int):
    return lambda x: x - n

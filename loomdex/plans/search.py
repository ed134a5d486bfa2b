"""Search: from the query's words to the ranked files.

The words of a query are expanded first, and the few terms that come out are named to the scan of the postings, which lie in order of terms;
the result page is small, too, so its files are named to the scan of the texts. All else is one lazy plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import timezone, tzinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions.analysis import stem, stem_py
from loomdex.functions.values import basename
from loomdex.operators.postings import corpus_stats, phrase_positions
from loomdex.plans.filters import in_scope, predicate
from loomdex.plans.query import And, Filter, Node, Not, Or, Phrase, Term, leaves, parse
from loomdex.session import NOW_MS

#: Constants of ranking (fixed values).
K1, B = 1.2, 0.75
WEIGHTS = {"phrase": 1000.0, "filename": 80.0, "bm25": 1.0, "folder": 10.0, "recency": 5.0}
FOLDERS = ("documents", "desktop", "downloads", "projects")
DAY = 86400000
RESULT_LIMIT, FUZZY_DISTANCE, PREFIX_LENGTH = 50, 1, 2
#: Terms and files that are named to a scan; an expansion to more terms is joined instead.
NAMED_TERMS, NAMED_FILES = 2000, 1000
#: What is suggested for what is typed, in this order (fixed values).
SUGGESTED = {
    "ext": "extension:", "extension": "extension:", "lang": "language:", "language": "language:", "auth": "author:", "author": "author:", "mod": "modified:", "modified": "modified:",
    "cre": "created:", "created": "created:", "fol": "folder:", "folder": "folder:", "siz": "size:", "size": "size:", "typ": "type:", "type": "type:",
}
ORDERS: dict[str, Callable[[], list[Column]]] = {
    "relevance": lambda: [F.desc("score"), F.asc("file_id")],
    "newest": lambda: [F.desc("modified_time"), F.asc("file_id")],
    "oldest": lambda: [F.asc("modified_time"), F.asc("file_id")],
    "largest": lambda: [F.desc("size"), F.asc("file_id")],
    "smallest": lambda: [F.asc("size"), F.asc("file_id")],
    "alphabetical": lambda: [F.asc(F.lower("filename")), F.asc("file_id")],
}


def idf(df: Column, n: Column | int) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(tf: Column, df: Column, length: Column, n: int, mean: float, k1: float = K1, b: float = B) -> Column:
    return idf(df, F.lit(n)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(float(mean))))


def filename_signal(filename: Column, terms: Column) -> Column:
    name = F.lower(filename)
    one = lambda t: F.when(name == t, 3.0).when(F.startswith(name, F.concat(t, F.lit("."))), 2.0).when(F.contains(name, t), 1.0).otherwise(0.0)
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + one(t))


def folder_signal(path: Column) -> Column:
    return F.lower(path).rlike("|".join(FOLDERS)).cast("double")


def recency_signal(modified: Column, now_ms: int) -> Column:
    age = F.lit(now_ms) - modified
    return F.when(age < DAY, 3.0).when(age < 7 * DAY, 2.0).when(age < 30 * DAY, 1.0).otherwise(0.0)


def legacy_score(bm25_score: Column, n_terms: Column, n_phrases: Column) -> Column:
    return bm25_score + 10 * n_terms + 1000 * n_phrases


@dataclass
class SearchIndex:
    """files with doc_length; terms (term, document_frequency); postings (term, file_id, term_frequency, positions); texts (file_id, text) for snippets."""

    files: DataFrame
    terms: DataFrame
    postings: DataFrame
    texts: DataFrame | None = None
    _stats: tuple[int, float] | None = field(default=None, repr=False)

    @property
    def stats(self) -> tuple[int, float]:
        """Of all files, whatever the scope of a search."""
        if self._stats is None:
            self._stats = corpus_stats(self.files)
        return self._stats


def expand(terms: DataFrame, words: list[str], stemming: bool = False, strict: bool = False) -> DataFrame:
    """(leaf, term, document_frequency): index terms for each word of a query, once per word, in one pass over the dictionary.

    A term fits if it is the word, begins with it (words of two letters and more), is one edit away, or, with stemming, shares its stem
    without being the stem itself (strict: or is it). The dictionary is scanned once for all words; lengths are compared before letters.
    """
    own_stem = stem(F.col("term")) if stemming else None
    d = terms.withColumn("_stem", own_stem) if stemming else terms
    fits = []
    for i, w in enumerate(words):
        c = F.col("term") == w
        if len(w) >= PREFIX_LENGTH:
            c = c | F.startswith("term", F.lit(w))
        c = c | ((F.abs(F.length("term") - len(w)) <= FUZZY_DISTANCE) & (F.levenshtein("term", F.lit(w), FUZZY_DISTANCE) >= 0))
        if stemming:
            same = F.col("_stem") == stem_py(w)
            c = c | (same if strict else same & (F.col("_stem") != F.col("term")))
        fits.append(F.when(c, F.lit(i)))
    if not fits:
        return d.select(F.lit(0).alias("leaf"), "term", "document_frequency").limit(0)
    return d.select(F.explode(F.array_compact(F.array(*fits))).alias("leaf"), "term", "document_frequency")


def phrase_matches(postings: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """(file_id, phrase_0, phrase_1, …): starts of each phrase in files that hold any of their words. One pass over the words' postings."""
    words = sorted({w for p in phrases for w in p.terms})
    held = postings.filter(F.col("term").isin(words)) if words else postings.limit(0)
    by = held.groupBy("file_id").agg(*[F.max(F.when(F.col("term") == w, F.col("positions"))).alias(f"w{i}") for i, w in enumerate(words)], F.lit(1).alias("_"))
    of = {w: F.col(f"w{i}") for i, w in enumerate(words)}
    empty = F.array().cast("array<int>")
    out = [F.coalesce(phrase_positions([of[w] for w in p.terms]), empty).alias(f"phrase_{i}") if p.terms else empty.alias(f"phrase_{i}") for i, p in enumerate(phrases)]
    return by.select("file_id", *out)


class Search:
    """A parsed query over an index. semantics 'reference': a word is found in a file if any word of the query is, and only files with a
    word are ranked; 'strict': each word counts for itself, and files found by phrases or filters alone are ranked too, with no score for words.
    """

    def __init__(
        self, index: SearchIndex, query: str, *, semantics: str = "reference", scope: list[str] = (), stemming: bool = False, now_ms: int = NOW_MS, zone: tzinfo = timezone.utc,
        weights: dict[str, float] | None = None, signals: dict[str, Callable[[DataFrame], Column]] | None = None,
    ):
        if semantics not in ("reference", "strict"):
            raise ValueError(semantics)
        self.index, self.strict, self.scope, self.stemming, self.now_ms, self.zone = index, semantics == "strict", list(scope), stemming, now_ms, zone
        self.weights, self.signals = WEIGHTS | (weights or {}), signals or {}
        self.root = parse(query, self.strict).root
        self.terms, self.phrases = leaves(self.root)
        self._numbers = {id(n): i for group in (self.terms, self.phrases) for i, n in enumerate(group)}

    def matches(self) -> DataFrame:
        """(file_id, leaves, matched_terms, hits) of every file with an expanded word; hits hold what BM25 needs.

        Expands when called: at most NAMED_TERMS rows come to the driver.
        """
        words, postings = expand(self.index.terms, [t.value for t in self.terms], self.stemming, self.strict), self.index.postings.select("term", "file_id", "term_frequency")
        few = words.limit(NAMED_TERMS + 1).collect()
        if len(few) <= NAMED_TERMS:
            postings = postings.filter(F.col("term").isin(sorted({r.term for r in few})))
            words = F.broadcast(words.sparkSession.createDataFrame(few, words.schema))  # bounded by the line above
        rows = postings.join(words, "term")
        return rows.groupBy("file_id").agg(
            F.collect_set("leaf").alias("leaves"), F.array_sort(F.collect_set("term")).alias("matched_terms"), F.collect_list(F.struct("term_frequency", "document_frequency")).alias("hits")
        )

    def _test(self, node: Node) -> Column:
        match node:
            case Term():
                if self.strict:
                    return F.coalesce(F.array_contains("leaves", F.lit(self._numbers[id(node)])), F.lit(False))
                return F.col("leaves").isNotNull()
            case Phrase():
                return F.coalesce(F.size(f"phrase_{self._numbers[id(node)]}") > 0, F.lit(False))
            case Filter():
                return predicate(node, self.now_ms, self.zone)
            case And(a, b):
                return self._test(a) & self._test(b)
            case Or(a, b):
                return self._test(a) | self._test(b)
            case Not(a):
                return ~self._test(a)
        raise TypeError(node)

    def found(self) -> DataFrame:
        """Files of the scope that fit the query, with their matches, before ranking."""
        d = self.index.files.filter(in_scope(F.col("path"), self.scope))
        if self.terms:
            d = d.join(self.matches(), "file_id", "left")
        else:
            d = d.withColumns({"leaves": F.lit(None).cast("array<int>"), "matched_terms": F.lit(None).cast("array<string>"), "hits": F.lit(None).cast("array<struct<term_frequency:int,document_frequency:bigint>>")})
        if self.phrases:
            d = d.join(phrase_matches(self.index.postings, self.phrases), "file_id", "left")
        return d.filter(F.lit(False) if self.root is None else self._test(self.root))

    def total(self) -> DataFrame:
        """One row, total_count: files that fit, ranked or not."""
        return self.found().agg(F.count("*").alias("total_count"))

    def ranked(self) -> DataFrame:
        """All files that fit and can be ranked, with score; unordered."""
        d = self.found()
        n, mean = self.index.stats
        if not self.strict:
            d = d.filter(F.col("leaves").isNotNull())
        one = lambda h: bm25(h["term_frequency"], h["document_frequency"], F.col("doc_length"), n, mean)
        empty = F.array().cast("array<string>")
        lists = [F.col(f"phrase_{i}") for i in range(len(self.phrases))]
        starts = F.flatten(F.array(*[F.coalesce(c, F.array().cast("array<int>")) for c in lists])) if lists else F.array().cast("array<int>")
        said = [F.when(F.size(c) > 0, F.array(*[F.lit(w) for w in p.terms])) for c, p in zip(lists, self.phrases) if p.terms]
        d = d.withColumns(
            {
                "matched_terms": F.coalesce("matched_terms", empty), "filename": basename(F.col("path")), "phrase_positions": starts,
                "phrase_terms": F.array_distinct(F.flatten(F.array_compact(F.array(*said)))) if said else empty,
                "bm25": F.coalesce(F.aggregate("hits", F.lit(0.0), lambda a, h: a + one(h)), F.lit(0.0)),
            }
        )
        parts = {"phrase": F.size("phrase_positions").cast("double"), "filename": filename_signal(F.col("filename"), F.col("matched_terms")), "bm25": F.col("bm25"), "folder": folder_signal(F.col("path")), "recency": recency_signal(F.col("modified_time"), self.now_ms)}
        parts |= {k: f(d) for k, f in self.signals.items()}
        score = F.lit(0.0)
        for k, c in parts.items():
            score = score + self.weights.get(k, 1.0) * c
        return d.select("file_id", "path", "filename", "size", "modified_time", score.alias("score"), "bm25", "matched_terms", "phrase_terms", (F.size("phrase_positions") > 0).alias("phrase_match"), "phrase_positions")

    def top(self, limit: int = RESULT_LIMIT, order: str = "relevance") -> DataFrame:
        """The best files; another order sorts only these."""
        best = self.ranked().orderBy(F.desc("score"), F.asc("file_id")).limit(limit)
        return best if order == "relevance" else best.orderBy(*ORDERS[order]())

    def with_snippets(self, limit: int = RESULT_LIMIT) -> DataFrame:
        """The best files with snippets. The page is found when this is called; then only its texts are read."""
        from loomdex.operators.snippets import snippets

        best = self.top(limit)
        if limit <= NAMED_FILES:
            page = best.collect()
            best = best.sparkSession.createDataFrame(page, best.schema)
        texts = self.index.texts.select("file_id", "text")
        if limit <= NAMED_FILES:
            texts, best = texts.filter(F.col("file_id").isin([r.file_id for r in page])), F.broadcast(best)
        d = texts.join(best, "file_id")
        words = F.array_union("matched_terms", F.array(*[F.lit(t.value) for t in self.terms]).cast("array<string>"))
        return d.withColumn("snippets", snippets(F.col("text"), words, F.col("phrase_positions"))).drop("text")


def suggestions(terms: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """(rank, suggestion): filter keys whose name begins with the text, then index terms that do, in order; at most `limit`."""
    text = prefix.lower()
    keys = list(dict.fromkeys(v for k, v in SUGGESTED.items() if k.startswith(text))) if text else []
    spark = terms.sparkSession
    first = spark.createDataFrame([(i + 1, k) for i, k in enumerate(keys[:limit])], "rank int, suggestion string")
    if not text or len(keys) >= limit:
        return first
    # the few first terms are numbered in one array, not by a window over all
    few = terms.filter(F.startswith("term", F.lit(text))).select("term").distinct().orderBy("term").limit(limit - len(keys))
    rest = few.agg(F.array_sort(F.collect_list("term")).alias("t")).select(F.posexplode("t").alias("i", "suggestion"))
    return first.unionByName(rest.select((F.col("i") + len(keys) + 1).alias("rank"), "suggestion"))

"""Registered queries for the operators of the search engine, and their SQL.

The corpus of the search queries is `documents` (file_id = doc_id, its text tokenised here); the queries about the tables of an index
run over `files`, `terms`, `postings`, and those about changes over `events`.
"""

from __future__ import annotations

import contextlib
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.catalog import Index
from loomdex.functions import values as V
from loomdex.functions.analysis import STOP_WORDS, detect_language, is_stop_word, language_profiles, stem, stem_py
from loomdex.functions.text import SEPARATOR, _tables, normalise
from loomdex.operators import corpus as C
from loomdex.operators import postings as P
from loomdex.operators.signed_counts import HadoopFiles
from loomdex.operators.snippets import GAP, MOST, SIDE, highlight, hit_clusters
from loomdex.plans import search as S
from loomdex.plans.filters import predicate
from loomdex.plans.query import Phrase, parse
from loomdex.session import NOW_MS, _file_system, new_path, spread, table, written
from loomdex.sources.extractors import extracted
from loomdex.streaming.changes import coalesced, debounced, queue_progress

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# the corpus

_FILES_COLUMNS = f"""doc_id as file_id, path, coalesce({{length}}, 0) as size, modified_time, lang as language,
  case when doc_id % 3 = 0 then null else concat('Author ', cast(doc_id % 7 as varchar(20))) end as author,
  case when doc_id % 4 = 0 then null else {NOW_MS} - ((doc_id * 104729) % 900) * 86400000 end as created_at,
  cast(null as varchar(20)) as extension"""


def corpus_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr(*[x.strip() for x in _split(_FILES_COLUMNS.format(length="octet_length(text)"))])


def _split(columns: str) -> list[str]:
    """At commas outside of parentheses."""
    out, depth, now = [], 0, ""
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def corpus_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "text")


def corpus_postings(spark: SparkSession, d: str) -> DataFrame:
    """doc_id is unique."""
    return P.build_postings(spread(corpus_texts(spark, d)), unique_ids=True)


_built: dict[tuple, S.SearchIndex] = {}


def _state(spark: SparkSession, d: str) -> tuple:
    """The session, the folder, and the files of its documents."""
    fs, path = _file_system(spark, f"{d}/documents.parquet")
    status = fs.getFileStatus(path)
    parts = fs.listStatus(path) if status.isDirectory() else [status]
    return (spark.sparkContext.applicationId, d, *sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in parts))


def search_index(spark: SparkSession, d: str) -> S.SearchIndex:
    """The index of a folder's documents, written once a session for each state of the table's files."""
    key = _state(spark, d)
    if key not in _built:
        files, texts = corpus_files(spark, d), corpus_texts(spark, d)
        postings = written(P.by_term(corpus_postings(spark, d)), "postings")
        files = files.join(P.document_length(files, postings), "file_id")
        _built[key] = S.SearchIndex(written(files, "files"), written(P.document_frequency(postings), "terms"), postings, texts)
    return _built[key]


def _sql_text() -> str:
    src, dst, _, _ = _tables()
    q = lambda s: s.replace("'", "''")
    # the characters of the data whose decomposition is longer than one
    return f"lower(translate(replace(replace(replace(text, '\u0931', '\u0930\u093c'), '…', '...'), 'ﬁ', 'fi'), '{q(src)}', '{q(dst)}'))"


_F = f"select {_FILES_COLUMNS.format(length='octet_length(encode(text))')} from documents"
_TOKENS = f"""
n as (select doc_id as file_id, list_filter(regexp_split_to_array({_sql_text()}, '{SEPARATOR}'), lambda x: x <> '') as l from documents where text is not null),
w as (select file_id, unnest(l) as term, generate_subscripts(l, 1) - 1 as pos from n),
p as (select file_id, term, cast(count(*) as integer) as term_frequency, list(cast(pos as integer) order by pos) as positions from w group by file_id, term),
t as (select term, count(*) as document_frequency from p group by term),
f as (select a.*, coalesce(b.dl, 0) as doc_length, regexp_replace(path, '^.*/', '') as filename from ({_F}) a left join (select file_id, sum(term_frequency) as dl from p group by file_id) b using (file_id))"""


@query(f"with {_TOKENS} select file_id, term, term_frequency, positions from p")
def t2_postings(spark, d):
    return corpus_postings(spark, d)


@query(f"with {_TOKENS} select * from t")
def a2_document_frequency(spark, d):
    return P.document_frequency(corpus_postings(spark, d))


@query(f"with {_TOKENS} select file_id, cast(doc_length as integer) as doc_length from f")
def a3_document_length(spark, d):
    return P.document_length(corpus_files(spark, d), corpus_postings(spark, d))


@query(f"with {_TOKENS} select count(*) as n_files, round(avg(doc_length), 6) as mean_length, (select count(*) from t) as n_terms, (select count(*) from p) as n_postings from f")
def a4_corpus_stats(spark, d):
    i = search_index(spark, d)
    one = i.files.agg(F.count("*").alias("n_files"), F.round(F.avg("doc_length"), 6).alias("mean_length"), F.lit(1).alias("k"))
    return one.join(i.terms.agg(F.count("*").alias("n_terms"), F.lit(1).alias("k")), "k").join(i.postings.agg(F.count("*").alias("n_postings"), F.lit(1).alias("k")), "k").drop("k")


@query(f"with {_TOKENS} select row_number() over (order by encode(term)) as term_id, term, document_frequency from t")
def k4_term_ids(spark, d):
    return P.encoded(search_index(spark, d).postings)[0]


_STOP = " union all ".join(f"select '{lang}' as language, unnest(['{"', '".join(ws.split())}']) as term" for lang, ws in STOP_WORDS.items())


@query(f"with {_TOKENS}, s as ({_STOP}) select f.language, p.term, cast(sum(term_frequency) as bigint) as n from p join f using (file_id) join (select distinct * from s) s on s.language = lower(f.language) and s.term = p.term group by 1, 2")
def t4_stop_words(spark, d):
    i = search_index(spark, d)
    rows = i.postings.join(i.files.select("file_id", "language"), "file_id").filter(is_stop_word(F.col("term"), F.col("language")))
    return rows.groupBy("language", "term").agg(F.sum("term_frequency").alias("n"))


@query()
def t5_stems(spark, d):
    return search_index(spark, d).terms.select("term", stem(F.col("term")).alias("stem"))


@query()
def t6_language(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", detect_language(F.col("text"), language_profiles(table(spark, d, "lang_samples"))).alias("language"))


# every second passage is judged by profiles of the others
@query("select sample_id, case when language in ('eng', 'hin', 'mar') then language end as language from lang_samples where sample_id % 2 = 1")
def t6_held_out(spark, d):
    s = table(spark, d, "lang_samples")
    return s.filter("sample_id % 2 = 1").select("sample_id", detect_language(F.col("text"), language_profiles(s.filter("sample_id % 2 = 0"))).alias("language"))


WORDS = ["backup", "notes", "run", "कविता"]


def _fits(words: list[str]) -> str:
    parts = [f"select {i} as leaf, term, document_frequency from t where term = '{w}' or {f"starts_with(term, '{w}')" if len(w) > 1 else 'false'} or (abs(length(term) - {len(w)}) <= 1 and levenshtein(term, '{w}') <= 1)" for i, w in enumerate(words)]
    return " union all ".join(parts)


# DuckDB counts edits in bytes, so the SQL keeps to words in ASCII
@query(f"with {_TOKENS} {_fits(WORDS[:3])}")
def j1_expand(spark, d):
    return S.expand(search_index(spark, d).terms, WORDS[:3])


@query()
def j4_expand_stems(spark, d):
    return S.expand(search_index(spark, d).terms, ["running", "planned", "कविता"], stemming=True)


def _phrase_sql(words: list[str], name: str) -> str:
    first = " ".join(f"join p p{i} on p{i}.file_id = p0.file_id and p{i}.term = '{w}'" for i, w in enumerate(words) if i)
    lists = "p0.positions"
    for i in range(1, len(words)):
        lists = f"list_intersect({lists}, list_transform(p{i}.positions, lambda x: x - {i}))"
    return f"{name} as (select p0.file_id, list_sort({lists}) as starts from p p0 {first} where p0.term = '{words[0]}')"


PHRASE = ["backup", "schedule"]


@query(f"with {_TOKENS}, {_phrase_sql(PHRASE, 'h')} select file_id, starts from h where len(starts) > 0")
def j7_phrase(spark, d):
    m = S.phrase_matches(search_index(spark, d).postings, [Phrase(" ".join(PHRASE), tuple(PHRASE))])
    return m.filter(F.size("phrase_0") > 0).select("file_id", F.array_sort("phrase_0").alias("starts"))


def _search_sql(words: list[str], phrases: list[list[str]], test: str, strict: bool, select: str = "") -> str:
    """SQL of a search. test: condition over lv (leaves or null), ph0, ph1… (starts or null) and the columns of files."""
    ph = "".join(f", {_phrase_sql(w, f'h{i}')}" for i, w in enumerate(phrases))
    joins = " ".join(f"left join h{i} on h{i}.file_id = f.file_id" for i in range(len(phrases)))
    starts = " + ".join(f"coalesce(len(ph{i}), 0)" for i in range(len(phrases))) or "0"
    cols = "".join(f", h{i}.starts as ph{i}" for i in range(len(phrases)))
    fits = _fits(words) if words else "select 0 as leaf, term, document_frequency from t where false"
    name = "list_sum(list_transform(mt, lambda x: case when lower(filename) = x then 3.0 when starts_with(lower(filename), x || '.') then 2.0 when contains(lower(filename), x) then 1.0 else 0.0 end))"
    age = f"({NOW_MS} - modified_time)"
    best = f"""
select file_id, path, matched_terms, round(bm25, 6) as bm25, round(1000.0 * n_starts + 80 * filename_score + bm25 + 10 * folder + 5 * recency, 6) as score, n_starts > 0 as phrase_match from (
  select *, {starts} as n_starts, coalesce(mt, []) as matched_terms, coalesce(sc, 0.0) as bm25, coalesce({name}, 0.0) as filename_score,
    case when regexp_matches(lower(path), 'documents|desktop|downloads|projects') then 1 else 0 end as folder,
    case when {age} < 86400000 then 3 when {age} < 604800000 then 2 when {age} < 2592000000 then 1 else 0 end as recency
  from found {'' if strict else 'where lv is not null'})
order by score desc, file_id limit 50"""
    return f"""with {_TOKENS}, e as ({fits}), st as (select count(*) as n, coalesce(nullif(avg(doc_length), 0), 1) as mean from f),
m as (select p.file_id, list(distinct leaf) as lv, list_sort(list(distinct p.term)) as mt,
    sum(ln(1 + (n - document_frequency + 0.5) / (document_frequency + 0.5)) * term_frequency * 2.2 / (term_frequency + 1.2 * (0.25 + 0.75 * doc_length / mean))) as sc
  from p join e using (term) join f using (file_id), st group by p.file_id){ph},
found as (select * from (select f.*, m.lv, m.mt, m.sc{cols} from f left join m using (file_id) {joins}) where {test})
{select or best}"""


def _top(spark, d, text: str, **kw) -> DataFrame:
    return S.Search(search_index(spark, d), text, **kw).top().select("file_id", "path", "matched_terms", F.round("bm25", 6).alias("bm25"), F.round("score", 6).alias("score"), "phrase_match")


@query(_search_sql(["backup", "schedule"], [], "lv is not null", False))
def q_any_word(spark, d):
    return _top(spark, d, "backup schedule")


@query(_search_sql(["backup", "schedule"], [], "list_contains(lv, 0) and list_contains(lv, 1)", True))
def q_strict_and(spark, d):
    return _top(spark, d, "backup AND schedule", semantics="strict")


@query(_search_sql(["backup", "schedule"], [], "list_contains(lv, 0) and not coalesce(list_contains(lv, 1), false)", True))
def q_strict_not(spark, d):
    return _top(spark, d, "backup NOT schedule", semantics="strict")


@query(_search_sql(["backup"], [], "lv is not null and not regexp_matches(lower(path), '\\.pdf$')", False))
def q_reference_not(spark, d):
    return _top(spark, d, "backup NOT type:.PDF")


@query(_search_sql(["report"], [["backup", "schedule"], ["the", "editor", "has"]], "len(ph0) > 0 or (lv is not null and len(ph1) > 0)", False))
def q_phrases(spark, d):
    return _top(spark, d, '"backup schedule" OR (report AND "the editor has")')


@query(_search_sql([], [["backup", "schedule"]], "len(ph0) > 0", True))
def q_strict_phrase(spark, d):
    return _top(spark, d, '"backup schedule"', semantics="strict")


_FILTERED = "lv is not null and regexp_extract(lower(path), '\\.[^.]*$') = '.pdf' and size > 1024 and contains(lower(path), 'documents') and modified_time < 1727740800000 and coalesce(contains(lower(author), 'author'), false)"


@query(_search_sql(["travel"], [], _FILTERED, False))
def q_filters(spark, d):
    return _top(spark, d, 'travel type:pdf size>1KB folder:Documents before:2024-10-01 author:"author"')


@query(_search_sql(["travel"], [], "lv is not null and starts_with(lower(path), '/home/u/desktop')", False))
def q_scope(spark, d):
    return _top(spark, d, "travel", scope=["/home/u/Desktop"])


@query(_search_sql(["travel"], [["backup", "schedule"]], "len(ph0) > 0 or lv is not null", False, "select count(*) as total_count from found"))
def q_total(spark, d):
    return S.Search(search_index(spark, d), '"backup schedule" OR travel').total()


@query("with x as (" + _search_sql(["travel"], [], "lv is not null", False) + ") select x.file_id, row_number() over (order by modified_time desc, x.file_id) as place from x join (select doc_id as file_id, modified_time from documents) using (file_id)")
def o3_newest(spark, d):
    from pyspark.sql import Window

    best = S.Search(search_index(spark, d), "travel").top()
    # at most fifty rows
    return best.select("file_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("modified_time"), "file_id")).cast("long").alias("place"))


@query(f"""with {_TOKENS}, s as (select term from t where starts_with(term, 're') order by encode(term) limit 10)
select cast(row_number() over (order by encode(term)) as integer) as rank, term as suggestion from s""")
def o5_suggestions(spark, d):
    return S.suggestions(search_index(spark, d).terms, "re")


# words of the texts as they stand with their offsets in code points; what Python takes for white space
_WORD_SQL = "[\\p{L}\\p{N}\\p{M}]+"
_BLANK_SQL = "\\s\\v\\x1c-\\x1f\\x85\\p{Z}"
_OFFSETS = f"""
pieces as (select doc_id as file_id, text, unnest(regexp_extract_all(text, '{_WORD_SQL}|[^\\p{{L}}\\p{{N}}\\p{{M}}]+')) as piece, generate_subscripts(regexp_extract_all(text, '{_WORD_SQL}|[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), 1) as i from documents where {{where}}),
spans as (select file_id, piece, i, cast(coalesce(sum(length(piece)) over (partition by file_id order by i rows between unbounded preceding and 1 preceding), 0) as bigint) as offs from pieces),
found_words as (select file_id, offs, {_sql_text().replace('text', 'piece')} as word, row_number() over (partition by file_id order by i) - 1 as number from spans where regexp_matches(piece, '^{_WORD_SQL}$'))"""
_CLUSTERS = f"""
gaps as (select *, case when offs - lag(offs) over (partition by file_id order by offs) > {GAP} then 1 else 0 end as new from hits),
runs as (select *, sum(new) over (partition by file_id order by offs rows unbounded preceding) as run from gaps)"""
SNIPPETS = 'travel "backup schedule"'


@query(f"""with {_TOKENS}, {_phrase_sql(PHRASE, 'h0')}, x as ({_search_sql(["travel"], [PHRASE], "lv is not null and len(ph0) > 0", False)}), {_OFFSETS.replace('{where}', 'doc_id in (select file_id from x)')},
hits as (select distinct w.file_id, w.offs from found_words w join x using (file_id) join h0 using (file_id) where list_contains(x.matched_terms, w.word) or w.word = 'travel' or list_contains(h0.starts, cast(w.number as integer))), {_CLUSTERS},
centres as (select file_id, run, list_sort(list(offs))[len(list(offs)) // 2 + 1] as c from runs where run < {MOST} group by file_id, run),
sides as (select k.file_id, run, text, greatest(0, c - {SIDE}) as a, least(length(text), c + {SIDE}) as b from centres k join documents on doc_id = k.file_id),
wide as (select *, a - length(regexp_extract(substr(text, 1, a), '[^{_BLANK_SQL}]*$')) as begins, b + length(regexp_extract(substr(text, b + 1), '^[^{_BLANK_SQL}]*')) as ends from sides),
cuts as (select file_id, run, case when begins > 0 then '…' else '' end || trim(regexp_replace(substr(text, begins + 1, ends - begins), '[{_BLANK_SQL}]+', ' ', 'g')) || case when ends < length(text) then '…' else '' end as s from wide)
select file_id, list(s order by run) as snippets from cuts group by file_id""")
def n1_snippets(spark, d):
    return S.Search(search_index(spark, d), SNIPPETS).with_snippets().select("file_id", "snippets")


@query()
def t15_highlight(spark, d):
    best = S.Search(search_index(spark, d), 'travel "backup schedule"').with_snippets()
    return best.select("file_id", F.explode("snippets").alias("s"), "phrase_terms", "matched_terms").select("file_id", highlight(F.col("s"), F.col("phrase_terms"), F.col("matched_terms")).alias("parts"))


@query(f"""with {_OFFSETS.replace('{where}', 'text is not null')}, hits as (select file_id, offs from found_words where word = 'backup'), {_CLUSTERS}
select file_id, cast(count(*) as integer) as n_hits, cast(min(offs) as integer) as first, cast(max(offs) as integer) as last from runs group by file_id, run""")
def n4_clusters(spark, d):
    return spread(corpus_texts(spark, d)).select("file_id", F.inline(hit_clusters(F.col("text"), F.array(F.lit("backup")))))


@query(f"with {_TOKENS} select term, round(ln(1 + (n - document_frequency + 0.5) / (document_frequency + 0.5)), 9) as idf from t, (select count(*) as n from f)")
def r1_idf(spark, d):
    i = search_index(spark, d)
    return i.terms.select("term", F.round(S.idf(F.col("document_frequency"), F.lit(i.stats[0])), 9).alias("idf"))


# tables of an index

_FILTERS = {
    "f_type": ("type:pdf", "coalesce(lower(coalesce(extension, regexp_extract(regexp_replace(path, '^.*[/\\\\]', ''), '^.+(\\.[^.]*)$', 1))) = '.pdf', false)"),
    "f_dot": ("type:.pdf", "coalesce(lower(coalesce(extension, regexp_extract(regexp_replace(path, '^.*[/\\\\]', ''), '^.+(\\.[^.]*)$', 1))) = '.pdf', false)"),
    "f_folder": ("folder:projects", "coalesce(contains(lower(path), 'projects'), false)"),
    "f_before": ("before:2023-06-01", "coalesce(modified_time < 1685577600000, false)"),
    "f_after": ("after:2023-06-01", "coalesce(modified_time > 1685577600000, false)"),
    "f_modified": ("modified:last30days", f"coalesce(modified_time >= {NOW_MS - 30 * V.DAY} and modified_time < {NOW_MS + V.DAY}, false)"),
    "f_created": ("created>=2022-01-01", "coalesce(coalesce(created_at, modified_time) >= 1640995200000, false)"),
    "f_size": ("size<=2.5kb", "coalesce(size <= 2560, false)"),
    "f_author": ("author:to", "coalesce(contains(lower(author), 'to'), false)"),
    "f_language": ("language:ENG", "coalesce(lower(language) = 'eng', false)"),
    "f_unknown": ("http:x", "true"),
}


@query("select file_id, " + ", ".join(f"{sql} as {k}" for k, (_, sql) in _FILTERS.items()) + " from files")
def f1_filters(spark, d):
    return table(spark, d, "files").select("file_id", *[predicate(parse(text).root, NOW_MS).alias(k) for k, (text, _) in _FILTERS.items()])


RULES = [("Trash/", "folder"), ("*.bak", "glob"), ("**/Backups/**", "glob"), ("report_*", "glob"), ("*_1?.txt", "glob")]


@query("""with s as (select file_id, replace(path, '\\', '/') as p, regexp_replace(replace(path, '\\', '/'), '^.*/', '') as b from files)
select file_id, list_contains(string_split(p, '/'), 'Trash') or regexp_matches(b, '^[^/]*\\.bak$') or regexp_matches(p, '^(.*/)?Backups/.*$') or regexp_matches(b, '^report_[^/]*$') or regexp_matches(b, '^[^/]*_1[^/]\\.txt$') as ignored from s""")
def f13_ignored(spark, d):
    return table(spark, d, "files").select("file_id", C.ignored(F.col("path"), RULES).alias("ignored"))


@query("""select file_id, regexp_replace(replace(path, '\\', '/'), '^.*/', '') as base, regexp_extract(replace(path, '\\', '/'), '^(.*)/[^/]*$', 1) as dir,
  lower(regexp_extract(regexp_replace(replace(path, '\\', '/'), '^.*/', ''), '^.+(\\.[^.]*)$', 1)) as ext,
  case when extension in ('.txt', '.md', '.docx') then 'text' when extension in ('.html') then 'code' when extension in ('.pdf') then 'pdf' else 'default' end as category from files""")
def t8_paths(spark, d):
    p = F.col("path")
    return table(spark, d, "files").select("file_id", V.basename(p).alias("base"), V.dirname(p).alias("dir"), V.extension(p).alias("ext"), V.file_category(F.col("extension")).alias("category"))


@query(f"""with s as (select file_id, size, ({NOW_MS} - modified_time) // 1000 as sec, doc_length from files)
select file_id, case when size < 1024 then size || ' B' when size < 1048576 then printf('%.1f KB', round(size / 1024.0, 1)) else printf('%.1f MB', round(size / 1048576.0, 1)) end as bytes,
  case when sec < 60 then 'just now' when sec < 3600 then (sec // 60) || 'm ago' when sec < 86400 then (sec // 3600) || 'h ago' when sec < 30 * 86400 then (sec // 86400) || 'd ago'
       when sec // 86400 // 30 < 12 then (sec // 86400 // 30) || 'mo ago' else (sec // 86400 // 30 // 12) || 'y ago' end as age,
  case when doc_length < 1000 then doc_length || 'ms' else printf('%.1fs', round(doc_length / 1000.0, 1)) end as duration from s""")
def t9_formats(spark, d):
    return table(spark, d, "files").select("file_id", V.format_bytes(F.col("size")).alias("bytes"), V.format_relative(F.col("modified_time"), NOW_MS).alias("age"), V.format_duration(F.col("doc_length")).alias("duration"))


@query("select file_id, left(content_hash, 12) || '…' || right(content_hash, 8) as preview from files where content_hash is not null")
def t16_hash_preview(spark, d):
    return table(spark, d, "files").filter("content_hash is not null").select("file_id", V.hash_preview(F.col("content_hash")).alias("preview"))


@query("select doc_id, sha256(text) as content_hash from documents where text is not null")
def s16_content_hash(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("select content_hash, count(*) as n_files, cast(sum(size) as bigint) as total_size, cast(greatest(0, sum(size) - max(size)) as bigint) as wasted from files where content_hash is not null and content_hash <> '' group by 1 having count(*) > 1")
def a8_duplicate_groups(spark, d):
    return C.duplicate_groups(table(spark, d, "files"))


@query("select content_hash, file_id, path from files where content_hash in (select content_hash from files where content_hash <> '' group by 1 having count(*) > 1)")
def j14_duplicate_members(spark, d):
    return C.duplicate_members(table(spark, d, "files"))


@query("select cast(sum(w) as bigint) as wasted from (select greatest(0, sum(size) - max(size)) as w from files where content_hash <> '' group by content_hash having count(*) > 1)")
def a9_wasted(spark, d):
    return C.wasted_total(table(spark, d, "files"))


@query("select term_id, term from terms t where not exists (select 1 from postings p where p.term_id = t.term_id)")
def j10_orphan_terms(spark, d):
    return C.orphan_terms(table(spark, d, "terms"), table(spark, d, "postings")).select("term_id", "term")


@query("select distinct term_id, file_id from postings p where not exists (select 1 from files f where f.file_id = p.file_id) or not exists (select 1 from terms t where t.term_id = p.term_id)")
def j11_orphan_postings(spark, d):
    return C.orphan_postings(*[table(spark, d, t) for t in ("postings", "files", "terms")])


# the postings of every fiftieth file are lost
@query("select file_id, path from files f where not exists (select 1 from postings p where p.file_id = f.file_id and p.file_id % 50 <> 0)")
def j12_partial_files(spark, d):
    return C.partial_files(table(spark, d, "files"), table(spark, d, "postings").filter("file_id % 50 != 0")).select("file_id", "path")


_SOUND = "exists (select 1 from files f where f.file_id = p.file_id) and exists (select 1 from terms t where t.term_id = p.term_id)"


@query(f"select term_id, file_id, term_frequency, written_at from postings p where {_SOUND}")
def j13_repaired_postings(spark, d):
    return C.repaired(*[table(spark, d, t) for t in ("files", "terms", "postings")])[1].select("term_id", "file_id", "term_frequency", "written_at")


@query(f"select term_id, term from terms where term_id in (select p.term_id from postings p where {_SOUND})")
def j13_repaired_terms(spark, d):
    return C.repaired(*[table(spark, d, t) for t in ("files", "terms", "postings")])[0].select("term_id", "term")


@query("""select * from (
select 'orphan_term' as type, count(*) as n from terms t where not exists (select 1 from postings p where p.term_id = t.term_id)
union all select 'orphan_posting', count(*) from (select distinct term_id, file_id from postings p where not exists (select 1 from files f where f.file_id = p.file_id) or not exists (select 1 from terms t where t.term_id = p.term_id))
union all select 'missing_file', count(*) from files f where size > 0 and not exists (select 1 from postings p where p.file_id = f.file_id)
union all select 'duplicate_metadata', count(*) from (select path from files where path is not null group by 1 having count(*) > 1)
union all select 'invalid_metadata', cast((select count(*) from files) <> 99 as int) + cast((select count(*) from terms) <> 99 as int)) where n > 0""")
def a11_integrity(spark, d):
    meta = spark.range(1).select(F.lit(99).cast("long").alias("total_indexed_files"), F.lit(99).cast("long").alias("total_indexed_terms"))
    return C.integrity_report(*[table(spark, d, t) for t in ("files", "terms", "postings")], meta)


_DISK = "select path, case when file_id % 7 = 0 then size + 1 else size end as size, modified_time from files where file_id % 10 <> 0"


@query(f"""with d as (select path, max((modified_time, size)) as v from ({_DISK}) group by path), k as (select path, max((modified_time, size)) as v from files group by path)
select coalesce(d.path, k.path) as path, case when d.path is null then 'delete' else 'index' end as task from d full join k on d.path = k.path where d.v is distinct from k.v""")
def w4_sync(spark, d):
    f = table(spark, d, "files")
    disk = f.filter("file_id % 10 <> 0").select("path", F.when(F.col("file_id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "modified_time")
    return C.sync_tasks(disk, f.select("path", "size", "modified_time"))


@query(f"""with d as (select path, max((modified_time, size)) as v from ({_DISK}) group by path), k as (select path, max((modified_time, size)) as v from files group by path)
select count(*) filter (d.path is not null) as to_index, count(*) filter (d.path is null) as to_delete from d full join k on d.path = k.path where d.v is distinct from k.v""")
def a12_sync_summary(spark, d):
    return C.sync_summary(w4_sync(spark, d))


@query("select file_id, path, author from files where language = 'eng' and extension = '.pdf'")
def f12_metadata(spark, d):
    return C.by_metadata(table(spark, d, "files"), language="eng", extension=".pdf").select("file_id", "path", "author")


@query("select file_id, path from files where starts_with(path, '/home/u/Documents/')")
def k10_folder_files(spark, d):
    return table(spark, d, "files").filter(C.under_folder(F.col("path"), "/home/u/Documents")).select("file_id", "path")


@query("select file_id, path from files where starts_with(lower(path), '/home/u/documents/')")
def k10_folder_files_reference(spark, d):
    return table(spark, d, "files").filter(C.under_folder(F.col("path"), "/home/u/documents", "reference")).select("file_id", "path")


@query("select file_id, path, size from files where path not in (select path from deleted_files) union all select file_id, path, -1 as size from (select distinct file_id, path from deleted_files)")
def k1_upsert(spark, d):
    new = table(spark, d, "deleted_files").select("file_id", "path", F.lit(-1).cast("long").alias("size")).distinct()
    return C.upsert_files(table(spark, d, "files").select("file_id", "path", "size"), new)


@query("""with gone as (select file_id from files where path in (select path from deleted_files))
select term_id, file_id, term_frequency from postings p where file_id is null or not exists (select 1 from gone where gone.file_id = p.file_id)""")
def k3_delete(spark, d):
    return C.without_files(table(spark, d, "files"), table(spark, d, "postings"), table(spark, d, "deleted_files"))[1].select("term_id", "file_id", "term_frequency")


# extraction: the texts as bytes of files

_CLEAN = "regexp_replace(replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(0), ''), '^[{b}]+|[{b}]+$', '', 'g')"


def _extracted(docs: DataFrame, extension: str, content) -> DataFrame:
    d = docs.filter("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.lit(extension).alias("extension"), content.cast("binary").alias("content"))
    return extracted(spread(d)).select(F.col("path").cast("long").alias("doc_id"), "text", "author", "created_at", "error")


@query(f"select doc_id, {_CLEAN.format(b=_BLANK_SQL)} as text, cast(null as varchar) as author, cast(null as bigint) as created_at, cast(null as varchar) as error from documents where text is not null")
def s5_markdown(spark, d):
    return _extracted(table(spark, d, "documents"), ".md", F.col("text"))


@query(f"select doc_id, {_CLEAN.format(b=_BLANK_SQL)} as text, 'Ada & Bo' as author, 1704067200000 as created_at, cast(null as varchar) as error from documents where text is not null")
def s6_html(spark, d):
    safe = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    head = "<html><head><title>t</title><meta name='author' content='Ada &amp; Bo'><meta name='date' content='2024-01-01'></head><body><nav>n</nav><script>var a = '</p>';</script><p>"
    return _extracted(table(spark, d, "documents"), ".html", F.concat(F.lit(head), safe, F.lit("</p><style>p {}</style><footer>f</footer></body></html>")))


@query("select doc_id, cast(null as varchar) as text, 'Invalid' as kind, 'corrupted' as category from documents where text is not null")
def s8_broken_files(spark, d):
    """Texts that say they are PDF: each is a failure of its own, none ends the job."""
    e = _extracted(table(spark, d, "documents"), ".pdf", F.col("text"))
    return e.select("doc_id", "text", F.substring("error", 1, 7).alias("kind"), V.failure_category(F.col("error")).alias("category"))


# an index on disk: the documents as a folder of files


def _on_disk(spark: SparkSession, d: str) -> tuple[Index, str]:
    home = new_path(spark, "catalog")
    _write_files(table(spark, d, "documents"), f"{home}/files")
    index = Index(spark, f"{home}/index", clock=lambda: NOW_MS)
    index.add_folder(f"{home}/files")
    index.start_indexing()
    return index, f"{home}/files"


_disk: dict[tuple, tuple[Index, str]] = {}


def _kept_on_disk(spark: SparkSession, d: str) -> tuple[Index, str]:
    """Written once a session for each state of the table's files; for queries that leave it as it was."""
    key = _state(spark, d)
    if key not in _disk:
        _disk[key] = _on_disk(spark, d)
    return _disk[key]


def _write_files(docs: DataFrame, folder: str) -> None:
    """A file a document, as Spark's text writer has it, with a line feed at the end. Mounted folders get a subfolder for a thousand ids."""
    if not HadoopFiles(docs.sparkSession, folder).mounted:
        docs.select(F.col("text").alias("value"), "doc_id").write.mode("append").partitionBy("doc_id").text(folder)
        return
    home = re.sub("^file:/+", "/", folder)
    os.makedirs(home, exist_ok=True)

    def run(batches):
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                path = f"{home}/{k // 1000}/doc_id={k}.txt"
                try:
                    f = open(path, "wb")
                except FileNotFoundError:
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    f = open(path, "wb")
                with f:
                    f.write((t or "").encode() + b"\n")
            yield b.select([0])

    spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long").write.format("noop").mode("overwrite").save()


def _delete_files(docs: DataFrame, folder: str, files: HadoopFiles) -> None:
    """The files of documents that _write_files made; those of mounted folders where the rows are."""
    if not files.mounted:
        for r in docs.select("doc_id").toLocalIterator():
            files.delete(f"{folder}/doc_id={r[0]}")
        return
    home = re.sub("^file:/+", "/", folder)

    def run(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                with contextlib.suppress(FileNotFoundError):
                    os.remove(f"{home}/{k // 1000}/doc_id={k}.txt")
            yield b

    docs.select("doc_id").mapInArrow(run, "doc_id long").write.format("noop").mode("overwrite").save()


def _doc_id():
    return F.regexp_extract("path", r"doc_id=(-?\d+)[./]", 1).cast("long").alias("doc_id")


@query(f"with {_TOKENS} select file_id as doc_id, cast(doc_length as integer) as doc_length, '.txt' as extension from f")
def c9_indexed(spark, d):
    return _kept_on_disk(spark, d)[0].table("files").select(_doc_id(), "doc_length", "extension")


@query(f"""with {_TOKENS}, q as (select term, count(*) as document_frequency from p where file_id % 10 <> 0 and file_id % 7 <> 0 group by term)
select term, document_frequency + (select count(*) from documents where doc_id % 10 <> 0 and doc_id % 7 = 0) * (term = 'rewritten')::int as document_frequency from (select * from q where term <> 'rewritten' union all select 'rewritten', coalesce((select document_frequency from q where term = 'rewritten'), 0))""")
def c9_resynced(spark, d):
    """Every tenth file is deleted and every seventh rewritten before the second run; terms come from both runs' segments."""
    index, folder = _on_disk(spark, d)
    docs = table(spark, d, "documents").select("doc_id", "text")
    _delete_files(docs.filter("doc_id % 10 = 0 or doc_id % 7 = 0"), folder, index.files)
    _write_files(docs.filter("doc_id % 10 != 0 and doc_id % 7 = 0").withColumn("text", F.lit("rewritten")), folder)
    index.start_indexing()
    return index.table("index_terms")


@query(f"with {_TOKENS} select 'index_terms' as name, count(*) as n from t union all select 'index_postings', count(*) from p union all select 'files', count(*) from f union all select 'terms', count(*) from t union all select 'postings', count(*) from p union all select 'healthy', 0")
def k18_restored(spark, d):
    """Exported, deleted, and imported again; beside its own tables the backup has terms and postings by id, and the index verifies."""
    index, folder = _kept_on_disk(spark, d)
    backup = f"{folder}-backup"
    index.export_backup(backup)
    index.delete_index()
    index.import_backup(backup)
    n = {t: index.table(t).count() for t in ("index_terms", "index_postings", "files")} | {t: spark.read.parquet(f"{backup}/{t}").count() for t in ("terms", "postings")}
    # files without words have no postings; nothing else may be found
    n["healthy"] = index.verify().filter("type != 'missing_file'").count()
    return spark.createDataFrame(list(n.items()), "name string, n long")


# changes, failures and runs

_MESSAGES = ["EACCES: permission denied", "file is Encrypted", "unable to deserialize xref", "resource busy or locked", "not supported", "something else"]
_MESSAGE = "case event_id % 6 " + " ".join(f"when {i} then '{m}'" for i, m in enumerate(_MESSAGES)) + " end"


@query(f"""with e as (select concat('/u/', cast(user_id as varchar(20))) as path, ts, {_MESSAGE} as message from events where event_type = 'error'),
g as (select path, max(struct_pack(ts := ts, message := message)) as l, cast(count(*) - 1 as integer) as retry_count from e group by path)
select path, case when l.message like 'EACCES%' then 'permission_denied' when l.message like '%Encrypted%' then 'encrypted' when l.message like '%deserialize%' then 'corrupted' when l.message like '%locked' then 'locked' when l.message = 'not supported' then 'unsupported' else 'extraction_failed' end as category,
  l.message as message, epoch_us(l.ts) // 1000 as occurred_at, retry_count from g""")
def k11_failures(spark, d):
    e = table(spark, d, "events").filter("event_type = 'error'").select(F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"), "ts", F.expr(_MESSAGE).alias("message"))
    return C.failure_rows(e).withColumn("occurred_at", F.unix_millis(F.col("occurred_at").cast("timestamp")))


@query(f"""with e as (select concat('/u/', cast(user_id as varchar(20))) as path, ts from events where event_type = 'error')
select path, epoch_us(max(ts)) // 1000 as occurred_at from e group by path order by max(ts) desc, path limit 20""")
def o4_recent_failures(spark, d):
    return k11_failures(spark, d).orderBy(F.desc("occurred_at"), "path").limit(20).select("path", "occurred_at")


_EVENTS = "select ts, concat('/u/', cast(user_id as varchar(20))) as path, case event_type when 'error' then 'delete' else 'index' end as event from events"


@query(f"""with e as ({_EVENTS}), g as (select distinct ts from e), n as (select ts, case when ts - lag(ts) over (order by ts) < interval 60 second then 0 else 1 end as new from g),
s as (select ts, sum(new) over (order by ts) as flush from n), b as (select flush, max(ts) + interval 60 second as flush_at from s group by flush)
select flush_at, path, max((ts, event))[2] as event, count(*) as n_events from e join s using (ts) join b using (flush) group by flush_at, path""")
def w2_debounce(spark, d):
    e = table(spark, d, "events").select("ts", F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"), F.when(F.col("event_type") == "error", "delete").otherwise("index").alias("event"))
    return debounced(e, "60 seconds")


@query(f"select path, case when bool_or(event = 'index') then 'index' else 'delete' end as task from ({_EVENTS}) group by path")
def w3_coalesce(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"), F.when(F.col("event_type") == "error", "delete").otherwise("index").alias("task"))
    return coalesced(e)


@query("""with t as (select value > 10 as done, event_type <> 'error' as ix from events)
select count(*) filter (done) as processed, count(*) as total, count(*) filter (done and ix) as indexed_files, cast(floor(100.0 * count(*) filter (done) / count(*) + 0.5) as integer) as percent from t""")
def w9_progress(spark, d):
    return queue_progress(table(spark, d, "events").select((F.col("value") > 10).alias("done"), F.when(F.col("event_type") == "error", "delete").otherwise("index").alias("task")))


_RUNS = "select o_orderkey as id, o_custkey as part, epoch_ms(o_orderdate) as completed_at, cast(floor(o_totalprice) as bigint) as duration_ms from orders"


@query(f"""with r as ({_RUNS}) select id, cast(floor((sum(duration_ms) over w + duration_ms) / (count(*) over w + 1) + 0.5) as bigint) as average_ms
from r window w as (partition by part order by completed_at, id rows between 18 preceding and current row)""")
def a10_average_durations(spark, d):
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("part"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("completed_at"), F.floor("o_totalprice").alias("duration_ms"))
    return C.average_durations(r, "part")


# indexes of none to seven files a customer and of ninety-odd, with failures beside them; the share is of the files, and only where there are some
@query(f"""with r as (select o_custkey as id, max(o_orderkey) % 3 as k, count(*) filter (o_orderstatus = 'O') as n, count(*) filter (o_orderstatus = 'F') as bad, max(epoch_ms(o_orderdate)) as t from orders group by 1),
i as (select id, t, case k when 0 then n else n + 90 * (k - 1) end as n, bad from r)
select id, n, bad, case when n > 0 and bad > 0.1 * n then 'error' when bad > 0 or {NOW_MS} - t > 86400000 then 'warning' else 'healthy' end as health from i""")
def a14_health(spark, d):
    o = F.col("o_orderstatus")
    r = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg((F.max("o_orderkey") % 3).alias("k"), F.count_if(o == "O").alias("n"), F.count_if(o == "F").alias("bad"), F.max(F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("t"))
    r = r.withColumn("n", F.when(F.col("k") == 0, F.col("n")).otherwise(F.col("n") + 90 * (F.col("k") - 1)))
    return r.select("id", "n", "bad", C.health(F.col("n"), F.col("bad"), F.lit(0), F.lit("indexed"), F.col("t"), NOW_MS).alias("health"))


@query("select l_orderkey as id, l_linenumber as line, floor(cast(l_quantity as double) * (case l_linenumber % 3 when 0 then 1 when 1 then 1024 else 1048576 end) + 0.5) as bytes from lineitem")
def t13_sizes(spark, d):
    literal = F.concat(F.col("l_quantity").cast("double").cast("string"), F.element_at(F.array(F.lit(" b"), F.lit("KB"), F.lit(" mb ")), (F.col("l_linenumber") % 3 + 1).cast("int")))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), V.size_of(literal).cast("double").alias("bytes"))

"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm import language, packing, reading, survivorship, term_stats, tokenizer
from loomdex.llm.labels import language_code
from loomdex.session import spread, table, written


def _marked(spark: SparkSession, d: str) -> DataFrame:
    names = written(term_stats.term_names(table(spark, d, "terms")), "names")
    return term_stats.marked(term_stats.counts_of(table(spark, d, "postings"), names), names)


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).filter("mark is not null").select("term", "mark")


def dictionaries(spark: SparkSession, d: str) -> language.Dictionaries:
    """Of the labelled samples, extended by a bounded draw of labelled files."""
    samples = language.bounded_samples(table(spark, d, "lang_samples"), language_code(F.col("language")), F.col("text"))
    samples += language.bounded_samples(table(spark, d, "graded_samples"), F.lit("eng"), F.col("text"))
    return language.Dictionaries(samples).extended(language.sample_documents(table(spark, d, "extracted_content"), table(spark, d, "files")))


def p3_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.language_segments(spread(table(spark, d, "extracted_content")), dictionaries(spark, d))


def p3_offsets(spark: SparkSession, d: str) -> DataFrame:
    """By file: texts, code points in their passages, and where the last passage ends; passages that overlap or leave out anything give other sums."""
    s = p3_segments(spark, d).groupBy("file_id").agg(F.count_if(F.col("seq") == 0).alias("n_texts"), F.sum(F.col("end") - F.col("begin")).alias("n_chars"), F.max("end").cast("long").alias("last"))
    return s.select("file_id", "n_texts", "n_chars", "last")


def p3_languages(spark: SparkSession, d: str) -> DataFrame:
    return language.document_languages(p3_segments(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return language.unnamed_languages(spread(table(spark, d, "extracted_content")), table(spark, d, "files"), dictionaries(spark, d))


def p5_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.surviving_files(table(spark, d, "files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.surviving_files(table(spark, d, "files")).select("content_hash", "file_id")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_corpus(spread(table(spark, d, "documents")))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.decode_corpus(tokenizer.encode_corpus(spread(table(spark, d, "documents"))))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return packing.pack(tokenizer.count_tokens(spread(docs), ["doc_id"]), n_items=docs.count())


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d))


def p7_faults(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents"))
    sized = written(tokenizer.count_tokens(docs, ["doc_id"]), "sizes")
    return packing.faults(packing.pack(sized), sized)


def _levels(spark: SparkSession, d: str, keep: list[str]) -> DataFrame:
    graded = language.bounded_samples(table(spark, d, "graded_samples"), F.col("level"), F.col("text"), reading.SAMPLES_PER_LEVEL)
    labelled = language.bounded_samples(table(spark, d, "lang_samples"), language_code(F.col("language")), F.col("text"), reading.SAMPLES_PER_LANGUAGE)
    model, _ = reading.train(graded, labelled)
    return reading.reading_levels(spread(table(spark, d, "documents")), model, keep)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.demanding(_levels(spark, d, ["doc_id"])).select("doc_id")


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d, ["doc_id"])


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    return reading.profile(_levels(spark, d, ["source"]))


# DuckDB has no NFKD: accents, full-width forms and the two ligatures of the data are named one by one
_WIDE, _NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))).replace("＇", ""), "".join(map(chr, range(0x21, 0x7F))).replace("'", "")
_P1 = f"""
with n as (select distinct term_id, regexp_replace(lower(case when regexp_matches(term, '[\u0900-\u097f]') then term else strip_accents(nfc_normalize(replace(replace(translate(term, '{_WIDE}', '{_NARROW}'), 'ﬁ', 'fi'), 'ﬂ', 'fl'))) end), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') as term from terms where term is not null),
names as (select * from n where term <> ''),
r as (select term_id, file_id, coalesce(written_at, -1) as w,
        greatest(coalesce(case when len(positions) > 0 then len(positions) end, term_frequency, 1), 1) as occ
      from postings where term_id is not null and file_id is not null),
v as (select term_id, file_id, max(struct_pack(w := w, occ := occ)) as v from r group by all),
c as (select term, count(distinct file_id) as files, sum(v.occ) as occ from v join names using (term_id) group by term),
m as (select term, cast(coalesce(any_value(occ), 0) as bigint) as occurrences, coalesce(any_value(files), 0) as files from (select distinct term from names) left join c using (term) group by term)
"""
_P1_MARK = "case when files < 3 then 'rare' when files > 0.2 * (select count(distinct file_id) from r) then 'common' end as mark"
P1_TERMS_SQL = f"{_P1} select term, occurrences, files, {_P1_MARK} from m"
P1_FOUND_SQL = f"{_P1} select * from (select term, {_P1_MARK} from m) where mark is not null"

_NO = ", ".join(f"'{v}'" for v in ["", "-", "--", "?", "??", "n/a", "na", "none", "null", "unknown", "pending", "xx", "und", "zxx"])
_P5 = f"""
with h as (select *, regexp_extract(lower(content_hash), '^\\s*(sha-?256:|0x)?([0-9a-f]{{64}})\\s*$', 2) as h,
    replace(path, '\\', '/') as p from files where content_hash is not null),
s as (select h as content_hash, file_id, path,
    case when language is not null and lower(trim(language)) not in ({_NO}) then language end as language,
    case when author is not null and lower(trim(author)) not in ({_NO}) then author end as author, created_at,
    case when extension is not null and lower(trim(extension)) not in ({_NO}) then extension end as extension,
    case when modified_time between 315532800000 and indexed_at then modified_time end as modified_time,
    case when regexp_matches(p, '(^|/)(Backups|backup-disk|Trash|\\.cache|tmp|Temp)/') or regexp_matches(p, ' \\(\\d+\\)\\.\\w+$| - Copy( \\d+)?\\.\\w+$|/Copy \\d+ of |\\.bak$|~$') then 0 else 1 end as standing
  from h where h <> ''),
g as (select content_hash from s group by 1 having count(distinct file_id) > 1),
k as (select *, (language is not null)::int + (author is not null)::int + (created_at is not null)::int + (extension is not null)::int as n, coalesce(modified_time, -1) as t
  from s semi join g using (content_hash))
"""
P5_FOUND_SQL = f"{_P5} select content_hash, file_id from (select *, row_number() over (partition by content_hash order by n desc, standing desc, t desc, file_id desc) as rn from k) where rn = 1"
_BEST = "first({0} order by ({0} is not null)::int desc, standing desc, t desc, n desc, file_id desc) as {0}"
P5_SURVIVORS_SQL = f"""{_P5}
select content_hash, {', '.join(_BEST.format(c) for c in ('language', 'author', 'created_at', 'extension'))},
  first(file_id order by n desc, standing desc, t desc, file_id desc) as file_id, first(path order by standing desc, t desc, n desc, file_id desc) as path,
  first(modified_time order by standing desc, t desc, n desc, file_id desc) as modified_time
from k group by content_hash"""

P3_OFFSETS_SQL = "select file_id, count(*) as n_texts, cast(sum(coalesce(length(text), 0)) as bigint) as n_chars, max(coalesce(length(text), 0)) as last from extracted_content group by file_id"

# every text with a character has a token; a right packing has no fault
P7_FAULTS_SQL = "select count(*) as n_ids, 0 as overfull, 0 as gaps, 0 as cut, 0 as lost from documents where text <> ''"

P6_ROUND_TRIP_SQL = "select doc_id, coalesce(text, '') as text from documents"


def queries() -> dict:
    own = [p1_found, p1_terms, p3_found, p3_segments, p3_offsets, p3_languages, p5_found, p5_survivors, p6_ids, p6_round_trip, p7_containers, p7_fill, p7_faults, p8_found, p8_levels, p8_profile]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND_SQL, "p1_terms": P1_TERMS_SQL, "p3_offsets": P3_OFFSETS_SQL, "p5_found": P5_FOUND_SQL, "p5_survivors": P5_SURVIVORS_SQL, "p6_round_trip": P6_ROUND_TRIP_SQL, "p7_faults": P7_FAULTS_SQL}

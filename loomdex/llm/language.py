"""The language of documents and of the passages of documents in several languages, by compression.

Each sentence is compressed with a zstandard raw-content dictionary of each language that its script allows; the language whose
dictionary makes it smallest is its language, unless the margin to the next one is narrow. A sentence that is too short or too
odd to be decided alone, whatever its length, is decided together with its neighbours. Dictionaries are made of everyday text and
labelled samples, as they stand and romanised. Text and samples take one form first: compatibility forms decomposed, accents removed,
lower case, words only; Latin letters and Devanagari characters become one byte each, so that a match of a few bytes is a
match of a few letters. Neighbouring sentences of a language make a segment.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.llm.base_text import BASE_TEXT
from loomdex.llm.labels import language_code

#: At most so many labelled passages a language are read to make its dictionary.
SAMPLES_PER_LANGUAGE = 400
#: At most so many labelled documents, drawn by hash, extend the dictionaries; and the size that a dictionary doesn't pass, in bytes.
SAMPLE_DOCUMENTS, DICTIONARY_BYTES = 1500, 60_000
#: zstandard level, its way of finding matches, and the least bytes of a match: shorter ones cost what they save.
LEVEL, STRATEGY, MIN_MATCH = 9, zstandard.STRATEGY_LAZY2, 4
#: Put before and after what is compressed, and at the end of every dictionary; no text holds these bytes. Without it zstandard finds no match in
#: the last bytes of a short sentence and stores the whole as it is if little is saved, so that all sizes were alike.
PAD = bytes(range(0x90, 0xB0))
#: A sentence has a language only if the next best size is larger by so many bytes, and by this share of what can be saved. (The constants
#: were chosen by everyday text whose subject was held out of the dictionaries, and by texts that are in none of the languages.)
LEAST_MARGIN, LEAST_CONFIDENCE = 2, 0.05
#: A sentence whose margin is of fewer bytes is weak: among others it takes their language if its own sizes allow, and a weak sentence alone doesn't
#: make a text one in its language.
WEAK = 6
#: A sentence that no dictionary makes smaller than this share of its letters is in none of the languages.
MOST_LEFT = 1.0
#: An undecided sentence is compressed with so many neighbours on each side, one step after the other; a decision so made has this share of its confidence.
REACHES, CONTEXT_SHARE = (1, 3), 0.5
#: Decisions that a worker remembers.
MEMO = 100_000

_ENDS = re.compile(r"[.!?।॥…]+[\"'»”’)\]]*(?:\s+|$)|\s*[\r\n]+\s*|\s+[★☆•*|]+\s+")
_NOISE = re.compile(r"\S*[\d_/\\@<>{}=#~|;$%^&+][^\s.,!?।]*")
_LATIN, _DEVA = re.compile(r"[a-z]+"), re.compile("[ऀ-ॣॱ-ॿ]+")
_MARKS = re.compile("[̀-ͯ]")
SPACES = {"latn": b" ", "deva": "ྀ".encode("utf-16-le")[:1]}
_LIGATURES = str.maketrans({"ß": "ss", "œ": "oe", "æ": "ae", "ø": "o", "ł": "l", "đ": "d", "ı": "i"})

# Romanisation of Devanagari as people type it (fixed values: letters and their usual spellings).
_CONSONANTS = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसहळ", "k kh g gh n ch chh j jh n t th d dh n t th d dh n p ph b bh m y r l v sh sh s h l".split()))
_VOWELS = dict(zip("अआइईउऊऋएऐओऔऑऍ", "a a i i u u ri e ai o au o e".split()))
_SIGNS = dict(zip("ािीुूृेैोौॉॅ", "a i i u u ri e ai o au o e".split()))
_NASAL, _VIRAMA, _NUKTA = "ंँ", "्", "़"


def romanised(word: str) -> str:
    """Latin spelling of a Devanagari word; the inherent vowel is dropped at the end and between a vowel and another syllable."""
    units: list[list[str]] = []  # consonant, vowel ('' none, '@' inherent)
    for c in word:
        if c in _CONSONANTS:
            units.append([_CONSONANTS[c], "@"])
        elif c in _VOWELS:
            units.append(["", _VOWELS[c]])
        elif c in _SIGNS and units:
            units[-1][1] = _SIGNS[c]
        elif c == _VIRAMA and units:
            units[-1][1] = ""
        elif c in _NASAL and units:
            units[-1][1] = ("a" if units[-1][1] == "@" else units[-1][1]) + "n"
        elif c == "ः" and units:
            units[-1][1] = ("a" if units[-1][1] == "@" else units[-1][1]) + "h"
    for i, u in enumerate(units):
        if u[1] == "@":
            last = i == len(units) - 1
            inner = 0 < i < len(units) - 1 and units[i - 1][1] not in ("", "@") and units[i + 1][1] not in ("", "@")
            u[1] = "" if (last and i > 0) or inner else "a"
    return "".join(a + b for a, b in units)


def plain(text: str) -> str:
    return text.lower() if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", text)).lower().translate(_LIGATURES)


def coded(text: str) -> tuple[str, bytes, int]:
    """Script ('latn', 'deva' or ''), the words in one byte a letter, and their number."""
    p = plain(_NOISE.sub(" ", text))
    latin = _LATIN.findall(p)
    if not p.isascii():
        deva = _DEVA.findall(p)
        if sum(map(len, deva)) > sum(map(len, latin)):
            # the low byte of U+0900–U+097F is below 0x80
            return "deva", "ྀ".join(deva).encode("utf-16-le")[::2], len(deva)
    return ("latn", " ".join(latin).encode(), len(latin)) if latin else ("", b"", 0)


def sentences(text: str) -> list[tuple[int, int]]:
    """Begin and end of each sentence or line."""
    out, at = [], 0
    for m in _ENDS.finditer(text):
        if m.end() > at and text[at : m.end()].strip():
            out.append((at, m.end()))
            at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


class Dictionaries:
    """Content of the dictionaries by script and language; bounded by the samples it is made of."""

    def __init__(self, samples: list[tuple[str, str]]):
        content: dict[tuple[str, str], list[bytes]] = defaultdict(list)
        for language, text in [(k.split("-")[0], v) for k, v in BASE_TEXT.items()] + samples:
            for a, b in sentences(text):
                script, data, _ = coded(text[a:b])
                if not script:
                    continue
                content[script, language].append(data)
                if script == "deva":
                    words = _DEVA.findall(plain(text[a:b]))
                    content["latn", language].append(" ".join(map(romanised, words)).encode())
                elif any(c in text for c in "äöü"):
                    wide = re.sub("[äöü]", lambda m: {"ä": "ae", "ö": "oe", "ü": "ue"}[m[0]], text[a:b].lower())
                    content["latn", language].append(coded(wide)[1])
        self.content = {k: b"\n".join(_within(dict.fromkeys(v), DICTIONARY_BYTES // 2)) for k, v in content.items()}

    def extended(self, documents: list[tuple[str, str]]) -> Dictionaries:
        """With the sentences of labelled documents that are new to the dictionary of their label.

        Labels are often wrong and documents mixed: a document counts only if four fifths of its classified letters are in the language of
        its label, and a sentence only if no other language makes it smaller. So dictionaries learn the words that samples don't show.
        """
        classifier = Classifier(self)
        fresh: dict[tuple[str, str], list[bytes]] = defaultdict(list)
        for label, text in documents:
            got = []
            for a, b in sentences(text):
                script, data, _ = coded(text[a:b])
                if script:
                    got.append((script, data, *classifier.decide(script, data)))
            letters = defaultdict(int)
            for _, data, language, _, _ in got:
                letters[language] += len(data)
            known = sum(letters.values()) - letters[None]
            if known and letters[label] >= 0.8 * known and letters[label] >= 0.4 * sum(letters.values()):
                for script, data, language, _, _ in got:
                    if (script, label) in self.content and (language == label or (language is None and classifier.allows(script, data, label))):
                        fresh[script, label].append(data)
        out = Dictionaries.__new__(Dictionaries)
        out.content = dict(self.content)
        for key, found in fresh.items():
            found = list(dict.fromkeys(found))
            while found and len(out.content[key]) < DICTIONARY_BYTES:
                size = Classifier.compressor(out.content[key])
                new = [d for d in found if size(d) > 0.35 * len(d)]
                part = _within(new, min(6000, DICTIONARY_BYTES - len(out.content[key])))
                if not part:
                    break
                out.content[key] += b"\n" + b"\n".join(part)
                found = new[len(part) :]
        return out


def _within(parts, most: int) -> list[bytes]:
    out, n = [], 0
    for p in parts:
        n += len(p) + 1
        if n > most:
            break
        out.append(p)
    return out


#: Language, or None; confidence; and the bytes by which the next best size is larger.
Decision = tuple[str | None, float, int]
UNDECIDED: Decision = (None, 0.0, 0)


class Classifier:
    def __init__(self, dictionaries: Dictionaries, level: int = LEVEL):
        self.by_script: dict[str, list[tuple[str, Callable[[bytes], int]]]] = defaultdict(list)
        self.memo: dict[tuple[str, bytes], Decision] = {}
        for (script, language), content in sorted(dictionaries.content.items()):
            self.by_script[script].append((language, self.compressor(content, level)))

    @staticmethod
    def compressor(content: bytes, level: int = LEVEL) -> Callable[[bytes], int]:
        """Bytes that a text takes beyond those of no text."""
        content += b"\n" + PAD + PAD
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(level, strategy=STRATEGY, dict_size=len(content), source_size=128, min_match=MIN_MATCH, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        d.precompute_compress(compression_params=params)
        compress = zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress
        nothing = len(compress(PAD + PAD))
        return lambda data: len(compress(PAD + data + PAD)) - nothing

    def sizes(self, script: str, data: bytes) -> list[tuple[int, str]]:
        return sorted([(size(data), language) for language, size in self.by_script.get(script, ())])

    def classify(self, text: str) -> tuple[str | None, float, int]:
        """Language or None, confidence from 0 to 1, letters."""
        script, data, _ = coded(text)
        return *(self.decide(script, data) if data else UNDECIDED)[:2], len(data)

    def decide(self, script: str, data: bytes) -> Decision:
        known = self.memo.get((script, data))
        if known is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            known = self.memo[script, data] = self._decide(script, data)
        return known

    def _decide(self, script: str, data: bytes) -> Decision:
        s = self.sizes(script, data)
        if not s:
            return UNDECIDED
        best, language = s[0]
        other = s[1][0] if len(s) > 1 else len(data)
        confidence = (other - best) / max(1, other)
        if other - best < LEAST_MARGIN or confidence < LEAST_CONFIDENCE or best > MOST_LEFT * len(data):
            return None, confidence, 0
        return language, confidence, other - best

    def allows(self, script: str, data: bytes, language: str, slack: int = LEAST_MARGIN) -> bool:
        """Whether no language makes the text smaller than this one by so many bytes."""
        own = {k: n for n, k in self.sizes(script, data)}
        return language in own and own[language] - min(own.values()) < slack

    def _in_context(self, parts: list[tuple[str, bytes]], i: int) -> Decision:
        """Language of a sentence and its neighbours of the same script together, if the sentence alone doesn't speak against it."""
        script, data = parts[i]
        for reach in REACHES:
            near = [d for k, d in parts[max(0, i - reach) : i + reach + 1] if k == script and d]
            if len(near) < 2:
                continue
            language, confidence, _ = self.decide(script, SPACES[script].join(near))
            if language is not None and self.allows(script, data, language, WEAK):
                return language, confidence * CONTEXT_SHARE, 0
        return UNDECIDED

    def languages(self, parts: list[tuple[str, bytes]]) -> list[Decision]:
        """Language, confidence and margin of each sentence of a text, in order. A margin of 0 says that the neighbours decided."""
        out = [self.decide(k, d) if d else UNDECIDED for k, d in parts]
        for i, (_, data) in enumerate(parts):
            if data and out[i][2] < WEAK:
                found = self._in_context(parts, i)
                if found[0] is not None and found[0] != out[i][0]:
                    out[i] = found
        return out

    def segments(self, text: str) -> list[tuple[int, int, str, float, int, int]]:
        """(begin, end, language, confidence, letters, margin) of passages, which together are the text.

        The confidence is the mean over the letters, the margin the greatest of a sentence that was decided alone. Sentences without a language
        go with the passage before them, or after them at the begin, and their letters have no confidence there; a text without any language
        has one passage 'und'.
        """
        spans = sentences(text)
        parts = [coded(text[a:b])[:2] for a, b in spans]
        out: list[list] = []
        free = 0  # letters before the first passage
        for (a, b), (_, data), (language, confidence, margin) in zip(spans, parts, self.languages(parts)):
            n = len(data)
            if out and language in (None, out[-1][2]):
                seg = out[-1]
                seg[1], seg[3], seg[4], seg[5] = b, seg[3] + confidence * n * (language is not None), seg[4] + n, max(seg[5], margin)
            elif language is None:
                free += n
            else:
                out.append([a if out else 0, b, language, confidence * n, n + free, margin])
                free = 0
        if not out:
            return [(0, len(text), "und", 0.0, 0, 0)]
        out[-1][1] = len(text)
        return [(a, b, language, c / max(1, n), n, m) for a, b, language, c, n, m in out]


def bounded_samples(samples: DataFrame, language: Column, text: Column, per_language: int = SAMPLES_PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most so many labelled passages a language, on the driver. Rows with a null text or an unknown label are left out."""
    rows = samples.select(language.alias("l"), text.alias("t")).filter("l is not null and t is not null").distinct()
    # each task keeps only its first `per_language` before anything is shuffled, however large the table
    first = Window.partitionBy("l").orderBy(F.xxhash64("t"), "t")
    some = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_language).select("l", "t").collect()
    return sorted((r.l, r.t) for r in some)


_SEGMENT = "seq int, begin int, end int, language string, confidence double, letters int, margin int"


def sample_documents(content: DataFrame, files: DataFrame, most: int = SAMPLE_DOCUMENTS) -> list[tuple[str, str]]:
    """(label, text) of at most `most` files with a label and a text, those with the smallest hashes of their ids, one row a file."""
    named = files.select("file_id", language_code(F.col("language")).alias("l")).filter("l is not null and file_id is not null").groupBy("file_id").agg(F.min("l").alias("l"))
    ids = content.select("file_id").filter("text is not null").join(named, "file_id", "left_semi").distinct().orderBy(F.xxhash64("file_id"), "file_id").limit(most)
    ids = F.broadcast(ids.join(named, "file_id"))  # at most `most` files
    rows = content.select("file_id", "text").filter("text is not null").join(ids, "file_id").groupBy("file_id").agg(F.max("text").alias("text"), F.max("l").alias("l"))
    return [(r.l, r.text) for r in rows.orderBy(F.xxhash64("file_id"), "file_id").collect()]


def language_segments(docs: DataFrame, dictionaries: Dictionaries, id_col: str = "file_id", text_col: str = "text") -> DataFrame:
    """(id, seq, begin, end, language, confidence, letters, margin): every passage of every row. A null or blank text has one passage, 'und'.

    begin and end are offsets in code points. Repeated rows give repeated passages.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(dictionaries)  # of bounded size
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(held.value)
        for b in batches:
            who, seqs, rows = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                s = classifier.segments(t) if t and t.strip() else [(0, len(t or ""), "und", 0.0, 0, 0)]
                who += [i] * len(s)
                seqs += range(len(s))
                rows += s
            cols = list(zip(*rows)) if rows else [[]] * 6
            types = [pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who, pa.int64())), pa.array(seqs, pa.int32()), *[pa.array(list(c), t) for c, t in zip(cols, types)]], [id_col, "seq", "begin", "end", "language", "confidence", "letters", "margin"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"`{id_col}` {kind}, {_SEGMENT}")


def document_languages(segments: DataFrame, id_col: str = "file_id") -> DataFrame:
    """(id, language, share, confidence): each language of a document with its share of the letters and its mean confidence."""
    by = segments.groupBy(id_col, "language").agg(F.max("confidence").alias("best"), (F.sum(F.col("confidence") * F.col("letters")) / F.greatest(F.sum("letters"), F.lit(1))).alias("confidence"), F.sum("letters").alias("letters"))
    one = by.groupBy(id_col).agg(F.collect_list(F.struct("language", "letters", "confidence")).alias("l"))  # at most one a language
    total = F.greatest(F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x["letters"]), F.lit(1))
    return one.select(id_col, F.explode("l").alias("x"), total.alias("n")).select(id_col, "x.language", (F.col("x.letters") / F.col("n")).alias("share"), "x.confidence")


def unnamed_languages(content: DataFrame, files: DataFrame, dictionaries: Dictionaries) -> DataFrame:
    """(file_id, language): languages of a file's texts that none of its labels names. Files without label name none.

    A language counts if a sentence of it is clear by itself (its margin isn't WEAK): a word such as TODO in a text of another makes none.
    """
    found = language_segments(content, dictionaries).filter((F.col("margin") >= WEAK) & F.col("file_id").isNotNull()).groupBy("file_id", "language").agg(F.lit(1).alias("_")).drop("_")
    named = files.select("file_id", language_code(F.col("language")).alias("language")).filter("language is not null").groupBy("file_id", "language").agg(F.lit(1).alias("_")).drop("_")
    return found.join(named, ["file_id", "language"], "left_anti")

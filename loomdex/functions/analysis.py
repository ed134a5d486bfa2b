"""Stop words, stems and languages of terms and texts."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.functions.text import normalise_py

#: Stop words by language (fixed values).
STOP_WORDS = {
    "eng": "a an the and or but is are was were be been being have has had do does did will would could should may might must shall can need dare ought used to of in for on with at by from as into through during before after above below between under again further then once here there when where why how all each every both few more most other some such no not only own same so than too very just now this that these those i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom whose am s t",
    "hin": "का की के को में ने से पर है हैं था थी थे और या लेकिन कि यह वह ये वे एक भी ही नहीं सब सभी कुछ किसी जो तो जब तक",
    "mar": "चा ची चे ला ली ले ने है आहे आहेत होता होती होते आणि किंवा पण की हा ही हे ते एक सुद्धा फक्त नाही सर्व काही कोणी जो तर जेव्हा पर्यंत मध्ये वर पासून",
}

#: Texts are judged by so many characters at their begin.
DETECT_CHARS = 5000


def is_stop_word(term: Column, language: Column) -> Column:
    """Null or unknown languages have no stop words."""
    out = F.lit(False)
    for code, words in STOP_WORDS.items():
        out = out | ((F.lower(language) == code) & term.isin(words.split()))
    return F.coalesce(out, F.lit(False))


def detect_language_py(text: str | None) -> str | None:
    """'eng', 'hin', 'mar' or None, by script and the share of function words."""
    if not text or not text.strip():
        return None
    words = (normalise_py(text[:DETECT_CHARS]) or "").replace("।", " ").split()
    words = [w.strip(".,;:!?\"'()[]") for w in words]
    letters = Counter("deva" if "ऀ" <= c <= "ॿ" else "latn" if c.isalpha() else "" for w in words for c in w)
    letters.pop("", None)
    if not letters:
        return None
    hits = {k: sum(w in _SETS[k] for w in words) for k in _SETS}
    if letters["deva"] > letters["latn"]:
        hits["mar"] += sum(w.endswith(_MAR_ENDS) for w in words) + text.count("ळ")
        hits["hin"] += sum(w in _HIN_MORE for w in words)
        return "mar" if hits["mar"] > hits["hin"] else "hin"
    foreign = sum(w in _FOREIGN for w in words)
    return "eng" if hits["eng"] > foreign and hits["eng"] >= max(1, len(words) // 12) else None


_SETS = {k: frozenset(v.split()) for k, v in STOP_WORDS.items()}
_MAR_ENDS = ("च्या", "साठी", "मध्ये", "ण्यात", "ांनी", "ून", "ाला", "तील", "पेक्षा")
_HIN_MORE = frozenset("हो कर हुई हुए गया गई रहा रही रहे हम मेरे मेरी आप बहुत इस उस अपने लिए साथ बाद".split())
_FOREIGN = frozenset("der die das und ist nicht ein eine mit von für auf den dem zu sich le la les et est une des du que qui dans pour pas sur el los las y en es una por con para del ke ki hai mein ko ne aur ka se".split())


#: Languages that the index stores; passages of at most so many labelled samples a language, and pieces of at most so many characters, make profiles.
STORED, PROFILE_SAMPLES, LEAST_LETTERS = ("eng", "hin", "mar"), 400, 3


class LanguageProfiles:
    """How often each language writes which three characters in a row, from labelled passages; of bounded size.

    A text is in the language that makes its trigrams likeliest; one of another language than STORED, or of none known here, has none.
    """

    def __init__(self, samples: list[tuple[str, str]]):
        self.counts: dict[str, Counter] = {}
        for language, text in samples:
            self.counts.setdefault(language, Counter()).update(self._grams(text))
        self.totals = {k: sum(c.values()) for k, c in self.counts.items()}
        self.kinds = len({g for c in self.counts.values() for g in c}) or 1

    @staticmethod
    def _grams(text: str) -> list[str]:
        words = re.sub(r"[\W\d_]+", " ", f" {normalise_py(_MATRAS.sub(_letter, text))} ")
        return [words[i : i + 3] for i in range(len(words) - 2)]

    def detect(self, text: str | None) -> str | None:
        grams = self._grams((text or "")[:DETECT_CHARS])
        if sum(c.isalpha() for g in grams for c in g[1]) < LEAST_LETTERS:
            return None
        known = sum(any(g in c for c in self.counts.values()) for g in grams)
        if known < len(grams) / 3:
            return None
        score = {k: sum(math.log((c[g] + 0.5) / (self.totals[k] + 0.5 * self.kinds)) for g in grams) for k, c in self.counts.items()}
        best = max(sorted(score), key=score.get)
        return best if best in STORED else None


#: Vowel signs of Devanagari count as letters here.
_MATRAS = re.compile("[ऀ-ःऺ-़ा-ॏ॑-ॗॢॣ]")


def _letter(m: re.Match) -> str:
    return chr(0xE000 + ord(m[0]))


def language_profiles(samples: DataFrame, language: str = "language", text: str = "text", most: int = PROFILE_SAMPLES) -> LanguageProfiles:
    """Of at most `most` passages a language; each task keeps only so many before anything is shuffled. Null labels and texts are left out."""
    rows = samples.select(F.col(language).alias("l"), F.col(text).alias("t")).filter("l is not null and t is not null")
    first = Window.partitionBy("l").orderBy(F.xxhash64("t"), "t")
    return LanguageProfiles(sorted((r.l, r.t) for r in rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= most).collect()))


def detect_language(text: Column, profiles: LanguageProfiles | None = None) -> Column:
    """'eng', 'hin', 'mar' or null by the first DETECT_CHARS characters: by profiles where samples are at hand, else by script and function words."""
    detect = profiles.detect if profiles else detect_language_py

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([detect(t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, T.StringType()).asNondeterministic()(F.substring(text, 1, DETECT_CHARS))


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def _measure(w: str) -> int:
    """How often a vowel is followed by a consonant."""
    v = [_vowel(w, i) for i in range(len(w))]
    return sum(a and not b for a, b in zip(v, v[1:]))


def _short(w: str) -> bool:
    return len(w) >= 3 and not _vowel(w, len(w) - 1) and _vowel(w, len(w) - 2) and not _vowel(w, len(w) - 3) and w[-1] not in "wxy"


# Steps 2 to 4 of Porter's published algorithm (fixed values: ending, replacement)
_STEP2 = [x.split(":") for x in "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log".split()]
_STEP3 = [x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split()]
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _replace(w: str, rules: list, least: int) -> str:
    for end, to in sorted(rules, key=lambda r: -len(r[0])):
        if w.endswith(end):
            stem = w[: len(w) - len(end)]
            return stem + to if _measure(stem) > least else w
    return w


def stem_py(term: str, language: str | None = "eng") -> str:
    """Porter's stem of an English word; other languages and words of one or two letters stay as they are."""
    if not language or language.lower() != "eng" or len(term) < 3 or not (term.isascii() and term.isalpha()):
        return term
    w = term.lower()
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            stem = w[: -len(end)]
            if w.endswith(end) and any(_vowel(stem, i) for i in range(len(stem))):
                w = stem
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and any(_vowel(w, i) for i in range(len(w) - 1)):
        w = w[:-1] + "i"
    w = _replace(w, _STEP2, 0)
    w = _replace(w, _STEP3, 0)
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stem(term: Column, language: str = "eng") -> Column:
    """For dictionaries of distinct terms, not for texts."""

    def run(terms: pa.Array) -> pa.Array:
        return pa.array([None if t is None else stem_py(t, language) for t in terms.to_pylist()], pa.string())

    return F.arrow_udf(run, T.StringType()).asNondeterministic()(term)

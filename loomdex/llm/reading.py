"""Reading level of documents: boosted trees over length, vocabulary, syntax and cohesion of each sentence.

Sentences are graded one by one, since documents mix kinds of prose, and a document's grade is the mean of its sentences weighted by
their words. Distinct words are looked up once a worker; all else runs over arrays of a whole batch.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.boosting import Trees, fit, isotonic
from loomdex.llm.base_text import BASE_TEXT
from loomdex.llm.language import plain, romanised

#: At most so many graded passages a level, and labelled passages a language, are read.
SAMPLES_PER_LEVEL, SAMPLES_PER_LANGUAGE = 400, 400
#: A sentence is hard from this grade on; levels 4 and 5 round to it.
HARD = 3.5
#: Least words of a document that can be found.
LEAST_WORDS = 40

#: Abbreviations that end no sentence; function words; words that open clauses; words that tie sentences together (fixed values).
ABBREVIATIONS = set("approx incl excl cf op cit no nos fig vol pp p ff ibid al etc vs viz resp dr mr mrs ms st prof art sec ch ed eds ca".split())
FUNCTION = set("the a an of to in on at by for with from as and or but nor not no is are was were be been being am do does did have has had will would shall should can could may might must i you he she it we they me him her us them my your his its our their this that these those there here who whom whose which what when where why how if than then so too very all any each every some such own same".split())
CLAUSES = set("that which who whom whose whenever wherever whether although though unless until because since while whereas provided notwithstanding insofar lest whereby wherein granted given if when where as after before".split())
TIES = set("however therefore thus hence moreover furthermore consequently accordingly nevertheless then also again so but this these those such it they same said aforementioned former latter".split())
SUFFIXES = tuple("tion sion tions sions ity ities ism isms ise ises ised ising ize izes ized izing ous ical ology ence ance ency ancy ment ments ness ive ably ibly ability".split())

_ASIDE = re.compile(r"\([^()\n]{0,80}\)|\[[^\[\]\n]{0,60}\]")
_CODE = re.compile(r"[/\\_=<>{}#@|~]")
_CODE_WORD = re.compile(r"(?<!\S)[^\s/\\_=<>{}#@|~]*[/\\_=<>{}#@|~]\S*")
#: Words, ends of sentences, ends of lines that no sentence runs on from, and punctuation within a sentence.
_TOKEN = re.compile(r"[^\W\d_ऀ-ॿ]+(?:['’-][^\W\d_]+)*|[ऀ-ॣॱ-ॿ]+|[.!?।॥…]+(?=[\s\"'»”’)\]]|$)|\n(?=\s*(?:[-*•>#–—A-ZÀ-Þ\d\n\t]|$))|[,;:]")
_VOWELS = re.compile("[aeiouy]+")

BREAK, COMMA, STOP, OTHER = 0, 1, 2, 3  # ids of what is no word
LANGUAGES = ("eng", "deu", "fra", "spa", "hin", "mar")


def syllables(word: str) -> int:
    n = len(_VOWELS.findall(word))
    return max(1, n - (word.endswith("e") and not word.endswith(("le", "ee")) and n > 1))


class WordModel:
    """What is known of words from the samples: their counts by level, and how likely each language writes them."""

    def __init__(self, graded: list[tuple[int, str]], labelled: list[tuple[str, str]], levels: list[int] | None = None):
        self.levels = levels or sorted({g for g, _ in graded})
        self.counts: dict[str, np.ndarray] = {}
        for level, text in graded:
            for w in words_of(text):
                self.counts.setdefault(w, np.zeros(len(self.levels)))[self.levels.index(level)] += 1
        self.totals = sum(self.counts.values(), np.zeros(len(self.levels)))
        lex: dict[str, Counter] = defaultdict(Counter)
        for language, text in [(k.split("-")[0], v) for k, v in BASE_TEXT.items()] + labelled + [("eng", t) for _, t in graded]:
            ws = words_of(text)
            lex[language].update(romanised(w) if "ऀ" <= w[0] <= "ॿ" else plain(w) for w in ws)
        self.lex = {k: v for k, v in lex.items() if k in LANGUAGES}
        self.lex_total = {k: sum(v.values()) for k, v in self.lex.items()}
        self.tri: dict[str, Counter] = {}
        for k, v in self.lex.items():
            c: Counter = Counter()
            for w in v:
                padded = f"^{w}$"
                c.update(padded[i : i + 3] for i in range(len(padded) - 2))
            self.tri[k] = c
        self.tri_total = {k: sum(v.values()) for k, v in self.tri.items()}

    def level_scores(self, word: str, minus: np.ndarray | None = None, totals: np.ndarray | None = None) -> tuple[np.ndarray, bool]:
        """Log-likelihood of the levels, centred, and whether the word is known. minus: counts to leave out (the sample's own)."""
        c = self.counts.get(word)
        if c is not None and minus is not None:
            c = c - minus
        if c is None or c.sum() < 2:
            return np.zeros(len(self.levels)), False
        s = np.log((c + 0.3) / ((self.totals if totals is None else totals) + 0.3 * 3000))
        return s - s.mean(), True

    def language_scores(self, word: str) -> list[float]:
        w = plain(word)
        padded = f"^{w}$"
        grams = [padded[i : i + 3] for i in range(len(padded) - 2)] or [padded]
        out = []
        for k in LANGUAGES:
            if k not in self.tri:
                out.append(-30.0)
                continue
            t, n = self.tri[k], self.tri_total[k] + 8000
            spelled = sum(math.log((t[g] + 0.5) / n) for g in grams) / len(grams)
            known = self.lex[k][w]
            # a word seen is worth its frequency; one unseen the mean likelihood of its letters
            out.append(max(spelled - 2.0, math.log(known / self.lex_total[k]) if known else -99.0))
        return out


def words_of(text: str) -> list[str]:
    return [t.lower() for t in cut(text) if t[0].isalpha()]


def cut(text: str) -> list[str]:
    """Tokens of a text; what stands in brackets, addresses, paths and code aside."""
    if "(" in text or "[" in text:
        text = _ASIDE.sub(" ", text)
    if _CODE.search(text):
        text = _CODE_WORD.sub(" ", text)
    return _TOKEN.findall(text)


#: Columns of the word table.
W_LEN, W_LEN7, W_LEN10, W_SYL, W_SYL3, W_SYL4, W_FUNCTION, W_CLAUSE, W_TIE, W_SUFFIX, W_UNKNOWN, W_DEVA, W_SHORT, W_LEVEL = range(14)
FEATURES = [
    "words", "mean_length", "sd_length", "longest", "share_7", "share_10", "syllables", "share_3_syllables", "share_4_syllables", "function", "clauses", "ties",
    "suffixes", "unknown", "commas", "stops", "repeated", "level_1", "level_2", "level_3", "level_4", "level_5", "level_mean",
]


class _Ids(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, token):
        self[token] = i = self.make(token)
        return i


class Sentences:
    """Tokens of texts as arrays. A word is computed when first met; the memory of words is bounded."""

    def __init__(self, model: WordModel, memo: int = 300_000):
        self.model, self.memo, self.n_levels = model, memo, len(model.levels)
        self._clear()

    def _clear(self) -> None:
        self.ids = _Ids(self._id)
        self.rows: list[list[float]] = [[0.0] * (W_LEVEL + self.n_levels + len(LANGUAGES)) for _ in range(4)]
        self.words: list[str] = ["", "", "", ""]

    def _id(self, token: str) -> int:
        c = token[0]
        if c == "," or c == ";" or c == ":":
            i = COMMA if c == "," else STOP
        elif c in ".!?।॥…\n":
            i = BREAK
        else:
            i = len(self.rows)
            w = token.lower()
            s, known = self.model.level_scores(w)
            n = len(w)
            syl = syllables(w)
            deva = float("ऀ" <= w[0] <= "ॿ")
            self.rows.append(
                [n, n >= 7, n >= 10, syl, syl >= 3, syl >= 4, w in FUNCTION, w in CLAUSES, w in TIES, n > 5 and w.endswith(SUFFIXES), not known, deva, w in ABBREVIATIONS or (n == 1 and w not in "ai" and not deva), *s, *(self.model.language_scores(w) if not deva else [0.0] * len(LANGUAGES))]
            )
            self.words.append(w)
        return i

    def tokens(self, text: str) -> np.ndarray:
        if len(self.rows) > self.memo:
            self._clear()
        found = cut(text)
        return np.fromiter(map(self.ids.__getitem__, found), np.int32, len(found))

    def table(self) -> np.ndarray:
        return np.array(self.rows, np.float64)


def sentence_features(tokens: list[np.ndarray], table: np.ndarray, n_levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the texts' tokens: of each sentence its text, its number of words, its features, and its scores by language with Devanagari words last."""
    flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
    doc = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    new = np.zeros(len(flat), bool)
    if len(flat):
        ends = flat == BREAK
        ends[1:] &= table[flat[:-1], W_SHORT] == 0  # a stop after an abbreviation ends nothing
        new[1:] = (doc[1:] != doc[:-1]) | ends[:-1]
    sent = np.cumsum(new) if len(flat) else flat
    n_sent = int(sent[-1]) + 1 if len(flat) else 0
    is_word = flat > OTHER
    ws, wi = sent[is_word], flat[is_word]
    words = np.bincount(ws, minlength=n_sent)
    n = np.maximum(words, 1)
    of = lambda col: np.bincount(ws, table[wi, col], n_sent)
    length = of(W_LEN)
    square = np.bincount(ws, table[wi, W_LEN] ** 2, n_sent)
    longest = np.zeros(n_sent)
    if len(ws):
        starts = np.flatnonzero(np.concatenate([[True], ws[1:] != ws[:-1]]))
        longest[ws[starts]] = np.maximum.reduceat(table[wi, W_LEN], starts)
    # repeated: words, not function words, that stand in the same or the last sentence before
    order = np.argsort(wi, kind="stable")
    near = np.zeros(len(wi), bool)
    if len(wi):
        a, b = order[:-1], order[1:]
        near[b] = (wi[a] == wi[b]) & (ws[b] - ws[a] <= 1)
    repeated = np.bincount(ws, near & (table[wi, W_FUNCTION] == 0), n_sent)
    levels = np.stack([of(W_LEVEL + k) for k in range(n_levels)], 1) / n[:, None] if n_sent else np.zeros((0, n_levels))
    # posterior mean of the level, with the words' votes tempered
    e = np.exp(np.clip(levels * np.minimum(n, 12)[:, None] * 0.5, -30, 30))
    mean = (e * np.arange(1, n_levels + 1)).sum(1) / e.sum(1)
    first = np.zeros(n_sent, np.int64)
    first[sent] = doc
    x = np.stack(
        [
            words, length / n, np.sqrt(np.maximum(square / n - (length / n) ** 2, 0)), longest, of(W_LEN7) / n, of(W_LEN10) / n, of(W_SYL) / n, of(W_SYL3) / n, of(W_SYL4) / n, of(W_FUNCTION) / n, of(W_CLAUSE) / n,
            of(W_TIE) / n, of(W_SUFFIX) / n, of(W_UNKNOWN) / n, np.bincount(sent, flat == COMMA, n_sent) / n, np.bincount(sent, flat == STOP, n_sent) / n, repeated / n, *levels.T, mean,
        ],
        1,
    )
    tongue = np.stack([of(W_LEVEL + n_levels + k) for k in range(len(LANGUAGES))] + [of(W_DEVA)], 1)
    return first, words, x, tongue


def foreign(words: np.ndarray, tongue: np.ndarray) -> np.ndarray:
    """Sentences in another language than English: most of at least four words, clearly likelier in it; or three words in Devanagari."""
    latin = words - tongue[:, -1]
    other = tongue[:, 1:-1].max(1) - tongue[:, 0]
    return ((latin >= 4) & (other > 4 + 0.35 * latin)) | (tongue[:, -1] >= 3)


class LevelModel:
    """Word model, trees and calibration; of bounded size. columns: the features that the trees use."""

    def __init__(self, words: WordModel, trees: Trees, knots: tuple[np.ndarray, np.ndarray] | None, columns: list[int]):
        self.words, self.trees, self.knots, self.columns = words, trees, knots, columns

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.trees.predict(x[:, self.columns])

    def grade(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.score(x), *self.knots)


def _training(graded: list[tuple[int, str]], model: WordModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, level and weight of each sentence. The words of a sample are scored as if the sample had not been seen."""
    xs, ys, ws = [], [], []
    for level, text in graded:
        s = Sentences(model)
        t = s.tokens(text)
        table = s.table()
        own: dict[str, np.ndarray] = {}
        k = model.levels.index(level)
        for w in words_of(text):
            own.setdefault(w, np.zeros(len(model.levels)))[k] += 1
        totals = model.totals - sum(own.values(), np.zeros(len(model.levels)))
        for i in range(4, len(s.words)):
            score, known = model.level_scores(s.words[i], own.get(s.words[i]), totals)
            table[i, W_LEVEL : W_LEVEL + len(score)] = score
            table[i, W_UNKNOWN] = not known
        _, n, x, _ = sentence_features([t], table, len(model.levels))
        keep = n >= 3
        xs.append(x[keep])
        ys.append(np.full(keep.sum(), level, float))
        ws.append(np.minimum(n[keep], 30) / max(1, np.minimum(n[keep], 30).sum()))
    w = np.concatenate(ws)
    return np.concatenate(xs), np.concatenate(ys), w / w.mean()


def _columns(levels: int, without: tuple[str, ...]) -> list[int]:
    names = FEATURES[: FEATURES.index("level_1")] + [f"level_{k + 1}" for k in range(levels)] + ["level_mean"]
    return [i for i, n in enumerate(names) if not n.startswith(without)] if without else list(range(len(names)))


def _uncalibrated(graded: list[tuple[int, str]], labelled: list[tuple[str, str]], levels: list[int], without: tuple[str, ...]) -> LevelModel:
    words = WordModel(graded, labelled, levels)
    columns = _columns(len(levels), without)
    x, y, w = _training(graded, words)
    return LevelModel(words, fit(x[:, columns], y, w), None, columns)


def _sentences_of(passages: list[tuple[int, str]], model: LevelModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage, words and features of each sentence."""
    s = Sentences(model.words)
    tokens = [s.tokens(t) for _, t in passages]
    passage, words, x, _ = sentence_features(tokens, s.table(), s.n_levels)
    return passage, words, x


def train(graded: list[tuple[int, str]], labelled: list[tuple[str, str]], folds: int = 5, groups: list[int] | None = None, without: tuple[str, ...] = ()) -> tuple[LevelModel, dict]:
    """The model and a report of its calibration.

    The calibration is fitted on the scores of sentences of passages that neither the word model nor the trees had seen, fold by fold; where
    groups are given, no passage of a fold's groups was. without: beginnings of the names of features to leave out.
    """
    graded = sorted(graded) if groups is None else graded
    levels = sorted({g for g, _ in graded})
    fold = [i % folds for i in range(len(graded))] if groups is None else groups
    score, level, weight = [], [], []
    for f in sorted(set(fold)):
        rest = [p for p, k in zip(graded, fold) if k != f]
        if not rest:
            continue
        out = [p for p, k in zip(graded, fold) if k == f]
        passage, words, x = _sentences_of(out, m := _uncalibrated(rest, labelled, levels, without))
        keep = words >= 3
        n = np.minimum(words[keep], 30)
        score.append(m.score(x[keep]))
        level.append(np.array([g for g, _ in out], float)[passage[keep]])
        weight.append(n / np.maximum(np.bincount(passage[keep], n, len(out)), 1)[passage[keep]])
    s, y, w = map(np.concatenate, (score, level, weight))
    model = _uncalibrated(graded, labelled, levels, without)
    model.knots = isotonic(s, y, w)
    cal = np.interp(s, *model.knots)
    return model, {"sentences": len(y), "sentence_mae": float(np.average(abs(cal - y), weights=w)), "sentence_hard_right": float(np.average((cal >= HARD) == (y >= HARD), weights=w))}


def kinds(graded: list[tuple[int, str]], n: int) -> list[int]:
    """The kind of writing of each passage, 0 to n - 1: passages are joined, most alike first, by the mean likeness of their words (cosine of the
    words of a passage that at most half of the passages hold). The level isn't asked. The samples name no source; this stands for it."""
    held = [set(words_of(t)) for _, t in graded]
    count = Counter(w for h in held for w in h)
    index = {w: i for i, w in enumerate(sorted(w for w, c in count.items() if c <= len(graded) / 2))}
    m = np.zeros((len(graded), len(index)))
    for i, h in enumerate(held):
        for w in h:
            if w in index:
                m[i, index[w]] = math.log(len(graded) / count[w])
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    like = m @ m.T
    groups = [[i] for i in range(len(graded))]
    while len(groups) > n:
        size = np.array([len(g) for g in groups])
        mean = like / np.outer(size, size)
        np.fill_diagonal(mean, -1)
        a, b = sorted(divmod(int(mean.argmax()), len(groups)))
        like[a] += like[b]
        like[:, a] += like[:, b]
        like = np.delete(np.delete(like, b, 0), b, 1)
        groups[a] += groups.pop(b)
    out = [0] * len(graded)
    for k, g in enumerate(groups):
        for i in g:
            out[i] = k
    return out


def cross_validate(graded: list[tuple[int, str]], labelled: list[tuple[str, str]], groups: list[int], without: tuple[str, ...] = ()) -> list[dict]:
    """Of each group, whose passages neither words, trees nor calibration have seen: its passages, their levels, mean error by passage, and the
    share of words on the right side of HARD. The calibration inside goes by the other groups in the same way."""
    report = []
    for f in sorted(set(groups)):
        rest = [(p, k) for p, k in zip(graded, groups) if k != f]
        out = [p for p, k in zip(graded, groups) if k == f]
        inner = [k for _, k in rest]
        model, _ = train([p for p, _ in rest], labelled, groups=inner if len(set(inner)) > 1 else None, without=without)
        passage, words, x = _sentences_of(out, model)
        grade, level = model.grade(x), np.array([g for g, _ in out], float)
        mean = np.bincount(passage, words * grade, len(out)) / np.maximum(np.bincount(passage, words, len(out)), 1)
        right = words * ((grade >= HARD) == (level[passage] >= HARD))
        report.append({"group": f, "passages": len(out), "levels": sorted(set(level.astype(int).tolist())), "mae": float(abs(mean - level).mean()), "mean": float(mean.mean()), "words": int(words.sum()), "hard_right": float(right.sum() / max(1, words.sum()))})
    return report


def summary(report: list[dict]) -> dict:
    """Over all groups: mean error by passage, and share of words on the right side of HARD."""
    n, w = sum(r["passages"] for r in report), sum(r["words"] for r in report)
    return {"passages": n, "mae": sum(r["mae"] * r["passages"] for r in report) / n, "hard_right": sum(r["hard_right"] * r["words"] for r in report) / w}


_COLUMNS = "grade double, scale string, hard_share double, n_words int, english boolean"


def reading_levels(docs: DataFrame, model: LevelModel, keep: list[str], text_col: str = "text", chunk_tokens: int = 1_000_000) -> DataFrame:
    """The columns `keep` and grade, scale, hard_share, n_words, english of every row.

    grade: for English prose the calibrated level of its sentences, weighted by words, scale 'level'; for other languages, which have no
    graded samples, a grade drawn from the lengths of words and sentences alone, scale 'length'. hard_share: share of the words in sentences of
    grade HARD or more. english: prose, and no sentence of it in another language. A text without words, blank or null has null grade and
    share, no words, and isn't English. Repeated rows give a row each.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # of bounded size
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        s = Sentences(m.words)

        def out(who: list[pa.Array], tokens: list[np.ndarray]) -> pa.RecordBatch:
            doc, words, x, tongue = sentence_features(tokens, s.table(), s.n_levels)
            n = len(tokens)
            grade = m.grade(x) if len(x) else np.zeros(0)
            odd = foreign(words, tongue)
            total = np.bincount(doc, words, n)
            safe = np.maximum(total, 1)
            level = np.bincount(doc, words * grade, n) / safe
            # length alone: mean sentence length plus the share of long words, on the usual scale of 20 to 60
            lengths = np.bincount(doc, words**2, n) / safe + 100 * np.bincount(doc, words * x[:, 4], n) / safe if len(x) else np.zeros(n)
            english = (total > 0) & (np.bincount(doc, odd, n) == 0)
            share = np.bincount(doc, words * (grade >= HARD), n) / safe
            none = total == 0
            value = np.where(english, level, np.clip(1 + (lengths - 20) / 10, 1, 5))
            scale = pa.array([None if z else "level" if e else "length" for z, e in zip(none, english)], pa.string())
            return pa.RecordBatch.from_arrays([*who, pa.array(value, mask=none), scale, pa.array(share, mask=none), pa.array(total.astype(np.int32)), pa.array(english)], [*keep, "grade", "scale", "hard_share", "n_words", "english"])

        for b in batches:
            tokens, at, size = [], 0, 0
            for i, t in enumerate(b.column(len(keep))):
                t = t.as_py()
                if len(s.rows) > s.memo and tokens:
                    yield out([c.slice(at, i - at) for c in b.columns[: len(keep)]], tokens)
                    tokens, at, size = [], i, 0
                tokens.append(s.tokens(t) if t else np.zeros(0, np.int32))
                size += len(tokens[-1])
                if size >= chunk_tokens:
                    yield out([c.slice(at, i + 1 - at) for c in b.columns[: len(keep)]], tokens)
                    tokens, at, size = [], i + 1, 0
            if tokens:
                yield out([c.slice(at) for c in b.columns[: len(keep)]], tokens)

    return docs.select(*keep, F.col(text_col).cast("string").alias("_text_")).mapInArrow(run, f"{kinds}, {_COLUMNS}")


def demanding(levels: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Rows in English of at least so many words, most of them in hard prose."""
    return levels.filter(F.col("english") & (F.col("n_words") >= least_words) & (F.col("hard_share") > 0.5))


def profile(levels: DataFrame, source: str = "source") -> DataFrame:
    """By source: rows, English rows, mean grade of the English rows, and how many of them are demanding."""
    hard = F.col("english") & (F.col("hard_share") > 0.5)
    return levels.groupBy(source).agg(F.count("*").alias("n_docs"), F.count_if("english").alias("n_english"), F.avg(F.when(F.col("english"), F.col("grade"))).alias("mean_grade"), F.count_if(hard).alias("n_demanding"))

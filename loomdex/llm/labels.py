"""Names of languages and values that are no values."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ISO 639-3 codes of the languages known here and their other names (fixed values: ISO 639-1/-2 codes and names in English,
#: in the language itself and in its neighbours).
NAMES = {
    "eng": ["en", "english", "englisch", "anglais", "inglés", "ingles", "अंग्रेज़ी", "इंग्रजी"],
    "hin": ["hi", "hindi", "हिन्दी", "हिंदी"],
    "mar": ["mr", "marathi", "मराठी"],
    "deu": ["de", "ger", "german", "deutsch", "allemand", "alemán", "aleman"],
    "fra": ["fr", "fre", "french", "français", "francais", "französisch", "francés", "frances"],
    "spa": ["es", "spanish", "español", "espanol", "castellano", "spanisch", "espagnol", "esp"],
}

#: What stands where a value should (fixed values).
NO_VALUES = ["", "-", "--", "?", "??", "???", ".", "_", "n/a", "na", "n.a.", "nil", "none", "null", "nan", "undefined", "unknown", "unbekannt", "inconnu", "desconocido", "tbd", "pending", "xx", "xxx", "und", "zxx", "mis", "mul"]


def cleaned(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", "")


def filled(c: Column) -> Column:
    """Whether a text holds a value; null, blank and placeholders do not."""
    return c.isNotNull() & ~F.coalesce(cleaned(c).isin(NO_VALUES), F.lit(True))


def language_code(c: Column) -> Column:
    """ISO 639-3 code of a label in any spelling, region after - or _ ignored; null if it names none of the languages known here."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable((n, code) for code, names in NAMES.items() for n in [code, *names])])
    word = F.regexp_extract(F.translate(cleaned(c), "_", "-"), r"(?U)^([^-\s(,;]+)", 1)
    return F.try_element_at(pairs, word)

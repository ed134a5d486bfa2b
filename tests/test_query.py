"""The query language and the literals in it."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from loomdex.functions.analysis import detect_language_py, stem_py
from loomdex.functions.text import normalise_py
from loomdex.functions.values import Span, parse_dates, parse_size
from loomdex.operators.corpus import glob_regex
from loomdex.operators.snippets import highlight_py, snippets_py
from loomdex.plans.query import And, Filter, Not, Or, Phrase, Query, QuerySyntaxError, Term, parse

NOW = 1735689600000


@pytest.mark.parametrize(
    "text, tree",
    [
        ("", None),
        ("   ", None),
        ("database", Term("database")),
        ('"database replication"', Phrase("database replication", ("database", "replication"))),
        ("database cache", And(Term("database"), Term("cache"))),
        ("database AND cache", And(Term("database"), Term("cache"))),
        ("database or cache", Or(Term("database"), Term("cache"))),
        ("database NOT mysql", And(Term("database"), Not(Term("mysql")))),
        ("(database OR redis) AND cache", And(Or(Term("database"), Term("redis")), Term("cache"))),
        ("type:pdf", Filter("type", ":", "pdf")),
        ("size>10MB", Filter("size", ">", "10MB")),
        ('folder:"system design"', Filter("folder", ":", "system design")),
        ("type:pdf database", And(Filter("type", ":", "pdf"), Term("database"))),
        ("a OR b AND c", Or(Term("a"), And(Term("b"), Term("c")))),
        ("café", Term("cafe")),
        ("author:Ada", Filter("author", ":", "Ada")),
        ("created>=2024-01-01", Filter("created", ">=", "2024-01-01")),
        ("http://x", Filter("http", ":", "//x")),
        ("run-time", Term("run-time")),
        ("NOT", Not(Term(""))),
        ("a) b", Term("a")),
        ('"open end', Phrase("open end", ("open", "end"))),
        ('"" x', Term("x")),
    ],
)
def test_trees(text, tree):
    assert parse(text).root == tree


def test_missing_parenthesis():
    with pytest.raises(QuerySyntaxError, match="Expected RPAREN but got EOF"):
        parse("(a")


def test_has_filters():
    assert parse("a type:pdf").has_filters and not parse("a b").has_filters and not Query(None).has_filters


def test_strict_splits_punctuation():
    assert parse("run-time", strict=True).root == Phrase("run-time", ("run", "time"))


@given(st.text(alphabet='ab "()<>:NOTANDOR-é', max_size=30))
def test_any_text_parses_or_lacks_a_parenthesis(text):
    try:
        parse(text)
    except QuerySyntaxError:
        assert "(" in text


@pytest.mark.parametrize("text, n", [("10MB", 10 * 2**20), ("1.5 kb", 1536), ("7", 7), ("7b", 7), ("1tb", 2**40), ("x", None), ("1 zb", None), ("-1kb", None), ("0.5b", 1)])
def test_sizes(text, n):
    assert parse_size(text) == n


def test_dates():
    day = 86400000
    assert parse_dates("today", NOW + 5) == Span(NOW, NOW + day)
    assert parse_dates("Yesterday", NOW) == Span(NOW - day, NOW)
    assert parse_dates("last7days", NOW) == Span(NOW - 7 * day, NOW + day)
    assert parse_dates("last1month", NOW).start == NOW - 31 * day
    assert parse_dates("last1year", NOW).start == NOW - 366 * day
    assert parse_dates("2024-01-01", NOW) == Span(1704067200000, 1704067200000)
    assert parse_dates("soon", NOW) is None


@pytest.mark.parametrize("word, stem", [("running", "run"), ("flies", "fli"), ("connection", "connect"), ("relational", "relat"), ("hopping", "hop"), ("agreed", "agre"), ("sky", "sky"), ("is", "is"), ("कविता", "कविता")])
def test_stems(word, stem):
    assert stem_py(word) == stem


def test_stem_other_language():
    assert stem_py("running", "hin") == "running" and stem_py("running", None) == "running"


def test_normalise():
    assert normalise_py("Hello World") == "hello world"
    assert normalise_py(" café résumé naïve ") == "cafe resume naive"
    assert normalise_py("ｂｅｒ½") == "ber1⁄2"
    assert normalise_py("नमस्ते") == "नमस्ते"
    assert normalise_py(None) is None


def test_detect():
    assert detect_language_py("The quick brown fox jumps over the lazy dog and this is a test.") == "eng"
    assert detect_language_py("यह एक हिंदी वाक्य है और इसमें कई शब्द हैं") == "hin"
    assert detect_language_py("हे एक मराठी वाक्य आहे आणि त्यात अनेक शब्द आहेत") == "mar"
    assert detect_language_py("") is None and detect_language_py(None) is None and detect_language_py("12 34") is None


def test_globs():
    import re

    fits = lambda g, p: re.fullmatch(glob_regex(g), p) is not None
    assert fits("*.tmp", "a.tmp") and not fits("*.tmp", "x/a.tmp") and fits("**/*.tmp", "x/y/a.tmp") and fits("**/*.tmp", "a.tmp")
    assert fits("a?[bc].{txt,md}", "axb.md") and not fits("a?[!b]", "axb") and fits("*", ".hidden")


def test_snippets():
    text = "x " * 200 + "needle " + "y " * 300 + "needle end"
    s = snippets_py(text, ["Needle"])
    assert len(s) == 2 and all("needle" in x for x in s) and s[0].startswith("…") and s[0].endswith("…") and not s[1].endswith("…")
    assert snippets_py("plain text", ["none"]) == ["plain text"]
    assert snippets_py("", ["a"]) == [] and snippets_py(None, ["a"]) == []
    assert snippets_py("a b c", [], [1]) == ["a b c"]


def test_highlight():
    assert highlight_py("the quick fox", ["quick", "fox"], ["fox", "quick"]) == [("the ", "text"), ("quick", "phrase"), (" ", "text"), ("fox", "phrase")]
    assert highlight_py("Foxes fox", [], ["fox"]) == [("Foxes ", "text"), ("fox", "term")]
    assert highlight_py("x", [], []) == [("x", "text")]


def test_logs(tmp_path):
    from loomdex.log import Logs

    logs = Logs(str(tmp_path), ("index",))
    logs.info("index", "sync", "3 files")
    logs.error("error", "sync", "not written")
    logs.debug("index", "sync", "not written")
    logs.close()
    assert (tmp_path / "index.log").read_text().endswith("[INFO] [sync] 3 files\n") and not (tmp_path / "error.log").exists()

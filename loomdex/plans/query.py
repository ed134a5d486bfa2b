"""The query language: words, "phrases", key:value filters, AND, OR, NOT and parentheses. Plain Python, no Spark."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from loomdex.functions.text import normalise_py


class Node:
    """A node of the query tree."""


@dataclass(frozen=True)
class Term(Node):
    value: str


@dataclass(frozen=True)
class Phrase(Node):
    value: str
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Filter(Node):
    key: str
    operator: str
    value: str


@dataclass(frozen=True)
class And(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Or(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Not(Node):
    child: Node


@dataclass(frozen=True)
class Query:
    root: Node | None

    @property
    def has_filters(self) -> bool:
        return any(isinstance(n, Filter) for n in walk(self.root))


class QuerySyntaxError(ValueError):
    pass


_LEXEME = re.compile(
    r"""\s*(?:
      (?P<open>\() | (?P<close>\))
    | "(?P<phrase>[^"]*)(?:"|$)
    | (?P<op>and|or|not)(?=[\s()]|$)
    | (?P<key>[a-z][a-z0-9]*)(?P<cmp>:|>=|<=|>|<)(?:"(?P<quoted>[^"]*)(?:"|$)|(?P<bare>[^\s()]*))
    | (?P<word>[^\s()]+)
    )""",
    re.IGNORECASE | re.VERBOSE | re.ASCII,
)


def _phrase_terms(value: str) -> tuple[str, ...]:
    """Words of a phrase: letters and digits; marks separate, unlike in the index."""
    return tuple(w for w in re.split(r"[\W_]+", value) if w)


def lex(text: str, strict: bool = False) -> list[Node | str]:
    """Leaves, and the signs ( ) AND OR NOT, in order. strict: words with punctuation become phrases, and phrases keep marks."""
    out: list[Node | str] = []
    text = text.strip()
    at = 0
    while m := _LEXEME.match(text, at):
        at = m.end()
        if m["open"] or m["close"]:
            out.append(m["open"] or m["close"])
        elif m["op"]:
            out.append(m["op"].upper())
        elif m["phrase"] is not None:
            value = normalise_py(m["phrase"].strip()) or ""
            if value:
                out.append(Phrase(value, strict_terms(value) if strict else _phrase_terms(value)))
        elif m["key"]:
            out.append(Filter(m["key"].lower(), m["cmp"], m["quoted"] if m["quoted"] is not None else m["bare"] or ""))
        else:
            value = normalise_py(m["word"]) or ""
            parts = strict_terms(value) if strict else (value,)
            out.append(Term(parts[0]) if len(parts) == 1 else Phrase(value, parts) if parts else Term(value))
        if at >= len(text):
            break
    return out


def strict_terms(value: str) -> tuple[str, ...]:
    """Words as the index has them: letters, digits and marks."""
    import regex

    return tuple(w for w in regex.split(r"[^\p{L}\p{N}\p{M}]+", value) if w)


#: How tightly a binary operator binds.
_BINDS = {"OR": 1, "AND": 2}


def parse(text: str, strict: bool = False) -> Query:
    """Words side by side are joined by AND; NOT binds tightest, OR least. An operator without operand stands for an empty word.

    A closing parenthesis too many ends the query; one too few is an error.
    """
    items = lex(text, strict)
    if not items:
        return Query(None)
    root, _ = _expression(items, 0, 1)
    return Query(root)


def _expression(items: list, at: int, least: int) -> tuple[Node, int]:
    left, at = _operand(items, at)
    while at < len(items):
        sign = items[at]
        if sign == ")":
            break
        op = sign if sign in ("AND", "OR") else "AND"
        if _BINDS[op] < least:
            break
        right, at = _expression(items, at + (sign == op), _BINDS[op] + 1)
        left = (And if op == "AND" else Or)(left, right)
    return left, at


def _operand(items: list, at: int) -> tuple[Node, int]:
    if at >= len(items):
        return Term(""), at + 1
    item = items[at]
    if item == "NOT":
        child, at = _operand(items, at + 1)
        return Not(child), at
    if item == "(":
        inner, at = _expression(items, at + 1, 1)
        if at >= len(items) or items[at] != ")":
            raise QuerySyntaxError("Expected RPAREN but got EOF")
        return inner, at + 1
    return (item if isinstance(item, Node) else Term("")), at + 1


def walk(node: Node | None) -> Iterator[Node]:
    """All nodes, left before right."""
    if node is None:
        return
    yield node
    for part in (getattr(node, "left", None), getattr(node, "right", None), getattr(node, "child", None)):
        yield from walk(part)


def leaves(root: Node | None) -> tuple[list[Term], list[Phrase]]:
    """Terms and phrases in order, those under NOT too."""
    nodes = list(walk(root))
    return [n for n in nodes if isinstance(n, Term)], [n for n in nodes if isinstance(n, Phrase)]

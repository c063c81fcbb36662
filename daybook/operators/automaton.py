"""Hundreds of names found in one pass over a text: an Aho-Corasick automaton, with the words' bounds and the equal letters that ``term_pattern`` has.

Letters compare without case, one by one, straight and curly quotes alike. A name that begins or ends with a word's character must begin or end there in the text too. Of a
client's names the one that begins first counts, of those that begin together the one that is listed first, as in the alternatives of a regular expression.

The automaton is built once in a worker and holds the names only, so its size is that of the list. Text goes through Arrow batches; rows stay where they are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Curly quotes and the straight ones that they are alike to.
_QUOTES = {0x2018: "'", 0x2019: "'", 0x201C: '"', 0x201D: '"'}


def _fold_table() -> dict[int, str]:
    """One character for each that has another case: the lower case of its upper case, where both are single."""
    table = dict(_QUOTES)
    for i in range(0x80, 0x20000):
        c = chr(i)
        up = c.upper() if len(c.upper()) == 1 else c
        low = up.lower() if len(up.lower()) == 1 else up
        if low != c and i not in table:
            table[i] = low
    table[0x130] = "i"  # whose lower case is a letter and a mark
    return table


_folds: dict[int, str] = {}
#: Letters of ASCII alone, and the sign of Kelvin, whose lower case is one.
_ASCII = {i: chr(i + 32) for i in range(65, 91)} | {0x212A: "k"}


def fold(text: str) -> str:
    """``text`` with letters of one case and straight quotes, character by character."""
    if text.isascii():
        return text.lower()
    if not _folds:
        _folds.update(_fold_table())
        _folds.update({i: chr(i + 32) for i in range(65, 91)})
    return text.translate(_folds)


def _word(c: str) -> bool:
    return c.isalpha() or c.isdecimal() or c == "_"


def _side(text: str, at: int) -> bool:
    """Whether the character at ``at`` belongs to a word: a mark without width does if what it stands on does."""
    c = text[at]
    if _word(c):
        return True
    while unicodedata.category(c) == "Mn":
        at -= 1
        if at < 0:
            return False
        c = text[at]
        if _word(c):
            return c != "_"
    return False


def _ascii_side(text: str, at: int) -> bool:
    c = text[at]
    return c == "_" or c.isascii() and c.isalnum()


def _bound(text: str, at: int, side=_side) -> bool:
    """Whether a word begins or ends before ``text[at]``."""
    return (at > 0 and side(text, at - 1)) != (at < len(text) and side(text, at))


class Finder:
    """The first mention of each client in a text. With ``ascii_words`` only letters, digits and underscores of ASCII make words, and only those letters have a case, as in expressions without Unicode classes."""

    def __init__(self, clients: list[tuple[str, list[str]]], ascii_words: bool = False):
        import ahocorasick

        self.fold = (lambda text: text.lower() if text.isascii() else text.translate(_ASCII)) if ascii_words else fold
        self.side = side = _ascii_side if ascii_words else _side
        edge = (lambda c: side(c, 0)) if ascii_words else (lambda c: c.isalnum() or c == "_")
        self.automaton = ahocorasick.Automaton()
        wanted: dict[str, list[tuple[int, int, bool, bool]]] = {}
        for place, (label, aliases) in enumerate(clients):
            for order, alias in enumerate(a.strip() for a in (aliases or [label]) if a and a.strip()):
                wanted.setdefault(self.fold(alias), []).append((place, order, edge(alias[0]), edge(alias[-1])))
        for name, uses in wanted.items():
            self.automaton.add_word(name, (len(name), uses))
        self.empty = not wanted
        if wanted:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> dict[int, tuple[int, int]]:
        """Place of each client that ``text`` names in the list, with where its first mention begins and how long it is."""
        if not text or self.empty:
            return {}
        found: dict[int, tuple[int, int, int]] = {}
        for last, (size, uses) in self.automaton.iter(self.fold(text)):
            begin = last + 1 - size
            for place, order, left, right in uses:
                known = found.get(place)
                if (known is None or (begin, order) < known[:2]) and (not left or _bound(text, begin, self.side)) and (not right or _bound(text, last + 1, self.side)):
                    found[place] = (begin, order, size)
        return {place: (begin, size) for place, (begin, _, size) in sorted(found.items())}


_finders: dict[str, Finder] = {}


def mentions(clients: list[tuple[str, list[str]]], *texts: Column, ascii_words: bool = False) -> Column:
    """``array<struct<place, source, at, size>>``: each client (by place in the list, in its order) that any of ``texts`` names, with the first of ``texts`` that does, and its first mention there from 1 on."""
    name = repr((clients, ascii_words))

    @F.pandas_udf("array<struct<place:int,source:int,at:int,size:int>>")
    def told(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        if name not in _finders:
            _finders.clear()
            _finders[name] = Finder(clients, ascii_words)
        finder = _finders[name]
        for batch in batches:
            out = []
            for row in zip(*batch, strict=True):
                hits: dict[int, dict] = {}
                for source, text in enumerate(row):
                    for place, (at, size) in finder.find(text).items():
                        hits.setdefault(place, {"place": place, "source": source, "at": at + 1, "size": size})
                out.append([hits[p] for p in sorted(hits)])
            yield pd.Series(out)

    return told.asNondeterministic()(*texts)  # so that a filter on the result doesn't compute it twice

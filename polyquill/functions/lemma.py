"""Words for matching beyond plain tokens: canonical decomposition without the
acute accent, and a tokeniser per language that may be replaced.

Lemmatisers of single languages are optional plug-ins: register one and the
queries that match answers by lemmas use it; without one the fallback is plain
words, for Chinese single characters. Tokenisers get composed text (NFC)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Tokeniser = Callable[[str], list[str]]


class _Blanked(dict):
    """For str.translate: punctuation and symbols but those of `kept` as blanks.
    Combining marks are parts of words."""

    def __init__(self, kept: str) -> None:
        super().__init__({ord(c): c for c in kept})

    def __missing__(self, code: int) -> str:
        self[code] = " " if unicodedata.category(chr(code))[0] in "PS" else chr(code)
        return self[code]


_QUOTES, _BRACKETS = ({ord(c): None for c in cs} for cs in ("\"'“”", "()"))
_PLAIN, _AZERBAIJANI = _Blanked("'"), _Blanked("-")


def plain_words(text: str) -> list[str]:
    return text.translate(_PLAIN).split()


def azerbaijani_words(text: str) -> list[str]:
    """Dotted capital I as I, also in lower case; quotes dropped, hyphens kept."""
    text = text.replace("İ", "I").replace("i\u0307", "i")
    return [w for w in text.translate(_QUOTES).translate(_AZERBAIJANI).split() if w.strip("-")]


def sundanese_words(text: str) -> list[str]:
    return plain_words(text.translate(_BRACKETS))


def chinese_characters(text: str) -> list[str]:
    return [c for c in text if c.isalnum()]


_TOKENISERS: dict[str, Tokeniser] = {"Azerbaijani": azerbaijani_words, "Sundanese": sundanese_words, "Chinese": chinese_characters}


def register(language: str, tokeniser: Tokeniser) -> None:
    """Use a lemmatiser for a language; it must be importable on executors."""
    _TOKENISERS[language] = tokeniser


def fold(word: str) -> str:
    """Canonical decomposition without U+0301, in lower case."""
    return unicodedata.normalize("NFD", word).replace("́", "").lower()


def _lemmas(text: str, tokenise: Tokeniser) -> list[str]:
    return [w for w in (fold(t) for t in tokenise(unicodedata.normalize("NFC", text))) if w]


def lemmas(text: str | None, language: str | None) -> list[str] | None:
    return None if text is None else _lemmas(text, _TOKENISERS.get(language or "", plain_words))


def lemmas_udf() -> Callable[[Column, Column], Column]:
    """Arrow-batched (text, language) -> array of folded words."""
    held = dict(_TOKENISERS)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, languages in batches:
            yield pd.Series([None if t is None else _lemmas(t, held.get(g or "", plain_words)) for t, g in zip(texts, languages, strict=True)], dtype=object)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<string>")


def lists_udf() -> Callable[[Column, Column], Column]:
    """(texts, languages) -> for each language the folded words of every text."""
    held = dict(_TOKENISERS)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for lists, languages in batches:
            yield pd.Series([None if ts is None or gs is None else [[_lemmas(t, held.get(g, plain_words)) for t in ts] for g in gs] for ts, gs in zip(lists, languages, strict=True)], dtype=object)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<array<array<string>>>")

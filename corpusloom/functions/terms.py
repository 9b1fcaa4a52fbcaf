"""Query terms: of the documentation engine and of the code engine, on the driver and as columns."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that documentation queries drop, and how many terms are kept.
STOPWORDS = ["a", "an", "and", "are", "as", "do", "for", "how", "i", "in", "is", "of", "or", "the", "to", "with"]
MAX_TERMS, MAX_TOKENS = 8, 12
NOT_ASCII = r"[^\x00-\x7f]"


def _first_occurrences(items: list[str]) -> list[str]:
    return list(dict.fromkeys(items))


def docs_terms(query: str) -> list[str]:
    """The first eight different words of letters a to z, digits and _, without stopwords."""
    words = "".join(c if c.isascii() and (c.isalnum() or c == "_") else " " for c in query.lower()).split()
    return [w for w in _first_occurrences(words) if w not in STOPWORDS][:MAX_TERMS]


def variants(term: str) -> list[str]:
    """The term, and its singular where it looks like a plural of more than three letters."""
    out = [term]
    if len(term) > 3:
        if term.endswith("ies"):
            out.append(term[:-3] + "y")
        if term.endswith("s"):
            out.append(term[:-1])
    return _first_occurrences(out)


def expanded_terms(terms: list[str]) -> list[str]:
    return _first_occurrences([v for t in terms for v in variants(t)])


def code_tokens(query: str) -> list[str]:
    """The first twelve different words of two or more letters or digits; _ separates, other signs are dropped."""
    words = ["".join(c for c in w.lower() if c.isalnum()) for w in query.replace("_", " ").split()]
    return _first_occurrences([w for w in words if len(w) >= 2])[:MAX_TOKENS]


def match_string(tokens: list[str]) -> str | None:
    """The prefix query of code tokens; None if there are none."""
    return " OR ".join(f"{t}*" for t in tokens) or None


def docs_terms_column(query: Column) -> Column:
    """:func:`docs_terms` of a column of queries."""
    words = F.regexp_extract_all(F.lower(query), F.lit("([a-z0-9_]+)"), 1)
    return F.slice(F.array_except(words, F.array(*map(F.lit, STOPWORDS))), 1, MAX_TERMS)


def variants_column(term: Column) -> Column:
    long = F.char_length(term) > 3
    ies = F.when(long & term.endswith("ies"), F.concat(term.substr(F.lit(1), F.char_length(term) - 3), F.lit("y")))
    singular = F.when(long & term.endswith("s"), term.substr(F.lit(1), F.char_length(term) - 1))
    return F.array_distinct(F.array_compact(F.array(term, ies, singular)))


def expanded_column(terms: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(terms, variants_column)))


def code_tokens_column(query: Column) -> Column:
    """:func:`code_tokens` of a column of queries."""
    words = F.transform(F.split(F.lower(F.regexp_replace(query, "_", " ")), r"(?U)\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    return F.slice(F.array_distinct(F.filter(words, lambda w: F.char_length(w) >= 2)), 1, MAX_TOKENS)


@cache
def _folding() -> tuple[str, str]:
    """Letters that lose their diacritics and what is left of them; then, without a counterpart, the marks themselves."""
    changed, gone = {}, []
    for code in [*range(0x80, 0xD800), *range(0xE000, 0x10000)]:
        letter = chr(code)
        bare = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", letter) if unicodedata.category(c) != "Mn"))
        if not bare:
            gone.append(letter)
        elif len(bare) == 1 and bare != letter:
            changed[letter] = bare
    return "".join(changed) + "".join(gone), "".join(changed.values())


def fold(text: str) -> str:
    """:func:`folded` of a text on the driver."""
    old, new = _folding()
    return text.lower().translate(str.maketrans(old[: len(new)], new, old[len(new) :]))


def folded(text: Column) -> Column:
    """Lower case without diacritics; null as empty text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike(NOT_ASCII), F.translate(low, *_folding())).otherwise(low)


def index_tokens(text: Column) -> Column:
    """Tokens of the full-text index: folded runs of letters and digits."""
    return F.array_remove(F.split(folded(text), r"[^\p{L}\p{N}]+"), "")

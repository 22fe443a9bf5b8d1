"""Tokens for lexicons with phrases, emoticons and hyphenated entries.

An entry that the plain word rule would cut, such as `:)` or `well-known`, is a
symbol and is met as a whole piece between white space. An entry of several words
is a phrase; at every place of a text the longest phrase that starts there is
one token. Entries are rules held by the caller, not data.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BREAK = r"[^\p{L}']+"
PIECE_BREAK = r"[\x20\x09-\x0D]+"
TAIL = "[.,!?]+$"


def symbols_of(entries: Iterable[str]) -> list[str]:
    """Entries of one piece that hold more than letters and apostrophes, in small letters."""
    small = {e.lower() for e in entries}
    return sorted(e for e in small if len(e.split()) == 1 and not e.replace("'", "").isalpha() and e.strip("'"))


def normal(entry: str, symbols: Sequence[str]) -> str:
    """The entry's tokens in small letters, separated by single spaces."""
    words = []
    for piece in entry.lower().split():
        words += [piece] if piece in symbols else re.findall(r"(?:[^\W\d_]|')+", piece)
    return " ".join(words)


def phrases_of(entries: Iterable[str], symbols: Sequence[str]) -> list[str]:
    """Entries of several tokens, normalised."""
    return sorted({n for e in entries if " " in (n := normal(e, symbols))})


def phrase_pattern(phrases: Iterable[str]) -> str:
    """A regular expression for the longest phrase at a place; phrases share their first words."""
    root: dict = {}
    for phrase in phrases:
        node = root
        for word in phrase.split(" "):
            node = node.setdefault(word, {})
        node[""] = {}

    def after(node: dict) -> str:
        following = "|".join(rf"\Q{word}\E" + after(below) for word, below in sorted(node.items()) if word)
        return f"(?: (?:{following}))" + "?" * ("" in node) if following else ""

    return "|".join(rf"\Q{word}\E" + after(below) for word, below in sorted(root.items()))


def pieces(text: Column, symbols: Sequence[str]) -> Column:
    """Words and symbols of a text in order; a symbol may be followed by marks."""
    if not symbols:
        return F.array_remove(F.split(text, WORD_BREAK), "")

    def cut(piece: Column) -> Column:
        bare = F.regexp_replace(piece, TAIL, "")
        return (
            F.when(F.lower(piece).isin(*symbols), F.array(piece))
            .when(F.lower(bare).isin(*symbols), F.array(bare))
            .otherwise(F.array_remove(F.split(piece, WORD_BREAK), ""))
        )

    return F.flatten(F.transform(F.split(text, PIECE_BREAK), cut))


def units(text: Column, symbols: Sequence[str] = (), phrases: Sequence[str] = ()) -> Column:
    """Tokens of a text: phrases (words separated by one space), symbols, words.

    Marks between the words of a phrase do not matter. NULL gives NULL, an empty
    text an empty array. Work is linear in the text.
    """
    tokens = pieces(text, symbols)
    if not phrases:
        return tokens
    pattern = rf"(?iu)({phrase_pattern(phrases)}|[^ ]+)(?: |$)"
    return F.regexp_extract_all(F.array_join(tokens, " "), F.lit(pattern), F.lit(1))

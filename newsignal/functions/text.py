"""Column functions on plain text and URLs. All run inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space; Spark's trim alone
# only knows U+0020.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

CHAINED_TERMS = 12

WORD_BREAK = r"[^\p{L}\p{N}]+"


def strip(text: Column) -> Column:
    """Text without white space at its ends; looks at the ends only."""
    return F.trim(text, F.lit(SPACES))


def empty_to_null(text: Column, sentinels: Iterable[str] = ("",)) -> Column:
    return F.when(~text.isin(*sentinels), text)


def first_digits(text: Column) -> Column:
    """First run of digits, NULL when there is none."""
    return empty_to_null(F.regexp_extract(text, r"(\d+)", 1))


def domain(url: Column) -> Column:
    return empty_to_null(F.regexp_extract(url, r"https?://(?:www\.)?([^/]+)", 1))


def strip_protocol(url: Column, https: bool = True) -> Column:
    return F.regexp_replace(url, "https?://" if https else "http://", "")


def cut_last_dot(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def slug(url: Column) -> Column:
    """Readable article name. Not a key: pages of one site can share it."""
    return F.regexp_replace(cut_last_dot(strip_protocol(url)), "[./]", "_")


def url_key(url: Column) -> Column:
    return F.sha2(url, 256)


def split_urls(field: Column, separator: str = "<UDIV>") -> Column:
    return F.split(field, separator)


def swap_suffix(name: Column, old: str = ".zip", new: str = ".parquet") -> Column:
    return F.replace(name, F.lit(old), F.lit(new))


def words(text: Column) -> Column:
    """Letter and digit runs in order, case kept."""
    return F.array_remove(F.split(text, WORD_BREAK), "")


def contains_any(text: Column, terms: Iterable[str], ignore_case: bool = False) -> Column:
    """True where the text contains any term as a substring.

    A few terms are a chain of `contains`. Many terms are one alternation behind
    a look at the next character, so that most positions cost a single test.
    """
    if ignore_case:
        text, terms = F.lower(text), [t.lower() for t in terms]
    terms = list(terms)
    if len(terms) <= CHAINED_TERMS or "" in terms:
        return reduce(Column.__or__, [text.contains(t) for t in terms], F.lit(False))
    starts = "".join(sorted({re.escape(t[0]) for t in terms}))
    return text.rlike(f"(?=[{starts}])(?:{'|'.join(map(re.escape, terms))})")


def number(text: Column, kind: str = "double") -> Column:
    """Number or NULL. Text such as 'nan' or 'inf' counts as missing."""
    value = text.try_cast(kind)
    if kind in ("double", "float"):
        finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
        return F.when(finite, value)
    return value


def day(text: Column) -> Column:
    """Date of a text YYYY-MM-DD, with or without time and zone; NULL when it is not one."""
    return text.try_cast("date")


def compact_day(digits: Column) -> Column:
    """Date of an eight-digit stamp, NULL when it is not one."""
    return F.to_date(F.try_to_timestamp(digits, F.lit("yyyyMMdd")))

"""The simple text profile: lower case, tokens of a-z and 0-9, an optional list of words to leave out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the English profile leaves out.
STOP_WORDS = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())


def tokens(text: Column, stop: frozenset[str] = frozenset()) -> Column:
    found = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")
    return F.filter(found, lambda t: ~t.isin(sorted(stop))) if stop else found


def words(query: str) -> list[str]:
    """A query's tokens, in order."""
    return [t for t in re.split("[^a-z0-9]+", query.lower()) if t]


def query_terms(query: str, stop: frozenset[str] = frozenset()) -> list[str]:
    """Distinct terms of a query, in order."""
    return list(dict.fromkeys(t for t in words(query) if t not in stop))


def occurrences(text: Column, needle: Column | str) -> Column:
    """How often needle occurs in text, not overlapping."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("int")


def snippet(text: Column, length: int = 200) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)

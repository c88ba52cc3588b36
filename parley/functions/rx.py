"""One pattern text for two engines: Python's ``re`` and Java's regular expressions.

Patterns are kept in Python's dialect.  For Spark they get the flags that make
Java treat word characters, boundaries, case and line ends as Python does, and
replacements are turned from ``\\1`` to ``$1``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def java(pattern: str, ignore_case: bool = True) -> str:
    """The pattern for Java: Unicode classes, newline-only line ends, optional case folding."""
    return f"(?{'i' if ignore_case else ''}dU){re.sub(r'[(][?]P<[a-z_]+>', '(', pattern)}"


def java_replacement(text: str) -> str:
    return re.sub(r"\\(\d)", r"$\1", text.replace("$", r"\$"))


def search(column: Column, pattern: str, ignore_case: bool = True) -> Column:
    return column.rlike(java(pattern, ignore_case))


def replace(column: Column, pattern: str, by: str, ignore_case: bool = True) -> Column:
    return F.regexp_replace(column, java(pattern, ignore_case), java_replacement(by))


def extract(column: Column, pattern: str, group: int, ignore_case: bool = True) -> Column:
    """A group's text, null where the pattern is not found or the group took no part."""
    p = java(pattern, ignore_case)
    return F.when(column.rlike(p), F.nullif(F.regexp_extract(column, p, group), F.lit("")))


def quoted(column: Column) -> Column:
    """A column's value as a literal inside a pattern."""
    return F.concat(F.lit("\\Q"), column, F.lit("\\E"))


def any_of(words, longest_first: bool = True) -> str:
    """Alternation of literal words."""
    return "|".join(map(re.escape, sorted(words, key=len, reverse=True) if longest_first else words))

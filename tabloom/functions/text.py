"""Column functions on strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def first_number(c: Column) -> Column:
    """First run of digits as a number; null when there is none."""
    found = F.regexp_extract(c, r"(\d+)", 1)
    return F.when(found != "", found).try_cast("double")


def first_char(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.substring(c, 1, 1))


def first_token(c: Column) -> Column:
    return F.element_at(F.split(F.trim(c), r"\s+"), 1)


def last_token(c: Column) -> Column:
    return F.element_at(F.split(F.trim(c), r"\s+"), -1)


def all_digits(c: Column) -> Column:
    return c.rlike("^[0-9]+$")


def numeric_part(c: Column) -> Column:
    """Number of a mixed column; null where the value is a label."""
    return F.when(all_digits(c), c).try_cast("double")


def label_part(c: Column) -> Column:
    """Label of a mixed column; null where the value is a number."""
    return F.when(all_digits(c), F.lit(None).cast("string")).otherwise(c)


def letters_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z]", "")


def upper(c: Column) -> Column:
    return F.upper(c)


def tag_first_match(c: Column, patterns: Sequence[tuple[str, str]], default: str) -> Column:
    """Tag of the first pattern that matches, in the given order."""
    out = None
    for pattern, tag in patterns:
        hit = c.rlike(pattern)
        out = F.when(hit, tag) if out is None else out.when(hit, tag)
    return F.lit(default) if out is None else out.otherwise(default)


def replace_text(c: Column, old: str, new: str) -> Column:
    """Replace every occurrence inside the value."""
    return F.replace(c, F.lit(old), F.lit(new))


def cross(*cols: Column, sep: str = "_") -> Column:
    """Joined labels; null when any part is null."""
    parts: list[Column] = []
    for i, c in enumerate(cols):
        parts += [F.lit(sep), c] if i else [c]
    return F.concat(*parts)

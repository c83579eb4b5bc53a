"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_text(c: Column) -> Column:
    """White-space runs become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def normalize_anchor(c: Column) -> Column:
    """Lower case, with every run of other characters than letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", " "))


def estimate_tokens(c: Column, mode: str = "ceil") -> Column:
    """Four characters a token, rounded up or (``mode`` "floor") down."""
    return (F.ceil(F.length(c) / 4) if mode == "ceil" else F.floor(F.length(c) / 4)).cast("long")


def truncate_tokens(c: Column, limit: int) -> Column:
    return F.substring(c, 1, 4 * limit)


def strip_fence(c: Column) -> Column:
    """JSON without a markdown code fence around it."""
    return F.trim(F.regexp_replace(c, "^\\s*```(?:json)?\\s*|\\s*```\\s*$", ""))


def mask_secret(c: Column) -> Column:
    """First and last four characters; all masked up to eight; null gives an empty text."""
    k = F.trim(c)
    stars = F.expr("repeat('*', 1)")
    masked = F.concat(F.substring(k, 1, 4), F.rpad(stars, F.greatest(F.lit(4), F.length(k) - 8), "*"), F.right(k, F.lit(4)))
    return F.when(c.isNull() | (F.length(k) == 0), F.lit("")).when(F.length(k) <= 8, F.rpad(F.lit(""), F.length(k), "*")).otherwise(masked)


def page_markers(c: Column) -> Column:
    """Distinct page numbers of ``Page n:`` marks, in numeric order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit("Page (\\d+):"), F.lit(1)), lambda x: x.cast("int"))))

"""Column expressions shared by the operators.  All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def strip(col: Column) -> Column:
    """Trim any white space, not only spaces."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def null_tokens(col: Column, tokens: Iterable[str]) -> Column:
    return F.when(~col.isin(*tokens), col)


def blank_to_null(col: Column) -> Column:
    return F.when(col != "", col)


def matches(col: Column, pattern: str) -> Column:
    """Search anywhere; a null value does not match."""
    return F.coalesce(col.rlike(pattern), F.lit(False))


def prefix_matches(col: Column, pattern: str) -> Column:
    return matches(col, f"^(?:{pattern})")


def any_match(col: Column, some: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, (matches(col, p) for p in some))


def match_count(col: Column, some: Iterable[str]) -> Column:
    """How many of the patterns a value matches."""
    return reduce(lambda a, b: a + b, (matches(col, p).cast("int") for p in some))


def number(col: Column) -> Column:
    """A double where the text, thousands separators left out, is a plain number; else null.

    ``inf``, ``nan``, digit underscores and type suffixes such as ``1d`` are not numbers.
    """
    plain = F.regexp_replace(col, ",", "")
    return F.when(plain.rlike(P.NUMBER), F.trim(plain).try_cast("double"))


def amount(col: Column) -> Column:
    """As :func:`number`, currency signs left out too."""
    return number(F.regexp_replace(col, r"[$,]", ""))


def ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def clamp(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def all_upper(col: Column) -> Column:
    return (col == F.upper(col)) & (col != F.lower(col))


def all_lower(col: Column) -> Column:
    return (col == F.lower(col)) & (col != F.upper(col))


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def to_text(col: Column, kind: str) -> Column:
    """Text of a value; floating-point numbers without exponent so that sets compare alike.  Null stays null."""
    return F.when(col.isNotNull(), F.regexp_replace(F.format_string("%.6f", col.cast("double")), r"\.?0+$", "")) if kind in ("double", "float") else col.cast("string")


def parse_date(col: Column) -> Column:
    """A timestamp by a fixed ladder of formats."""
    ladder = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "MM-dd-yyyy", "yyyy/MM/dd", "M/d/yyyy")
    return F.coalesce(*(F.try_to_timestamp(col, F.lit(f)) for f in ladder))


def date_format_label(col: Column) -> Column:
    forms = ((r"\d{4}-\d{2}-\d{2}", "YYYY-MM-DD"), (r"\d{2}/\d{2}/\d{4}", "MM/DD/YYYY"), (r"\d{2}-\d{2}-\d{4}", "MM-DD-YYYY"), (r"\d{4}/\d{2}/\d{2}", "YYYY/MM/DD"))
    return F.coalesce(*(F.when(matches(col, p), F.lit(label)) for p, label in forms), F.lit("unknown"))


def messages(*some: tuple[Column, Column | str]) -> Column:
    """Array of the messages whose condition holds, in the order given."""
    found = F.array(*(F.when(cond, F.lit(text) if isinstance(text, str) else text) for cond, text in some))
    return F.filter(found, lambda x: x.isNotNull())


def name_has(column: str, words: Iterable[str]) -> bool:
    return any(w in column.lower() for w in words)

"""Filter values in their many spellings, turned into column predicates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted operator spellings.
OPERATOR_SPELLINGS = {
    "neq": "neq",
    "ne": "neq",
    "not_equal": "neq",
    "!=": "neq",
    "is_null": "is_null",
    "null": "is_null",
    "is_not_null": "is_not_null",
    "not_null": "is_not_null",
    "in": "in",
    "not_in": "not_in",
    "like": "like",
}
# Words that stand for a missing value.
NULL_WORDS = ("N/A", "NULL")
NOT_NULL_WORD = "NOT_NULL"
# Fixed value: largest surrogate id; longer digit strings are platform ids.
LARGEST_SURROGATE = 2147483647


@dataclass(frozen=True)
class Condition:
    operator: str
    value: Any = None

    @property
    def items(self) -> list:
        if isinstance(self.value, (list, tuple, set)):
            return list(self.value)
        return [self.value]


def parse_condition(raw: Any) -> Condition:
    """Normalise a scalar, word, list or ``{operator, value}`` into a Condition."""
    if isinstance(raw, Condition):
        return raw
    if isinstance(raw, Mapping):
        operator = OPERATOR_SPELLINGS.get(str(raw.get("operator", "eq")).strip().lower(), "eq")
        if operator in ("is_null", "is_not_null"):
            return Condition(operator)
        value = raw.get("value")
        if operator in ("in", "not_in") and not isinstance(value, (list, tuple, set)):
            value = [value]
        return Condition(operator, value)
    if isinstance(raw, str):
        word = raw.strip()
        if word in NULL_WORDS:
            return Condition("is_null")
        if word == NOT_NULL_WORD:
            return Condition("is_not_null")
        if word.startswith("!="):
            return Condition("neq", word[2:].strip())
        return Condition("eq", raw)
    if isinstance(raw, (list, tuple, set)):
        return Condition("in", list(raw))
    return Condition("eq", raw)


def predicate(column: Column, raw: Any, text: bool = False) -> Column:
    """Predicate with SQL null semantics: a comparison with NULL keeps no row.

    ``text`` compares as strings, for labels and dimension values.
    """
    cond = parse_condition(raw)
    cast = (lambda v: None if v is None else str(v)) if text else (lambda v: v)
    if text:
        column = column.cast("string")
    match cond.operator:
        case "is_null":
            return column.isNull()
        case "is_not_null":
            return column.isNotNull()
        case "neq":
            return column != F.lit(cast(cond.value))
        case "in":
            return column.isin([cast(v) for v in cond.items]) if cond.items else F.lit(False)
        case "not_in":
            return ~column.isin([cast(v) for v in cond.items]) if cond.items else F.lit(True)
        case "like":
            return column.cast("string").like(str(cond.value))
    return column == F.lit(cast(cond.value))


def id_predicate(column: Column, raw: Any) -> Column:
    """Predicate on a surrogate key: values that are no integers match nothing."""
    cond = parse_condition(raw)
    if cond.operator in ("is_null", "is_not_null"):
        return predicate(column, cond)
    if cond.operator == "like":
        return predicate(column, cond, text=True)
    ids = [int(v) for v in cond.items if _is_integer(v)]
    if not ids:
        return F.lit(False)
    if cond.operator in ("in", "not_in"):
        return predicate(column, Condition(cond.operator, ids))
    return predicate(column, Condition(cond.operator, ids[0]))


def has_no_numeric_member(raw: Any) -> bool:
    """An ``in`` list without any number is the agreed sign for "no access"."""
    cond = parse_condition(raw)
    return cond.operator == "in" and not any(_is_number(v) for v in cond.items)


def is_platform_post_id(raw: Any) -> bool:
    """Whether a post filter carries platform ids rather than surrogate keys."""
    cond = parse_condition(raw)
    if cond.operator in ("is_null", "is_not_null"):
        return False
    return any(_is_platform_id(v) for v in cond.items)


def matches_patterns(
    value: Column, include: Iterable[str] | str | None = None, exclude: Iterable[str] | str | None = None
) -> Column:
    """Keep a value when any include matches and no exclude does.

    ``/re/`` is a regular expression, anything else a case-insensitive substring.
    """

    def any_of(patterns) -> Column | None:
        listed = [patterns] if isinstance(patterns, str) else list(patterns or [])
        tests = [_one_pattern(value, p) for p in listed if p]
        if not tests:
            return F.lit(False) if listed else None
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    keep = F.lit(True)
    included, excluded = any_of(include), any_of(exclude)
    if included is not None:
        keep = keep & included
    if excluded is not None:
        keep = keep & ~excluded
    return keep


def _one_pattern(value: Column, pattern: str) -> Column:
    if len(pattern) > 1 and pattern.startswith("/") and pattern.endswith("/"):
        return value.rlike(pattern[1:-1])
    return F.lower(value).contains(pattern.lower())


def _is_integer(value: Any) -> bool:
    try:
        return value is not None and float(str(value)) == int(float(str(value)))
    except (ValueError, OverflowError):
        return False


def _is_number(value: Any) -> bool:
    try:
        float(str(value))
        return value is not None
    except ValueError:
        return False


def _is_platform_id(value: Any) -> bool:
    text = "" if value is None else str(value).strip()
    if text == "":
        return False
    digits = text.lstrip("+-")
    if not digits.isdigit() or len(text) - len(digits) > 1:
        return True
    return int(digits) > LARGEST_SURROGATE

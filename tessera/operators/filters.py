"""Composable filter expressions, compiled to one Column so that Catalyst can push them into the scan."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELD = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*$")


def field_column(name: str, schema: Any = None) -> Column:
    """A column, or for a dotted name whose first part is a JSON string column the value at that path, as a string."""
    if not FIELD.match(name):
        raise ValueError(f"not a field name: {name!r}")
    head, _, path = name.partition(".")
    if schema is not None and head not in schema.fieldNames():
        raise ValueError(f"unknown field {head!r}; the table has {', '.join(schema.fieldNames())}")
    return F.get_json_object(F.col(head), f"$.{path}") if path else F.col(head)


@dataclass(frozen=True)
class Filter:
    op: str
    field: str | None = None
    value: Any = None
    parts: tuple[Filter, ...] = ()

    def __and__(self, other: Filter) -> Filter:
        return and_(self, other)

    def __or__(self, other: Filter) -> Filter:
        return or_(self, other)

    def __invert__(self) -> Filter:
        return not_(self)

    def column(self, schema: Any = None) -> Column:
        if self.op == "and":
            return reduce(lambda a, b: a & b, (p.column(schema) for p in self.parts))
        if self.op == "or":
            return reduce(lambda a, b: a | b, (p.column(schema) for p in self.parts))
        if self.op == "not":
            return ~self.parts[0].column(schema)
        c = field_column(self.field, schema)
        if self.op == "json":
            return json_contains_column(c, self.value)
        return {
            "eq": lambda: c == self.value, "gt": lambda: c > self.value, "lt": lambda: c < self.value, "ge": lambda: c >= self.value, "le": lambda: c <= self.value,
            "like": lambda: c.like(f"%{self.value}%"), "literal": lambda: c.contains(self.value), "in": lambda: c.isin(list(self.value)),
            "between": lambda: c.between(*self.value), "exists": c.isNotNull, "null": c.isNull,
        }[self.op]()

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.column(df.schema))


def json_contains_column(c: Column, value: Any) -> Column:
    """Containment of JSON: every key, however deep, has the given value; items of lists must all be contained in some item.

    Numbers are compared as numbers, null is a value, and keys may hold any character. False for text that is no JSON.
    """
    return F.coalesce(variant_contains(F.try_parse_json(c), value), F.lit(False))


def variant_contains(v: Column, value: Any) -> Column:
    kind = F.schema_of_variant(v)
    if isinstance(value, dict):
        quote = lambda key: f"$['{key}']" if "'" not in key else f'$["{key}"]'
        return reduce(lambda a, b: a & b, (F.coalesce(variant_contains(F.try_variant_get(v, quote(k), "variant"), x), F.lit(False)) for k, x in value.items()), kind.startswith("OBJECT"))
    if isinstance(value, list):
        items = F.try_variant_get(v, "$", "array<variant>")
        return reduce(lambda a, b: a & b, (F.coalesce(F.exists(items, (lambda y: lambda i: F.coalesce(variant_contains(i, y), F.lit(False)))(x)), F.lit(False)) for x in value), kind.startswith("ARRAY"))
    if value is None:
        return F.is_variant_null(v)
    if isinstance(value, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == value)
    if isinstance(value, (int, float)):
        return kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (F.try_variant_get(v, "$", "double") == float(value))
    return (kind == "STRING") & (F.try_variant_get(v, "$", "string") == str(value))


def checked(field: str, value: Any, kinds: tuple[type, ...]) -> Any:
    if value is None or not isinstance(value, kinds):
        raise TypeError(f"{field}: {value!r} has the wrong type")
    return value


ORDERED = (int, float, str, date)


def iso_date(value: str | date) -> date:
    """A date, or one from its ISO form YYYY-MM-DD."""
    if isinstance(value, date):
        return value
    try:
        return date.fromisoformat(value)
    except (ValueError, TypeError) as e:
        raise ValueError(f"not a date of the form YYYY-MM-DD: {value!r}") from e


def date_between(field: str, low: str | date, high: str | date) -> Filter:
    return between(field, iso_date(low), iso_date(high))


def equals(field: str, value: Any) -> Filter:
    return Filter("eq", field, checked(field, value, (int, float, str, bool, date)))


def contains(field: str, value: str, escape: bool = False) -> Filter:
    """Substring match; % and _ in the value stay wildcards unless escape is set."""
    return Filter("literal" if escape else "like", field, checked(field, value, (str,)))


def in_values(field: str, values: Sequence[Any]) -> Filter:
    if not values:
        raise ValueError(f"{field}: the list of values is empty")
    return Filter("in", field, tuple(values))


def between(field: str, low: Any, high: Any) -> Filter:
    if isinstance(low, str) != isinstance(high, str) or low > high:
        raise ValueError(f"{field}: {low!r} is above {high!r}")
    return Filter("between", field, (checked(field, low, ORDERED), checked(field, high, ORDERED)))


def exists(field: str) -> Filter:
    return Filter("exists", field)


def is_null(field: str) -> Filter:
    return Filter("null", field)


def greater_than(field: str, value: Any) -> Filter:
    return Filter("gt", field, checked(field, value, ORDERED))


def less_than(field: str, value: Any) -> Filter:
    return Filter("lt", field, checked(field, value, ORDERED))


def greater_equal(field: str, value: Any) -> Filter:
    return Filter("ge", field, checked(field, value, ORDERED))


def less_equal(field: str, value: Any) -> Filter:
    return Filter("le", field, checked(field, value, ORDERED))


def jsonb_contains(field: str, value: dict) -> Filter:
    return Filter("json", field, checked(field, value, (dict,)))


def and_(*parts: Filter) -> Filter:
    return Filter("and", parts=tuple(parts))


def or_(*parts: Filter) -> Filter:
    return Filter("or", parts=tuple(parts))


def not_(part: Filter) -> Filter:
    return Filter("not", parts=(part,))


def matches(category: str | None = None, min_date: Any = None, max_date: Any = None, tags: Sequence[str] | None = None, source_file: str | None = None, names: dict[str, str] | None = None) -> Column:
    """The result filter: exact category, a date range that rows without date pass, any tag, part of the file name. Dates are dates or of the form YYYY-MM-DD."""
    at = {"category": "source_category", "date": "document_date", "tags": "tags", "file": "source_file"} | (names or {})
    out = F.lit(True)
    if category is not None:
        out = out & F.coalesce(F.col(at["category"]) == category, F.lit(False))
    if min_date is not None:
        out = out & F.coalesce(F.col(at["date"]) >= F.lit(iso_date(min_date)), F.lit(True))
    if max_date is not None:
        out = out & F.coalesce(F.col(at["date"]) <= F.lit(iso_date(max_date)), F.lit(True))
    if tags is not None:
        out = out & F.coalesce(F.arrays_overlap(F.col(at["tags"]), F.array(*map(F.lit, tags))), F.lit(False))
    if source_file is not None:
        out = out & F.coalesce(F.col(at["file"]).contains(source_file), F.lit(False))
    return out

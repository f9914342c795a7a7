"""Typed filters, nested groups, quick search, sort and paging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.columns import BOOLEAN, DATETIME, FLOAT, INT, STRING

_EQUALITY = {"eq", "not_eq", "is_null", "is_not_null"}
_ORDER = {"gt", "gte", "lt", "lte", "between"}

# The operators each column type allows.
OPERATORS = {
    STRING: _EQUALITY | {"contains", "in", "not_in"},
    INT: _EQUALITY | _ORDER | {"in", "not_in"},
    FLOAT: _EQUALITY | _ORDER | {"in", "not_in"},
    BOOLEAN: _EQUALITY,
    DATETIME: _EQUALITY | _ORDER,
}

_APPLY = {
    "eq": lambda c, v: c == F.lit(v),
    "not_eq": lambda c, v: c != F.lit(v),
    "gt": lambda c, v: c > F.lit(v),
    "gte": lambda c, v: c >= F.lit(v),
    "lt": lambda c, v: c < F.lit(v),
    "lte": lambda c, v: c <= F.lit(v),
    "between": lambda c, v: c.between(F.lit(v[0]), F.lit(v[1])),
    "contains": lambda c, v: c.contains(F.lit(v)),
    "in": lambda c, v: c.isin(list(v)),
    "not_in": lambda c, v: ~c.isin(list(v)),
    "is_null": lambda c, v: c.isNull(),
    "is_not_null": lambda c, v: c.isNotNull(),
}

# Tests of a list that no element may pass, and what is asked of the elements.
_NO_ELEMENT = {"not_eq": "eq", "not_in": "in"}


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str
    value: Any = None


@dataclass(frozen=True)
class Group:
    operator: str
    conditions: Sequence[Condition] = field(default_factory=tuple)
    groups: Sequence["Group"] = field(default_factory=tuple)


@dataclass(frozen=True)
class Elements:
    """An array column of a registry, tested element by element."""

    column: Column


Registry = Mapping[str, tuple[str, Column | Elements]]


def _base_kind(kind: str) -> str:
    return kind[5:-1] if kind.startswith("List(") else kind


def _list_test(column: Column, operator: str, value: Any) -> Column:
    """Test of a list: some element passes it, or none for ``not_eq`` and ``not_in``.

    A null list passes ``is_null`` alone; null elements pass nothing.
    """
    if operator in ("is_null", "is_not_null"):
        return _APPLY[operator](column, value)
    asked = _APPLY[_NO_ELEMENT.get(operator, operator)]
    found = F.exists(column, lambda e: F.coalesce(asked(e, value), F.lit(False)))
    return ~found if operator in _NO_ELEMENT else found


def condition(registry: Registry, test: Condition) -> Column:
    """Column of one test; an unknown column or operator is an error."""
    if test.column not in registry:
        raise ValueError(f"no such filter column: {test.column}")
    kind, column = registry[test.column]
    if test.operator not in OPERATORS[_base_kind(kind)]:
        raise ValueError(f"{test.operator} is not allowed on {test.column} ({kind})")
    if isinstance(column, Elements):
        return _list_test(column.column, test.operator, test.value)
    return _APPLY[test.operator](column, test.value)


def all_of(registry: Registry, tests: Sequence[Condition]) -> Column:
    """Conjunction of the tests; no test keeps every row."""
    return reduce(lambda a, b: a & b, [condition(registry, t) for t in tests], F.lit(True))


def group(registry: Registry, node: Group) -> Column:
    """Nested AND / OR groups; an empty group keeps every row."""
    if node.operator not in ("AND", "OR"):
        raise ValueError(f"group operator must be AND or OR, not {node.operator}")
    parts = [condition(registry, t) for t in node.conditions]
    parts += [group(registry, g) for g in node.groups]
    if not parts:
        return F.lit(True)
    return reduce((lambda a, b: a & b) if node.operator == "AND" else (lambda a, b: a | b), parts)


def filter_transactions(df: DataFrame, registry: Registry,
                        tests: Sequence[Condition] | Group = ()) -> DataFrame:
    test = group(registry, tests) if isinstance(tests, Group) else all_of(registry, tests)
    return df.filter(test)


def matches_search(text: str, *columns: Column) -> Column:
    """Case-insensitive substring of any of the columns."""
    found = [F.coalesce(F.lower(c).contains(text.lower()), F.lit(False)) for c in columns]
    return reduce(lambda a, b: a | b, found)


def has_status(status: str, complete: Column) -> Column:
    """all, completed or pending."""
    if status == "all":
        return F.lit(True)
    if status not in ("completed", "pending"):
        raise ValueError(f"unknown status {status!r}")
    return complete if status == "completed" else ~complete


def page(df: DataFrame, sort: Sequence[tuple[str, str]], unique: str,
         limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of the sorted rows; ``unique`` breaks ties."""
    order = [F.desc(c) if way.lower() == "desc" else F.asc(c) for c, way in sort]
    return df.orderBy(*order, F.asc(unique)).offset(offset).limit(limit)

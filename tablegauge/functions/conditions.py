"""Conditions on the cells of a row, from rule dictionaries.

A condition maps columns to tests, all of which must hold, or combines conditions:

    {"status": "sold", "price": {"min": 0.01}}
    {"or": [{"unit": ["cm", "mm"]}, {"not": {"length": {"missing": True}}}]}

A test is a value (the cell equals it), a list (the cell is one of them), ``None`` (the cell is
missing), or a mapping with any of the tests below. No test but ``missing`` holds for a missing
cell, so ``not`` of it does: conditions are true or false, never unknown.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions.columns import check_columns, check_key_types, col, holds, is_string, key_pair, number, type_of
from tablegauge.functions.missing import is_missing

COMBINED = ("and", "or", "not")


def _comparable_value(df: DataFrame, name: str, value: Any) -> Column:
    """A literal that the column may be compared with; Spark would match ``1`` with ``'1'``."""
    if is_string(df, name) != isinstance(value, str) and isinstance(type_of(df, name), (T.NumericType, T.StringType)):
        raise TypeError(f"column {name!r} is {type_of(df, name).simpleString()}; {value!r} is not")
    return F.lit(value)


def _equals(df: DataFrame, name: str, value: Any) -> Column:
    return col(name) == _comparable_value(df, name, value)


def _among(df: DataFrame, name: str, values: Sequence[Any]) -> Column:
    return col(name).isin([_comparable_value(df, name, v) for v in values]) if values else F.lit(False)


def _matches(df: DataFrame, name: str, pattern: str) -> Column:
    return F.rlike(col(name).cast("string"), F.lit(f"^(?:{pattern})$"))


def _like_column(df: DataFrame, name: str, other: str) -> Column:
    check_columns(df, [other])
    check_key_types(df, [name], df, [other])
    ours, theirs = key_pair(df, name, df, other)
    return ours == theirs


def _bound(compare: Callable[[Column, Column], Column]) -> Callable[[DataFrame, str, Any], Column]:
    return lambda df, name, limit: compare(number(df, name), _comparable_value(df, name, limit))


TESTS: dict[str, Callable[[DataFrame, str, Any], Column]] = {
    "equals": _equals,
    "differs": lambda df, name, value: ~_equals(df, name, value),
    "in": _among,
    "not_in": lambda df, name, values: ~_among(df, name, values),
    "min": _bound(lambda a, b: a >= b),
    "max": _bound(lambda a, b: a <= b),
    "above": _bound(lambda a, b: a > b),
    "below": _bound(lambda a, b: a < b),
    "matches": _matches,
    "column": _like_column,
}


def _test(df: DataFrame, name: str, test: Any) -> Column:
    check_columns(df, [name])
    missing = is_missing(df, name)
    if test is None:
        return missing
    if not isinstance(test, Mapping):
        return holds(_among(df, name, list(test)) if isinstance(test, (list, tuple, set)) else _equals(df, name, test)) & ~missing
    unknown = [kind for kind in test if kind not in TESTS and kind != "missing"]
    if unknown or not test:
        raise ValueError(f"column {name!r}: no tests {unknown}; there are {[*TESTS, 'missing']}")
    found = [holds(TESTS[kind](df, name, value)) & ~missing for kind, value in test.items() if kind != "missing"]
    if "missing" in test:
        found.append(missing if test["missing"] else ~missing)
    return reduce(lambda a, b: a & b, found)


def condition(df: DataFrame, rule: Mapping[str, Any]) -> Column:
    """A condition as a column that is true or false for every row."""
    if not rule:
        raise ValueError("a condition needs at least one test")
    found = []
    for name, test in rule.items():
        if name in ("and", "or"):
            parts = [condition(df, part) for part in test]
            if not parts:
                raise ValueError(f"{name!r} needs at least one condition")
            found.append(reduce((lambda a, b: a & b) if name == "and" else (lambda a, b: a | b), parts))
        elif name == "not":
            found.append(~condition(df, test))
        else:
            found.append(_test(df, name, test))
    return reduce(lambda a, b: a & b, found)


def columns_of(rule: Mapping[str, Any]) -> list[str]:
    """The columns that a condition looks at, in order."""
    found: list[str] = []
    for name, test in rule.items():
        if name == "not":
            found += columns_of(test)
        elif name in COMBINED:
            for part in test:
                found += columns_of(part)
        else:
            found.append(name)
            if isinstance(test, Mapping) and "column" in test:
                found.append(test["column"])
    return list(dict.fromkeys(found))

"""How often each value of a column occurs, and how many values there are.

Counting distinct values of many columns side by side makes Spark carry every column
through the shuffle once per column. Here each cell becomes a narrow ``(column, value)``
pair that is counted before and after the shuffle; a value that fills a third of the
table is a single row per task by then.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions.columns import (
    NESTED,
    check_columns,
    col,
    comparable_column,
    is_float,
    is_string,
    number,
    text_of,
    type_of,
)
from tablegauge.functions.missing import blank_to_null_column
from tablegauge.operators.tally import literal_rows, result_row

def _frequencies(cells: DataFrame) -> DataFrame:
    """``position, value, rows`` of a frame whose columns all have one type.

    A column's position is a cheaper grouping key than its name.
    """
    values = F.array(*[col(name) for name in cells.columns])
    return (
        cells.select(F.posexplode(values).alias("position", "value"))
        .groupBy("position", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def _name_at(names: Sequence[str], position: Column) -> Column:
    return F.array(*[F.lit(name) for name in names])[position]


def _text(df: DataFrame, name: str, blank_is_missing: bool) -> Column:
    if blank_is_missing and is_string(df, name):
        return blank_to_null_column(df, name)
    return text_of(df, name)


def value_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value, rows``: values as text, null for missing."""
    columns = check_columns(df, columns)
    found = _frequencies(df.select(*[_text(df, n, True).alias(n) for n in columns]))
    return found.select(_name_at(columns, F.col("position")).alias("column"), "value", "rows")


def _native(df: DataFrame, name: str, blank_is_missing: bool, digest: bool) -> Column:
    """A column in one of few types, with equal values staying equal and no others."""
    kind, value = type_of(df, name), number(df, name)
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return value.cast("bigint")
    if is_float(df, name):
        return value.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("bigint")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, (T.DecimalType, T.TimestampNTZType)):
        return value
    if digest:
        return F.unhex(F.sha2(_text(df, name, blank_is_missing), 256))
    if isinstance(kind, NESTED):
        return comparable_column(df, name)
    return _text(df, name, blank_is_missing)


def distinct_counts(
    df: DataFrame,
    columns: Sequence[str],
    *,
    blank_is_missing: bool = True,
    digest: bool = False,
) -> DataFrame:
    """Per column ``total``, ``missing`` and ``distinct``; zeros when the table is empty.

    Columns of one type are counted together in their own type, each group of them in a
    scan that reads these columns only. ``digest`` counts texts and nested values by their
    SHA-256, so that long ones need not be shuffled.
    """
    columns = check_columns(df, columns)
    cells = df.select(*[_native(df, n, blank_is_missing, digest).alias(n) for n in columns])
    groups: dict[str, list[str]] = {}
    for field in cells.schema:
        groups.setdefault(field.dataType.simpleString(), []).append(field.name)

    zero = F.lit(0).cast("long")
    parts = [
        literal_rows(
            df.sparkSession,
            [
                result_row(position=F.lit(i), present=zero, rows=zero)
                for i, _ in enumerate(cells.columns)
            ],
        )
    ]
    names: list[str] = []
    for group in groups.values():
        found = _frequencies(cells.select(*[col(n) for n in group]))
        present = F.col("value").isNotNull().cast("long").alias("present")
        position = (F.col("position") + len(names)).alias("position")
        parts.append(found.select(position, present, "rows"))
        names += group
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("position")
        .agg(
            F.sum("rows").alias("total"),
            F.sum(F.when(F.col("present") == 0, F.col("rows")).otherwise(0)).alias("missing"),
            F.sum("present").alias("distinct"),
        )
        .select(_name_at(names, F.col("position")).alias("column"), "total", "missing", "distinct")
    )

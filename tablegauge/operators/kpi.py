"""Core measures: completeness, uniqueness, controlled vocabularies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.columns import check_columns, col, is_string
from tablegauge.functions.missing import is_missing
from tablegauge.functions.rates import rate
from tablegauge.operators.frequencies import distinct_counts, value_frequencies
from tablegauge.operators.tally import Tally, Totals, measure, measure_each, result_row

# Fixed value: name of the row that sums up all fields.
TOTAL_FIELD = "_gesamt"


def completeness_tally(df: DataFrame, fields: Sequence[str]) -> Tally:
    fields = check_columns(df, fields)

    def rows(total: Totals) -> list[Column]:
        def row(name: str, missing: Column, cells: Column) -> Column:
            return result_row(
                field=F.lit(name), missing=missing, completeness=1 - rate(missing, cells)
            )

        every = reduce(lambda a, b: a + b, [total(f) for f in fields])
        return [
            *[row(f, total(f), total("rows")) for f in fields],
            row(TOTAL_FIELD, every, total("rows") * len(fields)),
        ]

    return Tally({f: is_missing(df, f) for f in fields}, rows)


def completeness(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``field, missing, completeness`` per mandatory field and over all of them."""
    return measure(df, completeness_tally(df, fields))


def uniqueness(df: DataFrame, fields: Sequence[str], *, digest: bool = False) -> DataFrame:
    """Per field: total, missing, distinct, duplicates, and distinct / total.

    Duplicates are present values beyond the first of their kind. ``digest`` compares
    long texts by their SHA-256.
    """
    fields = check_columns(df, fields)
    return distinct_counts(df, fields, digest=digest).select(
        F.col("column").alias("field"),
        "total",
        "missing",
        "distinct",
        (F.col("total") - F.col("missing") - F.col("distinct")).alias("duplicates"),
        rate(F.col("distinct"), F.col("total")).alias("uniqueness"),
    )


def _outside(df: DataFrame, column: str, allowed: Sequence[object]) -> Column:
    """Present and not in the vocabulary; exact and case-sensitive, never null."""
    if any(isinstance(value, str) != is_string(df, column) for value in allowed):
        raise TypeError(f"vocabulary of {column!r} does not match the column's type")
    member = F.coalesce(col(column).isin(list(allowed)), F.lit(False))
    return ~is_missing(df, column) & ~member


def vocabulary_tally(
    df: DataFrame, table: str, column: str, allowed: Sequence[object], *, uniform: bool = True
) -> Tally:
    check_columns(df, [column], table)
    if not allowed:
        raise ValueError(f"{table}.{column}: the vocabulary is empty")
    missing, outside = is_missing(df, column), _outside(df, column, allowed)

    def rows(total: Totals) -> list[Column]:
        values = {
            "table": F.lit(table),
            "column": F.lit(column),
            "allowed": F.lit(", ".join(map(str, allowed))),
            "total": total("rows"),
            "missing": total("missing"),
            "valid": total("valid"),
            "valid_rate": rate(total("valid"), total("rows")),
            "invalid": total("invalid"),
            "invalid_rate": rate(total("invalid"), total("rows")),
        }
        if uniform:
            values["uniform"] = (total("invalid") == 0) & (total("missing") == 0)
        return [result_row(**values)]

    return Tally({"missing": missing, "invalid": outside, "valid": ~missing & ~outside}, rows)


def vocabulary(
    tables: Mapping[str, DataFrame],
    checks: Sequence[tuple[str, str, Sequence[object]]],
    *,
    uniform: bool = True,
) -> DataFrame:
    """One row per ``(table, column, allowed values)``; each table is read once.

    ``uniform`` adds the flag of a unit check: nothing missing and nothing invalid.
    """
    return measure_each(
        tables,
        [
            (table, vocabulary_tally(tables[table], table, column, allowed, uniform=uniform))
            for table, column, allowed in checks
        ],
    )


def vocabulary_validity(
    tables: Mapping[str, DataFrame], checks: Sequence[tuple[str, str, Sequence[object]]]
) -> DataFrame:
    """:func:`vocabulary` for category fields, without the ``uniform`` flag."""
    return vocabulary(tables, checks, uniform=False)


def vocabulary_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value, rows``: how often each present value occurs, frequent ones first.

    Long rows rather than one map per column, so the number of values is not bounded.
    """
    found = value_frequencies(df, columns).filter(F.col("value").isNotNull())
    return found.orderBy("column", F.desc("rows"), "value")


def vocabulary_invalid(df: DataFrame, column: str, allowed: Sequence[object]) -> DataFrame:
    """``column, value, rows``: the present values outside the vocabulary."""
    check_columns(df, [column])
    return (
        df.filter(_outside(df, column, allowed))
        .groupBy(col(column).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(F.lit(column).alias("column"), "value", "rows")
    )

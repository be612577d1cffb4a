"""Missing-value primitives: blanks, missing cells, totals, blank to null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.columns import check_columns, is_string
from tablegauge.functions.missing import blank_in, blank_to_null_column, is_missing
from tablegauge.operators.tally import Tally, Totals, measure, result_row


def _per_column(df: DataFrame, columns: Sequence[str] | None, predicate, label: str) -> Tally:
    names = check_columns(df, df.columns if columns is None else columns)

    def rows(total: Totals) -> list[Column]:
        return [result_row(**{"column": F.lit(n), label: total(n)}) for n in names]

    return Tally({n: predicate(df, n) for n in names}, rows)


def blank_count_tally(df: DataFrame, columns: Sequence[str] | None = None) -> Tally:
    return _per_column(df, columns, blank_in, "blank")


def missing_count_tally(df: DataFrame, columns: Sequence[str] | None = None) -> Tally:
    return _per_column(df, columns, is_missing, "missing")


def missing_total_tally(df: DataFrame, columns: Sequence[str] | None = None) -> Tally:
    names = check_columns(df, df.columns if columns is None else columns)

    def rows(total: Totals) -> list[Column]:
        return [result_row(missing=sum((total(n) for n in names[1:]), total(names[0])))]

    return Tally({n: is_missing(df, n) for n in names}, rows)


def blank_count(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, blank``: empty or whitespace-only strings per column."""
    return measure(df, blank_count_tally(df, columns))


def missing_count(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, missing``: null, NaN and blank cells per column."""
    return measure(df, missing_count_tally(df, columns))


def missing_total(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``missing``: missing cells over all columns."""
    return measure(df, missing_total_tally(df, columns))


def blank_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Blank strings become null; everything else is untouched."""
    names = check_columns(df, df.columns if columns is None else columns)
    return df.withColumns(
        {n: blank_to_null_column(df, n) for n in names if is_string(df, n)}
    )

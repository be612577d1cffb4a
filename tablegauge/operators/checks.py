"""Row-level checks: plausible ranges, identifier formats, prices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions.columns import (
    any_of,
    check_columns,
    check_numeric,
    col,
    holds,
    is_string,
    number,
    type_of,
)
from tablegauge.functions.missing import null_in
from tablegauge.functions.rates import rate
from tablegauge.operators.tally import Tally, Totals, measure, measure_each, result_row


def plausible_range_tally(
    df: DataFrame, table: str, columns: Sequence[str], maximum: float | None = None
) -> Tally:
    columns = check_numeric(df, columns, table)
    values = [number(df, n) for n in columns]
    missing = any_of(v.isNull() for v in values)
    low = ~missing & any_of(holds(v <= 0) for v in values)
    high = (
        F.lit(False)
        if maximum is None
        else ~missing & any_of(holds(v > F.lit(float(maximum))) for v in values)
    )

    def rows(total: Totals) -> list[Column]:
        return [
            result_row(
                table=F.lit(table),
                columns=F.lit(", ".join(columns)),
                maximum=F.lit(None if maximum is None else float(maximum)).cast("double"),
                total=total("rows"),
                missing=total("missing"),
                too_low=total("too_low"),
                too_high=total("too_high"),
                implausible=total("implausible"),
                implausible_rate=rate(total("implausible"), total("rows")),
                plausible=total("plausible"),
                plausible_rate=rate(total("plausible"), total("rows")),
            )
        ]

    return Tally(
        {
            "missing": missing,
            "too_low": low,
            "too_high": high,
            "implausible": low | high,
            "plausible": ~missing & ~(low | high),
        },
        rows,
    )


def plausible_range(
    tables: Mapping[str, DataFrame],
    checks: Sequence[tuple[str, Sequence[str], float | None]],
) -> DataFrame:
    """One row per ``(table, columns, maximum)``; each table is read once.

    A row with a null in the group is missing; otherwise it is implausible when any
    value is <= 0 or above ``maximum``, and counted once. Rates are over all rows.
    """
    return measure_each(
        tables,
        [(t, plausible_range_tally(tables[t], t, cols, maximum)) for t, cols, maximum in checks],
    )


def identifier_format_tally(
    df: DataFrame,
    table: str,
    column: str,
    length: int,
    sentinels: Sequence[int] = (),
    *,
    pad: bool = True,
) -> Tally:
    check_columns(df, [column], table)
    if not (isinstance(type_of(df, column), T.NumericType) or is_string(df, column)):
        raise TypeError(f"{table}.{column}: identifiers are numbers or text")
    missing = null_in(df, column)
    code = number(df, column).try_cast("bigint")
    digits = F.length(code.cast("string"))
    unparseable = ~missing & code.isNull()
    sentinel = holds(code.isin([int(s) for s in sentinels])) if sentinels else F.lit(False)
    # A minus sign is no digit: padded codes may not be that long, exact ones not negative.
    wrong = digits > length if pad else (digits != length) | (code < 0)
    wrong_length = holds(wrong) & ~sentinel

    def rows(total: Totals) -> list[Column]:
        invalid = total("sentinel") + total("format_invalid") + total("unparseable")
        return [
            result_row(
                table=F.lit(table),
                column=F.lit(column),
                total=total("rows"),
                missing=total("missing"),
                sentinel=total("sentinel"),
                format_invalid=total("format_invalid"),
                format_invalid_rate=rate(total("format_invalid"), total("rows")),
                unparseable=total("unparseable"),
                total_invalid=invalid,
                total_invalid_rate=rate(invalid, total("rows")),
                valid=total("valid"),
                valid_rate=rate(total("valid"), total("rows")),
            )
        ]

    return Tally(
        {
            "missing": missing,
            "sentinel": sentinel,
            "format_invalid": wrong_length,
            "unparseable": unparseable,
            "valid": code.isNotNull() & ~sentinel & ~wrong_length,
        },
        rows,
    )


def identifier_format(
    df: DataFrame,
    column: str,
    length: int,
    sentinels: Sequence[int] = (),
    *,
    pad: bool = True,
    table: str = "",
) -> DataFrame:
    """Numeric codes of a given length; rates are over all rows.

    Codes are read as whole numbers and zero-padded, so shorter ones pass and only
    longer ones fail; ``pad=False`` asks for the exact length. Text that is no number is
    counted as ``unparseable`` and invalid.
    """
    return measure(
        df, identifier_format_tally(df, table, column, length, sentinels, pad=pad)
    )


def _bad_currency(df: DataFrame, currency: str, currencies: Sequence[str]) -> Column:
    return ~holds(col(currency).isin(list(currencies)))


def price_validity_tally(
    df: DataFrame,
    price: str,
    currency: str,
    sentinels: Sequence[float],
    low: float,
    high: float,
    currencies: Sequence[str],
) -> Tally:
    check_numeric(df, [price])
    check_columns(df, [currency])
    value = number(df, price).cast("double")
    sentinel = holds(value.isin([float(s) for s in sentinels])) if sentinels else F.lit(False)
    outside = ~sentinel & holds((value < F.lit(float(low))) | (value > F.lit(float(high))))
    foreign = _bad_currency(df, currency, currencies)
    invalid = sentinel | outside | foreign

    def rows(total: Totals) -> list[Column]:
        return [
            result_row(
                total=total("rows"),
                sentinel=total("sentinel"),
                out_of_range=total("out_of_range"),
                bad_currency=total("bad_currency"),
                invalid=total("invalid"),
                invalid_rate=rate(total("invalid"), total("rows")),
                valid=total("valid"),
                valid_rate=rate(total("valid"), total("rows")),
            )
        ]

    return Tally(
        {
            "sentinel": sentinel,
            "out_of_range": outside,
            "bad_currency": foreign,
            "invalid": invalid,
            "valid": ~invalid,
        },
        rows,
    )


def price_validity(
    df: DataFrame,
    price: str,
    currency: str,
    sentinels: Sequence[float],
    low: float,
    high: float,
    currencies: Sequence[str],
) -> DataFrame:
    """Sentinel prices, prices out of ``[low, high]``, and currencies not allowed.

    A row with several defects is invalid once. A null price is not a price defect; a
    null currency is not an allowed currency.
    """
    return measure(
        df, price_validity_tally(df, price, currency, sentinels, low, high, currencies)
    )


def price_bad_currencies(
    df: DataFrame, currency: str, currencies: Sequence[str]
) -> DataFrame:
    """``currency, rows``: currencies that are not allowed, null included."""
    check_columns(df, [currency])
    return (
        df.filter(_bad_currency(df, currency, currencies))
        .groupBy(col(currency).alias("currency"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )

"""Codes: check digits, formats, and the shapes that values have."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions.columns import check_columns, col, holds, is_string, number, text_of, type_of
from tablegauge.functions.missing import is_missing, null_in
from tablegauge.functions.rates import rate
from tablegauge.operators.tally import Tally, Totals, measure, result_row

LONGEST_CODE = 18  # digits that a bigint always holds


def _digit(code: Column, place: int) -> Column:
    """The digit at a place from the right, from 0."""
    shifted = F.expr(f"{10**place}L")
    return F.call_function("div", code, shifted) % 10 if place else code % 10


def check_digit_of(code: Column, length: int) -> Column:
    """The digit that a GS1 code of ``length`` digits should end in, by weights 3 and 1 from
    the second digit from the right; shorter codes count as padded with zeros."""
    weighted = [_digit(code, place) * (3 if place % 2 else 1) for place in range(1, length)]
    return (10 - reduce(lambda a, b: a + b, weighted) % 10) % 10


def _parts(
    df: DataFrame, column: str, length: int, sentinels: Sequence[int]
) -> dict[str, Column]:
    """Disjoint kinds of a code, which together are all rows."""
    check_columns(df, [column])
    if not (isinstance(type_of(df, column), T.NumericType) or is_string(df, column)):
        raise TypeError(f"{column}: codes are numbers or text")
    if not 2 <= length <= LONGEST_CODE:
        raise ValueError(f"length must be from 2 to {LONGEST_CODE}")
    missing = null_in(df, column)
    code = number(df, column).try_cast("bigint")
    unparseable = ~missing & (code.isNull() | holds(code < 0))
    sentinel = holds(code.isin([int(s) for s in sentinels])) & ~unparseable if sentinels else F.lit(False)
    judged = ~missing & ~unparseable & ~sentinel
    too_long = judged & holds(code >= 10**length)
    short = judged & holds(code < 10 ** (length - 1))
    full = judged & ~too_long & ~short
    wrong = holds(_digit(code, 0) != check_digit_of(code, length))
    return {
        "missing": missing,
        "unparseable": unparseable,
        "sentinel": sentinel,
        "too_long": too_long,
        "short_check_digit_invalid": short & wrong,
        "short_valid": short & ~wrong,
        "check_digit_invalid": full & wrong,
        "valid": full & ~wrong,
    }


def check_digit_tally(
    df: DataFrame, table: str, column: str, length: int = 13, sentinels: Sequence[int] = ()
) -> Tally:
    counters = _parts(df, column, length, sentinels)

    def rows(total: Totals) -> list[Column]:
        judged = total("check_digit_invalid") + total("valid")
        return [
            result_row(
                table=F.lit(table),
                column=F.lit(column),
                total=total("rows"),
                **{name: total(name) for name in counters},
                check_digit_invalid_rate=rate(total("check_digit_invalid"), judged),
            )
        ]

    return Tally(counters, rows)


def check_digits(
    df: DataFrame, column: str, length: int = 13, sentinels: Sequence[int] = (), *, table: str = ""
) -> DataFrame:
    """How many codes end in the wrong check digit (EAN-13, or any GS1 code by its length).

    Every row is of one kind: missing, unparseable (no whole number, or a negative one), a
    sentinel, too long, short (fewer digits, judged as padded with zeros and counted apart), or
    of full length. The rate is over the codes of full length.
    """
    return measure(df, check_digit_tally(df, table, column, length, sentinels))


def check_digit_rows(
    df: DataFrame, column: str, length: int = 13, sentinels: Sequence[int] = (), label: str = "expected_digit"
) -> DataFrame:
    """The rows whose code of full length ends in the wrong digit, with the right one."""
    wrong = _parts(df, column, length, sentinels)["check_digit_invalid"]
    right = check_digit_of(number(df, column).try_cast("bigint"), length).cast("int")
    return df.filter(wrong).select(*[col(n) for n in df.columns], right.alias(label))


def key_format_tally(df: DataFrame, table: str, column: str, pattern: str) -> Tally:
    check_columns(df, [column])
    missing = is_missing(df, column)
    matches = holds(F.rlike(text_of(df, column), F.lit(f"^(?:{pattern})$"))) & ~missing

    def rows(total: Totals) -> list[Column]:
        present = total("matching") + total("not_matching")
        return [
            result_row(
                table=F.lit(table),
                column=F.lit(column),
                pattern=F.lit(pattern),
                total=total("rows"),
                missing=total("missing"),
                matching=total("matching"),
                not_matching=total("not_matching"),
                matching_rate=rate(total("matching"), present),
            )
        ]

    return Tally(
        {"missing": missing, "matching": matches, "not_matching": ~missing & ~matches}, rows
    )


def key_format(df: DataFrame, column: str, pattern: str, *, table: str = "") -> DataFrame:
    """How many present values match a pattern from end to end; the rate is over present values."""
    return measure(df, key_format_tally(df, table, column, pattern))


def key_format_rows(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """The rows whose present value does not match."""
    matches = holds(F.rlike(text_of(df, column), F.lit(f"^(?:{pattern})$")))
    return df.filter(~is_missing(df, column) & ~matches)


def shape_of(df: DataFrame, name: str, *, runs: bool = False) -> Column:
    """The shape of a value: capital letters as ``A``, small ones as ``a``, digits as ``9``, white
    space as a space, others as they are; ``runs`` writes a run of one kind once, with ``+``.

    Null for missing values.
    """
    shape = text_of(df, name)
    for pattern, sign in ((r"[\p{L}&&[^\p{Lu}]]", "a"), (r"\p{Lu}", "A"), (r"\p{Nd}", "9"), (r"\s", " ")):
        shape = F.regexp_replace(shape, pattern, sign)
    if runs:
        shape = F.regexp_replace(shape, r"([Aa9 ])\1+", "$1+")
    return F.when(~is_missing(df, name), shape)


def value_shapes(df: DataFrame, columns: Sequence[str], *, runs: bool = False) -> DataFrame:
    """``column, shape, rows, share, example``: the shapes of the present values of each column by
    frequency, with the smallest value of each.

    Columns are read together; shapes are counted before and after one shuffle.
    """
    columns = check_columns(df, columns)
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("column"), shape_of(df, n, runs=runs).alias("shape"), text_of(df, n).alias("value"))
            for n in columns
        ]
    )
    counted = (
        df.select(F.inline(cells))
        .where(F.col("shape").isNotNull())
        .groupBy("column", "shape")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("value").alias("example"))
    )
    # One row per column of the list, read by every task as one value.
    present = counted.groupBy("column").agg(F.sum("rows").alias("present"))
    present = present.agg(F.map_from_entries(F.collect_list(F.struct("column", "present")))).scalar()
    return counted.select(
        "column", "shape", "rows", rate(F.col("rows"), present[F.col("column")]).alias("share"), "example"
    )


def unusual_shape_rows(
    df: DataFrame, column: str, max_share: float, *, runs: bool = False, label: str = "shape"
) -> DataFrame:
    """The rows whose value has a shape that at most ``max_share`` of the present values have.

    Usual shapes are fewer than ``1 / max_share``; every task reads them as one value, and rows
    stay where they are.
    """
    if not 0 < max_share < 1:
        raise ValueError("max_share must lie between 0 and 1")
    usual = value_shapes(df, [column], runs=runs).where(F.col("share") > max_share)
    usual = usual.agg(F.collect_list("shape")).scalar()
    marked = df.withColumn("\tshape", shape_of(df, column, runs=runs))
    found = marked.where(~F.array_contains(usual, F.col("`\tshape`")))
    return found.select(*[col(n) for n in df.columns], F.col("`\tshape`").alias(label))

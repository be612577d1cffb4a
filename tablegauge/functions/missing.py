"""What counts as missing: null, NaN, the empty string, and whitespace-only strings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.columns import col, is_float, is_string

# Every character that counts as white space in text, control separators and the
# Unicode spaces included. Spark's plain trim() removes U+0020 only.
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())

# The texts a spreadsheet or CSV reader takes for "no value".
DEFAULT_NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


def is_blank(text: Column) -> Column:
    """True for ``''`` and whitespace-only text; null or false for null.

    Left trimming stops at the first other character and does not decode or copy the
    value, so long texts cost no more than short ones. Text that starts with a printable
    ASCII character, nearly all of it, is told apart by two comparisons alone.
    """
    may_be_blank = (text < F.lit("!")) | (text >= F.lit("\u0080"))
    return may_be_blank & (F.ltrim(text, F.lit(WHITESPACE)) == "")


def blank_in(df: DataFrame, name: str) -> Column:
    """:func:`is_blank` for text columns; false for columns of any other type."""
    return F.coalesce(is_blank(col(name)), F.lit(False)) if is_string(df, name) else F.lit(False)


def null_in(df: DataFrame, name: str) -> Column:
    """Null or NaN."""
    c = col(name)
    return (c.isNull() | F.isnan(c)) if is_float(df, name) else c.isNull()


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, NaN or blank. Never null itself, so it can be negated safely."""
    return null_in(df, name) | is_blank(col(name)) if is_string(df, name) else null_in(df, name)


def blank_to_null_column(df: DataFrame, name: str) -> Column:
    c = col(name)
    return F.when(~is_blank(c), c).alias(name) if is_string(df, name) else c


def null_tokens_to_null(
    df: DataFrame, tokens: Iterable[str] = DEFAULT_NULL_TOKENS
) -> DataFrame:
    """String cells equal to one of ``tokens`` become null; other columns are untouched."""
    tokens = list(tokens)
    return df.select(
        *[
            F.when(~col(n).isin(tokens), col(n)).alias(n) if is_string(df, n) else col(n)
            for n in df.columns
        ]
    )

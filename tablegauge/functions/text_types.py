"""Types of columns that were read as text.

Every cell has the narrowest type its text spells by a strict grammar; a column has the
smallest type that holds those of its cells without changing any. A cell that spells nothing
else is text, and so is then its column: no value is ever altered to make a column fit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions.columns import col

# Kinds of cells, a bit each. Whole numbers by how many digits a type must hold.
BOOLEAN, INT, LONG, WIDE, BIG, REAL, DATE, TIME, TEXT = (1 << i for i in range(9))

_WHOLE = r"^[+-]?(0|[1-9][0-9]*)$"
_REAL = r"^[+-]?((0|[1-9][0-9]*)(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:[0-9]{2})?$"
_EXACT_DIGITS = 15  # what a double holds of any decimal

# What a column's kinds must be among, narrowest type first.
_LATTICE = (
    (BOOLEAN, T.BooleanType()),
    (INT, T.IntegerType()),
    (INT | LONG | WIDE, T.LongType()),
    (INT | LONG | WIDE | BIG, T.DecimalType(38, 0)),
    (INT | LONG | REAL, T.DoubleType()),
    (DATE, T.DateType()),
    (DATE | TIME, T.TimestampType()),
)


def parsed(text: Column, kind: T.DataType, options: Mapping) -> Column:
    """Text as a value of a type, in the format the options name; null if it is none."""
    format = {T.DateType: "dateFormat", T.TimestampType: "timestampFormat"}.get(type(kind))
    if format in options:
        return F.try_to_timestamp(text, F.lit(options[format])).cast(kind)
    return text if isinstance(kind, T.StringType) else F.trim(text).try_cast(kind)


def cell_kind(text: Column, options: Mapping = {}) -> Column:
    """The kind of a cell as its bit; 0 for null.

    Numbers with leading zeros are text, since a number would lose them, and so are decimals of
    more digits than a double holds. Dates and times are ISO 8601, or as ``dateFormat`` and
    ``timestampFormat`` say.
    """
    bare = F.trim(text)
    digits = F.length(F.regexp_replace(bare, "[^0-9]", ""))
    mantissa = F.regexp_replace(F.regexp_replace(bare, "[eE].*$", ""), "[^0-9]", "")

    def when(kind: T.DataType, format: str, pattern: str) -> Column:
        spelled = F.lit(True) if format in options else F.rlike(bare, F.lit(pattern))
        return spelled & parsed(text, kind, options).isNotNull()

    whole = (
        F.when(bare.try_cast("int").isNotNull(), INT)
        .when(digits <= _EXACT_DIGITS, LONG)
        .when(bare.try_cast("bigint").isNotNull(), WIDE)
        .when(digits <= 38, BIG)
        .otherwise(TEXT)
    )
    exact = F.length(F.ltrim(mantissa, F.lit("0"))) <= _EXACT_DIGITS
    finite = F.abs(bare.try_cast("double")) < F.lit(float("inf"))
    return (
        F.when(text.isNull(), 0)
        .when(F.lower(bare).isin("true", "false"), BOOLEAN)
        .when(F.rlike(bare, F.lit(_WHOLE)), whole)
        .when(F.rlike(bare, F.lit(_REAL)) & exact & finite, REAL)
        .when(when(T.DateType(), "dateFormat", _DATE), DATE)
        .when(when(T.TimestampType(), "timestampFormat", _TIME), TIME)
        .otherwise(TEXT)
    )


def column_type(kinds: int) -> T.DataType:
    """The type of a column whose cells have these kinds together."""
    if kinds:
        for among, found in _LATTICE:
            if not kinds & ~among:
                return found
    return T.StringType()


def inferred(texts: DataFrame, options: Mapping = {}) -> DataFrame:
    """Each column in the type of its cells, which one pass over the table finds."""
    names: Sequence[str] = texts.columns
    found = texts.agg(*[F.bit_or(cell_kind(col(n), options)).alias(f"{i}") for i, n in enumerate(names)]).first()
    return texts.select(
        *[parsed(col(n), column_type(found[i] or 0), options).alias(n) for i, n in enumerate(names)]
    )

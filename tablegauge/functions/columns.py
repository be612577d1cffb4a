"""Column access by exact name, and schema checks made before a job starts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLOATS = (T.FloatType, T.DoubleType)
_STRINGS = (T.StringType, T.CharType, T.VarcharType)
NESTED = (T.ArrayType, T.MapType, T.StructType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Column by exact name, whatever spaces, dots or umlauts it holds."""
    return F.col(quoted(name))


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_float(df: DataFrame, name: str) -> bool:
    return isinstance(type_of(df, name), _FLOATS)


def is_string(df: DataFrame, name: str) -> bool:
    return isinstance(type_of(df, name), _STRINGS)


def string_columns(df: DataFrame) -> list[str]:
    return [name for name in df.columns if is_string(df, name)]


def check_columns(df: DataFrame, names: Iterable[str], what: str = "table") -> list[str]:
    """Names as a list; raises ``ValueError`` naming those the table lacks."""
    names = list(names)
    if not names:
        raise ValueError(f"{what}: no columns given")
    absent = [name for name in names if name not in df.columns]
    if absent:
        raise ValueError(f"{what}: no column {absent}; it has {df.columns}")
    return names


def check_numeric(df: DataFrame, names: Iterable[str], what: str = "table") -> list[str]:
    names = check_columns(df, names, what)
    other = [n for n in names if not isinstance(type_of(df, n), T.NumericType)]
    if other:
        raise TypeError(f"{what}: columns {other} are not numeric")
    return names


def check_key_types(
    left: DataFrame, left_keys: Sequence[str], right: DataFrame, right_keys: Sequence[str]
) -> None:
    """Raises ``TypeError`` where keys of two tables cannot be compared as they are.

    Numbers of any kinds can, see :func:`key_pair`. Text against numbers cannot: Spark
    would convert silently and match ``1`` with ``'1'``.
    """
    for a, b in zip(left_keys, right_keys, strict=True):
        type_a, type_b = type_of(left, a), type_of(right, b)
        both = (
            lambda kinds, x=type_a, y=type_b: isinstance(x, kinds) and isinstance(y, kinds)
        )
        if type_a == type_b or both(T.NumericType) or both(_STRINGS):
            continue
        raise TypeError(
            f"key {a!r} is {type_a.simpleString()} but {b!r} is {type_b.simpleString()}; "
            "cast one of them"
        )


def key_pair(
    left: DataFrame, left_key: str, right: DataFrame, right_key: str
) -> tuple[Column, Column]:
    """Two key columns in a form that is equal exactly when the keys are.

    Numbers of one kind keep their type. Of different kinds they become the text of
    :func:`exact_number`: ``1``, ``1.0`` and ``1.00`` are one key, and so are a decimal and
    a double that read the same, at any magnitude.
    """
    kinds = [type_of(left, left_key), type_of(right, right_key)]
    same = kinds[0] == kinds[1] or not all(isinstance(k, T.NumericType) for k in kinds)
    if same or all(isinstance(k, T.IntegralType) for k in kinds):
        return comparable_column(left, left_key), comparable_column(right, right_key)
    return exact_number(left, left_key), exact_number(right, right_key)


def exact_number(df: DataFrame, name: str) -> Column:
    """A number of any kind as ``<sign><digits>e<exponent>``, without zeros at either end.

    ``125e-1`` is 12.5, ``125e5`` 12,500,000, ``0e0`` both zeros. A floating number stands for
    the decimal of at most 15 digits (6 for a float) that reads as it, or else for the text that
    Spark writes. NaN is null, infinities keep their names.
    """
    # A lambda's argument is computed once a row; written out, each use of the text would
    # compute it anew.
    return F.transform(F.array(_number_text(df, name)), _exact_form)[0]


def _number_text(df: DataFrame, name: str) -> Column:
    """The text that :func:`exact_number` reads a number from, with ``E`` before an exponent."""
    c, kind = number(df, name), type_of(df, name)
    text = c.cast("string")
    if not isinstance(kind, _FLOATS):
        return text
    double = isinstance(kind, T.DoubleType)
    digits, smallest = (15, 2.2250738585072014e-308) if double else (6, 1.17549435e-38)
    # A text with no more digits than that is the only such decimal that reads as the number,
    # unless the number is subnormal. Only other numbers need the slower rounding.
    short = F.replace(F.format_string(f"%.{digits - 1}e", c), F.lit("e"), F.lit("E"))
    is_short = (F.length(text) <= digits + 1) & (F.abs(c) >= F.lit(smallest))
    return F.when(is_short, text).when(short.try_cast(kind) == c, short).otherwise(text)


def _exact_form(text: Column) -> Column:
    mantissa = F.substring_index(text, "E", 1)
    # Cast only where there is an exponent: a failing cast costs more than all the rest.
    power = F.when(F.contains(text, F.lit("E")), F.substring_index(text, "E", -1).cast("int")).otherwise(F.lit(0))
    whole = F.substring_index(mantissa, ".", 1)
    fraction = F.substr(mantissa, F.length(whole) + F.lit(2))
    significant = F.ltrim(F.replace(mantissa, F.lit("."), F.lit("")), F.lit("-0"))
    short = F.rtrim(significant, F.lit("0"))
    exponent = power - F.length(fraction) + F.length(significant) - F.length(short)
    sign = F.when(F.startswith(text, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    return (
        F.when(F.contains(text, F.lit("Infinity")), text)
        .when(short == "", F.lit("0e0"))
        .otherwise(F.concat(sign, short, F.lit("e"), exponent.cast("string")))
    )


def from_exact_number(text: Column, kind: T.DataType) -> Column:
    """The number that :func:`exact_number` made a text of; null if the type cannot hold it."""
    if isinstance(kind, T.IntegralType):
        return text.try_cast("decimal(38,0)").try_cast(kind)
    return text.try_cast(kind)


def number(df: DataFrame, name: str) -> Column:
    """Numeric column with NaN turned into null, so that it fails every comparison."""
    c = col(name)
    return F.when(~F.isnan(c), c) if is_float(df, name) else c


def comparable_column(df: DataFrame, name: str) -> Column:
    """Column in a form that groups, joins and sorts the way rows are compared.

    NaN equals null, null equals null, and maps, at any depth, compare as sorted entries.
    """
    return _normal(number(df, name), type_of(df, name))


def holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return holds_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(holds_map(f.dataType) for f in kind.fields)


def _normal(c: Column, kind: T.DataType) -> Column:
    """The value with every map in it as an array of entries, sorted by key."""
    if not holds_map(kind):
        return c
    if isinstance(kind, T.StructType):
        cells = [_normal(c[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*cells))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _normal(x, kind.elementType))
    return F.array_sort(
        F.transform(
            F.map_entries(c),
            lambda e: F.struct(
                _normal(e["key"], kind.keyType).alias("key"),
                _normal(e["value"], kind.valueType).alias("value"),
            ),
        )
    )


def _restored(c: Column, kind: T.DataType) -> Column:
    """The value that :func:`_normal` was given."""
    if not holds_map(kind):
        return c
    if isinstance(kind, T.StructType):
        cells = [_restored(c[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*cells))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _restored(x, kind.elementType))
    return F.map_from_entries(
        F.transform(
            c,
            lambda e: F.struct(
                _restored(e["key"], kind.keyType).alias("key"),
                _restored(e["value"], kind.valueType).alias("value"),
            ),
        )
    )


def comparable(df: DataFrame, names: Iterable[str] | None = None) -> list[Column]:
    """:func:`comparable_column` of several columns (all by default), under their names."""
    return [
        comparable_column(df, name).alias(name)
        for name in (df.columns if names is None else names)
    ]


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def holds(condition: Column) -> Column:
    """A comparison with null on either side does not hold."""
    return F.coalesce(condition, F.lit(False))


def unique(df: DataFrame) -> DataFrame:
    """Distinct rows, of any types that can be grouped."""
    counted = df.groupBy(*map(col, df.columns)).agg(F.count(F.lit(1)).alias("\tcopies"))
    return counted.drop("\tcopies")


def restore(rows: DataFrame, like: DataFrame) -> DataFrame:
    """Turns the sorted entries made by :func:`comparable` back into maps."""
    return rows.select(
        *[
            _restored(col(n), type_of(like, n)).alias(n)
            if n in like.columns and holds_map(type_of(like, n))
            else col(n)
            for n in rows.columns
        ]
    )


def text_of(df: DataFrame, name: str) -> Column:
    """Text that is equal exactly when two values of this column are equal."""
    return _text(number(df, name), type_of(df, name))


def _text(c: Column, kind: T.DataType) -> Column:
    """Text of a value, null for null; nested values cell by cell, maps in order of keys."""
    if isinstance(kind, _FLOATS):
        return (c + F.lit(0.0)).cast("string")  # -0.0 and 0.0 are one value
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("string")  # wall-clock text is ambiguous when clocks go back
    if isinstance(kind, T.BinaryType):
        return F.base64(c)
    if isinstance(kind, T.StructType):
        cells = [_cell(c[f.name], f.dataType) for f in kind.fields]
        return F.when(c.isNotNull(), F.concat(F.lit("("), *cells))
    if isinstance(kind, T.ArrayType):
        cells = F.transform(c, lambda x: _cell(x, kind.elementType))
        return F.concat(F.lit("["), F.array_join(cells, ""))
    if isinstance(kind, T.MapType):
        cells = F.transform(
            F.map_entries(c),
            lambda e: F.concat(_cell(e["key"], kind.keyType), _cell(e["value"], kind.valueType)),
        )
        return F.concat(F.lit("{"), F.array_join(F.array_sort(cells), ""))
    return c.cast("string")


def _cell(c: Column, kind: T.DataType) -> Column:
    """A text with its length in front, which keeps cells apart; a null has none."""
    text = _text(c, kind)
    cell = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.coalesce(cell, F.lit("-"))


def row_digest(df: DataFrame, names: Iterable[str] | None = None) -> Column:
    """SHA-256 of a row, equal for rows that compare as equal: 32 bytes for any width."""
    names = df.columns if names is None else names
    cells = [_cell(number(df, name), type_of(df, name)) for name in names]
    return F.unhex(F.sha2(F.concat(*cells), 256))

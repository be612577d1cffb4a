"""Column expressions and schema helpers shared by all operators."""

from tablegauge.functions.columns import (
    any_of,
    check_columns,
    check_key_types,
    check_numeric,
    col,
    comparable,
    comparable_column,
    holds,
    number,
    restore,
    row_digest,
    string_columns,
    text_of,
)
from tablegauge.functions.missing import (
    DEFAULT_NULL_TOKENS,
    WHITESPACE,
    blank_to_null_column,
    is_blank,
    is_missing,
    null_tokens_to_null,
)
from tablegauge.functions.rates import LEVELS, rate, traffic_light

__all__ = [
    "DEFAULT_NULL_TOKENS",
    "LEVELS",
    "WHITESPACE",
    "blank_to_null_column",
    "any_of",
    "check_columns",
    "check_key_types",
    "check_numeric",
    "col",
    "comparable",
    "comparable_column",
    "holds",
    "is_blank",
    "is_missing",
    "null_tokens_to_null",
    "number",
    "rate",
    "restore",
    "row_digest",
    "string_columns",
    "text_of",
    "traffic_light",
]

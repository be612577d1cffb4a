"""Columns and patterns that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space of the contracts, and its complement.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
# Runs of white space that are not one plain space already.
UNEVEN_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def text_of(name: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def normalised(text: Column) -> Column:
    """``text`` with every run of white space as one space."""
    return F.regexp_replace(text, UNEVEN_SPACE, " ")


def crc_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def whole_row(df: DataFrame) -> Column:
    """The whole row as one struct, so that its column names meet no others."""
    return F.struct(*[F.col(f"`{name}`") for name in df.columns])


def rows_again(df: DataFrame, column: str, like: DataFrame) -> DataFrame:
    """The rows packed by :func:`whole_row`, with the columns of ``like``."""
    return df.select(*[F.col(f"{column}.`{name}`").alias(name) for name in like.columns])


def source_key(source: Column) -> Column:
    """A key that is never null and sorts sources by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))



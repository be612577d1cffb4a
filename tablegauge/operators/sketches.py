"""Distinct values by sketches that merge: over partitions, tables and runs.

A HyperLogLog sketch per column takes a few kilobytes however many values there are. Sketches
of parts, or of runs, make the sketch of the whole, so distinct values are counted over a
history without reading its tables again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions.columns import check_columns, number, text_of, type_of
from tablegauge.functions.missing import is_missing
from tablegauge.operators.tally import result_row

PRECISION = 12  # logarithm of the number of registers
DEVIATIONS = 3  # standard errors that the bound allows


def sketch_error(precision: int = PRECISION) -> float:
    """The relative error that estimates stay within, three standard errors."""
    return DEVIATIONS * 1.04 / 2 ** (precision / 2)


def _sketched(df: DataFrame, name: str) -> Column:
    """A column in a form that sketches take, equal for equal values and null for missing ones."""
    kind = type_of(df, name)
    form = number(df, name).cast("bigint") if isinstance(kind, T.IntegralType) else text_of(df, name)
    return F.when(~is_missing(df, name), form)


def distinct_sketches(df: DataFrame, columns: Sequence[str] | None = None, *, precision: int = PRECISION) -> DataFrame:
    """``column, rows, present, sketch`` per column, from one scan; a sketch is null where no value
    is present."""
    names = df.columns if columns is None else check_columns(df, columns)
    found = [F.hll_sketch_agg(_sketched(df, n), precision).alias(f"\ts{i}") for i, n in enumerate(names)]
    present = [F.count_if(~is_missing(df, n)).alias(f"\tn{i}") for i, n in enumerate(names)]
    rows = [
        result_row(
            column=F.lit(n),
            rows=F.col("`\trows`"),
            present=F.col(f"`\tn{i}`"),
            sketch=F.when(F.col(f"`\tn{i}`") > 0, F.col(f"`\ts{i}`")),
        )
        for i, n in enumerate(names)
    ]
    counted = df.agg(F.count(F.lit(1)).alias("\trows"), *present, *found)
    return counted.select(F.inline(F.array(*rows)))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ("column",)) -> DataFrame:
    """Sketches of parts or runs added up: ``by``, ``rows``, ``present``, ``sketch``."""
    return sketches.groupBy(*by).agg(
        F.sum("rows").alias("rows"),
        F.sum("present").alias("present"),
        F.hll_union_agg("sketch", F.lit(True)).alias("sketch"),
    )


def sketch_counts(sketches: DataFrame) -> DataFrame:
    """The sketches' rows with ``distinct``, the estimate, in place of the sketch."""
    estimate = F.when(F.col("present") > 0, F.hll_sketch_estimate("sketch")).otherwise(0)
    return sketches.withColumn("distinct", estimate.cast("long")).drop("sketch")

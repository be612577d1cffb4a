"""Checks that only count rows: any number of them share one pass over a table.

A :class:`Tally` names row predicates and says how their totals become result rows.
:func:`measure` runs one of them, :func:`totals` adds the counters of many tallies to a
few aggregates, so a table is not read once per check.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.functions.columns import col

Totals = Callable[[str], Column]


@dataclass(frozen=True)
class Tally:
    """``counters``: name -> row predicate. ``rows``: totals -> one struct per result row.

    ``rows`` receives a function from counter name to its total; ``"rows"`` is the
    number of rows in the table.
    """

    counters: Mapping[str, Column]
    rows: Callable[[Totals], list[Column]]


def totals(df: DataFrame, tallies: Mapping[str, Tally]) -> DataFrame:
    """One row with every counter of every tally, from one pass over ``df``.

    Each counter is an aggregate of its own: Spark generates a method per few of them and
    evaluates what several share once per row, so any number of counters stays compiled.
    """
    counts = [
        F.count_if(predicate).alias(f"{name}\t{counter}")
        for name, tally in tallies.items()
        for counter, predicate in tally.counters.items()
    ]
    return df.agg(F.count(F.lit(1)).alias("rows"), *counts)


def result_rows(name: str, tally: Tally) -> Column:
    """Array of result rows of one tally, over a frame made by :func:`totals`."""

    def total(counter: str) -> Column:
        return F.col("rows") if counter == "rows" else col(f"{name}\t{counter}")

    return F.array(*tally.rows(total))


def measure(df: DataFrame, tally: Tally) -> DataFrame:
    return totals(df, {"check": tally}).select(F.inline(result_rows("check", tally)))


def measure_each(
    tables: Mapping[str, DataFrame], checks: Sequence[tuple[str, Tally]]
) -> DataFrame:
    """Rows of several ``(table, tally)`` checks of one kind, each table read once."""
    if not checks:
        raise ValueError("no checks given")
    per_table: dict[str, dict[str, Tally]] = {}
    for i, (table, tally) in enumerate(checks):
        per_table.setdefault(table, {})[str(i)] = tally
    return reduce(
        DataFrame.unionByName,
        [
            totals(tables[table], tallies).select(
                F.inline(F.concat(*[result_rows(n, t) for n, t in tallies.items()]))
            )
            for table, tallies in per_table.items()
        ],
    )


def result_row(**values: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in values.items()])


def literal_rows(spark: SparkSession, rows: Sequence[Column]) -> DataFrame:
    """A frame of a few literal structs, made by one task."""
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))

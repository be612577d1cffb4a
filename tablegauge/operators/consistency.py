"""Agreement of measures between a parent table and its deduplicated child."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.functions.columns import (
    any_of,
    check_columns,
    check_key_types,
    check_numeric,
    col,
    comparable_column,
    holds,
    key_pair,
    number,
)
from tablegauge.functions.rates import rate

ZERO_BASELINES = ("row_consistent", "skip_pair")


def first_per_key(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column] = ()
) -> DataFrame:
    """The first row of each key; null keys form a key of their own.

    Tables have no row order, so ``order_by`` states it; ties are broken on all other
    columns, nulls first. Spark keeps one row per key and task before the shuffle
    (a window group limit), so a hot key reaches the final task as a few rows only.
    """
    check_columns(df, keys)
    order = [
        comparable_column(df, o).asc_nulls_first() if isinstance(o, str) else o for o in order_by
    ]
    done = {*keys, *(o for o in order_by if isinstance(o, str))}
    ties = [comparable_column(df, n).asc_nulls_first() for n in df.columns if n not in done]
    window = Window.partitionBy(*[comparable_column(df, k) for k in keys]).orderBy(
        *(order + ties or [F.lit(0)])
    )
    rank = "\trank"
    return (
        df.withColumn(rank, F.row_number().over(window))
        .filter(F.col(f"`{rank}`") == 1)
        .drop(rank)
    )


def dedupe_keep_first(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column] = ()
) -> DataFrame:
    """One row per key, the first in ``order_by``; exact copies collapse with it."""
    return first_per_key(df, keys, order_by)


def resolved_keys(parent: DataFrame, child: DataFrame, keys: Sequence[str]) -> list[str]:
    """The keys a join can use: those the parent has. The child must have them all."""
    check_columns(child, keys, "child table")
    shared = [k for k in keys if k in parent.columns]
    if not shared:
        raise ValueError(f"parent table has none of the keys {list(keys)}")
    return shared


def pair_consistency(
    parent: DataFrame,
    child: DataFrame,
    pairs: Sequence[tuple[str, str]],
    keys: Sequence[str],
    max_deviation: float,
    *,
    order_by: Sequence[str | Column] = (),
    zero_baseline: str = "row_consistent",
    first: DataFrame | None = None,
) -> DataFrame:
    """Compares ``(parent measure, child measure)`` pairs over joined rows.

    The child is first reduced to one row per key. A row is left out when any measure is
    null, and inconsistent when some pair deviates by more than ``max_deviation`` of the
    parent's value. Rates are over comparable rows.

    ``zero_baseline="row_consistent"`` takes a row with any parent value of 0 as
    consistent; ``"skip_pair"`` ignores that pair only. ``first``: the child's first rows, where
    they are known already.
    """
    if zero_baseline not in ZERO_BASELINES:
        raise ValueError(f"zero_baseline must be one of {ZERO_BASELINES}")
    on = resolved_keys(parent, child, keys)
    ours = check_numeric(parent, [p for p, _ in pairs], "parent table")
    theirs = check_numeric(child, [c for _, c in pairs], "child table")
    check_key_types(parent, on, child, on)

    # The child's first rows are those of dedupe_keep_first: all columns break ties.
    first = first_per_key(child, keys, order_by) if first is None else first
    pairs_of_keys = [key_pair(parent, k, first, k) for k in on]
    left = parent.select(
        *[k.alias(f"k{i}") for i, (k, _) in enumerate(pairs_of_keys)],
        *[number(parent, n).cast("double").alias(f"p{i}") for i, n in enumerate(ours)],
    )
    right = first.select(
        *[k.alias(f"j{i}") for i, (_, k) in enumerate(pairs_of_keys)],
        *[number(first, n).cast("double").alias(f"c{i}") for i, n in enumerate(theirs)],
    )
    same_key = reduce(
        lambda a, b: a & b, [F.col(f"k{i}").eqNullSafe(F.col(f"j{i}")) for i in range(len(on))]
    )
    measures = range(len(pairs))
    excluded = any_of(F.col(f"{side}{i}").isNull() for side in "pc" for i in measures)
    deviates = any_of(_deviates(F.col(f"p{i}"), F.col(f"c{i}"), max_deviation) for i in measures)
    if zero_baseline == "row_consistent":
        deviates = deviates & ~any_of(F.col(f"p{i}") == 0 for i in measures)

    def pairs_where(condition: Column) -> Column:
        return F.count_if(condition)

    counted = left.join(right, same_key, "inner").agg(
        pairs_where(F.lit(True)).alias("pairs"),
        pairs_where(excluded).alias("excluded"),
        pairs_where(~excluded & ~deviates).alias("consistent"),
        pairs_where(~excluded & deviates).alias("inconsistent"),
    )
    total, out, good, bad = map(F.col, ("pairs", "excluded", "consistent", "inconsistent"))
    compared = total - out
    return counted.select(
        total,
        out,
        compared.alias("comparable"),
        good,
        rate(good, compared).alias("consistent_rate"),
        bad,
        rate(bad, compared).alias("inconsistent_rate"),
        (out + good + bad == total).alias("accounting_ok"),
    )


def _deviates(base: Column, other: Column, limit: float) -> Column:
    """False, never null, where the deviation is undefined: base 0, null, inf against inf."""
    share = F.try_divide(F.abs(base - other), base)
    return holds(~F.isnan(share) & (share > F.lit(float(limit))))

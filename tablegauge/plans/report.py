"""The numbers behind each dashboard panel, as frames a charting tool reads.

Inputs are check results, a few rows each. They are combined by unions and aggregates,
so nothing is fetched to the driver on the way.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.rates import rate, traffic_light
from tablegauge.operators.kpi import TOTAL_FIELD
from tablegauge.operators.tally import result_row


def with_level(results: DataFrame, rate_column: str, level: str = "level") -> DataFrame:
    """Adds the traffic-light level of a rate."""
    return results.withColumn(level, traffic_light(F.col(rate_column)))


def scorecard(
    *,
    completeness: DataFrame | None = None,
    uniqueness: DataFrame | None = None,
    pair_consistency: DataFrame | None = None,
    unit_consistency: DataFrame | None = None,
) -> DataFrame:
    """``kpi, table, scope, rate, level``: overall completeness, uniqueness of each key,
    consistency of comparable pairs, and validity of units; ``table`` is null for results
    that name none."""

    def card(df: DataFrame, kpi: str, scope: Column, value: str) -> DataFrame:
        table = F.col("table") if "table" in df.columns else F.lit(None).cast("string")
        return df.select(
            F.lit(kpi).alias("kpi"),
            table.alias("table"),
            scope.alias("scope"),
            F.col(value).alias("rate"),
        )

    cards = []
    if completeness is not None:
        overall = completeness.filter(F.col("field") == TOTAL_FIELD)
        cards.append(card(overall, "completeness", F.lit("all mandatory fields"), "completeness"))
    if uniqueness is not None:
        cards.append(card(uniqueness, "uniqueness", F.col("field"), "uniqueness"))
    if pair_consistency is not None:
        cards.append(
            card(
                pair_consistency, "pair_consistency", F.lit("comparable pairs"), "consistent_rate"
            )
        )
    if unit_consistency is not None:
        cards.append(card(unit_consistency, "unit_validity", F.col("column"), "valid_rate"))
    if not cards:
        raise ValueError("no results given")
    return with_level(reduce(DataFrame.unionByName, cards), "rate")


def panel_completeness(completeness: DataFrame) -> DataFrame:
    """Fields without the total, least complete first, with their level."""
    fields = completeness.filter(F.col("field") != TOTAL_FIELD)
    return with_level(fields, "completeness").orderBy("completeness", "field")


def _segments(
    result: DataFrame,
    bar: Column,
    parts: Mapping[str, str],
    whole: Sequence[str],
    overlapping: Sequence[str] = (),
    **front: Column,
) -> DataFrame:
    """``bar, segment, rows, share, overlapping``; shares are of the sum of ``whole``.

    ``front``: further columns of every segment.
    """
    total = reduce(lambda a, b: a + b, [F.col(n) for n in whole])
    return result.select(
        F.inline(
            F.array(
                *[
                    result_row(
                        **front,
                        bar=bar,
                        segment=F.lit(name),
                        rows=F.col(column),
                        share=rate(F.col(column), total),
                        overlapping=F.lit(name in overlapping),
                    )
                    for name, column in parts.items()
                ]
            )
        )
    )


def panel_consistency(pair_consistency: DataFrame, unit_consistency: DataFrame) -> DataFrame:
    """Shares over all joined pairs, not comparable ones included; and valid against
    invalid units over present values, a bar for each table and column."""
    pairs = _segments(
        pair_consistency,
        F.lit("pairs"),
        {
            "consistent": "consistent",
            "inconsistent": "inconsistent",
            "not_comparable": "excluded",
        },
        ["consistent", "inconsistent", "excluded"],
    )
    units = _segments(
        unit_consistency,
        F.col("column"),
        {"valid": "valid", "invalid": "invalid"},
        ["valid", "invalid"],
        table=F.col("table"),
    )
    every = pairs.withColumn("table", F.lit(None).cast("string")).unionByName(units)
    return every.drop("overlapping")


def panel_prices(price_validity: DataFrame) -> DataFrame:
    """Valid against invalid prices. Defect counts overlap, so they are marked and not
    parts of the whole."""
    return _segments(
        price_validity,
        F.lit("prices"),
        {
            "valid": "valid",
            "invalid": "invalid",
            "sentinel": "sentinel",
            "bad_currency": "bad_currency",
        },
        ["total"],
        overlapping=["sentinel", "bad_currency"],
    ).drop("bar")


def panel_references(referential_integrity: DataFrame) -> DataFrame:
    """Referenced against orphaned keys, per table where the result names one."""
    bar = F.col("table") if "table" in referential_integrity.columns else F.lit("references")
    return _segments(
        referential_integrity,
        bar,
        {"referenced": "referenced", "orphaned": "orphaned"},
        ["referenced", "orphaned"],
    ).drop("overlapping")


def row_count_notice(
    pair_consistency: DataFrame, unit_consistency: DataFrame, key_conflicts: DataFrame
) -> DataFrame:
    """``table, column, mismatch, unit_rows, pair_rows, exact_duplicates, conflicts``, one
    row per unit check.

    A unit check and the pairs count different rows when duplicates or conflicts were
    removed before the join; ``mismatch`` says so.
    """
    unit = F.struct("table", "column", (F.col("valid") + F.col("invalid")).alias("unit_rows"))
    parts = [
        unit_consistency.select(unit.alias("unit")),
        pair_consistency.select(
            (F.col("consistent") + F.col("inconsistent") + F.col("excluded")).alias("pair_rows")
        ),
        key_conflicts.select("exact_duplicates", "conflicts"),
    ]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    sums = ("pair_rows", "exact_duplicates", "conflicts")
    totals = every.agg(F.collect_list("unit").alias("units"), *[F.sum(n).alias(n) for n in sums])
    return totals.select(F.inline("units"), *sums).select(
        "table",
        "column",
        (F.col("unit_rows") != F.col("pair_rows")).alias("mismatch"),
        "unit_rows",
        *sums,
    )

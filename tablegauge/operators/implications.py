"""Rules across fields: where one condition holds, another must hold as well."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.columns import any_of, col
from tablegauge.functions.conditions import columns_of, condition
from tablegauge.functions.missing import is_missing
from tablegauge.functions.rates import rate
from tablegauge.operators.tally import Tally, Totals, measure_each, result_row

MISSING = ("violation", "skip")


def _parts(df: DataFrame, rule: Mapping[str, Any]) -> tuple[Column, Column, Column]:
    """Whether a rule applies to a row, cannot be decided there, and is violated."""
    missing = rule.get("missing", "violation")
    if missing not in MISSING:
        raise ValueError(f"rule {rule['name']!r}: missing must be one of {MISSING}")
    applies, demanded = condition(df, rule["if"]), condition(df, rule["then"])
    undecided = F.lit(False)
    if missing == "skip":
        undecided = applies & any_of(is_missing(df, n) for n in columns_of(rule["then"]))
    return applies, undecided, applies & ~undecided & ~demanded


def implication_tally(df: DataFrame, table: str, rule: Mapping[str, Any]) -> Tally:
    applies, undecided, violated = _parts(df, rule)

    def rows(total: Totals) -> list[Column]:
        decided = total("applicable") - total("undecided")
        return [
            result_row(
                table=F.lit(table),
                rule=F.lit(rule["name"]),
                total=total("rows"),
                applicable=total("applicable"),
                undecided=total("undecided"),
                fulfilled=decided - total("violated"),
                violated=total("violated"),
                violated_rate=rate(total("violated"), decided),
            )
        ]

    return Tally({"applicable": applies, "undecided": undecided, "violated": violated}, rows)


def implications(tables: Mapping[str, DataFrame], rules: Sequence[Mapping[str, Any]]) -> DataFrame:
    """One row per rule; each table is read once.

    A rule has a ``name``, a ``table``, the conditions ``if`` and ``then`` (see
    :mod:`tablegauge.functions.conditions`), and optionally ``missing``: ``"violation"``, the
    default, takes the conditions as they are; ``"skip"`` leaves rows out, as ``undecided``,
    where a column of ``then`` is missing. Rates are over the decided rows.
    """
    return measure_each(
        tables, [(r["table"], implication_tally(tables[r["table"]], r["table"], r)) for r in rules]
    )


def implication_rows(df: DataFrame, rules: Sequence[Mapping[str, Any]], label: str = "rule") -> DataFrame:
    """The rows that violate a rule, once per rule, with its name in front; one scan for all rules."""
    named = [F.when(_parts(df, r)[2], F.lit(r["name"])) for r in rules]
    marked = df.select(F.explode(F.array_compact(F.array(*named))).alias("\trule"), *[col(n) for n in df.columns])
    return marked.select(F.col("`\trule`").alias(label), *[col(n) for n in df.columns])

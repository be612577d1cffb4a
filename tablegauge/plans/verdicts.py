"""Thresholds on metrics: which results pass, over one run or a whole history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPE = ("check", "metric", "table", "field")


def _applies(threshold: Mapping[str, Any]) -> Column:
    found = F.lit(True)
    for name in SCOPE:
        if threshold.get(name) is not None:
            found = found & F.coalesce(F.col(name) == threshold[name], F.lit(False))
    return found


def verdicts(metrics: DataFrame, thresholds: Sequence[Mapping[str, Any]]) -> DataFrame:
    """The metric rows that thresholds name, with ``minimum``, ``maximum`` and ``passed``.

    ``metrics``: rows as :func:`tablegauge.sources.metrics_of` makes them, or a history of
    them; further columns, such as ``run_id``, stay. A threshold names a ``check`` and a
    ``metric`` and gives ``min``, ``max`` or both, bounds included; ``table`` and ``field``
    narrow it. A row has one verdict per threshold that names it. A value that is null, such as
    a rate over no rows, is neither passed nor failed. One pass, no shuffle.
    """
    if not thresholds:
        raise ValueError("no thresholds given")
    bounds = []
    for t in thresholds:
        if t.get("min") is None and t.get("max") is None or not {"check", "metric"} <= t.keys():
            raise ValueError(f"a threshold names a check and a metric, and gives min or max: {dict(t)}")
        low, high = (None if t.get(n) is None else float(t[n]) for n in ("min", "max"))
        low, high = (F.lit(x).cast("double") for x in (low, high))
        bounds.append(F.when(_applies(t), F.struct(low.alias("minimum"), high.alias("maximum"))))
    value = F.col("value")
    above = F.col("minimum").isNull() | (value >= F.col("minimum"))
    below = F.col("maximum").isNull() | (value <= F.col("maximum"))
    judged = metrics.select("*", F.inline(F.array_compact(F.array(*bounds))))
    return judged.withColumn("passed", F.when(value.isNotNull(), above & below))


def failed(judged: DataFrame) -> DataFrame:
    """The verdicts that did not pass."""
    return judged.filter(~F.col("passed"))


def run_verdicts(judged: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """``passed, failed, undecided`` verdicts, and whether all are fine, per run."""
    passed = F.col("passed")
    counted = judged.groupBy(*by).agg(
        F.count_if(passed).alias("passed"),
        F.count_if(~passed).alias("failed"),
        F.count_if(passed.isNull()).alias("undecided"),
    )
    return counted.withColumn("all_passed", F.col("failed") == 0)

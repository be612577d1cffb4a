"""Rates and their traffic-light level."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bound (inclusive) of each level; anything below the last is "red".
LEVELS = (
    ("dark_green", 1.00),
    ("light_green", 0.98),
    ("yellow", 0.95),
    ("orange", 0.90),
)
LOWEST_LEVEL = "red"


def rate(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, null when ``whole`` is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def traffic_light(value: Column) -> Column:
    """Level of an unrounded rate; null for a null rate."""
    level = F.when(value.isNull(), F.lit(None).cast("string"))
    for name, bound in LEVELS:
        level = level.when(value >= F.lit(bound), F.lit(name))
    return level.otherwise(F.lit(LOWEST_LEVEL))

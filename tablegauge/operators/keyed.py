"""All checks on the rows of a key from one pass over the table.

Duplicates, conflicts, the columns that differ, repeated rows and the first row of a key all
come from the same two frames: the distinct rows with their copies, and per key how many rows
and distinct rows it has, which columns differ, and its first row. Kept once, they serve every
check on the key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.columns import any_of, check_columns, col, holds, restore
from tablegauge.operators.consistency import first_per_key
from tablegauge.operators.profile import distinct_rows

_COPIES, _FIRST = "\tcopies", "\tfirst"


class KeyedRows:
    """The rows of ``df`` by ``keys``; the first of a key in the order of ``order_by``, ties broken
    on all other columns, nulls first.

    ``settle`` keeps the distinct rows and what is known of each key; without it both are
    computed again by every check. Copies collapse within each task before rows are shuffled,
    and what is known of a key is a partial aggregate, so a hot key is a few rows per task.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order_by: Sequence[str | Column] = (),
        settle: Callable[[DataFrame], DataFrame] | None = None,
    ):
        self.df, self.keys = df, check_columns(df, keys)
        self.order_by = list(order_by)
        self.others = [n for n in df.columns if n not in self.keys]
        self._settle = settle or (lambda frame: frame)

    @cached_property
    def rows(self) -> DataFrame:
        """Distinct rows with their copies, in comparable form."""
        return self._settle(distinct_rows(self.df, _COPIES))

    @cached_property
    def summary(self) -> DataFrame:
        """Per key: ``rows``, ``variants`` (distinct rows), a flag per other column whose present
        values differ, and the first row."""
        named = self._order_names()
        found = [
            F.sum(col(_COPIES)).alias("\trows"),
            F.count(F.lit(1)).alias("\tvariants"),
            *[holds(F.min(col(n)) != F.max(col(n))).alias(f"\tdiffers{i}") for i, n in enumerate(self.others)],
        ]
        if named is not None and self.others:
            found.append(F.min(F.struct(*[col(n) for n in named])).alias(_FIRST))
        return self._settle(self.rows.groupBy(*[col(k) for k in self.keys]).agg(*found))

    def _order_names(self) -> list[str] | None:
        """The other columns in the order that decides the first row; None if it is not by names."""
        if not all(isinstance(o, str) for o in self.order_by):
            return None
        ordered = [o for o in dict.fromkeys(self.order_by) if o in self.others]
        return ordered + [n for n in self.others if n not in ordered]

    def first(self) -> DataFrame:
        """One row per key, as :func:`first_per_key` picks it; null keys form a key of their own."""
        if self._order_names() is None:
            return restore(first_per_key(self.rows.drop(_COPIES), self.keys, self.order_by), self.df)
        cells = [col(n) if n in self.keys else F.col(f"`{_FIRST}`")[n].alias(n) for n in self.df.columns]
        return restore(self.summary.select(*cells), self.df)

    def conflicts(self) -> DataFrame:
        """As :func:`tablegauge.operators.keys.key_conflicts`."""
        zero, rows, variants = F.lit(0), col("\trows"), col("\tvariants")
        return self.summary.agg(
            F.coalesce(F.sum(rows), zero).alias("rows"),
            F.coalesce(F.sum(rows - variants), zero).alias("exact_duplicates"),
            F.coalesce(F.sum(variants - 1), zero).alias("conflicts"),
            F.count(F.lit(1)).alias("rows_after_cleaning"),
        )

    def _met(self, found: DataFrame, how: str) -> DataFrame:
        """Distinct rows with what is known of their key; null keys match null keys."""
        renamed = {k: f"\tkey{i}" for i, k in enumerate(self.keys)}
        match = reduce(lambda a, b: a & b, [col(k).eqNullSafe(col(m)) for k, m in renamed.items()])
        return self.rows.join(found.withColumnsRenamed(renamed), match, how).drop(*renamed.values())

    def conflict_rows(self) -> DataFrame:
        """As :func:`tablegauge.operators.keys.key_conflict_rows`."""
        found = self.summary.filter(col("\tvariants") > 1).select(*[col(k) for k in self.keys])
        return restore(self._met(found, "left_semi").drop(_COPIES), self.df)

    def conflict_columns(self, label: str = "conflict_in") -> DataFrame:
        """As :func:`tablegauge.operators.keys.key_conflict_columns`."""
        flags = {n: f"\tdiffers{i}" for i, n in enumerate(self.others)}
        found = self.summary.filter((col("\tvariants") > 1) & ~any_of(col(k).isNull() for k in self.keys))
        met = self._met(found.select(*[col(k) for k in self.keys], *map(col, flags.values())), "inner")

        def if_differs(name: str, value: Column) -> Column:
            return F.when(col(flags[name]), value)

        names = [if_differs(n, F.lit(n)) for n in self.others] or [F.lit(None).cast("string")]
        flagged = met.select(
            *[col(k) for k in self.keys],
            F.concat_ws(", ", *names).alias(label),
            *[if_differs(n, col(n)).alias(n) for n in self.others],
        )
        return restore(flagged, self.df)

    def repeated(self) -> DataFrame:
        """As :func:`tablegauge.operators.keys.repeated_rows`."""
        if not self.others:
            return self.df.limit(0)
        if self._order_names() is None:
            first = first_per_key(self.rows.drop(_COPIES), self.keys, self.order_by)
            first = first.select(*[col(k) for k in self.keys], F.struct(*[col(n) for n in self.others]).alias(_FIRST))
        else:
            several = self.summary.filter(col("\tvariants") > 1)
            first = several.select(*[col(k) for k in self.keys], F.col(f"`{_FIRST}`"))
        is_first = reduce(
            lambda a, b: a & b, [col(n).eqNullSafe(F.col(f"`{_FIRST}`")[n]) for n in self.others]
        )
        return restore(self._met(first, "inner").filter(~is_first).drop(_COPIES, _FIRST), self.df)

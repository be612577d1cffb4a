"""Table and column profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.columns import (
    check_columns,
    comparable,
    is_string,
    row_digest,
    type_of,
)
from tablegauge.functions.missing import blank_in, blank_to_null_column, is_missing, null_in
from tablegauge.functions.rates import rate
from tablegauge.operators.frequencies import distinct_counts
from tablegauge.operators.tally import result_row


def distinct_rows(df: DataFrame, copies: str = "copies") -> DataFrame:
    """Distinct rows with the number of times each occurs.

    Copies collapse inside each task before the shuffle, and the shuffle spreads rows
    over all their columns, so neither a hot key nor a mass of copies meets one task.
    """
    return df.groupBy(*comparable(df)).agg(F.count(F.lit(1)).alias(copies))


def _sum(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0))


def _cells(df: DataFrame, predicate) -> Column:
    """How many cells of a row satisfy ``predicate(df, column)``."""
    return reduce(
        lambda a, b: a + b, [predicate(df, name).cast("long") for name in df.columns]
    )


def _shape(df: DataFrame, digest: bool) -> DataFrame:
    """One row of table-wide counts, from one scan and one shuffle.

    Cells are counted per row, once for each group of equal rows.
    """
    marked = df.select(
        *(
            [row_digest(df).alias("\tdigest")]
            if digest
            else [c.alias(f"\tc{i}") for i, c in enumerate(comparable(df))]
        ),
        _cells(df, null_in).alias("\tnulls"),
        _cells(df, blank_in).alias("\tblanks"),
    )
    # Equal rows have equal counts, so these can be grouping columns as well.
    rows = marked.groupBy(*[F.col(f"`{n}`") for n in marked.columns]).agg(
        F.count(F.lit(1)).alias("\tcopies")
    )
    n = F.col("`\tcopies`")
    return rows.agg(
        _sum(n).alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
        _sum(n * F.col("`\tnulls`")).alias("null_cells"),
        _sum(n * F.col("`\tblanks`")).alias("blank_cells"),
        _sum(n - 1).alias("duplicate_rows"),
    )


def table_overview(df: DataFrame, *, digest: bool = False) -> DataFrame:
    """``metric, value, percent`` for rows, columns, null cells, blank cells, duplicate rows.

    Cell percentages are over rows x columns, duplicates over rows. Percentages are
    numbers from 0 to 100, null where they have no meaning or the table is empty.
    ``digest`` as in :func:`duplicate_row_count`.
    """
    cells = F.col("rows") * F.col("columns")
    none = F.lit(None).cast("double")
    return _shape(df, digest).select(
        F.inline(
            F.array(
                *[
                    result_row(metric=F.lit(name), value=F.col(name), percent=percent)
                    for name, percent in (
                        ("rows", none),
                        ("columns", none),
                        ("null_cells", rate(F.col("null_cells"), cells) * 100),
                        ("blank_cells", rate(F.col("blank_cells"), cells) * 100),
                        ("duplicate_rows", rate(F.col("duplicate_rows"), F.col("rows")) * 100),
                    )
                ]
            )
        )
    )


def missing_share(df: DataFrame, *, digest: bool = False) -> DataFrame:
    """``rows, columns, missing, missing_percent, duplicate_rows`` of the whole table.

    ``digest`` as in :func:`duplicate_row_count`.
    """
    missing = F.col("null_cells") + F.col("blank_cells")
    return _shape(df, digest).select(
        "rows",
        "columns",
        missing.alias("missing"),
        (rate(missing, F.col("rows") * F.col("columns")) * 100).alias("missing_percent"),
        "duplicate_rows",
    )


def duplicate_row_count(df: DataFrame, *, digest: bool = False) -> DataFrame:
    """``rows, distinct_rows, duplicate_rows``; nulls equal nulls.

    Whole rows are compared, and shuffled for it. ``digest`` compares a SHA-256 of each
    row instead: 32 bytes per row in the shuffle, however wide the table is.
    """
    if digest:
        df = df.select(row_digest(df).alias("\tdigest"))
    return distinct_rows(df, "\tcopies").agg(
        _sum(F.col("`\tcopies`")).alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        _sum(F.col("`\tcopies`") - 1).alias("duplicate_rows"),
    )


def column_profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    *,
    approximate: float | None = None,
    digest: bool = False,
) -> DataFrame:
    """Per column: type, missing cells, distinct present values, and their percentages.

    Percentages are over all rows. Distinct counts are exact; ``approximate`` takes a
    maximum relative error instead and then needs no shuffle of values. ``digest``
    compares long texts by their SHA-256.
    """
    names = check_columns(df, df.columns if columns is None else columns)
    types = {n: type_of(df, n).simpleString() for n in names}
    if approximate is None:
        counted = distinct_counts(df, names, digest=digest)
    else:
        counted = _approximate_counts(df, names, approximate)
    kind = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return counted.select(
        "column",
        kind[F.col("column")].alias("type"),
        "missing",
        (rate(F.col("missing"), F.col("total")) * 100).alias("missing_percent"),
        "distinct",
        (rate(F.col("distinct"), F.col("total")) * 100).alias("distinct_percent"),
    )


def _approximate_counts(df: DataFrame, names: Sequence[str], error: float) -> DataFrame:
    aggregates = [F.count(F.lit(1)).alias("total")]
    for i, n in enumerate(names):
        present = blank_to_null_column(df, n) if is_string(df, n) else comparable(df, [n])[0]
        aggregates.append(F.count_if(is_missing(df, n)).alias(f"missing_{i}"))
        aggregates.append(F.approx_count_distinct(present, error).alias(f"distinct_{i}"))
    rows = [
        result_row(
            column=F.lit(n),
            total=F.col("total"),
            missing=F.col(f"missing_{i}"),
            distinct=F.col(f"distinct_{i}"),
        )
        for i, n in enumerate(names)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def profile_tables(tables: Mapping[str, DataFrame], *, digest: bool = False) -> DataFrame:
    """:func:`table_overview` of every table, with a ``table`` column in front."""
    return _for_each(tables, lambda df: table_overview(df, digest=digest))


def profile_columns(
    tables: Mapping[str, DataFrame],
    *,
    approximate: float | None = None,
    digest: bool = False,
) -> DataFrame:
    """:func:`column_profile` of every table, with a ``table`` column in front."""
    return _for_each(
        tables, lambda df: column_profile(df, approximate=approximate, digest=digest)
    )


def _for_each(tables: Mapping[str, DataFrame], check) -> DataFrame:
    if not tables:
        raise ValueError("no tables given")
    return reduce(
        DataFrame.unionByName,
        [check(df).select(F.lit(name).alias("table"), "*") for name, df in tables.items()],
    )

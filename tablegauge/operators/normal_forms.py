"""Normal-form diagnostics: atomic cells, candidate keys, decompositions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.columns import (
    check_columns,
    col,
    comparable,
    quoted,
    restore,
    row_digest,
    string_columns,
    unique,
)
from tablegauge.operators.frequencies import distinct_counts
from tablegauge.operators.tally import Tally, Totals, measure, result_row


def _contains_any(text: Column, delimiters: Sequence[str]) -> Column:
    if not delimiters or not all(delimiters):
        raise ValueError("delimiters must be non-empty strings")
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(d)) for d in delimiters])


def atomicity_flags(
    df: DataFrame,
    delimiters: Sequence[str],
    keys: Sequence[str],
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Key columns, ``column`` and ``value`` of each text cell that holds a delimiter.

    The keys stand in for a row number, which tables do not have. Flagged cells are
    candidates for a person to judge. One pass, no shuffle. Without keys the cells come
    alone.
    """
    if keys:
        check_columns(df, keys)
    texts = string_columns(df) if columns is None else check_columns(df, columns)
    ids = [f"\tkey{i}" for i in range(len(keys))]
    if not texts:
        texts_of = df.select(
            *[col(k) for k in keys],
            F.lit(None).cast("string").alias("column"),
            F.lit(None).cast("string").alias("value"),
        )
        return texts_of.filter(F.lit(False))
    cells = df.select(
        *[col(k).alias(i) for k, i in zip(keys, ids)], *[col(n) for n in texts]
    ).unpivot([quoted(i) for i in ids], [quoted(n) for n in texts], "column", "value")
    return cells.filter(_contains_any(F.col("value"), delimiters)).select(
        *[col(i).alias(k) for k, i in zip(keys, ids)], "column", "value"
    )


def atomicity_tally(df: DataFrame, table: str, delimiters: Sequence[str]) -> Tally:
    texts = string_columns(df)

    def rows(total: Totals) -> list[Column]:
        flagged = reduce(lambda a, b: a + b, [total(n) for n in texts], F.lit(0).cast("long"))
        return [
            result_row(
                table=F.lit(table), text_columns=F.lit(len(texts)).cast("long"), flagged=flagged
            )
        ]

    return Tally({n: _contains_any(col(n), delimiters) for n in texts}, rows)


def atomicity_counts(
    tables: Mapping[str, DataFrame], delimiters: Sequence[str]
) -> DataFrame:
    """``table, text_columns, flagged``: number of flagged cells of every table."""
    return reduce(
        DataFrame.unionByName,
        [measure(df, atomicity_tally(df, name, delimiters)) for name, df in tables.items()],
    )


def _distinct_combinations(
    rows: DataFrame, names: Mapping[str, str], sets: Mapping[str, Sequence[str]]
) -> DataFrame:
    """``name, rows, distinct`` per column set over ``rows``; nulls are values.

    ``names``: the column of ``rows`` that stands for a column of a set. The values of a set
    come from those of the smallest set that holds it, and every step adds up how many rows
    they stand for: the sums are part of the result, so the optimiser cannot take a step out.
    Steps that several sets share are shuffled once, and only sets that no other holds read
    ``rows``.
    """
    weight = "\trows"
    found: dict[frozenset[str], DataFrame] = {}
    for columns in sorted({frozenset(c) for c in sets.values()}, key=lambda c: (-len(c), sorted(c))):
        wider = [c for c in found if columns < c]
        source = found[min(wider, key=lambda c: (len(c), sorted(c)))] if wider else rows
        counted = F.sum(col(weight)) if wider else F.count(F.lit(1))
        found[columns] = source.groupBy(*[col(n) for c, n in names.items() if c in columns]).agg(counted.alias(weight))
    return reduce(
        DataFrame.unionByName,
        [
            found[frozenset(columns)]
            .agg(
                F.coalesce(F.sum(col(weight)), F.lit(0)).alias("rows"),
                F.count_if(col(weight) > 0).alias("distinct"),
            )
            .select(F.lit(name).alias("name"), "rows", "distinct")
            for name, columns in sets.items()
        ],
    )


def _numbered(df: DataFrame, columns: Sequence[str]) -> tuple[list[Column], dict[str, str]]:
    """Columns in comparable form under short names, and the names by column."""
    names = {n: f"c{i}" for i, n in enumerate(columns)}
    return [c.alias(names[n]) for n, c in zip(columns, comparable(df, columns))], names


def candidate_key_scan(
    df: DataFrame,
    key_sets: Sequence[Sequence[str]],
    *,
    dedupe: bool = True,
    digest: bool = False,
) -> DataFrame:
    """``key_columns, rows, distinct_keys, duplicates`` for each column combination.

    ``duplicates`` is 0 exactly for a key. ``dedupe`` counts exact copies once, which
    concerns ``rows`` only: copies have the same keys. All sets are then counted from the
    distinct rows, which are made in one scan. With ``digest`` rows are compared by their
    SHA-256.
    """
    sets = {", ".join(check_columns(df, columns)): columns for columns in key_sets}
    if not sets:
        raise ValueError("no key sets given")
    used = [n for n in df.columns if any(n in columns for columns in sets.values())]
    if dedupe:
        compared = used if digest else df.columns
        cells, names = _numbered(df, compared)
        rows = unique(df.select(*cells, *([row_digest(df).alias("\tdigest")] if digest else [])))
    else:
        cells, names = _numbered(df, used)
        rows = df.select(*cells)
    return _distinct_combinations(rows, names, sets).select(
        F.col("name").alias("key_columns"),
        "rows",
        F.col("distinct").alias("distinct_keys"),
        (F.col("rows") - F.col("distinct")).alias("duplicates"),
    )


def projection(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct rows of a projection: one table of a decomposition. NaN is null."""
    check_columns(df, columns)
    return restore(unique(df.select(*comparable(df, columns))), df)


def decompose(
    df: DataFrame, projections: Mapping[str, Sequence[str]]
) -> dict[str, DataFrame]:
    """The tables a relation splits into: distinct rows of each projection."""
    return {name: projection(df, columns) for name, columns in projections.items()}


def decomposition_summary(
    df: DataFrame,
    projections: Mapping[str, Sequence[str]],
    keys: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """``projection, rows, distinct_keys, key_conflicts`` per table of a decomposition.

    The key of a projection defaults to all its columns, which never conflicts; with a
    smaller key, ``key_conflicts`` counts rows beyond the first of their key. Keys roll
    up from the rows of their projection.
    """
    keys = dict(keys or {})
    sets: dict[str, Sequence[str]] = {}
    for name, columns in projections.items():
        key = check_columns(df, keys.get(name, columns))
        if not set(key) <= set(check_columns(df, columns)):
            raise ValueError(f"projection {name!r} lacks columns of its key {key}")
        sets[f"rows\t{name}"], sets[f"keys\t{name}"] = columns, key
    part = F.split(F.col("name"), "\t")
    cells, names = _numbered(df, [n for n in df.columns if any(n in c for c in sets.values())])
    counted = (
        _distinct_combinations(df.select(*cells), names, sets)
        .select(part[0].alias("kind"), part[1].alias("projection"), "distinct")
        .groupBy("projection")
        .agg(
            F.sum(F.when(F.col("kind") == "rows", F.col("distinct"))).alias("rows"),
            F.sum(F.when(F.col("kind") == "keys", F.col("distinct"))).alias("distinct_keys"),
        )
    )
    return counted.withColumn("key_conflicts", F.col("rows") - F.col("distinct_keys"))


def entity_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, rows, entities``: distinct non-null values next to the row count."""
    return distinct_counts(df, columns, blank_is_missing=False).select(
        "column", F.col("total").alias("rows"), F.col("distinct").alias("entities")
    )

"""Keys: references between tables, duplicate keys, conflicting rows.

Rows are never gathered per key. Keys are counted with partial aggregates, and rows
return to their key through joins that adaptive execution splits when a key is hot.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions.columns import (
    any_of,
    check_columns,
    check_key_types,
    col,
    comparable,
    from_exact_number,
    holds,
    key_pair,
    number,
    restore,
    row_digest,
    type_of,
    unique,
)
from tablegauge.functions.rates import rate
from tablegauge.operators.consistency import first_per_key
from tablegauge.operators.key_domains import key_domains, linked_counts
from tablegauge.operators.profile import distinct_rows


def key_presence(
    left: DataFrame, left_key: str, right: DataFrame, right_key: str
) -> DataFrame:
    """``key, in_left, in_right`` for every non-null key of either table.

    One shuffle of keys that are already distinct per task; no join, so no side has to
    be small and no key can be hot.
    """
    check_columns(left, [left_key])
    check_columns(right, [right_key])
    check_key_types(left, [left_key], right, [right_key])

    # Nulls go before the key gets its form, which a filter on it would compute a second time.
    def side(df: DataFrame, name: str, key: Column, is_left: bool) -> DataFrame:
        return df.filter(number(df, name).isNotNull()).select(
            key.alias("key"),
            F.lit(is_left).alias("in_left"),
            F.lit(not is_left).alias("in_right"),
        )

    left_form, right_form = key_pair(left, left_key, right, right_key)
    found = (
        side(left, left_key, left_form, True)
        .unionByName(side(right, right_key, right_form, False))
        .groupBy("key")
        .agg(F.bool_or("in_left").alias("in_left"), F.bool_or("in_right").alias("in_right"))
    )
    kind = type_of(left, left_key)
    if found.schema["key"].dataType == kind or not isinstance(kind, T.NumericType):
        return found
    return found.withColumn("key", from_exact_number(F.col("key"), kind))


def referential_integrity(
    child: DataFrame, parent: DataFrame, column: str, parent_column: str
) -> DataFrame:
    """``keys, referenced, orphaned, orphan_rate`` over the child's distinct keys."""
    keys = key_presence(child, column, parent, parent_column)
    counted = keys.agg(
        F.count_if("in_left").alias("keys"),
        F.count_if(F.col("in_left") & F.col("in_right")).alias("referenced"),
        F.count_if(F.col("in_left") & ~F.col("in_right")).alias("orphaned"),
    )
    return counted.withColumn("orphan_rate", rate(F.col("orphaned"), F.col("keys")))


REFERENCES = ("keys", "referenced", "orphaned")
CHILDREN = ("keys", "with_child", "without_child")


def referential_integrity_rules(
    tables: Mapping[str, DataFrame], rules: Sequence[tuple[str, str, str, str]]
) -> DataFrame:
    """:func:`referential_integrity` per ``(table, column, parent table, parent column)``.

    Rules whose columns hold keys of one domain share one shuffle of these keys, and a table
    is read once for all its columns in it.
    """
    if not rules:
        raise ValueError("no reference rules given")
    return linked_counts(key_domains(tables, rules), rules, REFERENCES, "orphan_rate")


def missing_children(
    parent: DataFrame, child: DataFrame, key: str, child_key: str | None = None
) -> DataFrame:
    """``keys, with_child, without_child, without_child_rate`` over distinct parent keys."""
    keys = key_presence(parent, key, child, child_key or key)
    counted = keys.agg(
        F.count_if("in_left").alias("keys"),
        F.count_if(F.col("in_left") & F.col("in_right")).alias("with_child"),
        F.count_if(F.col("in_left") & ~F.col("in_right")).alias("without_child"),
    )
    return counted.withColumn("without_child_rate", rate(F.col("without_child"), F.col("keys")))


def missing_children_keys(
    parent: DataFrame, child: DataFrame, key: str, child_key: str | None = None
) -> DataFrame:
    """The parent keys without a child, one per row."""
    return (
        key_presence(parent, key, child, child_key or key)
        .filter(F.col("in_left") & ~F.col("in_right"))
        .select(F.col("key").alias(key))
    )


def key_conflicts(
    df: DataFrame, keys: Sequence[str], *, digest: bool = False
) -> DataFrame:
    """``rows, exact_duplicates, conflicts, rows_after_cleaning``.

    Conflicts are distinct rows beyond the first of their key; cleaning keeps one row
    per key. Rows are shuffled once over all columns, then only keys and counts.
    ``digest`` shuffles the key and a SHA-256 of the row instead of whole rows.
    """
    check_columns(df, keys)
    copies = "\tcopies"
    if digest:
        df = df.select(*comparable(df, keys), row_digest(df).alias("\tdigest"))
    per_key = (
        distinct_rows(df, copies)
        .groupBy(*[col(k) for k in keys])
        .agg(F.sum(f"`{copies}`").alias("rows"), F.count(F.lit(1)).alias("variants"))
    )
    zero = F.lit(0)
    return per_key.agg(
        F.coalesce(F.sum("rows"), zero).alias("rows"),
        F.coalesce(F.sum(F.col("rows") - F.col("variants")), zero).alias("exact_duplicates"),
        F.coalesce(F.sum(F.col("variants") - 1), zero).alias("conflicts"),
        F.count(F.lit(1)).alias("rows_after_cleaning"),
    )


def _with_keys(
    rows: DataFrame, keys: Sequence[str], found: DataFrame, how: str = "left_semi"
) -> DataFrame:
    """Joins ``rows`` to one row per key in ``found``; null keys match null keys."""
    renamed = {k: f"\tkey{i}" for i, k in enumerate(keys)}
    match = reduce(
        lambda a, b: a & b,
        [c.eqNullSafe(F.col(f"`{renamed[k]}`")) for k, c in zip(keys, map(col, keys))],
    )
    joined = rows.join(found.withColumnsRenamed(renamed), match, how)
    return joined.drop(*renamed.values())


def _conflicting_keys(
    rows: DataFrame, keys: Sequence[str], flags: Mapping[str, str] | None = None
) -> DataFrame:
    """Keys with more than one distinct row, from one aggregate over the raw rows.

    A column varies inside a key exactly when its smallest and largest present values
    differ, or when it is null in some rows only; copies of rows change neither. So rows
    need not be compared: three values per column and key, made in each task first.
    ``flags`` names columns that say whether present values differ.
    """
    others = [n for n in rows.columns if n not in keys]
    differs = {n: holds(F.min(col(n)) != F.max(col(n))) for n in others}
    partly = [F.count(col(n)).between(1, F.count(F.lit(1)) - 1) for n in others]
    varies = any_of([*differs.values(), *partly, F.lit(False)])
    named = [differs[n].alias(flag) for n, flag in (flags or {}).items()]
    found = rows.groupBy(*[col(k) for k in keys]).agg(varies.alias("\tvaries"), *named)
    return found.filter(F.col("`\tvaries`")).drop("\tvaries")


def key_conflict_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All distinct rows whose key has more than one distinct row.

    Whole rows are shuffled twice: by key, to those that conflict, where adaptive
    execution splits a hot key, and over all columns, to drop copies.
    """
    check_columns(df, keys)
    rows = df.select(*comparable(df))
    return restore(unique(_with_keys(rows, keys, _conflicting_keys(rows, keys))), df)


def key_conflict_columns(
    df: DataFrame, keys: Sequence[str], label: str = "conflict_in"
) -> DataFrame:
    """Rows of :func:`key_conflict_rows`, saying which columns differ inside the key.

    ``conflict_in`` lists the columns with more than one present value; other non-key
    columns are null. Rows with a null in the key are left out.
    """
    check_columns(df, keys)
    others = [n for n in df.columns if n not in keys]
    complete = df.filter(reduce(lambda a, b: a & b, [col(k).isNotNull() for k in keys]))
    rows = complete.select(*comparable(complete))
    rows = rows.filter(reduce(lambda a, b: a & b, [col(k).isNotNull() for k in keys]))
    flags = {n: f"\tdiffers{i}" for i, n in enumerate(others)}
    conflicting = _conflicting_keys(rows, keys, flags)

    def if_differs(name: str, value: Column) -> Column:
        return F.when(F.col(f"`{flags[name]}`"), value)

    names = [if_differs(n, F.lit(n)) for n in others] or [F.lit(None).cast("string")]
    # Copies go before columns that agree are blanked: distinct rows may then look alike.
    joined = unique(_with_keys(rows, keys, conflicting, "inner")).select(
        *[col(k) for k in keys],
        F.concat_ws(", ", *names).alias(label),
        *[if_differs(n, col(n)).alias(n) for n in others],
    )
    return restore(joined, df)


def repeated_rows(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column] = ()
) -> DataFrame:
    """Second and later distinct rows of each key, in the order of ``order_by``.

    Each row is compared with the first of its key, which is picked within each task
    before it is shuffled. The join splits a hot key over several tasks, so no task holds
    or sorts all rows of a key.
    """
    check_columns(df, keys)
    rows = df.select(*comparable(df))
    others = [n for n in df.columns if n not in keys]
    marks = {n: f"\tfirst{i}" for i, n in enumerate(others)}
    first = first_per_key(rows, keys, order_by).withColumnsRenamed(marks)
    is_first = reduce(
        lambda a, b: a & b,
        [col(n).eqNullSafe(F.col(f"`{m}`")) for n, m in marks.items()],
        F.lit(True),
    )
    rest = _with_keys(rows, keys, first, "inner").filter(~is_first).drop(*marks.values())
    return restore(unique(rest), df)

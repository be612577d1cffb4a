"""References among any number of key columns, from one shuffle per key domain.

Columns that rules compare, directly or through others, hold keys of one domain. All of them
are read into one frame, a table once, and each key collects a bit per column that has it.
Every rule is then a count over the masks: a key is orphaned where the child's bit is set and
the parent's is not. There is no join, so no side has to fit in memory and no key can be hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions.columns import (
    check_columns,
    check_key_types,
    comparable_column,
    exact_number,
    from_exact_number,
    number,
    type_of,
)
from tablegauge.functions.rates import rate
from tablegauge.operators.tally import result_row

Node = tuple[str, str]  # table and column
Link = tuple[str, str, str, str]  # table, column, other table, other column

_BITS = 62  # columns that one mask holds


def domains_of(links: Iterable[Link]) -> list[list[Node]]:
    """The columns of each domain, in the order in which the links name them."""
    found: list[list[Node]] = []
    for table, column, other, other_column in links:
        ends = [(table, column), (other, other_column)]
        touched = [d for d in found if any(n in d for n in ends)]
        joined = list(dict.fromkeys([n for d in touched for n in d] + ends))
        at = found.index(touched[0]) if touched else len(found)
        found = [d for d in found if d not in touched]
        found.insert(at, joined)
    return found


@dataclass(frozen=True)
class KeyDomain:
    """``masks``: ``key`` and ``m0``, ``m1``, ... with a bit per column of ``nodes``."""

    nodes: Sequence[Node]
    kinds: Mapping[Node, T.DataType]
    exact: bool
    masks: DataFrame

    def has(self, node: Node) -> Column:
        place = self.nodes.index(node)
        return F.getbit(F.col(f"m{place // _BITS}"), F.lit(place % _BITS)) == 1

    def links(self, links: Sequence[Link], names: tuple[str, str, str]) -> DataFrame:
        """``table, column`` and ``names`` (keys of the column, those the other column has, and those
        it lacks) per link, from one aggregate over the keys."""
        counters, rows = [], []
        for i, (table, column, other, other_column) in enumerate(links):
            ours, theirs = self.has((table, column)), self.has((other, other_column))
            counters += [
                F.count_if(ours).alias(f"all{i}"),
                F.count_if(ours & theirs).alias(f"met{i}"),
                F.count_if(ours & ~theirs).alias(f"unmet{i}"),
            ]
            parts = dict(zip(names, (F.col(f"{n}{i}") for n in ("all", "met", "unmet"))))
            rows.append(result_row(link=F.lit(i), table=F.lit(table), column=F.lit(column), **parts))
        return self.masks.agg(*counters).select(F.inline(F.array(*rows)))

    def unmet(self, link: Link, name: str) -> DataFrame:
        """The keys of a column that the other column of a link lacks, in the column's own type."""
        table, column, other, other_column = link
        kind = self.kinds[table, column]
        key = from_exact_number(F.col("key"), kind) if self.exact else F.col("key").cast(kind)
        lacking = self.masks.filter(self.has((table, column)) & ~self.has((other, other_column)))
        return lacking.select(key.alias(name))


def key_domain(
    tables: Mapping[str, DataFrame],
    nodes: Sequence[Node],
    settle: Callable[[DataFrame], DataFrame] | None = None,
) -> KeyDomain:
    """One domain. ``settle`` keeps the masks, so that rules and their keys share them."""
    for table, column in nodes:
        check_columns(tables[table], [column], table)
        check_key_types(tables[nodes[0][0]], [nodes[0][1]], tables[table], [column])
    kinds = {(t, c): type_of(tables[t], c) for t, c in nodes}
    distinct = set(map(type, kinds.values()))
    numeric = all(isinstance(k, T.NumericType) for k in kinds.values())
    same = len(set(kinds.values())) == 1 or all(issubclass(k, T.IntegralType) for k in distinct)
    exact = numeric and not same
    form = exact_number if exact else comparable_column
    masks = range(-(-len(nodes) // _BITS))

    def mask(place: int, m: int) -> Column:
        return F.lit(1 << place % _BITS if place // _BITS == m else 0).cast("bigint").alias(f"m{m}")

    by_table: dict[str, list[int]] = {}
    for place, (table, _) in enumerate(nodes):
        by_table.setdefault(table, []).append(place)
    parts = []
    for table, places in by_table.items():
        df = tables[table]
        if len(places) == 1:
            # Nulls go before the key gets its form, which a filter on it would compute a second time.
            name = nodes[places[0]][1]
            present = df.filter(number(df, name).isNotNull())
            keys = present.select(form(df, name).alias("key"), *[mask(places[0], m) for m in masks])
        else:
            widest = T.LongType() if numeric and not exact and len(distinct) > 1 else None
            cells = [form(df, nodes[p][1]) for p in places]
            cells = [c.cast(widest) for c in cells] if widest else cells
            keys = df.select(
                F.inline(F.array(*[F.struct(c.alias("key"), *[mask(p, m) for m in masks]) for c, p in zip(cells, places)]))
            ).filter(F.col("key").isNotNull())
        parts.append(keys)
    every = reduce(DataFrame.unionByName, parts)
    found = every.groupBy("key").agg(*[F.bit_or(f"m{m}").alias(f"m{m}") for m in masks])
    return KeyDomain(list(nodes), kinds, exact, found if settle is None else settle(found))


def key_domains(
    tables: Mapping[str, DataFrame],
    links: Sequence[Link],
    settle: Callable[[DataFrame], DataFrame] | None = None,
) -> list[KeyDomain]:
    return [key_domain(tables, nodes, settle) for nodes in domains_of(links)]


def domain_of(domains: Sequence[KeyDomain], link: Link) -> KeyDomain:
    return next(d for d in domains if link[:2] in d.nodes)


def linked_counts(
    domains: Sequence[KeyDomain], links: Sequence[Link], names: tuple[str, str, str], share: str
) -> DataFrame:
    """``table``, ``names`` and ``share`` (of the last of them) per link; an aggregate per domain."""
    parts = []
    for domain in domains:
        own = [link for link in links if domain_of(domains, link) is domain]
        if own:
            parts.append(domain.links(own, names))
    counted = reduce(DataFrame.unionByName, parts)
    return counted.select("table", *names, rate(F.col(names[2]), F.col(names[0])).alias(share))

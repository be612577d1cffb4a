"""Running many checks over a set of tables, reading each table as few times as possible.

Checks that only count rows share the passes over a table; the passes over all tables
are one job, and their result, a row per table, is kept in the checkpoint folder
for the checks to lay out. Checks on the rows of one key share its distinct rows, and
references share the keys of their domain; both are kept where several results need them.
Other checks on keys and distinct values stay lazy.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.operators import checks as row_checks
from tablegauge.operators import codes
from tablegauge.operators import keys as key_checks
from tablegauge.operators import kpi, normal_forms, profile
from tablegauge.operators.consistency import pair_consistency, resolved_keys
from tablegauge.operators.implications import implication_rows, implication_tally
from tablegauge.operators.key_domains import KeyDomain, Link, domain_of, key_domains, linked_counts
from tablegauge.operators.keyed import KeyedRows
from tablegauge.operators.tally import Tally, result_rows, totals
from tablegauge.plans import report
from tablegauge.plans.rules import allowed_values
from tablegauge.plans.verdicts import verdicts
from tablegauge.sources.results import metrics_of
from tablegauge.sources.work import settle as keep


CHECKS = (
    "overview",
    "completeness",
    "uniqueness",
    "pair_consistency",
    "unit_consistency",
    "vocabulary_validity",
    "plausible_range",
    "identifier_format",
    "check_digits",
    "key_format",
    "implications",
    "price_validity",
    "referential_integrity",
    "key_conflicts",
    "missing_children",
    "repeated_rows",
    "atomicity",
    "candidate_key_scan",
    "decomposition_summary",
    "entity_counts",
    "thresholds",
)


@dataclass(frozen=True)
class _Counted:
    check: str
    table: str
    tally: Tally
    name_table: bool = False


def run_suite(
    tables: Mapping[str, DataFrame],
    rules: Mapping[str, Any],
    *,
    settle: Callable[[DataFrame], DataFrame] | None = keep,
    details: bool = False,
) -> dict[str, DataFrame]:
    """Check name -> result, for the checks named in ``rules``.

    Values of ``rules`` are the parameters of the check; ``False`` or ``None`` switches
    it off. Vocabularies may be dotted paths into ``rules``. ``details`` adds the
    offending rows of each check. ``"digest": True`` in the rules compares rows and long
    texts by digest where a check offers that. ``settle`` materialises the row counts and what
    checks on keys share; ``None`` keeps everything lazy, and each result then reads its table
    again.

    ``thresholds`` are judged last, over the metrics of all other checks
    (:func:`tablegauge.plans.verdicts.verdicts`).
    """
    rules = {name: block for name, block in rules.items() if block not in (None, False)}
    shared = _Shared(tables, rules, details, settle)
    results = _row_level(tables, rules, settle)
    results |= _key_level(tables, rules, shared)
    if "thresholds" in rules:
        results["verdicts"] = verdicts(metrics_of(results), rules["thresholds"])
    if details:
        results |= _details(tables, rules, shared)
    return results


class _Shared:
    """What checks on keys have in common, made at first use and kept where used again."""

    def __init__(self, tables: Mapping[str, DataFrame], rules: Mapping[str, Any], details: bool, settle):
        self.tables, self.rules, self.details, self.settle = tables, rules, details, settle
        uses: dict[tuple[str, tuple[str, ...]], int] = {}
        self._orders: dict[tuple[str, tuple[str, ...]], list] = {}
        wanted = [("key_conflicts", "table", 1 + 2 * details), ("pair_consistency", "child", 1)]
        wanted += [("repeated_rows", "table", 1)] if details else []
        for check, name, n in wanted:
            for block in _several(rules.get(check, [])):
                key = block[name], tuple(block["keys"])
                uses[key] = uses.get(key, 0) + n
                if check != "key_conflicts":
                    self._orders.setdefault(key, list(block.get("order_by", ())))
        # Sharing compares whole rows; a single check by digest is better off alone.
        self._uses = {key for key, n in uses.items() if n > 1 and settle is not None}
        self._rows: dict[tuple, KeyedRows] = {}
        self._domains: list[KeyDomain] | None = None

    def rows(self, table: str, keys: Sequence[str], order_by: Sequence | None = None) -> KeyedRows | None:
        """The rows of a key, if several checks use them; ``order_by``: the order that a check needs."""
        key = table, tuple(keys)
        if key not in self._uses:
            return None
        if order_by is not None and not _same(order_by, self._orders.get(key, ())):
            return None
        if key not in self._rows:
            self._rows[key] = KeyedRows(self.tables[table], keys, self._orders.get(key, ()), self.settle)
        return self._rows[key]

    def links(self) -> list[Link]:
        return [
            (r["table"], r["column"], r["parent"], r["parent_column"])
            for r in _several(self.rules.get("referential_integrity", []))
        ]

    def children(self) -> Link | None:
        """The link from parent to child; its key is the first of ``keys`` the parent has, or ``key``."""
        if "missing_children" not in self.rules:
            return None
        block = self.rules["missing_children"]
        parent, child = block["parent"], block["child"]
        key = block.get("key") or resolved_keys(self.tables[parent], self.tables[child], block["keys"])[0]
        return parent, key, child, key

    @property
    def domains(self) -> list[KeyDomain]:
        if self._domains is None:
            children = self.children()
            links = self.links() + ([children] if children else [])
            # References of one kind are a single result, which reads the keys once.
            several = children is not None and (self.details or len(links) > 1)
            self._domains = key_domains(self.tables, links, self.settle if several else None)
        return self._domains


def _same(a: Sequence, b: Sequence) -> bool:
    """Whether two orders are the same names or the very same columns."""
    return len(a) == len(b) and all(
        x == y if isinstance(x, str) and isinstance(y, str) else x is y for x, y in zip(a, b)
    )


def _several(block: Any) -> list[Mapping[str, Any]]:
    return [block] if isinstance(block, Mapping) else list(block)


def _tallies(tables: Mapping[str, DataFrame], rules: Mapping[str, Any]) -> list[_Counted]:
    found: list[_Counted] = []
    for table, fields in rules.get("completeness", {}).items():
        tally = kpi.completeness_tally(tables[table], fields)
        found.append(_Counted("completeness", table, tally, name_table=True))
    for check, uniform in (("unit_consistency", True), ("vocabulary_validity", False)):
        for block in _several(rules.get(check, [])):
            table, allowed = block["table"], allowed_values(rules, block["allowed"])
            tally = kpi.vocabulary_tally(
                tables[table], table, block["column"], allowed, uniform=uniform
            )
            found.append(_Counted(check, table, tally))
    for block in _several(rules.get("plausible_range", [])):
        table = block["table"]
        tally = row_checks.plausible_range_tally(
            tables[table], table, block["columns"], block.get("maximum")
        )
        found.append(_Counted("plausible_range", table, tally))
    for block in _several(rules.get("identifier_format", [])):
        table = block["table"]
        tally = row_checks.identifier_format_tally(
            tables[table],
            table,
            block["column"],
            block["length"],
            block.get("sentinels", ()),
            pad=block.get("pad", True),
        )
        found.append(_Counted("identifier_format", table, tally))
    for block in _several(rules.get("check_digits", [])):
        table = block["table"]
        tally = codes.check_digit_tally(
            tables[table], table, block["column"], block.get("length", 13), block.get("sentinels", ())
        )
        found.append(_Counted("check_digits", table, tally))
    for block in _several(rules.get("key_format", [])):
        table = block["table"]
        tally = codes.key_format_tally(tables[table], table, block["column"], block["pattern"])
        found.append(_Counted("key_format", table, tally))
    for rule in _several(rules.get("implications", [])):
        tally = implication_tally(tables[rule["table"]], rule["table"], rule)
        found.append(_Counted("implications", rule["table"], tally))
    for block in _several(rules.get("price_validity", [])):
        tally = row_checks.price_validity_tally(
            tables[block["table"]],
            block["price"],
            block["currency"],
            block["sentinels"],
            block["low"],
            block["high"],
            allowed_values(rules, block["currencies"]),
        )
        found.append(_Counted("price_validity", block["table"], tally, name_table=True))
    if "atomicity" in rules:
        for table, df in tables.items():
            tally = normal_forms.atomicity_tally(df, table, rules["atomicity"]["delimiters"])
            found.append(_Counted("atomicity_counts", table, tally))
    return found


def _row_level(tables, rules, settle) -> dict[str, DataFrame]:
    found = {f"t{i}": counted for i, counted in enumerate(_tallies(tables, rules))}
    if not found:
        return {}
    named: dict[str, dict[str, Tally]] = {}
    for name, counted in found.items():
        named.setdefault(counted.table, {})[name] = counted.tally
    every = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [
            totals(tables[table], tallies).withColumn("\ttable", F.lit(table))
            for table, tallies in named.items()
        ],
    )
    if settle is not None:
        every = settle(every)

    parts: dict[str, list[DataFrame]] = {}
    for name, counted in found.items():
        rows = every.filter(F.col("`\ttable`") == counted.table).select(
            F.inline(result_rows(name, counted.tally))
        )
        if counted.name_table:
            rows = rows.select(F.lit(counted.table).alias("table"), "*")
        parts.setdefault(counted.check, []).append(rows)
    return {check: reduce(DataFrame.unionByName, rows) for check, rows in parts.items()}


def _overview(
    tables: Mapping[str, DataFrame], block: Any, digest: bool
) -> dict[str, DataFrame]:
    """``block`` is True, a list of tables, or a mapping with ``tables`` and ``approximate``."""
    options = block if isinstance(block, Mapping) else {"tables": block}
    names = options.get("tables", True)
    chosen = {name: tables[name] for name in (tables if names is True else names)}
    return {
        "table_overview": profile.profile_tables(chosen, digest=digest),
        "column_profile": profile.profile_columns(
            chosen, approximate=options.get("approximate"), digest=digest
        ),
    }


def _key_level(
    tables: Mapping[str, DataFrame], rules: Mapping[str, Any], shared: _Shared
) -> dict[str, DataFrame]:
    results: dict[str, DataFrame] = {}
    digest = bool(rules.get("digest"))
    if "overview" in rules:
        results |= _overview(tables, rules["overview"], digest)
    if "uniqueness" in rules:
        results["uniqueness"] = reduce(
            DataFrame.unionByName,
            [
                kpi.uniqueness(tables[table], fields, digest=digest).select(
                    F.lit(table).alias("table"), "*"
                )
                for table, fields in rules["uniqueness"].items()
            ],
        )
    if "pair_consistency" in rules:
        block = rules["pair_consistency"]
        order_by = block.get("order_by", ())
        same = shared.rows(block["child"], block["keys"], order_by)
        results["pair_consistency"] = pair_consistency(
            tables[block["parent"]],
            tables[block["child"]],
            block["pairs"],
            block["keys"],
            block["max_deviation"],
            order_by=order_by,
            zero_baseline=block.get("zero_baseline", "row_consistent"),
            first=same.first() if same else None,
        )
    if "referential_integrity" in rules:
        results["referential_integrity"] = linked_counts(
            shared.domains, shared.links(), key_checks.REFERENCES, "orphan_rate"
        )
    if "key_conflicts" in rules:
        block = rules["key_conflicts"]
        same = shared.rows(block["table"], block["keys"])
        results["key_conflicts"] = (
            same.conflicts()
            if same
            else key_checks.key_conflicts(tables[block["table"]], block["keys"], digest=digest)
        )
    if "missing_children" in rules:
        results["missing_children"] = linked_counts(
            shared.domains, [shared.children()], key_checks.CHILDREN, "without_child_rate"
        ).drop("table")
    return results | _diagnostics(tables, rules, digest)


def _details(
    tables: Mapping[str, DataFrame], rules: Mapping[str, Any], shared: _Shared
) -> dict[str, DataFrame]:
    results: dict[str, DataFrame] = {}
    for check in ("unit_consistency", "vocabulary_validity"):
        blocks = _several(rules.get(check, []))
        columns: dict[str, list[str]] = {}
        for block in blocks:
            columns.setdefault(block["table"], []).append(block["column"])
        values = [
            kpi.vocabulary_values(tables[t], names).select(F.lit(t).alias("table"), "*")
            for t, names in columns.items()
        ]
        invalid = [
            kpi.vocabulary_invalid(
                tables[b["table"]], b["column"], allowed_values(rules, b["allowed"])
            ).select(F.lit(b["table"]).alias("table"), "*")
            for b in blocks
        ]
        if blocks:
            results[f"{check}_values"] = reduce(DataFrame.unionByName, values)
            results[f"{check}_invalid"] = reduce(DataFrame.unionByName, invalid)
    for i, block in enumerate(_several(rules.get("price_validity", []))):
        name = "price_bad_currencies" if i == 0 else f"price_bad_currencies_{i}"
        results[name] = row_checks.price_bad_currencies(
            tables[block["table"]], block["currency"], allowed_values(rules, block["currencies"])
        )
    if "key_conflicts" in rules:
        block = rules["key_conflicts"]
        rows = shared.rows(block["table"], block["keys"]) or KeyedRows(tables[block["table"]], block["keys"])
        results["key_conflict_rows"] = rows.conflict_rows()
        results["key_conflict_columns"] = rows.conflict_columns()
    if "missing_children" in rules:
        link = shared.children()
        results["missing_children_keys"] = domain_of(shared.domains, link).unmet(link, link[1])
    if "atomicity" in rules:
        block = rules["atomicity"]
        for table, df in tables.items():
            results[f"atomicity_flags_{table}"] = normal_forms.atomicity_flags(
                df, block["delimiters"], block.get("keys", {}).get(table, ())
            )
    for block in _several(rules.get("repeated_rows", [])):
        table, order_by = block["table"], block.get("order_by", ())
        rows = shared.rows(table, block["keys"], order_by)
        results[f"repeated_rows_{table}"] = (
            rows.repeated() if rows else key_checks.repeated_rows(tables[table], block["keys"], order_by)
        )
    field_blocks: dict[str, list[Mapping[str, Any]]] = {}
    for rule in _several(rules.get("implications", [])):
        field_blocks.setdefault(rule["table"], []).append(rule)
    for table, own in field_blocks.items():
        results[f"implication_rows_{table}"] = implication_rows(tables[table], own)
    for check, rows_of in (
        (
            "check_digits",
            lambda df, b: codes.check_digit_rows(df, b["column"], b.get("length", 13), b.get("sentinels", ())),
        ),
        ("key_format", lambda df, b: codes.key_format_rows(df, b["column"], b["pattern"])),
    ):
        for block in _several(rules.get(check, [])):
            name = f"{check}_rows_{block['table']}_{block['column']}"
            results[name] = rows_of(tables[block["table"]], block)
    return results


def _diagnostics(
    tables: Mapping[str, DataFrame], rules: Mapping[str, Any], digest: bool
) -> dict[str, DataFrame]:
    """Candidate keys, decompositions and entities, with the table in front."""

    def scan(block: Mapping[str, Any]) -> DataFrame:
        return normal_forms.candidate_key_scan(
            tables[block["table"]],
            block["key_sets"],
            dedupe=block.get("dedupe", True),
            digest=digest,
        )

    def summary(block: Mapping[str, Any]) -> DataFrame:
        return normal_forms.decomposition_summary(
            tables[block["table"]], block["projections"], block.get("keys")
        )

    def entities(block: Mapping[str, Any]) -> DataFrame:
        return normal_forms.entity_counts(tables[block["table"]], block["columns"])

    results = {}
    for check, run in (
        ("candidate_key_scan", scan),
        ("decomposition_summary", summary),
        ("entity_counts", entities),
    ):
        if check in rules:
            parts = [
                run(block).select(F.lit(block["table"]).alias("table"), "*")
                for block in _several(rules[check])
            ]
            results[check] = reduce(DataFrame.unionByName, parts)
    return results


# The checks that each panel shows.
PANEL_CHECKS = {
    "scorecard": ("completeness", "uniqueness", "pair_consistency", "unit_consistency"),
    "panel_completeness": ("completeness",),
    "panel_consistency": ("pair_consistency", "unit_consistency"),
    "panel_prices": ("price_validity",),
    "panel_references": ("referential_integrity",),
    "row_count_notice": ("pair_consistency", "unit_consistency", "key_conflicts"),
}


def panel_rules(rules: Mapping[str, Any], panels: Sequence[str]) -> dict[str, Any]:
    """The rules without the checks that none of ``panels`` shows, for a run that feeds only these.

    What is no check, such as vocabularies, stays.
    """
    wanted = {check for panel in panels for check in PANEL_CHECKS[panel]}
    return {name: block for name, block in rules.items() if name in wanted or name not in CHECKS}


def report_panels(results: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The datasets behind a dashboard, from the results of :func:`run_suite`.

    Panels whose checks did not run are left out. Pass results read back after writing
    them, so that the checks behind them are not computed once more per panel.
    """
    has = results.keys().__contains__
    panels: dict[str, DataFrame] = {}
    if any(map(has, ("completeness", "uniqueness", "pair_consistency", "unit_consistency"))):
        panels["scorecard"] = report.scorecard(
            completeness=results.get("completeness"),
            uniqueness=results.get("uniqueness"),
            pair_consistency=results.get("pair_consistency"),
            unit_consistency=results.get("unit_consistency"),
        )
    if has("completeness"):
        panels["panel_completeness"] = report.panel_completeness(results["completeness"])
    if has("pair_consistency") and has("unit_consistency"):
        panels["panel_consistency"] = report.panel_consistency(
            results["pair_consistency"], results["unit_consistency"]
        )
        if has("key_conflicts"):
            panels["row_count_notice"] = report.row_count_notice(
                results["pair_consistency"], results["unit_consistency"], results["key_conflicts"]
            )
    if has("price_validity"):
        panels["panel_prices"] = report.panel_prices(results["price_validity"])
    if has("referential_integrity"):
        panels["panel_references"] = report.panel_references(results["referential_integrity"])
    return panels

"""Checks: tables and parameters in, a frame of metrics or offending rows out."""

from tablegauge.operators.checks import (
    identifier_format,
    plausible_range,
    price_bad_currencies,
    price_validity,
)
from tablegauge.operators.codes import (
    check_digit_of,
    check_digit_rows,
    check_digits,
    key_format,
    key_format_rows,
    unusual_shape_rows,
    value_shapes,
)
from tablegauge.operators.consistency import (
    dedupe_keep_first,
    first_per_key,
    pair_consistency,
    resolved_keys,
)
from tablegauge.operators.frequencies import value_frequencies
from tablegauge.operators.implications import implication_rows, implications
from tablegauge.operators.key_domains import KeyDomain, domains_of, key_domain, key_domains
from tablegauge.operators.keyed import KeyedRows
from tablegauge.operators.keys import (
    key_conflict_columns,
    key_conflict_rows,
    key_conflicts,
    key_presence,
    missing_children,
    missing_children_keys,
    referential_integrity,
    referential_integrity_rules,
    repeated_rows,
)
from tablegauge.operators.kpi import (
    TOTAL_FIELD,
    completeness,
    uniqueness,
    vocabulary,
    vocabulary_invalid,
    vocabulary_validity,
    vocabulary_values,
)
from tablegauge.operators.missing import (
    blank_count,
    blank_to_null,
    missing_count,
    missing_total,
)
from tablegauge.operators.normal_forms import (
    atomicity_counts,
    atomicity_flags,
    candidate_key_scan,
    decompose,
    decomposition_summary,
    entity_counts,
    projection,
)
from tablegauge.operators.profile import (
    column_profile,
    distinct_rows,
    duplicate_row_count,
    missing_share,
    profile_columns,
    profile_tables,
    table_overview,
)
from tablegauge.operators.sketches import (
    distinct_sketches,
    merge_sketches,
    sketch_counts,
    sketch_error,
)
from tablegauge.operators.tally import Tally, measure, measure_each, totals

__all__ = [
    "KeyDomain",
    "KeyedRows",
    "TOTAL_FIELD",
    "Tally",
    "atomicity_counts",
    "atomicity_flags",
    "blank_count",
    "blank_to_null",
    "candidate_key_scan",
    "check_digit_of",
    "check_digit_rows",
    "check_digits",
    "column_profile",
    "completeness",
    "decompose",
    "decomposition_summary",
    "dedupe_keep_first",
    "distinct_rows",
    "distinct_sketches",
    "domains_of",
    "duplicate_row_count",
    "entity_counts",
    "first_per_key",
    "identifier_format",
    "implication_rows",
    "implications",
    "key_conflict_columns",
    "key_conflict_rows",
    "key_conflicts",
    "key_domain",
    "key_domains",
    "key_format",
    "key_format_rows",
    "key_presence",
    "measure",
    "measure_each",
    "merge_sketches",
    "missing_children",
    "missing_children_keys",
    "missing_count",
    "missing_share",
    "missing_total",
    "pair_consistency",
    "plausible_range",
    "price_bad_currencies",
    "price_validity",
    "profile_columns",
    "profile_tables",
    "projection",
    "referential_integrity",
    "referential_integrity_rules",
    "repeated_rows",
    "resolved_keys",
    "sketch_counts",
    "sketch_error",
    "table_overview",
    "totals",
    "uniqueness",
    "unusual_shape_rows",
    "value_frequencies",
    "value_shapes",
    "vocabulary",
    "vocabulary_invalid",
    "vocabulary_validity",
    "vocabulary_values",
]

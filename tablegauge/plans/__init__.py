"""Suites of checks driven by rules, and the datasets a dashboard shows."""

from tablegauge.plans.report import (
    panel_completeness,
    panel_consistency,
    panel_prices,
    panel_references,
    row_count_notice,
    scorecard,
    with_level,
)
from tablegauge.plans.rules import allowed_values, article_condition, article_rules, lookup
from tablegauge.plans.suite import PANEL_CHECKS, panel_rules, report_panels, run_suite
from tablegauge.plans.verdicts import failed, run_verdicts, verdicts

__all__ = [
    "PANEL_CHECKS",
    "allowed_values",
    "article_condition",
    "article_rules",
    "failed",
    "lookup",
    "panel_completeness",
    "panel_consistency",
    "panel_prices",
    "panel_references",
    "panel_rules",
    "report_panels",
    "row_count_notice",
    "run_suite",
    "run_verdicts",
    "scorecard",
    "verdicts",
    "with_level",
]

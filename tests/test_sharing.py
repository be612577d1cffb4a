"""What checks share: scans, shuffles, and what is kept between them."""

import re

import pytest

from catalog import queries as q
from catalog.views import Inputs
from tablegauge import operators as op
from tablegauge import plans

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def executed(df):
    """The plan as it ran, with adaptive reuse of exchanges."""
    df.collect()
    return plan_of(df).split("== Initial Plan ==")[0]


@pytest.fixture
def inputs(spark):
    return Inputs(spark, SF_DIR)


RULES = {
    "pair_consistency": q.SUITE_RULES["pair_consistency"],
    "key_conflicts": q.SUITE_RULES["key_conflicts"],
    "repeated_rows": {"table": "plants", "keys": q.PLANT_KEYS, "order_by": q.PLANT_ORDER},
    "missing_children": q.SUITE_RULES["missing_children"],
    "referential_integrity": [
        {"table": "categories", "column": "article_id", "parent": "articles", "parent_column": "article_id"},
        {"table": "plants", "column": "article_id", "parent": "articles", "parent_column": "article_id"},
    ],
}


def test_the_child_is_read_once_for_all_checks_on_its_rows(inputs):
    results = plans.run_suite(q._tables(inputs), RULES, details=True)
    for name in ("pair_consistency", "key_conflicts", "key_conflict_rows", "key_conflict_columns", "repeated_rows_plants"):
        plan = plan_of(results[name])
        assert "lineitem" not in plan and "Scan ExistingRDD" in plan, name
    # References read no table at all any more: one shuffle of keys served them.
    for name in ("referential_integrity", "missing_children", "missing_children_keys"):
        assert "FileScan" not in plan_of(results[name]), name


def test_shared_results_equal_single_ones(inputs, rows):
    tables = q._tables(inputs)
    results = plans.run_suite(tables, RULES, details=True)
    alone = plans.run_suite(tables, RULES, details=True, settle=None)
    assert results.keys() == alone.keys()
    for name in results:
        assert rows(results[name]) == rows(alone[name]), name
    plants, keys = tables["plants"], q.PLANT_KEYS
    assert rows(results["key_conflicts"]) == rows(op.key_conflicts(plants, keys))
    assert rows(results["repeated_rows_plants"]) == rows(op.repeated_rows(plants, keys, q.PLANT_ORDER))
    assert rows(results["pair_consistency"]) == rows(q._pairs(inputs))


def test_another_order_is_not_shared(inputs, rows):
    rules = RULES | {"repeated_rows": {"table": "plants", "keys": q.PLANT_KEYS, "order_by": ["status"]}}
    results = plans.run_suite(q._tables(inputs), rules, details=True)
    expected = op.repeated_rows(inputs.v_plants, q.PLANT_KEYS, ["status"])
    assert rows(results["repeated_rows_plants"]) == rows(expected)


def test_nested_key_sets_roll_up(inputs):
    """Distinct rows are made once, and each set comes from the next wider one."""
    plan = executed(op.candidate_key_scan(inputs.lineitem, q.LINEITEM_SETS))
    assert plan.count("FileScan parquet") == 1
    # Rows, five sets, and one row of counts for each.
    shuffles = re.findall(r"Exchange hashpartitioning", plan)
    assert len(shuffles) - plan.count("ReusedExchange") <= 6 and "ReusedExchange" in plan


def test_only_maximal_sets_read_the_table(inputs):
    sets = [["price_id"], ["price", "currency"], ["currency"], ["price_id", "currency"], ["price"]]
    plan = executed(op.candidate_key_scan(inputs.v_prices, sets, dedupe=False))
    assert plan.count("FileScan parquet") == 2  # price_id with currency, and price with currency


def test_a_decomposition_reads_the_table_once_per_projection(inputs):
    plan = executed(op.decomposition_summary(inputs.v_categories, q.PROJECTIONS, q.PROJECTION_KEYS))
    assert plan.count("FileScan parquet") == 3


def test_panels_run_only_their_checks(inputs):
    rules = plans.panel_rules(q.SUITE_RULES, ["scorecard"])
    assert rules.keys() - {"vocabularies"} == set(plans.PANEL_CHECKS["scorecard"])
    assert plans.panel_rules(q.SUITE_RULES, ["panel_prices"]).keys() == {"vocabularies", "price_validity"}


def test_field_checks_are_in_the_row_pass(inputs):
    rules = plans.article_rules(q.FIELD_RULES) | {"overview": False}
    tables = {"articles": inputs.v_articles, "prices": inputs.v_prices}
    settled = plans.run_suite(tables, rules)
    for name in ("implications", "check_digits", "key_format", "identifier_format"):
        assert "FileScan" not in plan_of(settled[name])

"""Rules across fields, codes and shapes, thresholds, sketches, shared keys."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablegauge import operators as op
from tablegauge import plans, sources
from tablegauge.functions.conditions import columns_of, condition

ROWS = [
    (1, "frozen", "deep", 1.0, 2.0),
    (2, "frozen", "cool", 3.0, 2.0),
    (3, "frozen", None, 0.0, None),
    (4, "drink", "deep", None, 2.0),
    (5, None, "deep", float("nan"), 1.0),
    (6, " ", "", 5.0, 5.0),
]
SCHEMA = "id int, kind string, zone string, a double, b double"


@pytest.fixture
def goods(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize(
    "rule, ids",
    [
        ({"kind": "frozen"}, {1, 2, 3}),
        ({"kind": ["frozen", "drink"]}, {1, 2, 3, 4}),
        ({"kind": None}, {5, 6}),
        ({"kind": {"differs": "frozen"}}, {4}),  # a missing cell differs from nothing
        ({"not": {"kind": "frozen"}}, {4, 5, 6}),
        ({"zone": {"not_in": ["deep"]}}, {2}),
        ({"zone": {"missing": False}, "a": {"min": 1}}, {1, 2}),
        ({"a": {"above": 0, "below": 5}}, {1, 2}),
        ({"a": {"max": 0}}, {3}),
        ({"a": {"column": "b"}}, {6}),
        ({"not": {"a": {"column": "b"}}}, {1, 2, 3, 4, 5}),
        ({"zone": {"matches": "d.*p"}}, {1, 4, 5}),
        ({"or": [{"kind": "drink"}, {"and": [{"kind": "frozen"}, {"zone": "cool"}]}]}, {2, 4}),
        ({"kind": []}, set()),
        ({"id": 3}, {3}),
        ({"id": {"in": [1, 6], "min": 2}}, {6}),
    ],
)
def test_conditions(goods, rule, ids):
    assert {r.id for r in goods.where(condition(goods, rule)).collect()} == ids
    assert {r.id for r in goods.where(~condition(goods, rule)).collect()} == {r[0] for r in ROWS} - ids


def test_conditions_that_cannot_be(goods):
    for rule in ({}, {"kind": {}}, {"kind": {"like": "x"}}, {"none": 1}, {"or": []}):
        with pytest.raises(ValueError):
            condition(goods, rule)
    for rule in ({"id": "3"}, {"kind": 3}, {"kind": {"column": "id"}}, {"id": {"min": "1"}}):
        with pytest.raises(TypeError):
            condition(goods, rule)
    nested = {"not": {"or": [{"a": {"column": "b"}}, {"zone": "x"}]}, "kind": None}
    assert columns_of(nested) == ["a", "b", "zone", "kind"]


RULE = {"name": "frozen is deep", "table": "goods", "if": {"kind": "frozen"}, "then": {"zone": "deep"}}


def test_implications(goods, rows):
    found = op.implications({"goods": goods}, [RULE, {**RULE, "missing": "skip"}])
    assert rows(found) == [
        ("goods", "frozen is deep", 6, 3, 0, 1, 2, 2 / 3),
        ("goods", "frozen is deep", 6, 3, 1, 1, 1, 0.5),
    ]
    none = op.implications({"goods": goods.limit(0)}, [RULE]).first()
    assert none.total == 0 and none.violated_rate is None
    listed = op.implication_rows(goods, [RULE, {"name": "small", "table": "goods", "if": {"a": {"min": 0}}, "then": {"b": {"max": 2}}}])
    assert listed.columns == ["rule", *goods.columns]
    assert rows(listed, "rule", "id") == [("frozen is deep", 2), ("frozen is deep", 3), ("small", 3), ("small", 6)]
    with pytest.raises(ValueError):
        op.implications({"goods": goods}, [{**RULE, "missing": "maybe"}])


def test_field_rules_share_the_pass(spark, goods):
    rules = [{**RULE, "name": f"rule {i}"} for i in range(40)]
    plan = op.implications({"goods": goods}, rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LocalTableScan") + plan.count("Scan ExistingRDD") == 1


def test_german_conditions():
    rules = {"zonen": {"kalt": ["deep", "cool"]}}
    block = {"oder": [{"kind": {"ungleich": "x"}}, {"nicht": {"zone": {"in": "zonen.kalt", "fehlt": False}}}], "a": {"ueber": 1}}
    assert plans.article_condition(block, rules) == {
        "or": [{"kind": {"differs": "x"}}, {"not": {"zone": {"in": ["deep", "cool"], "missing": False}}}],
        "a": {"above": 1},
    }
    with pytest.raises(ValueError):
        plans.article_condition({"a": {"etwa": 1}}, rules)


def digit(code, length):
    body = str(code).zfill(length)[:-1]
    return -sum(int(d) * (3 if i % 2 == 0 else 1) for i, d in enumerate(reversed(body))) % 10


@pytest.mark.parametrize("length", [8, 13, 18])
def test_check_digits(spark, length):
    pick = random.Random(length)
    codes = [pick.randrange(10 ** (length - 1), 10**length) for _ in range(300)]
    codes += [c - c % 10 + digit(c, length) for c in codes[:100]]
    codes += [pick.randrange(10 ** (length - 2)) for _ in range(50)] + [0, -5, 10**length - 1]
    df = spark.createDataFrame([(str(c),) for c in codes] + [(None,), ("x1",), ("",)], "c string")
    found = op.check_digits(df, "c", length, [10**length - 1], table="t").first().asDict()
    full = [c for c in codes if 10 ** (length - 1) <= c < 10**length - 1]
    short = [c for c in codes if 0 <= c < 10 ** (length - 1)]
    wrong = [c for c in full if c % 10 != digit(c, length)]
    assert found["check_digit_invalid"] == len(wrong) and found["valid"] == len(full) - len(wrong) >= 100
    assert found["short_valid"] == sum(c % 10 == digit(c, length) for c in short)
    assert found["short_valid"] + found["short_check_digit_invalid"] == len(short)
    assert (found["sentinel"], found["missing"], found["unparseable"], found["too_long"]) == (1, 1, 3, 0)
    kinds = [k for k in found if k not in ("table", "column", "total", "check_digit_invalid_rate")]
    assert sum(found[k] for k in kinds) == found["total"] == df.count()
    listed = op.check_digit_rows(df, "c", length, [10**length - 1])
    assert Counter((int(r.c), r.expected_digit) for r in listed.collect()) == Counter((c, digit(c, length)) for c in wrong)


def test_known_codes(spark):
    df = spark.createDataFrame([(4006381333931,), (4006381333932,), (73513537,)], "c long")
    found = op.check_digits(df, "c").first()
    assert (found.valid, found.check_digit_invalid, found.short_valid) == (1, 1, 1)


def test_formats_and_shapes(spark, rows):
    values = ["A0001", "A0002", "A99999", "AAAAA", "a0003", " ", None, "Ü1 x", "A0001\n"]
    df = spark.createDataFrame([(v,) for v in values], "k string")
    # "A0001" with a line end matches to its end, as patterns do.
    assert rows(op.key_format(df, "k", r"A\d{4}", table="t")) == [("t", "k", r"A\d{4}", 9, 2, 3, 4, 3 / 7)]
    shapes = {r.shape: (r.rows, r.example) for r in op.value_shapes(df, ["k"]).collect()}
    assert shapes["A9999"] == (2, "A0001") and shapes["A9 a"] == (1, "Ü1 x") and shapes["AAAAA"] == (1, "AAAAA")
    runs = {r.shape for r in op.value_shapes(df, ["k"], runs=True).collect()}
    assert runs == {"A9+", "A+", "a9+", "A9 a", "A9+ "}
    assert rows(op.unusual_shape_rows(df, "k", 0.2), "k") == [("A0001\n",), ("A99999",), ("AAAAA",), ("a0003",), ("Ü1 x",)]
    assert op.value_shapes(df.limit(0), ["k"]).collect() == []
    assert op.unusual_shape_rows(df.limit(0), "k", 0.2).collect() == []


def test_verdicts(spark, rows):
    metrics = spark.createDataFrame(
        [
            ("completeness", "t", "a", "completeness", 0.99),
            ("completeness", "t", "b", "completeness", 0.9),
            ("completeness", "t", "b", "missing", 5.0),
            ("uniqueness", None, "a", "uniqueness", None),
        ],
        "check string, table string, field string, metric string, value double",
    )
    found = plans.verdicts(
        metrics,
        [
            {"check": "completeness", "metric": "completeness", "min": 0.95},
            {"check": "completeness", "metric": "missing", "field": "b", "max": 5},
            {"check": "uniqueness", "metric": "uniqueness", "min": 0.5, "max": 1},
            {"check": "uniqueness", "metric": "uniqueness", "table": "t", "min": 0.5},
        ],
    )
    assert rows(found, "field", "metric", "minimum", "maximum", "passed") == [
        ("a", "completeness", 0.95, None, True),
        ("a", "uniqueness", 0.5, 1.0, None),
        ("b", "completeness", 0.95, None, False),
        ("b", "missing", None, 5.0, True),
    ]
    assert rows(plans.failed(found), "field") == [("b",)]
    assert rows(plans.run_verdicts(found, ["check"])) == [("completeness", 2, 1, 0, False), ("uniqueness", 0, 0, 1, True)]
    for bad in ([], [{"check": "x", "metric": "y"}], [{"metric": "y", "min": 1}]):
        with pytest.raises(ValueError):
            plans.verdicts(metrics, bad)


def test_thresholds_in_a_suite(goods, rows):
    rules = {"completeness": {"goods": ["id", "zone"]}, "thresholds": [{"check": "completeness", "metric": "completeness", "min": 0.9}]}
    found = plans.run_suite({"goods": goods}, rules)["verdicts"]
    assert rows(found, "field", "passed") == [("_gesamt", False), ("id", True), ("zone", False)]


def test_sketches_merge(spark):
    df = spark.range(20_000).selectExpr("id % 7000 AS n", "concat('v', id % 300) AS s", "CAST(NULL AS DOUBLE) AS none", "id * 0.5D AS d")
    whole = {r.column: r for r in op.sketch_counts(op.distinct_sketches(df)).collect()}
    parts = [op.distinct_sketches(df.where(F.col("n") % 3 == i)) for i in range(3)]
    merged = {r.column: r for r in op.sketch_counts(op.merge_sketches(parts[0].union(parts[1]).union(parts[2]))).collect()}
    for name, exact in (("n", 7000), ("s", 300), ("none", 0), ("d", 20_000)):
        for found in (whole[name], merged[name]):
            assert found.rows == 20_000 and abs(found.distinct - exact) <= exact * op.sketch_error()
    assert whole["none"].present == 0
    assert op.sketch_error(16) < op.sketch_error(12) < op.sketch_error(8)


def test_domains_of_links():
    links = [("c", "x", "p", "k"), ("d", "y", "q", "k"), ("e", "z", "p", "k"), ("q", "k", "p", "k")]
    assert op.domains_of(links) == [[("c", "x"), ("p", "k"), ("e", "z"), ("d", "y"), ("q", "k")]]
    assert op.domains_of(links[:3]) == [[("c", "x"), ("p", "k"), ("e", "z")], [("d", "y"), ("q", "k")]]


def test_many_rules_are_one_shuffle_of_keys(spark):
    tables = {"p": spark.range(1, 101).withColumnRenamed("id", "k")}
    tables |= {f"c{i}": spark.range(i, 101 + i).selectExpr("CAST(id AS INT) AS x", "id + 500 AS y") for i in range(5)}
    rules = [(f"c{i}", "x", "p", "k") for i in range(5)] + [("c0", "y", "p", "k"), ("p", "k", "c4", "x")]
    found = op.referential_integrity_rules(tables, rules)
    plan = found._jdf.queryExecution().executedPlan().toString()
    expected = []
    for child, column, parent, parent_column in rules:
        ours = {r[0] for r in tables[child].select(column).collect()}
        theirs = {r[0] for r in tables[parent].select(parent_column).collect()}
        expected.append((child, len(ours), len(ours & theirs), len(ours - theirs), len(ours - theirs) / len(ours)))
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert plan.count("Exchange hashpartitioning(key") == 1 and plan.count("Range (") == 6
    assert "Join" not in plan


def test_more_columns_than_a_mask_holds(spark):
    tables = {"p": spark.range(10)} | {f"c{i}": spark.range(i % 13, i % 13 + 2) for i in range(70)}
    rules = [(f"c{i}", "id", "p", "id") for i in range(70)]
    found = {r.table: r.orphaned for r in op.referential_integrity_rules(tables, rules).collect()}
    assert found == {f"c{i}": max(0, i % 13 + 2 - max(10, i % 13)) for i in range(70)}


KEYED = [(1, 1, "a", 1.0), (1, 1, "a", 1.0), (1, 1, "b", None), (2, 1, None, 2.0), (None, 1, "x", 1.0), (None, 1, "y", 1.0), (3, 1, "z", 0.0)]


@pytest.mark.parametrize("order_by", [(), ("d",), ("c", "d"), "column"])
@pytest.mark.parametrize("settled", [False, True])
def test_shared_rows_equal_the_single_checks(spark, rows, order_by, settled):
    order_by = (F.col("d").desc(),) if order_by == "column" else order_by
    df = spark.createDataFrame(KEYED, "k int, n int, c string, d double")
    keys = ["k", "n"]
    shared = op.KeyedRows(df, keys, order_by, sources.settle if settled else None)
    assert rows(shared.conflicts()) == rows(op.key_conflicts(df, keys))
    assert rows(shared.conflict_rows()) == rows(op.key_conflict_rows(df, keys))
    assert rows(shared.conflict_columns()) == rows(op.key_conflict_columns(df, keys))
    assert rows(shared.repeated()) == rows(op.repeated_rows(df, keys, order_by))
    assert rows(shared.first()) == rows(op.dedupe_keep_first(df, keys, order_by))
    only_keys = op.KeyedRows(df.select("k"), ["k"])
    assert rows(only_keys.first()) == [(1,), (2,), (3,), (None,)] and only_keys.repeated().collect() == []
    assert rows(op.KeyedRows(df.limit(0), keys).conflicts()) == [(0, 0, 0, 0)]

"""What the plans must and must not contain, whatever the data."""

import re

import pytest

from catalog.queries import queries
from catalog.views import Inputs
from tablegauge import operators as op

SF_DIR = "/root/testdata/sf0.001"
QUERIES = queries()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"\bExchange (?:hash|single|range)", plan_of(df), re.IGNORECASE))


@pytest.fixture
def no_broadcast(spark):
    """Joins as they are planned when no side is known to be small."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loops_and_no_python_in_tasks(spark, no_broadcast, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    for node in ("CartesianProduct", "NestedLoopJoin", "BroadcastExchange", "EvalPython"):
        assert node not in plan
    assert not re.search(r"(Map|FlatMapGroups|Aggregate|Window)InPandas", plan)


def test_row_checks_read_only_their_columns(spark):
    t = Inputs(spark, SF_DIR)
    plan = plan_of(op.completeness(t.orders, ["o_totalprice"]))
    assert re.search(r"ReadSchema: struct<o_totalprice:double>", plan)
    assert exchanges(op.completeness(t.orders, ["o_totalprice"])) == 1


def test_key_presence_is_one_shuffle_of_keys(spark, no_broadcast):
    t = Inputs(spark, SF_DIR)
    found = op.missing_children(t.orders, t.lineitem, "o_orderkey", "l_orderkey")
    assert exchanges(found) == 2  # keys, then one row of counts per task
    assert "Join" not in plan_of(found)
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint>", plan_of(found))
    assert "PushedFilters: [IsNotNull(l_orderkey)]" in plan_of(found)


def test_first_rows_are_picked_before_the_shuffle(spark):
    t = Inputs(spark, SF_DIR)
    plan = plan_of(op.first_per_key(t.lineitem, ["l_orderkey"], ["l_shipdate"]))
    before, after = plan.split("Exchange hashpartitioning")
    assert "WindowGroupLimit" in before and "WindowGroupLimit" in after


def test_conflicts_shuffle_rows_once_and_keys_once(spark):
    t = Inputs(spark, SF_DIR)
    keys = ["l_orderkey", "l_linenumber"]
    assert exchanges(op.key_conflicts(t.lineitem, keys)) == 3
    narrow = plan_of(op.key_conflicts(t.lineitem, keys, digest=True))
    assert len(re.findall(r"Exchange hashpartitioning\(([^)]*)\)", narrow)[-1].split(",")) == 4


def test_pairs_read_measures_and_order_only(spark):
    t = Inputs(spark, SF_DIR)
    child = t.lineitem.select("l_partkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    found = op.pair_consistency(
        t.part.selectExpr("p_partkey AS k", "p_retailprice AS a"),
        child.withColumnRenamed("l_partkey", "k"),
        [("a", "l_extendedprice")],
        ["k", "l_linenumber"],
        0.1,
        order_by=["l_shipdate"],
    )
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(found))
    assert {c.split(":")[0] for c in ",".join(scans).split(",")} == {
        "p_partkey",
        "p_retailprice",
        "l_partkey",
        "l_linenumber",
        "l_extendedprice",
        "l_shipdate",
    }


def test_distinct_values_of_one_type_share_a_scan(spark):
    t = Inputs(spark, SF_DIR)
    plan = plan_of(op.column_profile(t.lineitem))
    assert plan.count("FileScan parquet") == 4  # bigint, double, string, timestamp
    assert "cast(l_quantity" not in plan


def test_any_number_of_counters_is_one_scan(spark):
    t = Inputs(spark, SF_DIR)
    names = t.lineitem.columns
    wide = t.lineitem.selectExpr(*[f"{n} AS {n}_{i}" for i in range(7) for n in names])
    found = op.completeness(wide, wide.columns)
    assert len(wide.columns) > 70
    assert plan_of(found).count("FileScan parquet") == 1 and exchanges(found) == 1


@pytest.mark.parametrize("copies", [2, 7])
def test_counters_are_compiled(spark, copies):
    """Spark compiles the aggregate over rows, and the JVM its methods (up to 8,000 bytes each)."""
    t = Inputs(spark, SF_DIR)
    wide = t.lineitem.selectExpr(*[f"{n} AS {n}_{i}" for i in range(copies) for n in t.lineitem.columns])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        execution = op.completeness(wide, wide.columns)._jdf.queryExecution()
        assert re.search(r"\*\(\d+\) HashAggregate\(keys=\[\], functions=\[partial_count", execution.executedPlan().toString())
        generated = execution.debug().codegenToSeq()
        parts = [generated.apply(i) for i in range(generated.size())]
        sizes = [p._3().maxMethodCodeSize() for p in parts if "Exchange" not in p._1()]
        assert sizes and 0 < max(sizes) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_candidate_keys_expand_no_rows(spark):
    t = Inputs(spark, SF_DIR)
    sets = [["l_orderkey"], ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber", "l_partkey"]]
    assert "Expand" not in plan_of(op.candidate_key_scan(t.lineitem, sets))


def test_conflicts_shuffle_whole_rows_twice(spark, no_broadcast):
    t = Inputs(spark, SF_DIR)
    keys = ["l_orderkey", "l_linenumber"]
    for found in (op.key_conflict_rows(t.lineitem, keys), op.key_conflict_columns(t.lineitem, keys)):
        # The keyed aggregate, its keys, rows by key, rows to drop copies.
        assert exchanges(found) == 4
    plan = plan_of(op.key_conflict_columns(t.lineitem, keys))
    assert plan.count("PushedFilters: [IsNotNull(l_orderkey), IsNotNull(l_linenumber)]") == 2


def test_a_hot_conflicting_key_is_split(spark, no_broadcast):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(40_000, numPartitions=8).selectExpr("IF(id % 2 = 0, 7, id % 5000) AS k", "id AS v")
        for find in (op.key_conflict_rows, op.key_conflict_columns):
            found = find(df, ["k"])
            assert len(found.collect()) == 40_000
            assert "skew=true" in plan_of(found)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

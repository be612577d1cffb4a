import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tablegauge import operators as op

SCHEMA = "k string, n int, a string, b double"


@pytest.fixture
def table(spark):
    return spark.createDataFrame(
        [
            ("x", 1, "one", 1.0),
            ("x", 1, "one", 1.0),
            ("x", 1, "two", 1.0),
            ("x", 1, None, 1.0),
            ("y", 1, "one", math.nan),
            ("y", 1, "one", None),
            ("z", 2, None, 3.0),
            ("z", 2, "only", 3.0),
            (None, 1, "p", 1.0),
            (None, 1, "q", 2.0),
            ("single", 1, "s", 1.0),
        ],
        SCHEMA,
    )


def test_conflicts(table, rows):
    expected = [(11, 2, 4, 5)]
    assert rows(op.key_conflicts(table, ["k", "n"])) == expected
    assert rows(op.key_conflicts(table, ["k", "n"], digest=True)) == expected
    assert rows(op.key_conflicts(table.limit(0), ["k"])) == [(0, 0, 0, 0)]


def test_conflict_details(table, rows):
    keys = ["k", "n"]
    assert rows(op.key_conflict_rows(table, keys)) == sorted(
        [
            ("x", 1, "one", 1.0),
            ("x", 1, "two", 1.0),
            ("x", 1, None, 1.0),
            ("z", 2, None, 3.0),
            ("z", 2, "only", 3.0),
            (None, 1, "p", 1.0),
            (None, 1, "q", 2.0),
        ],
        key=lambda r: tuple(map(repr, r)),
    )
    assert rows(op.key_conflict_columns(table, keys)) == sorted(
        [
            ("x", 1, "a", "one", None),
            ("x", 1, "a", "two", None),
            ("x", 1, "a", None, None),
            ("z", 2, "", None, None),  # differs only in being null
            ("z", 2, "", None, None),
        ],
        key=lambda r: tuple(map(repr, r)),
    )
    assert rows(op.repeated_rows(table, keys, ["a"])) == sorted(
        [
            ("x", 1, "one", 1.0),
            ("x", 1, "two", 1.0),
            ("z", 2, "only", 3.0),
            (None, 1, "q", 2.0),
        ],
        key=lambda r: tuple(map(repr, r)),
    )


def test_keys_only_table(spark, rows):
    df = spark.createDataFrame([("x",), ("x",), ("y",)], "k string")
    assert rows(op.key_conflicts(df, ["k"])) == [(3, 1, 0, 2)]
    assert rows(op.key_conflict_rows(df, ["k"])) == []
    assert rows(op.key_conflict_columns(df, ["k"])) == []
    assert rows(op.repeated_rows(df, ["k"])) == []


def test_map_columns_compare_by_content(spark, rows):
    df = spark.sql(
        "SELECT * FROM VALUES (1, map('a', 1, 'b', 2)), (1, map('b', 2, 'a', 1)), "
        "(2, map('a', 1)), (2, map('a', 2)) AS t(k, m)"
    )
    assert rows(op.key_conflicts(df, ["k"])) == [(4, 1, 1, 2)]
    assert [(r.k, r.m) for r in op.key_conflict_rows(df, ["k"]).orderBy("m.a").collect()] == [
        (2, {"a": 1}),
        (2, {"a": 2}),
    ]


def test_references(spark, rows):
    child = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("c",)], "k string")
    parent = spark.createDataFrame([("a",), ("a",), (None,), ("z",)], "id string")
    assert rows(op.referential_integrity(child, parent, "k", "id")) == [(3, 1, 2, 2 / 3)]
    assert rows(op.referential_integrity(child.limit(0), parent, "k", "id")) == [(0, 0, 0, None)]
    assert rows(op.missing_children(parent, child, "id", "k")) == [(2, 1, 1, 0.5)]
    assert rows(op.missing_children_keys(parent, child, "id", "k")) == [("z",)]
    assert rows(
        op.referential_integrity_rules({"c": child, "p": parent}, [("c", "k", "p", "id")])
    ) == [("c", 3, 1, 2, 2 / 3)]


def test_key_types_must_agree(spark):
    texts = spark.createDataFrame([("1",)], "k string")
    longs = spark.createDataFrame([(1,)], "k long")
    ints = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(TypeError):
        op.referential_integrity(texts, longs, "k", "k")
    assert op.referential_integrity(ints, longs, "k", "k").first().referenced == 1


def test_candidate_keys(spark, rows):
    df = spark.createDataFrame(
        [(1, "a", None), (1, "a", None), (1, "b", None), (2, "a", "x"), (None, "a", "x")],
        "`n r` int, b string, c string",
    )
    sets = [["n r"], ["b", "n r"], ["n r", "b"], ["c"]]
    assert rows(op.candidate_key_scan(df, sets)) == [
        ("b, n r", 4, 4, 0),
        ("c", 4, 2, 2),
        ("n r", 4, 3, 1),
        ("n r, b", 4, 4, 0),
    ]
    assert rows(op.candidate_key_scan(df, sets, digest=True)) == rows(
        op.candidate_key_scan(df, sets)
    )
    assert ("n r", 5, 3, 2) in rows(op.candidate_key_scan(df, sets, dedupe=False))
    assert rows(op.candidate_key_scan(df.limit(0), [["c"]])) == [("c", 0, 0, 0)]


def test_decomposition(spark, rows):
    df = spark.createDataFrame(
        [(1, "a", "s"), (1, "a", "t"), (1, "b", "s"), (None, "a", "s")], "id int, c string, s string"
    )
    parts = op.decompose(df, {"ic": ["id", "c"], "is": ["id", "s"]})
    assert rows(parts["ic"]) == [(1, "a"), (1, "b"), (None, "a")]
    summary = op.decomposition_summary(
        df, {"ic": ["id", "c"], "is": ["id", "s"]}, {"ic": ["id"]}
    )
    assert rows(summary) == [("ic", 3, 2, 1), ("is", 3, 3, 0)]
    # A projection is always free of exact duplicates.
    assert rows(op.duplicate_row_count(parts["is"]))[0][2] == 0


def test_atomicity(spark, rows):
    df = spark.createDataFrame(
        [(1, "a,b", "x(y", 1.0), (2, "plain", None, 2.0), (3, "|", "[", 3.0)],
        "id int, `t 1` string, u string, n double",
    )
    assert rows(op.atomicity_flags(df, [",", "(", "|"], ["id"])) == [
        (1, "t 1", "a,b"),
        (1, "u", "x(y"),
        (3, "t 1", "|"),
    ]
    assert rows(op.atomicity_flags(df, [","], ["t 1"])) == [("a,b", "t 1", "a,b")]
    assert rows(op.atomicity_flags(df.select("id"), [","], ["id"])) == []
    assert rows(op.atomicity_counts({"t": df, "n": df.select("n")}, ["("])) == [
        ("n", 0, 0),
        ("t", 2, 1),
    ]
    for bad in ([], [""]):
        with pytest.raises(ValueError):
            op.atomicity_flags(df, bad, ["id"])


ROW = st.tuples(
    st.sampled_from(["h", "h", "h", "i", None]),
    st.sampled_from([1, 2, None]),
    st.sampled_from(["p", "q", "", None]),
    st.sampled_from([0.0, 1.0, math.nan, None]),
)


@settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(ROW, max_size=25))
def test_against_brute_force(spark, data):
    keys = ["k", "n"]
    table = [
        tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in data
    ]
    counts = Counter(table)
    by_key = defaultdict(list)
    for r in counts:
        by_key[r[:2]].append(r)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)

    c = op.key_conflicts(df, keys).first()
    assert tuple(c) == (len(table), len(table) - len(counts), len(counts) - len(by_key), len(by_key))
    conflicting = [r for group in by_key.values() if len(group) > 1 for r in group]
    assert Counter(map(tuple, op.key_conflict_rows(df, keys).collect())) == Counter(conflicting)

    def order(r):
        return tuple((v is not None, v) for v in r)

    later = [r for g in by_key.values() for r in sorted(g, key=lambda r: order(r[2:]))[1:]]
    assert Counter(map(tuple, op.repeated_rows(df, keys).collect())) == Counter(later)
    first = [min(g, key=lambda r: order(r[2:])) for g in by_key.values()]
    found = [
        tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r)
        for r in op.dedupe_keep_first(df, keys).collect()
    ]
    assert Counter(found) == Counter(first)

    named = {}
    for key, group in by_key.items():
        if len(group) > 1 and None not in key:
            cells = {n: {r[i] for r in group} - {None} for i, n in ((2, "a"), (3, "b"))}
            named[key] = ", ".join(n for n, values in cells.items() if len(values) > 1)
    got = {(r.k, r.n): r.conflict_in for r in op.key_conflict_columns(df, keys).collect()}
    assert got == named

    u = {r.field: r for r in op.uniqueness(df, ["a", "b"]).collect()}
    for i, n in ((2, "a"), (3, "b")):
        present = [r[i] for r in table if r[i] not in (None, "")]
        assert (u[n].total, u[n].distinct) == (len(table), len(set(present)))
        assert u[n].missing + u[n].distinct + u[n].duplicates == u[n].total


def test_numeric_keys_of_different_kinds(spark, rows):
    left = spark.createDataFrame([(1,), (2,), (9007199254740993,), (None,)], "k bigint")
    right = spark.createDataFrame([(1.0,), (2.5,), (9007199254740992.0,), (float("nan"),)], "k double")
    assert rows(op.referential_integrity(left, right, "k", "k")) == [(3, 1, 2, 2 / 3)]
    assert rows(op.missing_children_keys(left, right, "k")) == [(2,), (9007199254740993,)]
    decimals = left.selectExpr("CAST(k AS DECIMAL(20, 2)) AS k")
    assert rows(op.referential_integrity(decimals, right, "k", "k")) == [(3, 1, 2, 2 / 3)]
    parent = spark.createDataFrame([(1.0, 5.0)], "k double, a double")
    child = spark.createDataFrame([(1, 5.0)], "k bigint, b double")
    assert op.pair_consistency(parent, child, [("a", "b")], ["k"], 0.1).first().consistent == 1
    with pytest.raises(TypeError):
        op.referential_integrity(left, spark.createDataFrame([("1",)], "k string"), "k", "k")


def test_pairs_use_the_rows_that_dedupe_keeps(spark, rows):
    parent = spark.createDataFrame([(1, 10.0), (2, 10.0)], "k int, a double")
    child = spark.createDataFrame(
        [(1, "z", 10.0), (1, "a", 99.0), (2, None, 99.0), (2, "b", 10.0)], "k int, other string, b double"
    )
    for order in ((), ["other"], ["b"], [F.lit(1)], [F.desc("b")]):
        kept = op.dedupe_keep_first(child, ["k"], order)
        a = rows(op.pair_consistency(parent, child, [("a", "b")], ["k"], 0.1, order_by=order))
        assert a == rows(op.pair_consistency(parent, kept, [("a", "b")], ["k"], 0.1))
    assert op.pair_consistency(parent, child, [("a", "b")], ["k"], 0.1).first().inconsistent == 2


def test_projections_compare_like_their_summary(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, None), (2, 0.0), (2, -0.0)], "a int, b double")
    assert op.decompose(df, {"p": ["a", "b"]})["p"].count() == 2
    assert op.decomposition_summary(df, {"p": ["a", "b"]}).first()["rows"] == 2
    maps = spark.sql("SELECT map('x', 1, 'y', 2) AS m UNION ALL SELECT map('y', 2, 'x', 1)")
    (row,) = op.decompose(maps, {"p": ["m"]})["p"].collect()
    assert row.m == {"x": 1, "y": 2}


def test_any_number_of_columns_can_be_keys(spark):
    names = [f"c{i}" for i in range(70)]
    df = spark.range(3).selectExpr(*[f"id % {i % 3 + 1} AS {n}" for i, n in enumerate(names)])
    found = {r.key_columns: (r["rows"], r.distinct_keys) for r in op.candidate_key_scan(df, [names, names[:1]]).collect()}
    assert found == {", ".join(names): (3, 3), "c0": (3, 1)}

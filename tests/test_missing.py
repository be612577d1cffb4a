import math

import pytest
from pyspark.sql import functions as F

from tablegauge import operators as op
from tablegauge.functions import WHITESPACE, null_tokens_to_null, rate, traffic_light

NAN = math.nan
MISSING_TEXTS = [None, "", " ", "\t", "\n", " \r\n ", "\u00a0", "\u3000", "\x1c", "\x1f "]
PRESENT_TEXTS = ["\u200b", "x", " x ", "\u3000x", "0", "null"]


def test_white_space_is_that_of_python():
    assert all(c.isspace() for c in WHITESPACE)
    assert {"\t", "\n", "\x1c", "\x85", " ", "\u00a0", "\u2003", "\u3000"} <= set(WHITESPACE)
    assert "\u200b" not in WHITESPACE


@pytest.fixture
def table(spark):
    texts = MISSING_TEXTS + PRESENT_TEXTS
    numbers = [NAN, None, 0.0, 1.5] * 4
    return spark.createDataFrame(
        list(zip(texts, numbers, range(len(texts)))), "text string, `a.b number` double, `ä` int"
    )


def test_blank_and_missing_counts(table, rows):
    assert rows(op.blank_count(table)) == [("a.b number", 0), ("text", 9), ("ä", 0)]
    assert rows(op.missing_count(table)) == [("a.b number", 8), ("text", 10), ("ä", 0)]
    assert rows(op.missing_total(table)) == [(18,)]
    assert rows(op.missing_count(table, ["text"])) == [("text", 10)]


def test_blank_to_null_leaves_the_rest_alone(table):
    before = {r["ä"]: r for r in table.collect()}
    for r in op.blank_to_null(table).collect():
        old = before[r["ä"]]
        assert r["text"] == (None if old["ä"] < len(MISSING_TEXTS) else old["text"])
        assert repr(r["a.b number"]) == repr(old["a.b number"])


def test_completeness_counts_every_kind(table, rows):
    found = rows(op.completeness(table, ["text", "a.b number"]))
    assert found == [
        ("_gesamt", 18, 1 - 18 / 32),
        ("a.b number", 8, 0.5),
        ("text", 10, 1 - 10 / 16),
    ]


def test_uniqueness_and_profile_agree_with_sets(table, rows):
    assert rows(op.uniqueness(table, ["text", "a.b number", "ä"])) == [
        ("a.b number", 16, 8, 2, 6, 2 / 16),
        ("text", 16, 10, 6, 0, 6 / 16),
        ("ä", 16, 0, 16, 0, 1.0),
    ]
    assert rows(op.column_profile(table)) == [
        ("a.b number", "double", 8, 50.0, 2, 12.5),
        ("text", "string", 10, 62.5, 6, 37.5),
        ("ä", "int", 0, 0.0, 16, 100.0),
    ]
    assert rows(op.column_profile(table, digest=True)) == rows(op.column_profile(table))
    assert rows(op.column_profile(table, approximate=0.01)) == rows(op.column_profile(table))


def test_entities_keep_blanks_as_values(table, rows):
    assert rows(op.entity_counts(table, ["text"])) == [("text", 16, 15)]


def test_empty_table_gives_zeros_and_null_rates(spark, table, rows):
    empty = table.limit(0)
    assert rows(op.completeness(empty, ["text"])) == [("_gesamt", 0, None), ("text", 0, None)]
    assert rows(op.uniqueness(empty, ["text", "ä"])) == [
        ("text", 0, 0, 0, 0, None),
        ("ä", 0, 0, 0, 0, None),
    ]
    assert ("duplicate_rows", 0, None) in rows(op.table_overview(empty))
    assert ("columns", 3, None) in rows(op.table_overview(empty))
    assert rows(op.missing_share(empty)) == [(0, 3, 0, None, 0)]
    assert rows(op.duplicate_row_count(empty)) == [(0, 0, 0)]
    assert rows(op.column_profile(empty, ["ä"])) == [("ä", "int", 0, None, 0, None)]


def test_missing_column_is_named(table):
    with pytest.raises(ValueError, match="nope"):
        op.completeness(table, ["nope"])
    with pytest.raises(ValueError):
        op.completeness(table, [])


def test_null_tokens(spark, rows):
    df = spark.createDataFrame([("NA", 1), ("N/A", 2), ("na", 3), (None, 4)], "a string, b int")
    assert rows(null_tokens_to_null(df)) == [("na", 3), (None, 1), (None, 2), (None, 4)]


def test_rates_and_levels(spark):
    values = [1.0, 0.999, 0.98, 0.97, 0.95, 0.90, 0.8999, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(traffic_light(F.col("v"))).collect()] == [
        "dark_green",
        "light_green",
        "light_green",
        "yellow",
        "yellow",
        "orange",
        "red",
        None,
    ]
    one = spark.range(1)
    assert one.select(rate(F.lit(1), F.lit(0))).first()[0] is None
    assert one.select(rate(F.lit(1), F.lit(4))).first()[0] == 0.25


def test_overview_counts_duplicates_null_to_null(spark, rows):
    df = spark.createDataFrame(
        [(None, NAN), (None, None), ("", 1.0), ("", 1.0), ("", 1.0), ("x", 0.0), ("x", -0.0)],
        "a string, b double",
    )
    expected = [
        ("blank_cells", 3, 3 / 14 * 100),
        ("columns", 2, None),
        ("duplicate_rows", 4, 4 / 7 * 100),
        ("null_cells", 4, 4 / 14 * 100),
        ("rows", 7, None),
    ]
    assert rows(op.table_overview(df)) == expected
    assert rows(op.table_overview(df, digest=True)) == expected
    assert rows(op.missing_share(df)) == [(7, 2, 7, 50.0, 4)]
    assert rows(op.duplicate_row_count(df)) == [(7, 3, 4)]
    assert rows(op.duplicate_row_count(df, digest=True)) == [(7, 3, 4)]
    assert rows(op.profile_tables({"t": df})) == [("t", *r) for r in expected]


def test_many_types_are_counted_in_their_own_way(spark, rows):
    df = spark.sql(
        """SELECT * FROM VALUES
        (1Y, 1.0F, 1.10BD, true, DATE'2024-01-01', TIMESTAMP'2024-01-01 00:00:00.000001',
         TIMESTAMP_NTZ'2024-01-01 00:00:00', X'00', array('a, b'), map('k', 1, 'j', 2),
         named_struct('x', 1)),
        (1Y, float('nan'), 1.10BD, true, DATE'2024-01-01', TIMESTAMP'2024-01-01 00:00:00.000002',
         TIMESTAMP_NTZ'2024-01-01 00:00:00', X'01', array('a', 'b'), map('j', 2, 'k', 1),
         named_struct('x', 2)),
        (2Y, null, 1.20BD, null, DATE'2024-01-02', TIMESTAMP'2024-01-01 00:00:00.000002',
         TIMESTAMP_NTZ'2024-01-02 00:00:00', X'01', array('a', 'b'), null, null)
        AS t(tiny, single, exact, flag, day, instant, local, raw, list, pairs, record)"""
    )
    found = {r["column"]: (r["missing"], r["distinct"]) for r in op.column_profile(df).collect()}
    assert found == {
        "tiny": (0, 2),
        "single": (2, 1),
        "exact": (0, 2),
        "flag": (1, 1),
        "day": (0, 2),
        "instant": (0, 2),
        "local": (0, 2),
        "raw": (0, 2),
        "list": (0, 2),
        "pairs": (1, 1),
        "record": (1, 2),
    }
    assert rows(op.duplicate_row_count(df.drop("instant"))) == [(3, 3, 0)]
    same = df.select("pairs").filter("pairs is not null")
    assert rows(op.duplicate_row_count(same)) == [(2, 1, 1)]
    assert rows(op.duplicate_row_count(same, digest=True)) == [(2, 1, 1)]


def test_long_texts_count_the_same_by_digest(spark, rows):
    texts = ["a" * 64, "a" * 65, "a" * 65, "b" * 5000, "b" * 5000 + "c", "sha2:" + "0" * 64]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows(op.uniqueness(df, ["t"])) == [("t", 6, 0, 5, 1, 5 / 6)]
    assert rows(op.uniqueness(df, ["t"], digest=True)) == [("t", 6, 0, 5, 1, 5 / 6)]


def test_many_counters_take_several_passes(spark, rows):
    wide = spark.range(10).selectExpr(
        "id", *[f"nullif(id, {i % 10}) AS `c.{i}`" for i in range(70)]
    )
    names = [f"c.{i}" for i in range(70)]
    found = {r.field: r.missing for r in op.completeness(wide, names).collect()}
    assert found == {n: 1 for n in names} | {"_gesamt": 70}
    assert rows(op.missing_total(wide.limit(0))) == [(0,)]


NESTED = """
SELECT named_struct('t', timestamp_micros(1), 'd', 0.0D, 'm', map('a', 1, 'b', 2), 'l', array(1.5D)) AS s
UNION ALL SELECT named_struct('t', timestamp_micros(2), 'd', 0.0D, 'm', map('a', 1, 'b', 2), 'l', array(1.5D))
UNION ALL SELECT named_struct('t', timestamp_micros(1), 'd', -0.0D, 'm', map('b', 2, 'a', 1), 'l', array(1.5D))
UNION ALL SELECT named_struct('t', timestamp_micros(1), 'd', NULL, 'm', map('b', 2, 'a', 1), 'l', array(1.5D))
UNION ALL SELECT NULL
"""


def test_nested_values_are_compared_exactly(spark):
    df = spark.sql(NESTED)
    for digest in (False, True):
        assert op.column_profile(df, digest=digest).first()["distinct"] == 3
        assert op.uniqueness(df, ["s"], digest=digest).first()["distinct"] == 3
        assert op.duplicate_row_count(df, digest=digest).first().duplicate_rows == 1
        assert op.candidate_key_scan(df, [["s"]], digest=digest).first().distinct_keys == 4
    assert op.entity_counts(df, ["s"]).first().entities == 3

import math

import pytest

from tablegauge import operators as op

NAN = math.nan
PAIRS = [("p1", "c1"), ("p2", "c2")]


def pair_result(df):
    r = df.first()
    return (r.pairs, r.excluded, r.comparable, r.consistent, r.inconsistent, r.accounting_ok)


@pytest.fixture
def frames(spark):
    parent = spark.createDataFrame(
        [
            ("limit", 10.0, 1.0),  # 10 against 11 is exactly the limit
            ("above", 0.3, 1.0),  # 0.3 against 0.33 is just above it in floating point
            ("zero", 0.0, 1.0),  # base 0, the other pair deviates
            ("negative", -10.0, 1.0),  # never inconsistent
            ("nan", NAN, 1.0),
            ("null", None, 1.0),
            ("twice", 1.0, 1.0),
            ("twice", 2.0, 1.0),
            (None, 1.0, 1.0),
            ("alone", 1.0, 1.0),
        ],
        "k string, p1 double, p2 double",
    )
    child = spark.createDataFrame(
        [
            ("limit", "A", 11.0, 1.0),
            ("above", "A", 0.33, 1.0),
            ("zero", "A", 5.0, 9.0),
            ("negative", "A", -50.0, 1.0),
            ("nan", "A", 1.0, 1.0),
            ("null", "A", 1.0, 1.0),
            ("twice", "A", 1.0, 1.0),
            ("twice", "B", 1.0, 1.0),
            ("twice", "B", 7.0, 7.0),
            (None, "A", 1.0, 1.0),
            (None, "A", 1.0, 1.0),
            ("orphan", "A", 1.0, 1.0),
        ],
        "k string, plant string, c1 double, c2 double",
    )
    return parent, child


def test_pairs_by_hand(frames):
    parent, child = frames
    # limit ok, above bad, zero ok, negative ok, nan and null out, null key ok,
    # twice: base 1 ok and base 2 bad for either plant.
    assert pair_result(op.pair_consistency(parent, child, PAIRS, ["k", "plant"], 0.1)) == (
        11,
        2,
        9,
        6,
        3,
        True,
    )
    skip = op.pair_consistency(
        parent, child, PAIRS, ["k", "plant"], 0.1, zero_baseline="skip_pair"
    )
    assert pair_result(skip) == (11, 2, 9, 5, 4, True)


def test_pair_keys_adapt_to_the_parent(frames, spark):
    parent, child = frames
    assert op.resolved_keys(parent, child, ["k", "plant"]) == ["k"]
    with pytest.raises(ValueError, match="plant"):
        op.resolved_keys(parent, child.drop("plant"), ["k", "plant"])
    with pytest.raises(ValueError):
        op.resolved_keys(parent.drop("k"), child, ["k"])
    numbers = spark.createDataFrame([(1, 1.0, 1.0)], "k long, p1 double, p2 double")
    with pytest.raises(TypeError):
        op.pair_consistency(numbers, child, PAIRS, ["k"], 0.1)


def test_pairs_of_empty_tables(frames):
    parent, child = frames
    r = op.pair_consistency(parent.limit(0), child, PAIRS, ["k"], 0.1).first()
    assert (r.pairs, r.consistent, r.consistent_rate, r.accounting_ok) == (0, 0, None, True)


def test_order_decides_the_first_row(spark, rows):
    df = spark.createDataFrame(
        [("a", 2, "x"), ("a", 1, "y"), ("a", 1, "y"), (None, 5, "z"), (None, None, "w")],
        "k string, n int, t string",
    )
    assert rows(op.dedupe_keep_first(df, ["k"], ["n"])) == [("a", 1, "y"), (None, None, "w")]
    assert rows(op.dedupe_keep_first(df, ["k"], [df.n.desc()])) == [("a", 2, "x"), (None, 5, "z")]
    assert rows(op.dedupe_keep_first(df.select("k"), ["k"])) == [("a",), (None,)]


def test_vocabulary_rows(spark, rows):
    df = spark.createDataFrame(
        [("cm",), ("cm",), ("CM",), ("mm",), ("",), (" ",), (None,)], "u string"
    )
    r = op.vocabulary({"t": df}, [("t", "u", ["cm", "m"])]).first()
    assert (r.table, r.column, r.allowed) == ("t", "u", "cm, m")
    assert (r.total, r.missing, r.valid, r.invalid, r.uniform) == (7, 3, 2, 2, False)
    assert (r.valid_rate, r.invalid_rate) == (2 / 7, 2 / 7)
    good = op.vocabulary({"t": df.filter("u = 'cm'")}, [("t", "u", ["cm"])]).first()
    assert good.uniform is True
    assert "uniform" not in op.vocabulary_validity({"t": df}, [("t", "u", ["cm"])]).columns
    assert rows(op.vocabulary_values(df, ["u"])) == [("u", "CM", 1), ("u", "cm", 2), ("u", "mm", 1)]
    assert rows(op.vocabulary_invalid(df, "u", ["cm"])) == [("u", "CM", 1), ("u", "mm", 1)]
    with pytest.raises(TypeError):
        op.vocabulary({"t": df}, [("t", "u", [1])])
    with pytest.raises(ValueError):
        op.vocabulary({"t": df}, [("t", "u", [])])


def test_plausible_range(spark):
    df = spark.createDataFrame(
        [
            (1.0, 200.0),
            (0.0, 1.0),
            (-1.0, 201.0),  # both, counted once
            (1.0, 200.1),
            (NAN, -5.0),  # missing comes first
            (None, 1.0),
        ],
        "a double, b double",
    )
    r = op.plausible_range({"t": df}, [("t", ["a", "b"], 200), ("t", ["a", "b"], None)]).collect()
    bounded = next(x for x in r if x.maximum is not None)
    open_ended = next(x for x in r if x.maximum is None)
    assert (bounded.missing, bounded.too_low, bounded.too_high) == (2, 2, 2)
    assert (bounded.implausible, bounded.plausible, bounded.total) == (3, 1, 6)
    assert (open_ended.too_high, open_ended.implausible, open_ended.plausible) == (0, 2, 2)
    with pytest.raises(TypeError):
        op.plausible_range({"t": df.selectExpr("'x' AS a")}, [("t", ["a"], 1)])


def code_counts(r):
    return (r.missing, r.sentinel, r.format_invalid, r.unparseable, r.total_invalid, r.valid)


def test_identifier_text(spark):
    codes = ["4000000000001", "400000000001", "40000000000012", "9999999999999", "abc", "", None]
    df = spark.createDataFrame([(c,) for c in codes], "code string")
    r = op.identifier_format(df, "code", 13, [9999999999999]).first()
    assert code_counts(r) == (1, 1, 1, 2, 4, 2)
    assert (r.valid_rate, r.total_invalid_rate) == (2 / 7, 4 / 7)
    strict = op.identifier_format(df, "code", 13, [9999999999999], pad=False).first()
    assert code_counts(strict) == (1, 1, 2, 2, 5, 1)


def test_identifier_double(spark):
    codes = [4000000000001.0, 4000000000001.9, 40000000000012.0, NAN, None, 9999999999999.0, 7.0]
    df = spark.createDataFrame([(c,) for c in codes], "code double")
    assert code_counts(op.identifier_format(df, "code", 13, [9999999999999]).first()) == (
        2,
        1,
        1,
        0,
        2,
        3,
    )


def test_prices(spark, rows):
    df = spark.createDataFrame(
        [
            (None, "EUR"),  # no price is no price defect
            (NAN, "EUR"),
            (5.0, None),  # no currency is no allowed currency
            (9999.99, "INR"),  # counted once
            (0.01, "EUR"),
            (0.10, "EUR"),
            (999.99, "CHF"),
            (0.09, "EUR"),
            (1000.0, "INR"),
            (5.0, "eur"),
        ],
        "p double, c string",
    )
    r = op.price_validity(df, "p", "c", [9999.99, 0.01], 0.10, 999.99, ["EUR", "CHF"]).first()
    assert (r.total, r.sentinel, r.out_of_range, r.bad_currency) == (10, 2, 2, 4)
    assert (r.invalid, r.valid, r.valid_rate) == (6, 4, 0.4)
    assert rows(op.price_bad_currencies(df, "c", ["EUR", "CHF"])) == [
        ("INR", 2),
        ("eur", 1),
        (None, 1),
    ]


def test_exact_codes_are_not_negative(spark):
    df = spark.createDataFrame([(-123456789012,), (1234567890123,), (123456789012,)], "code bigint")
    assert op.identifier_format(df, "code", 13, pad=False).first().format_invalid == 2
    assert op.identifier_format(df, "code", 13).first().format_invalid == 0

"""Types of CSV columns, keys of different numeric kinds, nested values in key checks."""

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from tablegauge import operators as op
from tablegauge import sources
from tablegauge.functions.columns import exact_number, from_exact_number
from tablegauge.functions.text_types import cell_kind, column_type

D = decimal.Decimal


def read(spark, tmp_path, lines, **options):
    path = tmp_path / "t.csv"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    spec = {"t": {"path": str(path), "format": "csv"}}
    return sources.load_tables(spark, spec, check_names=False, **options)["t"]


def test_text_that_looks_like_values_stays_text(spark, tmp_path, rows):
    lines = ["flag,code,at,day,zeros", "Y,12D,12:30,2024-01-02,007", "N,34F,09:15,2024-02-30,008", "NA,NA,NA,NA,NA"]
    found = read(spark, tmp_path, lines, null_tokens=["NA"])
    assert {t for _, t in found.dtypes} == {"string"}
    assert rows(found)[0] == ("N", "34F", "09:15", "2024-02-30", "008")


def test_types_of_cells(spark, tmp_path):
    cells = {
        "b": ["true", "FALSE", ""],
        "i": ["1", "-2147483648", "+3"],
        "l": ["1", "2147483648", "-9223372036854775808"],
        "w": ["1", "9223372036854775808", "12345678901234567890123456789012345678"],
        "r": ["1", "2.50", "1e-3"],
        "d": ["2024-01-02", "1999-12-31", ""],
        "t": ["2024-01-02", "2024-01-02 03:04:05.678", "2024-01-02T03:04:05Z"],
        "wide_and_real": ["1234567890123456", "0.5", ""],
        "long_fraction": ["0.12345678901234567", "1", ""],
        "mixed": ["1", "true", "2024-01-02"],
        "huge": ["1e999", "1", ""],
        "nothing": ["", "", ""],
        "spaces": [" 12 ", "3", ""],
    }
    lines = [",".join(cells), *[",".join(v[i] for v in cells.values()) for i in range(3)]]
    found = read(spark, tmp_path, lines)
    kinds = ["boolean", "int", "bigint", "decimal(38,0)", "double", "date", "timestamp"]
    assert [t for _, t in found.dtypes] == [*kinds, *["string"] * 5, "int"]
    first = found.where("i = 1").first()
    assert (first.b, first.l, first.w, first.r, first.d) == (True, 1, D(1), 1.0, dt.date(2024, 1, 2))


def test_absent_tokens_change_no_type(spark, tmp_path, rows):
    lines = ["a,b,c,d", "1,0.5,2024-01-02,x", "2,,,", "3,7,2024-01-03 10:00:00,true"]
    plain = read(spark, tmp_path, lines)
    tokens = read(spark, tmp_path, lines, null_tokens=["NA", "-"])
    assert plain.dtypes == tokens.dtypes and rows(plain) == rows(tokens)
    assert rows(read(spark, tmp_path, lines, null_tokens=["x"])) != rows(plain)


def test_formats(spark, tmp_path, rows):
    path = tmp_path / "t.csv"
    path.write_text("d,e\n31.12.2023,x\n01.01.2024,01.01.2024\n")
    spec = {"t": {"path": str(path), "format": "csv", "options": {"dateFormat": "dd.MM.yyyy"}}}
    found = sources.load_tables(spark, spec, check_names=False)["t"]
    assert found.dtypes == [("d", "date"), ("e", "string")]
    assert rows(found) == [(dt.date(2023, 12, 31), "x"), (dt.date(2024, 1, 1), "01.01.2024")]


def test_the_lattice_joins_cells(spark):
    cells = ["1", "99999999999", "1.5", "true", "2024-01-01", "x", None]
    bits = [r.k for r in spark.createDataFrame([(c,) for c in cells], "c string").select(cell_kind(F.col("c")).alias("k")).collect()]
    assert len(set(bits)) == len(cells) and bits[-1] == 0
    for a in range(len(cells)):
        for b in range(len(cells)):  # a join is the same from both sides, and with itself
            assert column_type(bits[a] | bits[b]) == column_type(bits[b] | bits[a])
            assert column_type(bits[a] | bits[a] | 0) == column_type(bits[a])


NUMBERS = ["12345678.50", "0.00001", "100", "0", "-7.25", "1E+20", "123456789012345", "0.1", "-0.000123"]


@pytest.mark.parametrize("kind", ["decimal(38,10)", "decimal(30,5)", "string"])
def test_keys_of_different_kinds_match(spark, kind):
    texts = [t for t in NUMBERS if kind != "decimal(30,5)" or D(t) == round(D(t), 5)]
    doubles = spark.createDataFrame([(float(t),) for t in texts], "k double")
    if kind == "string":
        with pytest.raises(TypeError):
            op.referential_integrity(doubles, doubles.select(F.col("k").cast("string")), "k", "k")
        return
    exact = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").cast(kind).alias("k"))
    for child, parent in ((doubles, exact), (exact, doubles)):
        found = op.referential_integrity(child, parent, "k", "k").first()
        assert (found["keys"], found.orphaned) == (len(texts), 0)
        assert op.missing_children_keys(child, parent.limit(0), "k").dtypes == child.dtypes
        assert op.missing_children_keys(child, parent.limit(0), "k").exceptAll(child).count() == 0


def test_whole_doubles_and_large_integers_keep_their_digits(spark):
    whole = spark.createDataFrame([(9007199254740993,), (5,), (1000,)], "k long")
    floating = spark.createDataFrame([(9007199254740992.0,), (5.0,), (1000.0,)], "k double")
    found = op.referential_integrity(whole, floating, "k", "k").first()
    assert (found["keys"], found.referenced) == (3, 2)
    assert [r.k for r in op.missing_children_keys(whole, floating, "k").collect()] == [9007199254740993]


def test_exact_form_of_many_doubles(spark):
    import random

    pick = random.Random(3)
    values = [pick.uniform(-1, 1) * 10 ** pick.randrange(-300, 300) for _ in range(2000)]
    values += [round(pick.uniform(-1e6, 1e6), pick.randrange(6)) for _ in range(2000)]
    values += [float(10**k) for k in range(-20, 23)] + [0.0, -0.0, float("inf"), float("-inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", exact_number(df, "v").alias("e")).collect()
    back = df.select(exact_number(df, "v").alias("e")).select(from_exact_number(F.col("e"), df.schema["v"].dataType).alias("v"))
    for r, b in zip(rows, back.collect()):
        if r.v != r.v:
            assert r.e is None
        elif abs(r.v) == float("inf"):
            assert r.e in ("Infinity", "-Infinity")
        else:
            assert b.v == r.v and float(D(r.e)) == r.v
            if len(D(repr(r.v)).as_tuple().digits) <= 15:
                assert D(r.e) == D(repr(r.v))
            digits = r.e.lstrip("-").split("e")[0]
            assert digits == "0" or (digits[0] != "0" and digits[-1] != "0")


NESTED = "k int, s struct<n: int, m: map<string, struct<x: double, inner: map<string, int>>>, l: array<map<string, int>>>"


@pytest.fixture
def nested(spark):
    def value(n, first, inner, last):
        m = {"a": (first, inner), "b": (2.0, None)}
        return (n, m, [last, None])

    swapped = (1, {"b": (2.0, None), "a": (1.0, {"q": 2, "p": 1})}, [{"z": 2, "y": 1}, None])
    return spark.createDataFrame(
        [
            (1, value(1, 1.0, {"p": 1, "q": 2}, {"y": 1, "z": 2})),
            (1, swapped),
            (2, value(1, 1.0, {"p": 1}, {"y": 1})),
            (2, value(1, 1.0, {"p": 2}, {"y": 1})),
            (3, None),
            (3, value(1, 1.0, None, {})),
            (4, None),
            (4, None),
        ],
        NESTED,
    )


def test_nested_values_in_key_checks(nested):
    found = op.key_conflicts(nested, ["k"]).first()
    assert tuple(found) == (8, 2, 2, 4)
    conflicting = op.key_conflict_rows(nested, ["k"])
    assert conflicting.schema == nested.schema
    assert sorted(r.k for r in conflicting.collect()) == [2, 2, 3, 3]
    flagged = op.key_conflict_columns(nested, ["k"])
    assert sorted((r.k, r.conflict_in) for r in flagged.collect()) == [(2, "s"), (2, "s"), (3, ""), (3, "")]
    assert {r.s.m["a"].inner["p"] for r in flagged.where("k = 2").collect()} == {1, 2}
    repeated = op.repeated_rows(nested, ["k"])
    assert sorted(r.k for r in repeated.collect()) == [2, 3]
    assert op.dedupe_keep_first(nested, ["k"]).count() == 4
    assert op.projection(nested, ["s"]).count() == 5
    assert op.duplicate_row_count(nested).first().duplicate_rows == 2


def test_the_exact_form_is_computed_once_a_row(spark):
    decimals = spark.sql("SELECT CAST(id AS DECIMAL(20, 4)) AS k FROM range(3)")
    doubles = spark.sql("SELECT CAST(id AS DOUBLE) AS k FROM range(3)")
    tables, rules = {"a": decimals, "b": doubles}, [("a", "k", "b", "k")]
    for found in (op.referential_integrity(decimals, doubles, "k", "k"), op.referential_integrity_rules(tables, rules)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        # One text of the double is rounded, in a condition and its value, and none in a filter.
        assert plan.count("format_string") == 2
        assert found.first()["referenced"] == 3


def test_exact_form_at_the_edges(spark):
    tiny, inf = 4.9e-324, float("inf")
    doubles = [tiny, -3 * tiny, 2.2250738585072014e-308, 1e7, 100000001.0, 2e23, 1e23, 0.1 + 0.2, 1 / 3, -12.5, -0.0, inf, -inf]
    texts = ["49e-325", "-15e-324", "22250738585072014e-324", "1e7", "100000001e0", "2e23", "1e23", "3e-1"]
    texts += ["3333333333333333e-16", "-125e-1", "0e0", "Infinity", "-Infinity"]
    texts[7] = "30000000000000004e-17"
    df = spark.createDataFrame([(i, v) for i, v in enumerate(doubles)], "i int, v double")
    assert [r.e for r in df.orderBy("i").select(exact_number(df, "v").alias("e")).collect()] == texts
    floats = spark.createDataFrame([(i, v) for i, v in enumerate([0.1, 1.4e-45, -1e10, 123456.0, inf])], "i int, v float")
    found = floats.orderBy("i").select(exact_number(floats, "v").alias("e"))
    assert [r.e for r in found.collect()] == ["1e-1", "14013e-49", "-1e10", "123456e0", "Infinity"]
    decimals = spark.sql(
        "SELECT CAST(v AS DECIMAL(38, 20)) AS v FROM VALUES (1, '0'), (2, '-0.00000000000000000010'), (3, '1200'), (4, NULL) AS t(i, v) ORDER BY i"
    )
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            found = [r.e for r in decimals.select(exact_number(decimals, "v").alias("e")).collect()]
        finally:
            spark.conf.unset("spark.sql.ansi.enabled")
        assert found == ["0e0", "-1e-19", "12e2", None]

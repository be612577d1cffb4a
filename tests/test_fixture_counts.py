"""Counts measured on the defect views at sf 0.01 before any operator existed."""

import pytest

from catalog.queries import QUERIES_BY_NAME as Q
from catalog.views import Inputs
from tablegauge import operators as op

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def t(spark):
    return Inputs(spark, SF_DIR)


def test_articles(t):
    missing = {r.field: r.missing for r in Q["completeness"](t).collect()}
    assert missing["name"] == 69 + 62 + 52
    assert missing["unit"] == 45 + 41
    assert missing["gtin"] == 29
    assert missing["length_cm"] == 38
    unique = {r.field: r for r in Q["uniqueness"](t).collect()}
    assert (unique["article_id"].total, unique["article_id"].duplicates) == (2000, 20)
    assert Q["vocabulary"](t).first().invalid == 49
    code = Q["identifier_format"](t).first()
    assert (code.missing, code.sentinel, code.format_invalid) == (29, 27, 25)
    strict = Q["identifier_format_strict"](t).first()
    assert strict.format_invalid == 25 + 24
    sizes = op.plausible_range({"a": t.v_articles}, [("a", ["length_cm"], 200)]).first()
    assert (sizes.missing, sizes.too_low, sizes.too_high) == (38, 33 + 32, 29)


def test_plants(t):
    known = t.v_plants.filter("article_id < 1000000000")
    conflicts = op.key_conflicts(known, ["article_id", "plant"]).first()
    assert conflicts.rows == 54_519
    assert conflicts.exact_duplicates == 54_519 - 34_865
    assert conflicts.rows_after_cleaning == 7_270
    assert op.missing_children(t.v_articles, t.v_plants, "article_id").first().without_child == 181
    pairs = Q["pair_consistency"](t).first()
    assert (pairs.pairs, pairs.excluded) == (7_266, 3_406)


def test_prices(t):
    prices = Q["price_validity"](t).first()
    assert (prices.sentinel, prices.out_of_range) == (149 + 144, 134 + 128)
    assert prices.bad_currency == 883 + 743
    assert {(r.currency, r.rows) for r in Q["price_bad_currencies"](t).collect()} == {
        ("INR", 883),
        (None, 743),
    }


def test_references(t):
    r = Q["referential_integrity"](t).first()
    assert (r["keys"], r.orphaned) == (300, 150)
    assert Q["missing_children"](t).first().without_child == 257
    natural = op.key_conflicts(t.lineitem, ["l_orderkey", "l_linenumber"]).first()
    assert (natural.rows, natural.exact_duplicates) == (60_000, 0)
    assert natural.rows_after_cleaning == 45_832
    assert op.atomicity_flags(t.documents, [",", ";", "/", "(", ")"], ["doc_id"]).select(
        "doc_id"
    ).distinct().count() == 959

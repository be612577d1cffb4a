"""Ownership of values: who holds them, and in how many repositories."""

import pytest

from tablegauge.llm import secrets
from tests.llm.helpers import LONG, documents

TOKEN = "Zx9Kq2Lm7Pw4Tr8Vb3Nc6"


def judged(spark, rows, **parameters):
    return {r.doc_id: r for r in secrets.secret_digests(documents(spark, rows), **parameters).collect()}


def test_copied_within_one_source_is_no_live_token(spark):
    found = judged(spark, [(i, f"copy {TOKEN} of it", "en", "a") for i in range(500)])
    assert {(r.spans, r.n_live, r.most_owners, r.most_repositories) for r in found.values()} == {("", 0, 0, 0)}


@pytest.mark.parametrize("n, live", [(1, True), (10, True), (11, False)])
def test_as_many_repositories_as_allowed(spark, n, live):
    found = judged(spark, [(i, TOKEN, "en", "a") for i in range(n)])
    assert {r.n_live for r in found.values()} == {int(live)}
    assert {r.most_repositories for r in found.values()} == {n if live else 0}


@pytest.mark.parametrize("owners, live", [(2, True), (3, False)])
def test_as_many_owners_as_allowed(spark, owners, live):
    found = judged(spark, [(i, f"x {TOKEN}", "en", f"s{i}") for i in range(owners)])
    assert {(r.n_live, r.most_owners) for r in found.values()} == {(1, owners) if live else (0, 0)}


def test_base_spans_stay_and_say_who_holds_them(spark):
    text = "password = hunter2hunter2"
    found = judged(spark, [(i, text, "en", f"s{i % 4}") for i in range(40)])
    assert {(r.n_assign, r.n_live, r.most_owners, r.most_repositories) for r in found.values()} == {(1, 0, 4, 40)}
    assert {r.spans for r in found.values()} == {"assign:0:25"}


def test_null_empty_repeated_and_long_texts(spark):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, TOKEN, "en", None), (3, TOKEN, "en", None)]
    rows += [(4, f"{LONG} {TOKEN}x {LONG}", "en", "a"), (None, "token: abcdef", None, None)]
    listed = secrets.secret_digests(documents(spark, rows)).collect()
    assert len(listed) == len(rows)
    found = {r.doc_id: r for r in listed}
    assert found[1].spans == found[2].spans == "" and found[1].most_owners == 0
    assert (found[3].n_live, found[3].most_repositories) == (1, 1)
    assert found[4].spans == f"token:{len(LONG) + 1}:{len(LONG) + 2 + len(TOKEN)}"
    assert found[None].spans == "assign:0:13"

"""License scans against words and phrases counted one by one."""

import re

import pytest

from tablegauge.llm.license_rules import BASE, BASE_PHRASES, PRIORITY, rules
from tablegauge.llm.licenses import Detection, detections, license_digests, resolved
from tests.llm.helpers import LONG, documents

DATA = "/root/testdata/sf0.01/documents.parquet"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def base_of(text):
    words = words_of(text)
    places = []
    for phrase, label in BASE_PHRASES.items():
        own = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    starts = [i for i, _ in places]
    labels = ",".join(sorted({label for _, label in places}))
    return len(words), len(places), min(starts, default=None), max(starts, default=None), labels


def slow_labels(text, signatures):
    """Every rule over the words joined by one space; every pair of detections compared."""
    joined = " ".join(words_of(text))
    found = []
    for i, r in enumerate(signatures):
        pattern = re.compile(f"(?<![^ ]){r.pattern}(?![^ ])")
        found += [(i, m.start(), m.end()) for m in pattern.finditer(joined)]

    def beats(a, b):
        pa, pb = (PRIORITY[signatures[x[0]].kind] for x in (a, b))
        covers = a[1] <= b[1] and a[2] >= b[2]
        return a != b and covers and (pa > pb or pa == pb and ((a[1], a[2]) != (b[1], b[2]) or a[0] < b[0]))

    kept = [d for d in found if signatures[d[0]].kind == BASE or not any(beats(o, d) for o in found)]
    return ",".join(sorted({signatures[i].label for i, _, _ in kept}))


TEXTS = {
    1: "This work is licensed under the GNU General Public License,\n version 3.",
    2: "mit license; MIT  License, apache LICENSE v2 cc-by CC BY-NC 4.0",
    3: "SPDX-License-Identifier: LGPL-2.1-or-later. Permit licenses, mit lizenz",
    4: "gplv3 and BSD 3-clause license; Creative Commons Attribution-ShareAlike 3.0 Unported",
    5: "éapache license apache licenseé ſpdx MİT license",
    6: "You may not use this file except in compliance with the License. All rights reserved.",
    7: "",
    8: None,
    9: LONG + " released under the MIT license " + LONG + " mit license",
    10: "x\x7fmit\x00license\x60y",
    11: "governed by the terms and conditions of the mozilla public license, v. 2.0",
}


def test_hundreds_of_rules():
    signatures = rules()
    assert len(signatures) > 300
    assert len(set(signatures)) == len(signatures)
    for r in signatures:
        re.compile(r.pattern)


def test_texts(spark):
    signatures = rules()
    rows = [(i, t, "en", "a") for i, t in TEXTS.items()] + [(2, TEXTS[2], None, None), (None, TEXTS[1], "en", "a")]
    found = license_digests(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        text = TEXTS[1 if r.doc_id is None else r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of(text)
        assert r.labels == slow_labels(text, signatures), r.doc_id
        assert 0 <= r.score < 1 and (r.score > 0) == bool(r.labels)
    labels = {r.doc_id: r.labels for r in found}
    assert labels[1] == "gpl,gpl-3.0" and labels[3] == "lgpl-2.1" and labels[6] == "all-rights-reserved,apache-2.0"
    assert labels[9] == "mit" and labels[11] == "mpl-2.0" and labels[7] == labels[8] == ""


def test_empty_table(spark):
    found = license_digests(documents(spark, []))
    assert found.collect() == []
    assert found.dtypes[:4] == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_base", "bigint"), ("first_word", "bigint")]


def test_given_documents(spark):
    docs = spark.read.parquet(DATA)
    texts = {r.doc_id: r.text for r in docs.collect()}
    signatures = rules()
    for r in license_digests(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of(texts[r.doc_id])
        if r.labels or r.doc_id % 40 == 0:
            assert r.labels == slow_labels(texts[r.doc_id], signatures)


@pytest.mark.parametrize("seed", range(3))
def test_intervals(seed):
    """Containment against all pairs."""
    import random

    pick = random.Random(seed)
    signatures = rules()
    found = []
    for _ in range(300):
        start = pick.randrange(200)
        found.append(Detection(pick.randrange(len(signatures)), start, start + pick.randrange(1, 30)))
    found = sorted(set(found))

    def beaten(d):
        for o in found:
            a, b = (PRIORITY[signatures[x.rule].kind] for x in (o, d))
            if o != d and o.start <= d.start and o.end >= d.end and (
                a > b or a == b and ((o.start, o.end) != (d.start, d.end) or o.rule < d.rule)
            ):
                return True
        return False

    expected = {d for d in found if signatures[d.rule].kind == BASE or not beaten(d)}
    assert set(resolved(found, signatures)) == expected


def test_places_are_words(spark):
    rows = [(1, "a b c licensed under the apache license version 2.0 z", "en", "a")]
    (row,) = detections(documents(spark, rows)).collect()
    assert [tuple(d) for d in row.detections] == [("apache-2.0", "grant", 3, 8), ("apache", "base", 6, 2)]

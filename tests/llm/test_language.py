"""Language identification against a full model in plain Python."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tablegauge.llm import language
from tests.llm.helpers import LONG, documents

DATA = "/root/testdata/sf0.001/documents.parquet"


class Full:
    """Every word and n-gram counted, one floor, no fixed point."""

    def __init__(self, rows):
        self.units = [defaultdict(Counter) for _ in range(language.LONGEST + 1)]
        for text, lang in rows:
            if text is None or lang is None:
                continue
            for word in language.LETTERS.findall(text.lower()):
                self.units[0][word][lang] += 1
                for k in range(1, language.LONGEST + 1):
                    marked = f" {word} "
                    for i in range(len(marked) - k + 1):
                        self.units[k][marked[i : i + k]][lang] += 1
        self.totals = [Counter() for _ in self.units]
        for total, units in zip(self.totals, self.units):
            for counts in units.values():
                total.update(counts)
        self.languages = sorted(self.totals[0])

    def log(self, k, unit, lang):
        total = self.totals[k]
        n = self.units[k][unit][lang] if unit in self.units[k] else 0
        return math.log(n / (total[lang] + 1)) if n else math.log(0.5 / (max(total.values()) + 1))

    def word(self, word):
        if word in self.units[0]:
            return [self.log(0, word, lang) for lang in self.languages]
        marked = f" {word} "
        for k in range(language.LONGEST, 0, -1):
            grams = [marked[i : i + k] for i in range(len(marked) - k + 1)]
            grams = [g for g in grams if g in self.units[k]]
            if grams:
                return [sum(self.log(k, g, lang) for g in grams) / len(grams) for lang in self.languages]
        return [0.0] * len(self.languages)

    def text(self, text):
        words = [w for w in language.LETTERS.findall((text or "").lower()) if any(map(str.isalpha, w))]
        if not words or not self.languages:
            return "und", 0.0
        sums = [0.0] * len(self.languages)
        for w, n in Counter(words).items():
            sums = [a + n * b for a, b in zip(sums, self.word(w))]
        best = max(sums)
        at = next(i for i, s in enumerate(sums) if s > best - 1e-4)  # ties go by name
        return self.languages[at], 1 / sum(math.exp(s - sums[at]) for s in sums)


def compare(spark, train, texts, **parameters):
    docs = documents(spark, [(i, t, None, "a") for i, t in texts])
    labelled = documents(spark, [(i, t, lang, "a") for i, (t, lang) in enumerate(train)])
    full = Full(train)
    found = language.identify(docs, language.fit(labelled, **parameters)).collect()
    expected = sorted(((i, *full.text(t)) for i, t in texts), key=repr)
    assert len(found) == len(texts)
    for r, (i, lang, score) in zip(sorted(found, key=repr), expected):
        assert (r.doc_id, r.lang_pred) == (i, lang)
        assert r.score == pytest.approx(score, abs=1e-3)
    return full


TRAIN = [
    ("the cat sat on the mat and the dog ran", "en"),
    ("der hund und die katze sitzen auf der matte", "de"),
    ("le chat est sur le tapis et le chien", "fr"),
    ("uno dos tres gato perro casa", "es"),
    (None, "en"),
    ("text without a language", None),
]


@pytest.mark.parametrize("frequent", [0, 3, 1000])
def test_words_and_backoff(spark, frequent):
    """What is broadcast changes nothing."""
    texts = [
        (1, "the hund"),
        (2, "katzen sitzend"),
        (3, "chats tapisserie"),
        (4, None),
        (5, ""),
        (6, "123 ²²² --"),
        (7, "gatos perros 日本語"),
        (8, "日本語"),
        (9, "x"),
        (10, LONG),
        (None, "the cat"),
        (11, "the cat"),
        (11, "the cat"),
        (12, "q" * 50_000),
        (13, "le der"),
    ]
    compare(spark, TRAIN, texts, frequent=frequent)


def test_equal_languages_go_by_name(spark):
    compare(spark, [("same words here", "b"), ("same words here", "a")], [(1, "same words"), (2, "samesame"), (3, "日")])


def test_equal_frequencies(spark):
    """Five words of one frequency each: all stay, however little is broadcast."""
    train = [("one two three four five", "en"), ("eins zwei drei vier funf", "de")]
    texts = list(enumerate("one two three four five eins zwei drei vier funf".split()))
    full = compare(spark, train, texts, frequent=4)
    assert [full.text(t)[0] for _, t in texts] == ["en"] * 5 + ["de"] * 5


def test_given_documents(spark):
    docs = spark.read.parquet(DATA)
    train = docs.where(~language.held_out(F.col("doc_id")))
    full = Full([(r.text, r.lang) for r in train.collect()])
    found = language.identify(docs, language.fit(train, frequent=500)).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(found) == len(texts)
    for r in found:
        lang, score = full.text(texts[r.doc_id])
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-3)


def test_nothing_to_learn_from_or_to_judge(spark):
    compare(spark, [(None, "en"), ("x", None)], [(1, "the cat"), (2, None)])
    model = language.fit(documents(spark, [(1, "the cat", "en", "a")]))
    assert language.identify(documents(spark, []), model).collect() == []

"""Segments and word scores against their definitions."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tablegauge.llm.toxicity import LETTERS, LONGEST, SHORTEST, Scores, maximal_segments, segments, words_in_place


def by_definition(scores):
    """Segments all of whose proper parts score less, that lie in no other such segment."""
    n = len(scores)
    total = [0]
    for s in scores:
        total.append(total[-1] + s)

    def value(a, b):
        return total[b + 1] - total[a]

    every = [(a, b) for a in range(n) for b in range(a, n)]
    strict = [
        (a, b)
        for a, b in every
        if value(a, b) > 0
        and all(value(c, d) < value(a, b) for c, d in every if a <= c and d <= b and (c, d) != (a, b))
    ]
    outer = [(a, b) for a, b in strict if not any((c, d) != (a, b) and c <= a and b <= d for c, d in strict)]
    return sorted((a, b, value(a, b)) for a, b in outer)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-6, 6), max_size=9))
def test_maximal_segments(scores):
    assert sorted(maximal_segments(scores)) == by_definition(scores)


WORDS = {"bad": 2.0, "worse": 3.5, "fine": -0.4, "plain": 0.0, "mild": 0.3, "é": 1.0}
GRAMS = {" ba": (2_000_000, 1_000_000, 0.9), "orse": (-900_000, 4_000_000, 1.0), "ild ": (700_000, 900_000, 0.5)}
GAP = 0.3


def score_of(word):
    """The listed score, or what the strongest n-gram says."""
    if word in WORDS:
        return WORDS[word]
    marked = f" {word} "
    grams = {marked[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(marked) - n + 1)}
    best = (0.0, 0.0)
    for total, weight, kept in (GRAMS[g] for g in grams & GRAMS.keys()):
        best = max(best, (abs(total) / weight**0.5, kept * total / weight))
    return round(best[1], 2)


def test_words_and_segments():
    pick, scores = random.Random(5), Scores(WORDS, GRAMS, GAP)
    vocabulary = [*WORDS, "bars", "horse", "wild", "horses", "child", "ba", "İx", "other", "Bad", "12", "so2so"]
    for _ in range(400):
        text = "".join(pick.choice(vocabulary) + pick.choice([" ", ", ", "\n", "-", "3"]) for _ in range(pick.randrange(14)))
        words = LETTERS.findall(text.lower())
        if len(text.lower()) != len(text):
            words = [w.lower() for w in LETTERS.findall(text)]
        for w in words:
            assert scores[w] == score_of(w)
        weights = [round(score_of(w) * 100) - 30 for w in words]
        above = max((score_of(w) for w in LETTERS.findall(text.lower())), default=0) > GAP
        n, found = segments(text, scores)
        expected = maximal_segments(weights) if above else []
        assert [(a, b, round(s * 100)) for a, b, s in found] == expected
        assert n == (len(LETTERS.findall(text.lower())) if found else n)
        assert scores.any_above(text.lower()) == above
        places = words_in_place(text)
        assert len(places) == len(words)
        scores.trim()


def test_nothing_to_find():
    empty = Scores({}, {}, GAP)
    assert segments("any words at all", empty) == (0, [])
    assert segments("", Scores(WORDS, GRAMS, GAP)) == (0, [])

"""The cube method's draws: balance, inclusion probabilities, landing."""

import itertools
import random

import numpy as np
import pytest

from tablegauge.llm.mixing import LANDING, _flight, _land


def units_of(pick, n):
    return [[i, pick.randrange(1, 900), pick.uniform(0.05, 0.95), pick.getrandbits(63)] for i in range(n)]


def flown(units, seed, most=LANDING):
    """All flights of one block, as a task makes them; the units that land."""
    held, decided = [], []
    for u in units:
        held.append(u)
        while len(held) > max(most, 2):
            _flight(held[:3], seed)
            done = [v for v in held[:3] if v[2] in (0.0, 1.0)]
            assert done
            decided += done
            held = [v for v in held if v not in done]
    return decided, held


@pytest.mark.parametrize("seed", range(20))
def test_flights_keep_both_totals(seed):
    """Words and documents due stay the same to rounding while units are decided."""
    units = units_of(random.Random(seed), 200)
    words, documents = (sum(u[2] * w for u, w in zip(units, ws)) for ws in ([u[1] for u in units], [1] * 200))
    decided, held = flown(units, seed)
    after = decided + held
    assert len(after) == 200 and len(held) <= LANDING
    assert sum(u[2] * u[1] for u in after) == pytest.approx(words, rel=1e-6)
    assert sum(u[2] for u in after) == pytest.approx(documents, rel=1e-6)


def test_units_are_drawn_as_often_as_their_probability_says():
    pick = random.Random(4)
    first = units_of(pick, 40)
    taken = np.zeros(40)
    runs = 3000
    for run in range(runs):
        units = [[i, size, p, pick.getrandbits(63)] for i, size, p, _ in first]
        decided, held = flown(units, run, most=2)
        for u in decided + held:
            taken[u[0]] += u[2]
    off = np.abs(taken / runs - [u[2] for u in first])
    assert off.max() < 5 * 0.5 / runs**0.5  # five standard errors


@pytest.mark.parametrize("seed", range(10))
def test_landing_takes_the_nearest_outcome(seed):
    units = units_of(random.Random(seed), 7)
    words, documents = sum(u[1] * u[2] for u in units), sum(u[2] for u in units)

    def off(outcome):
        return abs(sum(o * u[1] for o, u in zip(outcome, units)) - words) + abs(sum(outcome) - documents)

    best = min(map(off, itertools.product((0, 1), repeat=7)))
    _land(units)
    assert off([u[2] for u in units]) == pytest.approx(best)


def test_equal_sizes_keep_their_number():
    units = [[i, 5, 0.5, i * 7919] for i in range(90)]
    decided, held = flown(units, 3)
    assert sum(u[2] for u in decided + held) == pytest.approx(45)

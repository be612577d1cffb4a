"""Packing against a round-robin walked through event by event."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablegauge.llm.packing import Rounds, packed, place
from tests.llm.helpers import documents

BPE = public_tokenizers.path("byte_bpe_50k.json")


def walked(queues, size):
    """Tokens that the first q queues have sent by the end of each round, from exact times."""
    total, done = sum(n for _, n in queues), []

    def times(items, tokens):
        """Per item min(n, w t) at the time when they add up to ``tokens``."""
        last = Fraction(0)
        for time in sorted({Fraction(n, w) for w, n in items if w and n}):
            if sum(min(Fraction(n), w * time) for w, n in items) >= tokens:
                rate = sum(w for w, n in items if w and n and Fraction(n, w) > last)
                last += (tokens - sum(min(Fraction(n), w * last) for w, n in items)) / rate
                break
            last = time
        return [min(Fraction(n), w * last) for w, n in items]

    first = sum(n for w, n in queues if w)
    for k in range(-(-total // size) + 1):
        tokens = min(k * size, total)
        sent = times(queues, min(tokens, first))
        if tokens > first:
            waiting = times([(0 if w else n, 0 if w else n) for w, n in queues], tokens - first)
            sent = [a + b for a, b in zip(sent, waiting)]
        done.append([int(sum(sent[:q], Fraction(0))) for q in range(len(queues) + 1)])
    return done


@pytest.mark.parametrize("seed", range(4))
def test_rounds(seed):
    pick, tried = random.Random(seed), 0
    while tried < 60:
        queues = [(pick.choice([0, 1, 2, 5, 7]), pick.choice([0, 1, 5, 30, 100, 333])) for _ in range(pick.randrange(1, 7))]
        window, turns = pick.choice([7, 16]), pick.choice([1, 3])
        size, weights = window * turns, sum(w for w, _ in queues)
        if not sum(n for _, n in queues) or any(not w or w * size < weights for w, _ in queues[:-1]):
            continue
        tried += 1
        rounds = Rounds(queues, size)
        for k, row in enumerate(walked(queues, size)):
            assert [rounds.sent(q, k) for q in range(len(queues) + 1)] == row
        filled = set()
        for q, (_, n) in enumerate(queues):
            start = 0
            while start < n:
                length = min(n - start, pick.randrange(1, 60))
                pieces = place(start, length, q, rounds, window)
                assert sum(p[0] for p in pieces) == length
                for size_, sequence, offset in pieces:
                    spots = {(sequence, offset + i) for i in range(size_)}
                    assert not spots & filled and offset + size_ <= window
                    filled |= spots
                start += length
        total = sum(n for _, n in queues)
        assert filled == {(i // window, i % window) for i in range(total)}


ROWS = [(i, f"number {i} of many words " * (1 + i % 5), "en", "abc"[i % 3]) for i in range(120)]
ROWS += [(500, "<|endoftext|> is text", "en", "a"), (501, None, None, None), (502, "", "en", "b")]
ROWS += [(600, "thrice the same row", "en", "a")] * 3


def pieces_of(spark, **parameters):
    return packed(documents(spark, ROWS), BPE, window=64, **parameters).collect()


def whole(rows):
    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    want = Counter((r[0], tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1])) for r in ROWS)
    found = defaultdict(list)
    for r in rows:
        found[r.doc_id, r.row].append((r.start, bytes(r.ids)))
    joined = Counter()
    for (doc_id, _), parts in found.items():
        ids = b"".join(ids for _, ids in sorted(parts))
        joined[doc_id, tuple(np.frombuffer(ids, "<u4").tolist())] += 1
    assert joined == want
    spots = Counter((r.sequence_id, r.offset + i) for r in rows for i in range(r.length))
    assert max(spots.values()) == 1
    assert set(spots) == {(i // 64, i % 64) for i in range(sum(r.length for r in rows))}


def shares(rows):
    source = {r[0]: r[3] for r in ROWS}
    found = defaultdict(Counter)
    for r in rows:
        found[r.sequence_id][source[r.doc_id]] += r.length
    return found


def test_own_shares_and_copies(spark):
    """Repeated rows are told apart by their row."""
    rows = pieces_of(spark)
    whole(rows)
    total = Counter()
    for window in shares(rows).values():
        total.update(window)
    every = sum(total.values())
    for k, window in shares(rows).items():
        if sum(window.values()) == 64:
            for s in ("a", "b", "c"):
                assert abs(window[s] - 64 * total[s] / every) < 2


def test_targets(spark):
    """Half, a quarter and a quarter until a queue is empty; what is not named comes last."""
    rows = pieces_of(spark, targets={"a": 2, "b": 1, "c": 1})
    whole(rows)
    found = shares(rows)
    full = [found[k] for k in sorted(found)][:10]
    assert all(abs(w["a"] - 32) < 2 and abs(w["b"] - 16) < 2 and abs(w["c"] - 16) < 2 for w in full)
    last = max(found)
    assert found[last][None] + found[last - 1][None] == 1


def test_longer_pieces(spark):
    short, long = pieces_of(spark), pieces_of(spark, round_windows=4)
    whole(long)
    assert len(long) < len(short)
    found = shares(long)
    total = sum((Counter(c) for c in found.values()), Counter())
    every = sum(total.values())
    for k in range(max(found) // 4):
        turn = sum((Counter(found[4 * k + i]) for i in range(4)), Counter())
        assert all(abs(turn[s] - 256 * total[s] / every) < 2 for s in "abc")


def test_empty_table(spark):
    assert packed(documents(spark, []), BPE).collect() == []
    assert packed(documents(spark, []), BPE, targets={"a": 1}).collect() == []

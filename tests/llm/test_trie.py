"""The prefix trie against tries built by hand in Python."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

from tablegauge.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, parent string, rank string, prior string"


def trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            m = (role or "", text or "")
            sha = hashlib.sha256(f"{len(m[0].encode())}:{m[0]}{m[1]}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), sha, m))
    own = {c: [m for _, _, m in sorted(turns, key=lambda t: t[:2])] for c, turns in own.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, ids in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(ids) - 1) * len(node[-1][1]) if node else 0
            leaves[node[:d]] += not children[node]
    return sorted(
        (
            (
                min(ids),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(ids),
                children[node],
                leaves[node],
                saved[node],
                hashlib.sha256(",".join(str(c) for c in sorted(ids) if len(seqs[c]) == len(node)).encode()).hexdigest(),
            )
            for node, ids in members.items()
        ),
        key=repr,
    )


def check(spark, rows, **parameters):
    df = spark.createDataFrame([(*r, "n", "p", "1", "x") for r in rows], SCHEMA).repartition(5)
    found = prefix_trie(df, **parameters)
    assert [t for _, t in found.dtypes] == ["bigint"] * 7 + ["string"]
    assert sorted(map(tuple, found.collect()), key=repr) == trie(rows)


def conversations(seed, n, lengths):
    pick = random.Random(seed)
    rows = []
    for c in range(n):
        same = pick.random() < 0.6
        for t in range(pick.choice(lengths)):
            text = f"x{t}" if same else pick.choice(["a", "bb", "", None, "éé😀"])
            rows.append((c, t if pick.random() > 0.02 else None, "u" if same else pick.choice(["u", None]), text))
    return rows


def test_long_conversations_go_on_in_blocks(spark):
    """Three turns a block and two blocks a group: paths of up to six levels."""
    check(spark, conversations(1, 250, [0, 1, 3, 5, 6, 7, 12, 13, 40]), width=3, fan_out=2)


def test_production_blocks(spark):
    rows = conversations(2, 150, [1, 7, 8, 9, 16, 300])
    check(spark, [*rows, (None, 1, "u", "no id"), (149, 5, "u", "twice"), (149, 5, "u", "twice"), (-5, 1, "u", "x")])


def test_copies_and_long_texts(spark):
    """A conversation that half of all repeat, and a text of a million characters."""
    rows = [(c, t, "u", f"same {t}") for c in range(200) for t in range(9)]
    check(spark, rows + [(c, 0, "u", "word " * 200_000) for c in (300, 301)])


def test_turnless_and_nothing(spark):
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in range(101, 200)}
    c = next(c for c in h if h[c] > 1)
    check(spark, [(c, 0, "u", "lost")])  # its stem is absent, its only turn is replaced
    check(spark, [])

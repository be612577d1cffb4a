"""Mixture-controlled packing: deficit round-robin over one queue per source.

Documents are tokenized, each followed by one end id, and queue up by source. Every window
of ``window`` tokens takes from every queue in proportion to its target until the queue is
empty; the others then share its part. Without ``targets`` a queue's target is its share of
all tokens, so that all are empty at the end. Tokens are whole: what a queue got less than
its part in one window is carried as a deficit into the next, so that after any window the
queues up to q have sent the whole part, rounded down, of what is due to them together.

That closed form holds over all windows and partitions. With weights w and queues of N tokens,
let every queue send w tokens per unit of time until it is empty: by time t the queues have
sent the sum of min(N, w t), and window k ends when that is k windows. So the state of the
round-robin is known at any window without walking through those before it, from one row per
queue, and tasks place their documents independently. Every window is full but the last.
Sources that would get less than one token per window share the last queue, which bounds the
queues by the window.

``round_windows`` lets the queues take turns over so many windows instead of one: each round
is on target, its windows carry deficits among each other, and pieces are longer.

Tokens are made once, and kept with each document's place in the queue of its task; a task's
place in the whole queue is a running sum over tasks, a table of one row per task and source.

Defined results: null or empty texts are just the end id; a null source is a source of its
own, the last; repeated rows are packed as often as they occur, ``row`` tells them apart; a
source without a target is packed when the others are done; an empty table gives an empty
result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import accumulate
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablegauge.llm.text import source_key
from tablegauge.llm.work import Scratch, ranked

WINDOW = 2048
END_ID = 1
# The pre-tokenization pattern of the byte-level vocabulary, without backtracking.
PATTERN = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
)


def byte_ranks(tokenizer_json: str) -> dict[bytes, int]:
    """The ranks of a byte-level BPE vocabulary; its ids are in order of the merges."""
    import json

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    with open(tokenizer_json, encoding="utf-8") as file:
        described = json.load(file)
    special = {t["content"] for t in described["added_tokens"]}
    vocab = described["model"]["vocab"].items()
    return {bytes(byte_of[c] for c in token): i for token, i in vocab if token not in special}


def id_kind(ranks: dict[bytes, int], end_id: int) -> str:
    """How ids are kept: two bytes where they fit, else four."""
    return "<u2" if max(max(ranks.values(), default=0), end_id) < 1 << 16 else "<u4"


def tokenized(docs: DataFrame, ranks: dict[bytes, int], end_id: int) -> DataFrame:
    """``doc_id``, ``row``, ``source``, ``n``, ``lane`` (of the task), ``before`` (tokens of the
    source in the lane so far), ``ids`` (little-endian, 2 or 4 bytes each)."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, PATTERN))
    kind = id_kind(ranks, end_id)
    schema = "doc_id long, row long, source string, n long, lane long, before long, ids binary"

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks, pattern = shared.value
        encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        lane, sent = TaskContext.get().partitionId(), {}
        row = (lane << 36) - 1
        for batch in batches:
            out, size = [], 0
            for doc_id, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.append(encoding.encode_to_numpy(text or ""), end_id).astype(kind)
                before = sent.get(source, 0)
                sent[source] = before + len(ids)
                row += 1
                out.append((doc_id, row, source, len(ids), lane, before, ids.tobytes()))
                size += len(out[-1][-1])
                if size > 1 << 24:
                    yield _batch(out, schema)
                    out, size = [], 0
            yield _batch(out, schema)

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        source_key(F.col("source")).alias("source"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(tokenize, schema)


ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), ARROW[kind]) for c, (_, kind) in zip(columns, fields)], [n for n, _ in fields]
    )


class Rounds:
    """What queues have sent by the end of each round of ``size`` tokens.

    ``queues``: weight and tokens of each, in order; all but the last get a token in every round.
    Queues of weight 0 wait until all others are empty, and then count by their tokens. Time is cut into phases, between which a queue
    runs empty; in a phase the sum over the first q queues grows in a straight line.
    """

    def __init__(self, queues: list[tuple[int, int]], size: int):
        self.size, self.total = size, sum(n for _, n in queues)
        self.queues = queues
        self.starts: list[int] = []  # first whole number of tokens sent in each phase,
        self.times: list[Fraction] = []  # its time, from 0 in each of the two turns,
        self.lines: list[tuple[list[int], list[int]]] = []  # and per q: tokens of empty queues, weight of others
        first = self._phases([w for w, _ in queues], 0, set())
        done = {i for i, (w, n) in enumerate(queues) if w}
        if first < self.total:
            self.second = len(self.starts)
            self._phases([0 if w else n for w, n in queues], first, done)
        else:
            self.second = len(self.starts)

    def _phases(self, weights: list[int], sent: int, done: set[int]) -> int:
        """Adds the phases of a turn that begins after ``sent`` tokens; returns those sent after it."""
        by_time: dict[Fraction, list[int]] = {}
        for i, (w, (_, n)) in enumerate(zip(weights, self.queues)):
            if w and n:
                by_time.setdefault(Fraction(n, w), []).append(i)
        empty, time = set(done), Fraction(0)
        for at in sorted(by_time):
            tokens = [0, *accumulate(n if i in empty else 0 for i, (_, n) in enumerate(self.queues))]
            active = [0, *accumulate(0 if i in empty else w if n else 0 for i, (w, (_, n)) in enumerate(zip(weights, self.queues)))]
            self.starts.append(ceil(tokens[-1] + time * active[-1]))
            self.times.append(time)
            self.lines.append((tokens, active))
            empty |= set(by_time[at])
            time = at
        return sum(self.queues[i][1] for i in empty)

    def sent(self, q: int, k: int) -> int:
        """What the first ``q`` queues have sent together by the end of round ``k``."""
        tokens = min(k * self.size, self.total)
        done, active = self.lines[bisect_right(self.starts, tokens) - 1]
        return done[q] + (tokens - done[-1]) * active[q] // active[-1]

    def round_of(self, q: int, start: int) -> int:
        """A round by whose end queue ``q`` has sent at most ``start`` tokens, close to the last such."""
        w, n = self.queues[q]
        low, high = (0, self.second) if w else (self.second, len(self.starts))
        phase = low
        if high - low > 1:
            phase = low + bisect_right(self.times[low:high], Fraction(start, w or n)) - 1
        done, active = self.lines[phase]
        return max(0, (done[-1] + start * active[-1] // (w or n)) // self.size - 2)


def place(start: int, n: int, q: int, rounds: Rounds, window: int) -> list[tuple[int, int, int]]:
    """Where the tokens [start, start + n) of queue ``q`` go: pieces (length, sequence, offset)."""
    k = rounds.round_of(q, start)
    low_k, high_k = rounds.sent(q, k), rounds.sent(q + 1, k)
    pieces = []
    while n:
        low_next, high_next = rounds.sent(q, k + 1), rounds.sent(q + 1, k + 1)
        till = high_next - low_next
        while till > start and n:
            # The round's queues follow each other in it; a piece ends where its window does.
            at = low_next - low_k + start - (high_k - low_k)
            sequence, offset = k * (rounds.size // window) + at // window, at % window
            length = min(n, till - start, window - offset)
            pieces.append((length, sequence, offset))
            start, n = start + length, n - length
        k, low_k, high_k = k + 1, low_next, high_next
    return pieces


def packed(
    docs: DataFrame,
    tokenizer_json: str,
    *,
    window: int = WINDOW,
    end_id: int = END_ID,
    targets: Mapping[str | None, int] | None = None,
    round_windows: int = 1,
) -> DataFrame:
    """One row per piece: ``doc_id``, ``row`` (of the document's row), ``start`` (its tokens before
    the piece), ``length``, ``doc_tokens`` (with the end id), ``sequence_id``, ``offset`` (in the
    sequence), ``ids`` (little-endian unsigned 32-bit).

    ``targets``: whole weights by source; sources that are not named have weight 0.
    """
    scratch = Scratch(docs.sparkSession)
    ranks = byte_ranks(tokenizer_json)
    tokens = scratch.keep(tokenized(docs, ranks, end_id), "tokens")
    lanes = scratch.keep(tokens.groupBy("source", "lane").agg(F.sum("n").alias("n")), "lanes")
    totals = lanes.groupBy("source").agg(F.sum("n").alias("tokens"))
    weight = F.col("tokens")
    if targets is not None:
        named = [(F.lit("1") if s is None else F.lit(f"0{s}"), int(w)) for s, w in targets.items()]
        zero = F.lit(0).cast("long")
        weight = F.coalesce(*[F.when(F.col("source") == key, F.lit(w).cast("long")) for key, w in named], zero)
    totals = scratch.keep(totals.withColumn("weight", weight), "totals")
    size = window * round_windows
    weights = totals.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    # A queue of its own sends a token in every round, so queues are at most as many as tokens there.
    rare = (F.col("weight") * size < weights) | (F.col("weight") == 0)
    queues = scratch.keep(ranked(totals.withColumn("rare", rare), scratch, "ranges", ["rare", "source"], "tokens"), "queues")
    own = [(r.weight, r.tokens) for r in queues.where(~F.col("rare")).orderBy("rank").collect()]
    shared = queues.where("rare").agg(F.sum("weight"), F.sum("tokens"), F.min("before")).first()
    first_shared = shared[2] or 0
    rounds = Rounds(own + [(shared[0], shared[1])] if shared[1] else own, size)
    number = F.when(F.col("rare"), F.lit(len(own))).otherwise(F.col("rank").cast("int"))
    skip = F.when(F.col("rare"), F.col("before") - first_shared).otherwise(F.lit(0))
    queues = queues.select("source", number.alias("queue"), skip.alias("skip"))
    ahead = W.partitionBy("source").orderBy("lane").rowsBetween(W.unboundedPreceding, -1)
    starts = lanes.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).join(queues, "source")
    starts = scratch.keep(starts.select("source", "lane", (F.col("ahead") + F.col("skip")).alias("ahead"), "queue"), "starts")
    kind = id_kind(ranks, end_id)
    schema = "doc_id long, row long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for doc_id, row, n, begin, queue, ids in zip(*(c.to_pylist() for c in batch.columns)):
                ids, at = np.frombuffer(ids, kind).astype("<u4").tobytes(), 0
                for length, sequence, offset in place(begin, n, queue, rounds, window):
                    piece = ids[4 * at : 4 * (at + length)]
                    out.append((doc_id, row, at, length, n, sequence, offset, piece))
                    at += length
                size += len(ids)
                if size > 1 << 24:
                    yield _batch(out, schema)
                    out, size = [], 0
            yield _batch(out, schema)

    return (
        tokens.join(starts, ["source", "lane"])
        .select("doc_id", "row", "n", (F.col("before") + F.col("ahead")).alias("begin"), "queue", "ids")
        .mapInArrow(cut, schema)
    )


def packed_digests(docs: DataFrame, tokenizer_json: str, **parameters) -> DataFrame:
    """The pieces with ``ids_crc32`` in place of the ids, ``row`` last."""
    pieces = packed(docs, tokenizer_json, **parameters)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "row"
    )

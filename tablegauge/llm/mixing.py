"""Mixing sources to target weights by the cube method (Deville and Tillé, 2004).

Targets: sources in order of code point (null last) get the weights in turn and share the
total size; no target exceeds ``max_copies`` times its source's size, and what is cut off is
shared again by weight. A document is taken a whole number of times: the whole part of its
source's rate, and one time more with the fractional part as its inclusion probability.
Those draws are balanced: the flight phase moves the probabilities of three documents at a
time along the null space of the two constraints (size and number of documents), until one
of them is 0 or 1. Blocks of a source fly in parallel and leave at most two undecided
documents each, which meet in the next level's blocks; the largest documents of a block fly
first, so those left are small. When one block is left per source, its flight ends with
``LANDING`` documents, and of all their outcomes the one nearest to the target, in words and
in documents, is taken.

Draws depend on the seed, the id and the size alone, so reruns agree. Blocks hold about
``BLOCK`` documents whatever a source's size, and a task holds a few documents at a time.

Defined results: a null text has size 0, is never drawn for its size and takes 0; a null
source is a source of its own; rows repeated in full are told apart arbitrarily, which can
only exchange equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.text import WORD, rows_again, source_key, text_of, whole_row
from tablegauge.llm.work import Scratch, ranked

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
BLOCK = 512
LANDING = 12  # documents per source whose outcomes are compared at the end
MASK = (1 << 64) - 1
FAN = 128  # blocks of one level that meet in one block of the next
EPS = 1e-9


def source_targets(sizes: DataFrame, weights: tuple, max_copies: int, scratch: Scratch) -> DataFrame:
    """``source``, ``source_size``, ``docs``, ``target``: one row per source key."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = scratch.keep(
        ranked(totals, scratch, "ranges", ["source"], "source_size").select(
            "source",
            "source_size",
            "docs",
            F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).alias("weight"),
        ),
        "sources",
    )
    cap = F.col("source_size") * float(max_copies)
    total, level, capped = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0], 0.0, None
    while True:
        over = cap <= F.col("weight") * level
        used, free, n = sources.agg(
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)),
            F.sum(F.when(~over, F.col("weight"))),
            F.count(F.when(over, 1)),
        ).first()
        if n == capped or not free:
            break
        capped, level = n, (total - used) / free
    return sources.withColumn("target", F.least(cap, F.col("weight") * level))


def _draw(units: list, seed: int) -> float:
    """A number from 0 to 1 that depends on the seed and every unit: flights that share two of
    three units are drawn independently."""
    state = seed & MASK
    for u in units:  # the finalizer of SplitMix64 over each hash
        state = (state ^ u[3] & MASK) + 0x9E3779B97F4A7C15 & MASK
        state = (state ^ state >> 30) * 0xBF58476D1CE4E5B9 & MASK
        state = (state ^ state >> 27) * 0x94D049BB133111EB & MASK
        state ^= state >> 31
    return (state >> 11) / (1 << 53)


def _flight(units: list, rng_seed: int) -> None:
    """Moves the probabilities of up to three units [row, size, p, hash] until one is decided."""
    if len(units) == 3:
        a, b, c = (u[1] for u in units)
        way = [b - c, c - a, a - b]
        if a == b == c:
            way = [1.0, -1.0, 0.0]
    else:  # two units left after all: keep the number of documents
        way = [1.0, -1.0]
    up = min((1 - u[2]) / w if w > 0 else u[2] / -w for u, w in zip(units, way) if w)
    down = min(u[2] / w if w > 0 else (1 - u[2]) / -w for u, w in zip(units, way) if w)
    step = up if _draw(units, rng_seed) * (up + down) < down else -down
    for u, w in zip(units, way):
        u[2] += step * w
        if u[2] < EPS:
            u[2] = 0.0
        elif u[2] > 1 - EPS:
            u[2] = 1.0


def _land(units: list) -> None:
    """Decides the last units so that words and documents come nearest to what is due."""
    size, p = (np.array([u[i] for u in units], dtype=float) for i in (1, 2))
    outcomes = (np.arange(1 << len(units))[:, None] >> np.arange(len(units))) & 1
    off = np.abs(outcomes @ size - size @ p) + np.abs(outcomes.sum(axis=1) - p.sum())
    for u, taken in zip(units, outcomes[np.argmin(off)]):
        u[2] = float(taken)


def _fly(units: DataFrame, last: bool, seed: int) -> DataFrame:
    """One level: ``row``, ``source``, ``block``, ``size``, ``h``, ``p`` with new ``p``."""

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["row", "source", "block", "size", "h", "p"]
        most = LANDING if last else 2
        held: list = []
        key = None
        for frame in frames:
            out = []

            def flush() -> None:
                if last:
                    _land(held)
                out.extend((u[0], *key, u[1], u[3], u[2]) for u in held)
                held.clear()

            for row, source, block, size, h, p in zip(*(frame[n].tolist() for n in names)):
                if (source, block) != key:
                    if held:
                        flush()
                    key = (source, block)
                held.append([row, size, p, h])
                if len(held) > most:
                    _flight(held[:3], seed)
                    for u in [u for u in held[:3] if u[2] in (0.0, 1.0)]:
                        out.append((u[0], *key, u[1], u[3], u[2]))
                        held.remove(u)
            yield pd.DataFrame(out, columns=names)
        if held:
            out = []
            flush()
            yield pd.DataFrame(out, columns=names)

    # Landing documents are of all sizes, so that their outcomes fill any gap.
    order = ["h", "size", "row"] if last else [F.col("size").desc(), "h", "row"]
    return (
        units.repartition("source", "block")
        .sortWithinPartitions("source", "block", *order)
        .mapInPandas(walk, "row long, source string, block long, size long, h long, p double")
    )


def balanced_sample(units: DataFrame, scratch: Scratch, seed: int) -> DataFrame:
    """``row``, ``p`` (1 if drawn, else 0) for ``row``, ``source``, ``size``, ``h``, ``p``
    (between 0 and 1), ``docs`` (number of units of the source)."""
    most = units.agg(F.max("docs")).first()[0] or 0
    levels = 1
    while math.ceil(most / BLOCK) > FAN ** (levels - 1):
        levels += 1
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK), F.lit(1)).cast("long")
    left = units.withColumn("block", F.pmod("h", blocks)).select("row", "source", "block", "size", "h", "p")
    decided = None
    for level in range(levels):
        flown = scratch.keep(_fly(left, level == levels - 1, seed + level), f"flight-{level}")
        done = flown.where("p = 0 or p = 1").select("row", "p")
        decided = done if decided is None else decided.union(done)
        left = flown.where("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") / FAN))
    return decided


def mixed_rows(
    docs: DataFrame,
    *,
    weights: tuple = WEIGHTS,
    max_copies: int = MAX_COPIES,
    seed: int = 17,
    carry: bool = False,
) -> DataFrame:
    """One row per document: ``doc_id``, ``size`` (words), ``source_size``, ``target`` (words
    of the source in the mix), ``copies`` and, with ``carry``, ``doc``, the whole row."""
    scratch = Scratch(docs.sparkSession)
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        source_key(F.col("source")).alias("source"),
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        *([whole_row(docs).alias("doc")] if carry else []),
    )
    table = scratch.keep(found.withColumn("row", F.monotonically_increasing_id()), "sizes")
    sizes = table.drop("doc")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(F.col("rate") + EPS)
    rates = scratch.keep(
        source_targets(sizes, weights, max_copies, scratch)
        .withColumn("rate", F.least(rate, F.lit(float(max_copies))))
        .withColumn("whole", whole.cast("long"))
        .withColumn("p", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0))),
        "rates",
    )
    rated = table.join(rates, "source")
    units = (
        sizes.join(rates.where(F.col("p") > EPS), "source")
        .withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size"))
        .select("row", "source", "size", "h", "p", "docs")
    )
    drawn = balanced_sample(units, scratch, seed)
    # A merge join at every size: draws are as many as documents.
    drawn = drawn.select("row", F.col("p").cast("long").alias("once_more")).hint("merge")
    return rated.join(drawn, "row", "left").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("whole") + F.coalesce("once_more", F.lit(0))).alias("copies"),
        *(["doc"] if carry else []),
    )


def mixture(docs: DataFrame, **parameters) -> DataFrame:
    """One row per document: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken``
    (words the mix takes, repeats counted)."""
    rows = mixed_rows(docs, **parameters)
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of the mix: every document as often as it is taken, with all its columns."""
    rows = mixed_rows(docs, carry=True, **parameters).where("copies > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return rows_again(rows.select("doc", copies.alias("copy")), "doc", docs)

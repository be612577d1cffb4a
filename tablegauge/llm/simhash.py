"""Near duplicates: SimHash fingerprints, joined with themselves in binary tries.

Fingerprints: of the 64-bit hashes of all word shingles, bit by bit the majority. Copies
collapse to one fingerprint each before anything is compared. Two fingerprints that differ
in at most ``budget`` bits agree in one of ``budget + 1`` blocks of bits, so every
fingerprint goes to one group per block value. Within a group the sorted fingerprints are a
binary trie: pairs of nodes are walked down together, differing bits add up, and a pair is
left as soon as they exceed the budget, or when both of its nodes already belong to one
component. A group over ``group_limit`` is split at its most evenly set bits: its members
go to pairs of sub-nodes that differ in at most ``budget`` of these bits, so no link is lost
and no task holds more than a few nodes. Each task returns stars of linked fingerprints,
not pairs; connected components join them over the whole corpus.

Defined results: null or empty texts have fingerprint 0 and link like any other; a null
``doc_id`` never is a component's id unless all of its ids are null; repeated rows give
repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tablegauge.llm.components import components
from tablegauge.llm.text import rows_again, whole_row
from tablegauge.llm.work import Scratch

SHINGLE_WORDS = 3
BUDGET = 3
GROUP_LIMIT = 1 << 15
PAIRS_AT_ONCE = 1 << 20  # node pairs walked together; more wait on a stack


def fingerprint_of(text: str | None, words_per_shingle: int, seed: int) -> int:
    """The fingerprint as a signed 64-bit number."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    hashes = np.array(
        [xxhash.xxh64_intdigest(s, seed) for s in map(b" ".join, zip(*[words[i:] for i in range(k)]))],
        dtype="<u8",
    )
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int, seed: int, carry: bool) -> DataFrame:
    """``doc_id``, ``fp`` and, with ``carry``, ``doc``, the whole row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            found = [fingerprint_of(t.as_py(), words_per_shingle, seed) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int64()), *batch.columns[1:]], ["fp", *batch.schema.names[1:]]
            )

    rows = docs.select(
        F.col("text").cast("string").alias("text"),
        F.col("doc_id").cast("long").alias("doc_id"),
        *([whole_row(docs).alias("doc")] if carry else []),
    )
    schema = StructType([StructField("fp", LongType()), *rows.schema.fields[1:]])
    return rows.mapInArrow(of, schema)


class Stars:
    """Components of numbered members, and what is uniform along their sorted order."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self._mark()

    def _mark(self) -> None:
        self.changes = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            la, lb = label[a], label[b]
            differ = la != lb
            a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
            if not len(a):
                break
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                further = label[label]
                if np.array_equal(further, label):
                    break
                label[:] = further
        self._mark()

    def one(self, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
        """Which pairs of ranges lie in one component altogether."""
        whole = (self.changes[a_end - 1] == self.changes[a]) & (self.changes[b_end - 1] == self.changes[b])
        return whole & (self.label[a] == self.label[b])


def trie_links(fps: np.ndarray, roots: np.ndarray, budget: int, stars: Stars, at_once: int) -> None:
    """Walks pairs of trie nodes from ``roots`` and links members within ``budget`` bits.

    ``fps`` is unsigned and ascending within every node; a node is a range of it. ``roots``
    has rows (a, a_end, b, b_end), a node with itself or with another node.
    """
    ones: dict[int, np.ndarray] = {}
    stack = [(0, np.column_stack([roots, np.zeros(len(roots), dtype=roots.dtype)]))]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > at_once:
            half = len(pairs) // 2
            stack += [(depth, pairs[:half]), (depth, pairs[half:])]
            continue
        a, a_end, b, b_end, _ = pairs.T
        pairs = pairs[~stars.one(a, a_end, b, b_end)]
        a, a_end, b, b_end, errors = pairs.T
        single = (a_end - a == 1) & (b_end - b == 1)
        if single.any():  # both nodes are paths to one leaf
            x, y = a[single], b[single]
            near = np.bitwise_count(fps[x] ^ fps[y]) <= budget
            stars.link(x[near], y[near])
            a, a_end, b, b_end, errors = pairs[~single].T
        if not len(a):
            continue
        if depth == 64:  # equal members of two nodes
            stars.link(a, b)
            continue
        if depth not in ones:
            bit = (fps >> np.uint64(63 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        count = ones[depth]
        a_mid = a_end - (count[a_end] - count[a])
        b_mid = b_end - (count[b_end] - count[b])
        same = (a == b) & (a_end == b_end)
        children = np.concatenate(
            [
                np.column_stack([a, a_mid, b, b_mid, errors]),
                np.column_stack([a_mid, a_end, b_mid, b_end, errors]),
                np.column_stack([a, a_mid, b_mid, b_end, errors + 1]),
                np.column_stack([a_mid, a_end, b, b_mid, errors + 1])[~same],
            ]
        )
        full = (children[:, 0] < children[:, 1]) & (children[:, 2] < children[:, 3])
        stack.append((depth + 1, children[full & (children[:, 4] <= budget)]))


def _stars_of(node: np.ndarray, side: np.ndarray, fps: np.ndarray, budget: int, at_once: int):
    """Star edges among the members of each node pair; rows come sorted by pair and side."""
    order = np.lexsort((fps, side, node))
    node, side, fps = node[order], side[order], fps[order]
    edge = np.flatnonzero((node[1:] != node[:-1]) | (side[1:] != side[:-1])) + 1
    start, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(fps)]])
    own = np.flatnonzero(side[start] == 0)
    left = np.flatnonzero((side[start] == 1))
    pairs = [np.column_stack([start[own], end[own], start[own], end[own]])]
    left = left[left + 1 < len(start)]
    left = left[(side[start[left + 1]] == 2) & (node[start[left]] == node[start[left + 1]])]
    pairs.append(np.column_stack([start[left], end[left], start[left + 1], end[left + 1]]))
    roots = np.concatenate(pairs)
    stars = Stars(len(fps))
    for bits in sorted({1, budget} if budget > 1 else {budget}):  # near links first: they prune
        trie_links(fps, roots, bits, stars, at_once)
    linked = np.flatnonzero(stars.label != np.arange(len(fps)))
    return fps[linked].view(np.int64), fps[stars.label[linked]].view(np.int64)


def links(classes: DataFrame, budget: int, group_limit: int, scratch: Scratch) -> DataFrame:
    """Edges ``u``, ``v`` between fingerprints (the column ``fp``, all different) that connect
    exactly what links of at most ``budget`` differing bits connect."""
    width = 64 // (budget + 1)
    blocks = [
        F.struct(
            F.lit(b).alias("block"),
            F.shiftrightunsigned("fp", b * width).bitwiseAND((1 << width) - 1).alias("value"),
        )
        for b in range(budget + 1)
    ]
    keyed = classes.select("fp", F.explode(F.array(*blocks)).alias("k")).select("fp", "k.block", "k.value")
    sizes = scratch.keep(keyed.groupBy("block", "value").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    depth = F.ceil(F.log2(F.col("n") / group_limit)).cast("int")
    large = sizes.where(F.col("n") > group_limit).select("block", "value", depth.alias("depth"))
    bit = F.expr("shiftright(fp, bit) & 1")
    uneven = F.abs(2 * F.sum("set") - F.count("*"))
    chosen = (
        keyed.join(large, ["block", "value"])
        .select("block", "value", "depth", "fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
        .select("block", "value", "depth", "bit", bit.alias("set"))
        .groupBy("block", "value", "depth", "bit")
        .agg(uneven.alias("uneven"))
        .groupBy("block", "value", "depth")
        .agg(F.sort_array(F.collect_list(F.struct("uneven", "bit"))).alias("bits"))
        .select("block", "value", F.expr("slice(bits.bit, 1, depth)").alias("bits"))
    )
    chosen = scratch.keep(chosen, "bits")
    plan = sizes.join(chosen, ["block", "value"], "left").select(
        "block", "value", F.coalesce("bits", F.array().cast("array<int>")).alias("bits")
    )
    node = F.expr("aggregate(bits, 0L, (x, b) -> x * 2 + (shiftright(fp, b) & 1))")
    masks = F.expr(
        f"filter(sequence(0L, shiftleft(1L, size(bits)) - 1), m -> bit_count(m) <= {budget})"
    )
    members = (
        keyed.join(plan, ["block", "value"])
        .select("block", "value", "fp", node.alias("node"), F.explode(masks).alias("mask"))
        .select(
            "block",
            "value",
            F.least("node", F.expr("node ^ mask")).alias("low"),
            "mask",
            F.when(F.col("mask") == 0, 0).when(F.expr("node < (node ^ mask)"), 1).otherwise(2).alias("side"),
            "fp",
        )
    )
    keys = ["block", "value", "low", "mask"]
    at_once = PAIRS_AT_ONCE

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(rows: np.ndarray) -> pa.RecordBatch:
            changed = (rows[1:, :4] != rows[:-1, :4]).any(axis=1)
            number = np.concatenate([[0], np.cumsum(changed)])
            u, v = _stars_of(number, rows[:, 4], np.ascontiguousarray(rows[:, 5]).view(np.uint64), budget, at_once)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        held = np.empty((0, 6), dtype=np.int64)
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            held = np.concatenate([held, np.column_stack(columns)])
            if not len(held):
                continue
            last = np.flatnonzero((held[:, :4] != held[-1, :4]).any(axis=1))
            if len(last):  # the last pair may go on in the next batch
                yield result(held[: last[-1] + 1])
                held = held[last[-1] + 1 :]
        if len(held):
            yield result(held)

    return (
        members.repartition(*keys)
        .sortWithinPartitions(*keys, "side")
        .select(*keys, "side", "fp")
        .mapInArrow(walk, "u long, v long")
    )


def near_duplicate_classes(
    docs: DataFrame,
    *,
    words_per_shingle: int = SHINGLE_WORDS,
    seed: int = 42,
    budget: int = BUDGET,
    group_limit: int = GROUP_LIMIT,
    carry: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The documents (``row``, ``doc_id``, ``fp``, with ``carry`` also ``doc``) and the classes
    of equal fingerprints (``fp``, ``first``: the smallest id and row, ``component_id``,
    ``component_row``: of the component's first document)."""
    scratch = Scratch(docs.sparkSession)
    found = fingerprints(docs, words_per_shingle, seed, carry)
    table = scratch.keep(found.withColumn("row", F.monotonically_increasing_id()), "documents")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    classes = scratch.keep(table.groupBy("fp").agg(first.alias("first")), "classes")
    roots = components(links(classes, budget, group_limit, scratch), scratch)
    rooted = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    leaders = scratch.keep(rooted.groupBy("root").agg(F.min("first").alias("leader")), "leaders")
    labelled = rooted.join(leaders.hint("merge"), "root").select(
        "fp",
        F.col("leader.doc_id").alias("component_id"),
        F.col("leader.row").alias("component_row"),
    )
    return table, scratch.keep(labelled, "labelled")


def near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``
    (the smallest id that links lead to, its own included)."""
    table, labelled = near_duplicate_classes(docs, **parameters)
    return table.select("doc_id", "fp").join(labelled.hint("merge"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that stay: the first document of each component."""
    table, labelled = near_duplicate_classes(docs, carry=True, **parameters)
    first = labelled.select(F.col("component_row").alias("row")).distinct()
    return rows_again(table.join(first.hint("merge"), "row", "left_semi").select("doc"), "doc", docs)

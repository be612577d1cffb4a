"""The trie of conversation prefixes, by ROLLUP over positional turn columns.

Conversations are laid out in blocks of ``width`` columns, a turn id each: the SHA-256 of a
turn's role and text. One ``GROUP BY node, ROLLUP(t0, t1, ...)`` then aggregates all prefixes
together, and ``grouping_id`` says how many turns of the block a prefix has. Long
conversations go on in further blocks, each keyed by the node that the block before it ends
in. That node's id is a digest of the path to it. Paths are digested in a tree of fixed
fan-out: groups of blocks, groups of these, and so on, and each block takes the digest of what
lies in front of it. So all blocks of all conversations are in the same ROLLUP, and the number
of rounds grows with the logarithm of the longest conversation only.

Sums over subtrees are sums over a node's members too. A node belongs to its smallest member,
and the turns that a conversation shares with a smaller one are those before the first node of
its own. So what subtree sums need is one number per conversation, known after the first
ROLLUP, and a second one adds it up:

* a leaf is counted by the conversation that it belongs to;
* a node's ``saved_tokens`` are, over its members, the characters of the turns shared with a
  smaller member, from the node on.

Rows are numbered by ranges, counted in partial aggregates, and met in merge joins, so that
neither a very long conversation nor a very common turn lands in one task. The ids of
conversations that end in one node are joined to texts of bounded size in parallel; only the
digest itself reads these one after another, because SHA-256 does.

Defined results: null roles and texts are empty; rows without ``conv_id`` belong to no
conversation; null turns come first; rows of one conversation and turn are ordered by the
SHA-256 of role and text, and repeated rows are turns of their own; long texts count whole;
an empty table gives no node, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.work import Scratch, ranked

WIDTH = 8  # turns in a block
FAN_OUT = 32  # blocks whose digests are joined
STEM = 100  # a conversation's stem is the one at the last multiple of this
MOST_SHARED = 6  # turns taken from the stem are fewer than this
RUN_BYTES = 1 << 20
ROOT = hashlib.sha256(b"").digest()
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _sha(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def turns_in_order(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id``, ``pos`` (from 0), ``turn_id``, ``chars``, ``cum`` (characters before) per turn."""
    role, text = (F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("role", "text"))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        _sha(F.octet_length(role).cast("string"), F.lit(":"), role, text).alias("turn_id"),
        F.char_length(text).cast("long").alias("chars"),
    ).where("conv_id IS NOT NULL")
    numbered = scratch.keep(ranked(turns, scratch, "turns", ["conv_id", "turn", "turn_id"], "chars"), "numbered")
    first = numbered.groupBy("conv_id").agg(F.min("rank").alias("rank0"), F.min("before").alias("before0"))
    return numbered.hint("merge").join(scratch.keep(first, "first"), "conv_id").select(
        "conv_id",
        (F.col("rank") - F.col("rank0")).cast("int").alias("pos"),
        "turn_id",
        "chars",
        (F.col("before") - F.col("before0")).alias("cum"),
    )


def rebuilt(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """The turns of every conversation with the first few of its stem in place of its own, and
    a row without a turn at place 0 for each conversation."""
    head = F.array_sort(F.collect_list(F.struct("pos", "turn_id", "chars")))  # at most five
    heads = turns.where(F.col("pos") < MOST_SHARED - 1).groupBy("conv_id").agg(head.alias("head"))
    heads = scratch.keep(heads, "heads")
    stems = heads.where(F.col("conv_id") % STEM == 0).select(F.col("conv_id").alias("stem"), F.col("head").alias("stem_head"))

    def chars_of(turns_: Column) -> Column:
        return F.aggregate(turns_, F.lit(0).cast("long"), lambda a, t: a + t["chars"])

    nothing = F.slice(F.col("head"), 1, 0)
    convs = (
        heads.withColumn("shared", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).cast("int"))
        .withColumn("stem", F.col("conv_id") - F.col("conv_id") % STEM)
        .hint("merge")
        .join(stems, "stem", "left")
        .withColumn("taken", F.coalesce(F.slice("stem_head", 1, F.col("shared")), nothing))
        .select(
            "conv_id",
            "shared",
            "taken",
            (F.size("taken") - F.col("shared")).alias("shift"),
            (chars_of(F.col("taken")) - chars_of(F.slice("head", 1, F.col("shared")))).alias("more"),
        )
    )
    convs = scratch.keep(convs, "convs")
    own = (
        turns.hint("merge")
        .join(convs, "conv_id")
        .where("pos >= shared")
        .select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "turn_id", "chars", (F.col("cum") + F.col("more")).alias("cum"))
    )
    taken = convs.select("conv_id", "taken", F.posexplode("taken").alias("pos", "t")).select(
        "conv_id",
        "pos",
        F.col("t.turn_id").alias("turn_id"),
        F.col("t.chars").alias("chars"),
        chars_of(F.slice("taken", F.lit(1), F.col("pos"))).alias("cum"),
    )
    bare = convs.select(
        "conv_id",
        F.lit(0).alias("pos"),
        F.lit(None).cast("binary").alias("turn_id"),
        F.lit(None).cast("long").alias("chars"),
        F.lit(0).cast("long").alias("cum"),
    )
    return own.unionByName(taken).unionByName(bare)


def blocks_of(turns: DataFrame, width: int) -> DataFrame:
    """``conv_id``, ``block``, ``base`` (characters before), and per column turn id ``t<i>`` and
    characters ``c<i>``."""
    place = F.col("pos") % width
    return turns.groupBy("conv_id", F.floor(F.col("pos") / width).alias("block")).agg(
        F.min("cum").alias("base"),
        *[F.max(F.when(place == i, F.col("turn_id"))).alias(f"t{i}") for i in range(width)],
        *[F.coalesce(F.max(F.when(place == i, F.col("chars"))), F.lit(0)).alias(f"c{i}") for i in range(width)],
    )


def paths(items: DataFrame, last: int, fan_out: int) -> DataFrame:
    """For items (``conv_id``, ``i``, ``digest``): ``prior`` and ``after``, digests of all items
    of the conversation in front of the item, and with it.

    ``last``: the largest ``i``. Items are grouped by ``fan_out``; what lies in front of a group
    comes from the groups' own digests, in the same way.
    """
    digests = F.transform("items", lambda x: x["digest"])
    listed = F.array_sort(F.collect_list(F.struct("i", "digest")))  # at most fan_out
    groups = (
        items.groupBy("conv_id", F.floor(F.col("i") / fan_out).alias("g"))
        .agg(listed.alias("items"))
        .withColumn("digests", digests)
    )
    joined = F.aggregate("digests", F.unhex(F.lit("")), lambda a, d: F.concat(a, d))
    if last < fan_out:
        groups = groups.withColumn("prior", F.lit(ROOT)).withColumn("after", _sha(F.lit(ROOT), joined))
    else:
        upper = groups.select("conv_id", F.col("g").alias("i"), _sha(joined).alias("digest"))
        upper = paths(upper, last // fan_out, fan_out).withColumnRenamed("i", "g")
        groups = groups.hint("merge").join(upper, ["conv_id", "g"])

    def up_to(n: Column) -> Column:
        """The path with the first ``n`` items of the group."""
        some = F.aggregate(F.slice("digests", F.lit(1), n), F.col("prior"), lambda a, d: F.concat(a, d))
        return F.when(n == 0, F.col("prior")).when(n == fan_out, F.col("after")).otherwise(F.unhex(F.sha2(some, 256)))

    each = groups.select("conv_id", "prior", "after", "digests", F.posexplode("items").alias("k", "item"))
    return each.select(
        "conv_id",
        F.col("item.i").alias("i"),
        up_to(F.col("k")).alias("prior"),
        up_to(F.col("k") + 1).alias("after"),
    )


def keyed_blocks(blocks: DataFrame, width: int, fan_out: int, scratch: Scratch) -> DataFrame:
    """Blocks with ``prior``, the node that the block before ends in, and ``after``, their own last."""
    blocks = scratch.keep(blocks, "blocks")
    last = blocks.agg(F.max("block")).first()[0] or 0
    present = [F.coalesce(F.col(f"t{i}"), F.unhex(F.lit(""))) for i in range(width)]
    items = blocks.select("conv_id", F.col("block").alias("i"), _sha(*present).alias("digest"))
    found = paths(items, last, fan_out).withColumnRenamed("i", "block")
    return scratch.keep(blocks.hint("merge").join(found, ["conv_id", "block"]), "keyed")


def _node(width: int, turns: Column) -> Column:
    """The id of the node that ``turns`` turns of a block lead to."""
    ids = [F.col("prior")]
    ids += [_sha(F.col("prior"), *[F.col(f"t{i}") for i in range(n)]) for n in range(1, width)]
    ids += [F.col("after")]
    chosen = F.lit(None).cast("binary")
    for n, node in enumerate(ids):
        chosen = F.when(turns == n, node).otherwise(chosen)
    return chosen


def _rollup(blocks: DataFrame, width: int, sums: str = "") -> DataFrame:
    """One row per node: ``node``, ``parent``, ``depth``, ``conv_id``, ``n_convs``, ``turns`` (in the
    block), and ``sums``."""
    columns = ", ".join(f"t{i}" for i in range(width))
    found = blocks.sparkSession.sql(
        f"""SELECT prior, block, {columns}, max(after) AS after, min(conv_id) AS conv_id, count(*) AS n_convs,
                   {width} - bit_count(grouping_id()) AS turns {sums}
            FROM {{blocks}} GROUP BY prior, block, ROLLUP ({columns})""",
        blocks=blocks,
    )
    turns = F.col("turns")
    last = F.coalesce(*[F.when(turns == n, F.col(f"t{n - 1}")) for n in range(1, width + 1)])
    found = found.where(last.isNotNull() | ((turns == 0) & (F.col("block") == 0)))
    own = [F.col(n) for n in found.columns[found.columns.index("conv_id") :]]
    return found.select(
        _node(width, turns).alias("node"),
        F.when(turns > 0, _node(width, turns - 1)).alias("parent"),
        (F.col("block") * width + turns).cast("long").alias("depth"),
        *own,
    )


RUNS = pa.schema([("node", pa.binary()), ("first", pa.int64()), ("ids", pa.binary())])
DIGESTS = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, schema)], schema=schema)


def _ended(ends: DataFrame) -> DataFrame:
    """``node``, ``ends_sha256`` of the conversations (``node``, ``conv_id``) that end there."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids of one node that follow each other, as text of about a megabyte at most."""
        done: list[tuple] = []
        node, first, ids, size, held = None, 0, [], 0, 0
        for batch in batches:
            for n, c in zip(*(column.to_pylist() for column in batch.columns)):
                if n != node or size > RUN_BYTES:
                    if ids:
                        done.append((node, first, b",".join(ids)))
                        held += size + len(node)
                    node, first, ids, size = n, c, [], 0
                    if held > RUN_BYTES:
                        yield _batch(done, RUNS)
                        done, held = [], 0
                ids.append(b"%d" % c)
                size += len(ids[-1]) + 1
        if ids:
            done.append((node, first, b",".join(ids)))
        yield _batch(done, RUNS)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            found: list[tuple] = []
            for n, ids in zip(batch.column(0), batch.column(2)):
                n = n.as_py()
                if n != node:
                    if node is not None:
                        found.append((node, sha.hexdigest()))
                    node, sha = n, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.as_buffer())
            yield _batch(found, DIGESTS)
        yield _batch([] if node is None else [(node, sha.hexdigest())], DIGESTS)

    parts = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    parts = parts.mapInArrow(runs, "node binary, first long, ids binary")
    parts = parts.repartition(F.col("node")).sortWithinPartitions("node", "first")
    return parts.mapInArrow(digests, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, *, width: int = WIDTH, fan_out: int = FAN_OUT) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    scratch = Scratch(conversations.sparkSession)
    turns = scratch.keep(turns_in_order(conversations, scratch), "placed")
    scratch.drop("turns", "numbered", "first")
    blocks = keyed_blocks(blocks_of(rebuilt(turns, scratch), width), width, fan_out, scratch)
    scratch.drop("placed", "heads", "convs", "blocks")

    nodes = scratch.keep(_rollup(blocks, width).select("node", "parent", "depth", "conv_id"), "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node"))
    children = scratch.keep(children.agg(F.count(F.lit(1)).alias("n_children")), "children")
    own = (
        nodes.hint("merge")
        .join(children, "node", "left")
        .groupBy("conv_id")
        .agg(F.min("depth").alias("own"), F.bool_or(F.col("n_children").isNull()).cast("long").alias("leaf"))
    )

    # Characters in front of each column of a block, and behind the last.
    cum = [F.col("base")]
    for i in range(width):
        cum.append(cum[-1] + F.col(f"c{i}"))
    at_own = F.lit(None).cast("long")
    for i in range(width):
        at_own = F.when(F.col("own") == F.col("block") * width + i + 1, cum[i]).otherwise(at_own)
    shared = F.when(F.col("own").isNull(), cum[width]).when(F.col("own") == 0, F.lit(0)).otherwise(at_own)
    filled = sum((F.col(f"t{i}").isNotNull().cast("int") for i in range(width)), F.lit(0))
    convs = (
        blocks.hint("merge")
        .join(scratch.keep(own, "own"), "conv_id", "left")
        .groupBy("conv_id")
        .agg(
            F.max(shared).alias("shared"),
            F.max(F.coalesce("leaf", F.lit(0))).alias("leaf"),
            F.max_by(_node(width, filled), "block").alias("node"),
        )
    )
    convs = scratch.keep(convs, "members")

    # What a member shares with a smaller one, from the node of each column on.
    zero = F.lit(0).cast("long")
    saved = [F.when(F.col("block") == 0, F.col("shared")).otherwise(zero)]
    saved += [F.greatest(F.col("shared") - cum[i], zero) for i in range(width)]
    summed = blocks.hint("merge").join(convs.select("conv_id", "shared", "leaf"), "conv_id").select(
        "conv_id", "prior", "after", "block", "leaf",
        *[f"t{i}" for i in range(width)],
        *[s.alias(f"s{n}") for n, s in enumerate(saved)],
    )
    sums = ", sum(leaf) AS n_leaves" + "".join(f", sum(s{n}) AS s{n}" for n in range(width + 1))
    chosen = F.coalesce(*[F.when(F.col("turns") == n, F.col(f"s{n}")) for n in range(width + 1)])
    trie = _rollup(summed, width, sums).withColumn("saved_tokens", chosen)
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ended = scratch.keep(_ended(convs), "ended")
    return (
        trie.hint("merge")
        .join(children, "node", "left")
        .join(ended, "node", "left")
        .join(parents, "parent", "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            F.coalesce("n_children", zero).alias("n_children"),
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
        )
    )

"""Cross-tokenizer alignment in Arrow: which tokens of two tokenizers cover the same bytes.

Tokenizer A reads a space and the text, tokenizer B the text, before which it puts a space of
its own. Tasks take texts in chunks of a few megabytes. A chunk's token lists are flattened
with their parent indices; the segmented cumulative sum of token sizes gives each token's end
within its document; an Acero hash join of the two sides on (document, end) finds the ends
they share, which cut the tokens into groups. Groups repeat, so links are made once per
distinct group of a chunk: a full outer join of the ends inside the groups has a row per link,
whose missing side is the next token there is. ``Table.group_by`` adds up how often each pair
of ids is linked in the chunk.

Spark adds the chunks' counts by pair, finds the highest count of each id of B, and brings both
back to the chunks that hold the pair: a chunk knows its pairs by number, its groups by their
links, and its documents by their groups. A pair is one row per chunk there, however often it
occurs, and nothing is broadcast but the two vocabularies. Texts are encoded once.

Defined results: null and empty texts, and texts whose tokens' bytes are not the space and
the text, have no tokens: zeros, and an empty ``groups_sha256``; the strings of special tokens
are ordinary text; repeated rows count each; a long text is a chunk by itself; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.packing import PATTERN, byte_ranks
from tablegauge.llm.slices import sliced
from tablegauge.llm.work import Scratch

CHUNK_BYTES = 2 << 20
MARK = "▁"  # stands for a space in pieces


class Side(NamedTuple):
    """Tokens of one tokenizer over some segments (documents or groups)."""

    ids: pa.Array
    segment: pa.Array
    key: pa.Array  # segment and end


def piece_bytes(model: bytes) -> list[bytes]:
    """What each piece of a sentencepiece model stands for."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    return [
        bytes([int(piece[3:-1], 16)]) if pieces.is_byte(i) else piece.replace(MARK, " ").encode()
        for i in range(pieces.get_piece_size())
        for piece in [pieces.id_to_piece(i)]
    ]


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(np.int32)))


def side(tokens: pa.ListArray, sizes: pa.Array) -> Side:
    """Ids, parent indices, and the segmented cumulative sums of the sizes as keys."""
    ids, segment = pc.list_flatten(tokens), pc.list_parent_indices(tokens)
    ends = pc.cumulative_sum(sizes.take(ids))
    starts = np.concatenate([[0], ends.to_numpy()])[np.cumsum(np.concatenate([[0], pc.list_value_length(tokens).to_numpy()]))[:-1]]
    within = pc.subtract(ends, pa.array(starts).take(segment))
    return Side(ids, segment, pc.add(pc.shift_left(pc.cast(segment, pa.int64()), pa.scalar(40, pa.int64())), within))


def shared_ends(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of both sides that end together, in order."""
    left = pa.table({"key": a.key, "a": pa.array(np.arange(len(a.ids)))})
    right = pa.table({"key": b.key, "b": pa.array(np.arange(len(b.ids)))})
    both = left.join(right, "key", join_type="inner", use_threads=False).sort_by("a")
    return both["a"].to_numpy(), both["b"].to_numpy()


def links(a: Side, b: Side) -> pa.Table:
    """``segment``, ``a``, ``b``: a row per pair of tokens that overlap, ids in order of place."""
    left, right = pa.table({"key": a.key, "a": a.ids}), pa.table({"key": b.key, "b": b.ids})
    both = left.join(right, "key", join_type="full outer", use_threads=False).sort_by("key").combine_chunks()
    return pa.table(
        {
            "segment": pc.shift_right(both["key"], pa.scalar(40, pa.int64())),
            "a": pc.fill_null_backward(both["a"]),
            "b": pc.fill_null_backward(both["b"]),
        }
    )


CHUNKS = pa.schema(
    [
        ("chunk", pa.string()),
        ("doc_id", pa.int64()),
        ("n_a", pa.int64()),
        ("n_b", pa.int64()),
        ("n_groups", pa.int64()),
        ("groups_sha256", pa.string()),
        ("items", pa.list_(pa.int32())),  # of a document: its groups
        ("sizes", pa.list_(pa.int32())),  # of the chunk: links of each group,
        ("pairs", pa.list_(pa.int32())),  # the pair of each link,
        ("keys", pa.list_(pa.int64())),  # the pairs,
        ("counts", pa.list_(pa.int64())),  # and how often each is linked
    ]
)
CHUNK_DDL = (
    "chunk string, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string,"
    " items array<int>, sizes array<int>, pairs array<int>, keys array<long>, counts array<long>"
)


def aligned_chunk(a_list: pa.ListArray, b_list: pa.ListArray, a_sizes: pa.Array, b_sizes: pa.Array, width: int):
    """Of documents whose tokens cover the same bytes: number of groups and digest per document,
    groups of each as numbers, links per group, pairs of links, pairs and their counts."""
    a, b = side(a_list, a_sizes), side(b_list, b_sizes)
    a_at, b_at = shared_ends(a, b)
    a_cuts, b_cuts = (pa.array(np.concatenate([[0], at + 1]), pa.int32()) for at in (a_at, b_at))
    texts = [
        pc.binary_join(pa.ListArray.from_arrays(cuts, pc.cast(s.ids, pa.string())), ",")
        for s, cuts in ((a, a_cuts), (b, b_cuts))
    ]
    groups = pc.binary_join_element_wise(*texts, "|")
    n_groups = np.bincount(a.segment.take(pa.array(a_at)).to_numpy(), minlength=len(a_list))
    starts = np.concatenate([[0], np.cumsum(n_groups)])
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), groups), ";")
    digests = [hashlib.sha256(text.as_buffer()).hexdigest() for text in pc.cast(whole, pa.binary())]

    coded = groups.dictionary_encode()
    numbers = coded.indices.to_numpy()
    first = np.empty(len(coded.dictionary), np.int64)
    first[numbers[::-1]] = np.arange(len(numbers))[::-1]
    once = [
        side(pa.ListArray.from_arrays(cuts, s.ids).take(pa.array(first)), sizes)
        for s, cuts, sizes in ((a, a_cuts, a_sizes), (b, b_cuts, b_sizes))
    ]
    found = links(*once)
    times = pa.array(np.bincount(numbers, minlength=len(first)))
    pair = pc.add(pc.multiply(pc.cast(found["a"], pa.int64()), width), pc.cast(found["b"], pa.int64()))
    counted = pa.table({"pair": pair, "n": times.take(found["segment"].combine_chunks())})
    counted = counted.group_by("pair", use_threads=False).aggregate([("n", "sum")]).combine_chunks()
    place = pc.index_in(pair, value_set=counted["pair"].combine_chunks()).to_numpy()
    per_group = np.bincount(found["segment"].to_numpy(), minlength=len(first))
    items = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(numbers, pa.int32()))
    return n_groups, digests, items, per_group, place, counted["pair"].to_numpy(), counted["n_sum"].to_numpy()


def _chunks(docs: DataFrame, tokenizer_json: str, model_file: str) -> tuple[DataFrame, int]:
    """Rows of documents and of chunks as in ``CHUNKS``, and by how much an id of A is
    multiplied in a pair."""
    ranks = byte_ranks(tokenizer_json)
    with open(model_file, "rb") as file:
        model = file.read()
    pieces = piece_bytes(model)
    a_bytes = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        a_bytes[i] = token
    shared = docs.sparkSession.sparkContext.broadcast((ranks, PATTERN, model, a_bytes, pieces))
    width = len(pieces)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece
        import tiktoken

        ranks, pattern, model, a_bytes, b_bytes = shared.value
        a = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        b = sentencepiece.SentencePieceProcessor(model_proto=model)
        tokens = [pa.array(x, pa.binary()) for x in (a_bytes, b_bytes)]
        sizes = [pc.cast(pc.binary_length(t), pa.int64()) for t in tokens]
        lane, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in sliced(batch, 1, CHUNK_BYTES):
                n += 1
                texts = part.column(1).to_pylist()
                sides = [
                    lists([a.encode_to_numpy(f" {t}") if t else np.empty(0) for t in texts]),
                    lists([np.array(b.encode(t) if t else [], np.int32) for t in texts]),
                ]
                covered = pa.array([b" " + t.encode() if t else b"" for t in texts], pa.binary())
                same = pa.array([bool(t) for t in texts], pa.bool_())
                for ids, spelled in zip(sides, tokens):
                    spelled = pa.ListArray.from_arrays(ids.offsets, spelled.take(ids.values))
                    same = pc.and_(same, pc.equal(pc.binary_join(spelled, b""), covered))
                kept = np.flatnonzero(same.to_numpy(zero_copy_only=False))
                chosen = [ids.take(pa.array(kept)) for ids in sides]
                out = {f.name: pa.nulls(part.num_rows + 1, f.type) for f in CHUNKS}
                columns = aligned_chunk(*chosen, *sizes, width)
                where = np.full(part.num_rows, -1)
                where[kept] = np.arange(len(kept))
                where = pa.array(where, mask=where < 0)
                numbers = [pc.list_value_length(c) for c in chosen] + [pa.array(columns[0])]
                for name, values in zip(("n_a", "n_b", "n_groups"), numbers):
                    out[name] = _filled(pc.cast(values, pa.int64()).take(where), 0)
                out["groups_sha256"] = _filled(pa.array(columns[1], pa.string()).take(where), "")
                out["doc_id"] = pa.concat_arrays([part.column(0).cast(pa.int64()), pa.nulls(1, pa.int64())])
                out["items"] = pa.concat_arrays([columns[2].take(where), pa.nulls(1, pa.list_(pa.int32()))])
                for name, values in zip(("sizes", "pairs", "keys", "counts"), columns[3:]):
                    kind = CHUNKS.field(name).type
                    one = pa.array([values.astype(kind.value_type.to_pandas_dtype())], kind)
                    out[name] = pa.concat_arrays([pa.nulls(part.num_rows, kind), one])
                out["chunk"] = pa.array([f"{lane}-{n}"] * (part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([out[f.name] for f in CHUNKS], schema=CHUNKS)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(chunks, CHUNK_DDL), width


def _filled(values: pa.Array, missing) -> pa.Array:
    """Documents without tokens get ``missing``; the chunk's own row, behind them, is null."""
    return pa.concat_arrays([pc.fill_null(values, missing), pa.nulls(1, values.type)])


def _summed(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[ends - lengths]


DIGESTS = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    + [("groups_sha256", pa.string())]
)


def alignments(docs: DataFrame, tokenizer_json: str, model_file: str) -> DataFrame:
    """One row per document: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``,
    ``count_sum``, ``groups_sha256``."""
    scratch = Scratch(docs.sparkSession)
    chunks, width = _chunks(docs, tokenizer_json, model_file)
    chunks = scratch.keep(chunks, "chunks")
    pairs = chunks.where("keys IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("keys", "counts")).alias("place", "pair"))
    pairs = pairs.select("chunk", "place", F.col("pair.keys").alias("pair"), F.col("pair.counts").alias("n"))
    counts = scratch.keep(pairs.groupBy("pair").agg(F.sum("n").alias("count")), "counts")
    counts = counts.withColumn("b", F.col("pair") % width)
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    counts = counts.hint("merge").join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    counts = scratch.keep(counts, "scored")
    known = pairs.hint("merge").join(counts, "pair").select(F.col("chunk").alias("of"), "place", "count", "best")

    def of_chunk(rows: pa.Table, known: pa.Table) -> pa.Table:
        is_own = rows["keys"].is_valid()
        own, docs = rows.filter(is_own), rows.filter(pc.invert(is_own)).combine_chunks()
        known = known.sort_by("place")
        place, sizes = (own[n].combine_chunks().values.to_numpy() for n in ("pairs", "sizes"))
        items = pc.fill_null(docs["items"], pa.scalar([], docs["items"].type)).combine_chunks()
        lengths, groups = pc.list_value_length(items).to_numpy(), pc.list_flatten(items).to_numpy()
        totals = []
        for name in ("best", "count"):
            of_pair = known[name].cast(pa.int64()).to_numpy()
            totals.append(_summed(_summed(of_pair[place], sizes)[groups], lengths))
        n_links = pc.subtract(pc.add(docs["n_a"], docs["n_b"]), docs["n_groups"])
        columns = [docs[n] for n in ("doc_id", "n_a", "n_b", "n_groups")]
        return pa.table([*columns, n_links, *map(pa.array, totals), docs["groups_sha256"]], schema=DIGESTS)

    ddl = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in DIGESTS)
    return chunks.groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(of_chunk, ddl)


def linked_pairs(docs: DataFrame, tokenizer_json: str, model_file: str) -> DataFrame:
    """``a``, ``b``, ``count``: how often each pair of ids is linked in all documents."""
    chunks, width = _chunks(docs, tokenizer_json, model_file)
    pairs = chunks.where("keys IS NOT NULL").select(F.explode(F.arrays_zip("keys", "counts")).alias("pair"))
    counted = pairs.groupBy(F.col("pair.keys").alias("pair")).agg(F.sum("pair.counts").alias("count"))
    return counted.select(F.floor(F.col("pair") / width).alias("a"), (F.col("pair") % width).alias("b"), "count")

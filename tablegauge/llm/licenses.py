"""License scans by ordered signature rules.

Several hundred regular expressions (``license_rules``) are matched over the words of a text.
A rule has keywords, and only texts that hold all of them are searched with it, so most texts
are read by a few substring searches alone. Detections that overlap are resolved by priority:
an identifier beats a sentence of the licence, that a grant, that a title, that a mention, and
a detection goes if one of the same or a higher priority covers its whole interval. Of equal
intervals and priorities the first rule stays. The phrases of the contract are rules of the
lowest priority that are never left out.

Words are runs of ASCII letters, digits and characters beyond ASCII, after lower-casing A-Z.
Their places are counted in numpy over the bytes of many texts at once. Each text is searched
whole and stands for itself: one scan, no shuffle. Texts are taken in slices of a few
megabytes, or singly where longer.

Defined results: null and empty texts have no words and no detections, and score 0; without
places ``first_word`` and ``last_word`` are null; repeated rows are judged alike, one by one;
an empty table gives an empty result. ``score`` is the chance that any label is right, if the
labels' best detections were independent.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.license_rules import BASE, CONFIDENCE, PRIORITY, Rule, rules
from tablegauge.llm.slices import data_of, sliced
from tablegauge.llm.text import text_of

SLICE_BYTES = 4 << 20
WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))


class Detection(NamedTuple):
    rule: int
    start: int  # bytes of the normalised text
    end: int


def translation() -> bytes:
    """Byte to byte: A-Z in lower case, whatever is no word as a space."""
    lower = bytes(range(256)).lower()
    return bytes(b if b in WORD_BYTES else 0x20 for b in lower)


def compiled(pattern: str) -> re.Pattern[bytes]:
    """The pattern between spaces, any number of which may separate words."""
    spaced = re.sub(r" (\??)", lambda m: " *" if m[1] else " +", pattern)
    return re.compile(f" {spaced}(?= )".encode())


def matches(text: bytes, signatures: Sequence[Rule], patterns: dict[int, re.Pattern]) -> list[Detection]:
    """All detections in a normalised text that begins and ends with a space.

    ``patterns``: what is compiled so far, by the rule's place.
    """
    known: dict[str, bool] = {}
    found = []
    for i, rule in enumerate(signatures):
        for word in rule.keywords:
            if (holds := known.get(word)) is None:
                holds = known[word] = word.encode() in text
            if not holds:
                break
        else:
            if (pattern := patterns.get(i)) is None:
                pattern = patterns[i] = compiled(rule.pattern)
            found += [Detection(i, m.start() + 1, m.end()) for m in pattern.finditer(text)]
    return found


def resolved(found: list[Detection], signatures: Sequence[Rule]) -> list[Detection]:
    """Detections that none of the same or a higher priority covers, and all base ones."""

    def priority(d: Detection) -> int:
        return PRIORITY[signatures[d.rule].kind]

    kept: list[Detection] = []
    starts: list[int] = []  # of what is kept so far, ascending,
    reach: list[int] = []  # and the furthest end among those up to there
    ordered = sorted(found, key=lambda d: (-priority(d), d.start, -d.end, d.rule))
    for _, level in groupby(ordered, key=priority):
        own, furthest = [], -1
        for d in level:
            above = bisect_right(starts, d.start)
            covered = furthest >= d.end or (above and reach[above - 1] >= d.end)
            if not covered:
                own.append(d)
                furthest = max(furthest, d.end)
            elif signatures[d.rule].kind == BASE:
                own.append(d)
        kept += own
        starts, reach = [], []
        for d in sorted(kept, key=lambda d: d.start):
            starts.append(d.start)
            reach.append(max(d.end, reach[-1] if reach else -1))
    return sorted(kept, key=lambda d: (d.start, -d.end, d.rule))


DETECTION = pa.struct(
    [("label", pa.string()), ("kind", pa.string()), ("first_word", pa.int64()), ("words", pa.int64())]
)
SCHEMA = "doc_id long, n_words long, detections array<struct<label: string, kind: string, first_word: bigint, words: bigint>>"


def detections(docs: DataFrame, signatures: Sequence[Rule] | None = None) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``detections`` (label, kind, first word,
    number of words), in order of their places."""
    signatures = [Rule(*r) for r in (rules() if signatures is None else signatures)]
    plain = [tuple(r) for r in signatures]
    table = translation()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = [Rule(*r) for r in plain]
        kinds = [(r.label, r.kind) for r in signatures]
        patterns: dict[int, re.Pattern] = {}
        for batch in batches:
            for part in sliced(batch, 1, SLICE_BYTES):
                data, offsets = data_of(part.column(1))
                data = data.translate(table)
                is_word = np.frombuffer(data, np.uint8) != 0x20
                begins = is_word.copy()
                begins[1:] &= ~is_word[:-1]
                firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
                begins[firsts] = is_word[firsts]  # a text's first word may touch the text before
                begins = np.flatnonzero(begins)
                ahead = np.searchsorted(begins, offsets)
                listed = []
                for i in range(part.num_rows):
                    text = b" " + data[offsets[i] : offsets[i + 1]] + b" "
                    found = resolved(matches(text, signatures, patterns), signatures)
                    row = []
                    if found:
                        places = begins[ahead[i] : ahead[i + 1]] - offsets[i] + 1
                        for d in found:
                            first, behind = np.searchsorted(places, [d.start, d.end])
                            row.append((*kinds[d.rule], int(first), int(behind - first)))
                    listed.append([dict(zip(("label", "kind", "first_word", "words"), r)) for r in row])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(ahead), pa.int64()), pa.array(listed, pa.list_(DETECTION))],
                    ["doc_id", "n_words", "detections"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(scan, SCHEMA)


def license_digests(docs: DataFrame, signatures: Sequence[Rule] | None = None) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_base``, ``first_word``, ``last_word`` (of the
    base phrases), ``base_labels``, ``labels``, ``score``."""
    found = detections(docs, signatures)
    base = F.filter("detections", lambda d: d["kind"] == BASE)
    confidence = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])

    def names(of):
        return F.array_sort(F.array_distinct(F.transform(of, lambda d: d["label"])))

    def doubt(label):
        own = F.filter("detections", lambda d: d["label"] == label)
        return 1 - F.array_max(F.transform(own, lambda d: confidence[d["kind"]]))

    starts = F.transform("base", lambda d: d["first_word"])
    return found.withColumn("base", base).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(names("base"), ",").alias("base_labels"),
        F.array_join(names("detections"), ",").alias("labels"),
        F.round(1 - F.aggregate(names("detections"), F.lit(1.0), lambda a, n: a * doubt(n)), 6).alias("score"),
    )

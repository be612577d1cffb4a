"""Toxic passages by maximum-scoring segments.

Words (runs of letters, in lower case) get log-odds of toxic against clean labelled
documents under Dirichlet priors that follow the word's frequency in the whole corpus
(Monroe et al., 2008); a word counts once per document. No word is cut: weak log-odds shrink
towards those of similar words by empirical Bayes. A word's character n-grams pool the words
that share them (a random-effects mean, each word weighing at most 1); the word's strongest
n-gram, without the word's own part, says what to expect of it, and how far its own log-odds
move it from there is the posterior mean under a spike and a normal slab. Words without a
label score as their n-grams say. Every word costs a small gap penalty besides. One linear scan finds
all maximal scoring segments of a document (Ruzzo and Tompa, 1999). Their scores follow an
extreme-value law whose scale is solved from the word frequencies of clean text (Karlin and
Altschul, 1990); the segments' normalised scores add up, each less the logarithm of the
document's length, and a logistic curve turns the sum into a probability.

Labels come from a sample of at most ``max_labelled`` labelled documents with texts of at most
``max_bytes`` together, chosen by hash: no word that is broadcast is not in them. Corpus frequencies cover every document. Scores are rounded to
hundredths; the model lists the labelled words and n-grams whose scores that leaves different
from what an unlisted one gets.

Defined results: null and empty texts and texts without letters have no passage and the
score of such documents; repeated labels of one id count as toxic if any of them is; null
labels are skipped; without labels of both kinds every score is the share of toxic labels.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablegauge.llm.text import crc_remainder, rows_again, whole_row
from tablegauge.llm.work import Scratch

LETTERS = re.compile(r"[^\W\d_]+")
MAX_LABELLED = 50_000
MAX_BYTES = 256 << 20  # of the labelled texts
PRIOR = 0.2  # weight of the prior, as a share of the labelled words
SHORTEST, LONGEST = 3, 6  # characters of an n-gram
FIXED = 1_000_000  # sums over words are whole numbers, so that they don't depend on their order
GAP = 0.3  # cost of every word, so that clean text scores below zero on average
FLUSH = 200_000  # words a task counts before it passes them on
THRESHOLD = 0.3
POOLED = 30_000  # words whose n-grams are summed at once
REMEMBERED = 400_000  # unlisted words whose scores a task keeps


@dataclass
class Model:
    words: dict[str, float]
    rate: float  # lambda of the extreme-value law
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)  # without a passage; slope and offset with one
    gap: float = GAP
    grams: dict[str, tuple[int, int, float]] = field(default_factory=dict)  # sums, share that shrinking leaves


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first, last, score), in linear time."""
    found: list[list] = []  # [first, last, sum before, sum at the end, nearest one with a smaller sum before]
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        first, j = i, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append([first, i, before, total, j])
                break
            first, before, next_j = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = next_j
    return [(a, b, end - start) for a, b, start, end, _ in found]


def _grams(word: str) -> set[str]:
    """The character n-grams; a space marks the word's ends."""
    marked = f" {word} "
    return {marked[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(marked) - n + 1)}


def _own(odds: float, variance: float) -> tuple[int, int]:
    """A word's part in the sums of its n-grams: weighted log-odds, and weight."""
    weight = 1 / (variance + 1)
    return round(odds * weight * FIXED), round(weight * FIXED)


def _automaton(values: dict[str, tuple]):
    """Finds all n-grams of a word at once."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for gram, value in values.items():
        automaton.add_word(gram, value)
    automaton.make_automaton()
    return automaton


def _says(total: int, weight: int, kept: float) -> tuple[float, float]:
    """The strength of an n-gram, by which the strongest is chosen, and its log-odds."""
    return abs(total) / weight**0.5, kept * total / weight


def _expected(word: str, automaton, own: tuple[int, int]) -> tuple[float, float]:
    """What the strongest n-gram says of a word, and what it says without the word's ``own`` part."""
    if not len(automaton):
        return 0.0, 0.0
    listed, free, odds = (0.0, 0.0), 0.0, 0.0
    own_total, own_weight = own
    for _, (says, total, weight, kept) in automaton.iter(f" {word} "):
        if says > listed:
            listed = says
        if weight > own_weight:
            total, weight = total - own_total, weight - own_weight
            strength = abs(total) / weight**0.5
            if strength >= free:
                found = kept * total / weight
                if strength > free or found > odds:
                    free, odds = strength, found
    return listed[1], odds


class Scores(dict):
    """Scores of words: the listed ones, and others as their n-grams say, worked out once."""

    def __init__(self, words: dict[str, float], grams: dict[str, tuple[int, int, float]], gap: float):
        super().__init__(words)
        self.words, self.gap = words, gap
        self.grams = _automaton({gram: _says(*known) for gram, known in grams.items()})
        # What a word above the gap must hold: itself if listed, else an n-gram above it.
        above = {word for word, score in words.items() if score > gap}
        above |= {gram.strip() for gram, known in grams.items() if round(_says(*known)[1], 2) > gap}
        self.gate = _automaton({part: len(part) for part in above})

    def __missing__(self, word: str) -> float:
        says = [value for _, value in self.grams.iter(f" {word} ")] if len(self.grams) else []
        score = self[word] = round(max(says, default=(0.0, 0.0))[1], 2)
        return score

    def any_above(self, low: str) -> bool:
        """Whether a word of a text in lower case scores above the gap; only words that hold
        what such a word must hold are looked at."""
        if not len(self.gate):
            return False
        checked = 0
        for end, size in self.gate.iter(low):
            if end < checked:
                continue
            first = end - size + 1
            while first and low[first - 1].isalnum() and LETTERS.match(low, first - 1):
                first -= 1
            checked = LETTERS.match(low, first).end()
            if self[low[first:checked]] > self.gap:
                return True
        return False

    def trim(self) -> None:
        """Forgets all but the listed words where many others have come up."""
        if len(self) > len(self.words) + REMEMBERED:
            self.clear()
            self.update(self.words)


def segments(text: str, scores: Scores) -> tuple[int, list[tuple[int, int, float]]]:
    """The number of words, and the positive segments as (first word, last word, score); words are
    those of :func:`words_in_place`. Many texts hold no word above the gap, and one search
    says so; their words are not counted."""
    low, gap = text.lower(), scores.gap
    if not scores.any_above(low):
        return 0, []
    words = LETTERS.findall(low)
    n = len(words)
    if len(low) != len(text):
        words = [w.lower() for w in LETTERS.findall(text)]
    weights = np.fromiter(map(scores.__getitem__, words), float, len(words))
    weights = np.rint(weights * FIXED).astype(np.int64) - round(gap * FIXED)
    # Runs of words above the gap, and what lies between them, are what a segment is made of.
    above = np.concatenate([[False], weights > 0, [False]])
    first, last = np.flatnonzero(above[1:-1] & ~above[:-2]), np.flatnonzero(above[1:-1] & ~above[2:])
    total = np.concatenate([[0], np.cumsum(weights)])
    sums = np.empty(max(2 * len(first) - 1, 0), np.int64)
    sums[::2], sums[1::2] = total[last + 1] - total[first], total[first[1:]] - total[last[:-1] + 1]
    return n, [(int(first[a // 2]), int(last[b // 2]), s / FIXED) for a, b, s in maximal_segments(sums.tolist())]


def words_in_place(text: str) -> list[tuple[int, int]]:
    """Start and end of every word, in the text itself: a few letters change their length in
    lower case."""
    low = text.lower()
    return [m.span() for m in LETTERS.finditer(low if len(low) == len(text) else text)]


def passages(text: str, model: Model, scores: Scores | None = None) -> tuple[int, list[tuple[int, int, float]]]:
    """The number of words (0 without a segment), and the positive segments as (start, end, score)
    in code points."""
    n, found = segments(text, Scores(model.words, model.grams, model.gap) if scores is None else scores)
    spans = words_in_place(text) if found else []
    return n, [(spans[a][0], spans[b][1], s) for a, b, s in found]


def evidence(n: int, found: list[tuple[int, int, float]], rate: float) -> float | None:
    """The largest sum of normalised scores over the r best segments; None without any."""
    total, best = 0.0, None
    for r, s in enumerate(sorted((s for _, _, s in found), reverse=True), 1):
        total += rate * s - np.log(max(n, 2)) + np.log(r)
        best = total if best is None else max(best, total)
    return None if best is None else float(min(max(best, -30.0), 60.0))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each word, by label (2: none): word, all, toxic, clean."""
    counts = [Counter(), Counter(), Counter()]

    def flush() -> pa.RecordBatch:
        words = list(counts[0].keys() | counts[1].keys() | counts[2].keys())
        clean, toxic, free = ([c.get(w, 0) for w in words] for c in counts)
        both = [a + b + c for a, b, c in zip(clean, toxic, free)]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), *(pa.array(x, pa.int64()) for x in (both, toxic, clean))],
            ["word", "n", "toxic", "clean"],
        )

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[2 if label is None else label].update(set(LETTERS.findall((text or "").lower())))
            if sum(map(len, counts)) > FLUSH:
                yield flush()
    yield flush()


def _sample(labels: DataFrame, keep: Column, max_labelled: int) -> DataFrame:
    ids = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    ids = ids.where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & keep)
    # Hashes are even, so a share of them holds little more than the sample; only that is sorted.
    share = min(1.0, 1.1 * max_labelled / max(ids.count(), 1))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 32))
    ids = ids.where(place < int(share * (1 << 32))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    return ids.orderBy(F.xxhash64("id"), "id").limit(max_labelled)


def _within(sample: DataFrame, rows: DataFrame, max_bytes: int) -> DataFrame:
    """The labelled documents of a sample, in its order, whose texts have ``max_bytes`` together."""
    size = F.max(F.octet_length(F.coalesce("text", F.lit("")))).alias("size")
    sized = rows.join(F.broadcast(sample), "id").groupBy("id").agg(F.max("toxic").alias("toxic"), size)
    so_far = F.sum("size").over(W.orderBy(F.xxhash64("id"), "id"))  # over the sample's few rows
    return sized.withColumn("size", so_far).where(F.col("size") <= max_bytes).drop("size")


def _shrink(odds, variance, prior: tuple[float, float]):
    """Posterior mean of log-odds that are 0, or with a share ``prior[0]`` normal with variance ``prior[1]``."""
    share, slab = prior
    against = np.exp(np.clip(-(odds**2) * slab / (2 * variance * (variance + slab)), -700, 0))
    against = against * np.sqrt((variance + slab) / variance) * (1 - share) / share
    return odds * slab / (variance + slab) / (1 + against)


def _prior(scored: DataFrame, slab: float | None = None) -> tuple[float, float]:
    """Share and variance of log-odds other than 0, by expectation and maximisation over
    ``odds`` and ``variance`` in bins; ``slab``: a given variance."""
    bins = scored.select(
        F.round("odds", 1).alias("odds"), F.round(F.log("variance"), 1).alias("variance")
    ).groupBy("odds", "variance").count()
    bins = np.array(sorted(tuple(b) for b in bins.collect()), dtype=float).reshape(-1, 3)
    if not len(bins):
        return 1e-6, 1.0
    odds, variance, n = bins[:, 0], np.exp(bins[:, 1]), bins[:, 2]
    share, fixed, slab = 0.01, slab is not None, 1.0 if slab is None else slab
    for _ in range(100):
        with_slab = np.exp(-(odds**2) / 2 / (variance + slab)) / np.sqrt(variance + slab) * share
        without = np.exp(-(odds**2) / 2 / variance) / np.sqrt(variance) * (1 - share)
        p = n * with_slab / np.maximum(with_slab + without, 1e-300)
        square = (odds * slab / (variance + slab)) ** 2 + slab * variance / (variance + slab)
        share = float(np.clip(p.sum() / n.sum(), 1e-6, 0.5))
        slab = slab if fixed else float(max((p * square).sum() / max(p.sum(), 1e-9), 0.05))
    return share, slab


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the words' parts by n-gram: gram, total, weight."""

    def pooled(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        grams = [_grams(word) for word in table.column(0).to_pylist()]
        odds, variance = (table.column(k).to_numpy() for k in (1, 2))
        weight = 1 / (variance + 1)  # as in _own
        word = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        coded = pa.array([g for some in grams for g in some], pa.string()).dictionary_encode()
        place = coded.indices.to_numpy()
        # Whole numbers far below 2^53: their sums in doubles are exact.
        sums = [
            np.bincount(place, weights=np.rint(part * FIXED)[word], minlength=len(coded.dictionary)).astype(np.int64)
            for part in (odds * weight, weight)
        ]
        return pa.RecordBatch.from_arrays([coded.dictionary, *map(pa.array, sums)], ["gram", "total", "weight"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= POOLED:
            yield pooled(held)
            held = []
    if held:
        yield pooled(held)


def _learn(scored: DataFrame, scratch: Scratch) -> tuple[DataFrame, dict[str, tuple[int, int, float]]]:
    """Scores of the labelled words from ``odds`` and ``variance``, and the n-grams by which
    other words score: columns ``word``, ``n``, ``clean``, ``score``, ``expected`` (unlisted)."""
    prior = _prior(scored)
    pooled = scored.select("word", "odds", "variance").mapInArrow(_pool, "gram string, total long, weight long")
    pooled = pooled.groupBy("gram").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))
    pooled = scratch.keep(
        pooled.where("weight > 0")
        .withColumn("odds", F.col("total") / F.col("weight"))
        .withColumn("variance", F.lit(float(FIXED)) / F.col("weight")),
        "grams",
    )
    gram_prior = _prior(pooled, slab=1.0)

    def shrunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds, variance = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
            score = _shrink(odds, variance, gram_prior)
            kept = np.divide(score, odds, out=np.zeros_like(odds), where=odds != 0)
            listed = pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(kept, pa.float64())], ["gram", "total", "weight", "kept"]
            )
            yield listed.filter(pa.array(np.round(score, 2) != 0))

    listed = pooled.mapInArrow(shrunk, "gram string, total long, weight long, kept double").toPandas()
    grams = dict(zip(listed.gram, zip(listed.total.tolist(), listed.weight.tolist(), listed.kept.tolist())))
    shared = scored.sparkSession.sparkContext.broadcast(grams)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton({gram: (_says(*known), *known) for gram, known in shared.value.items()})
        for batch in batches:
            words, odds, variance = (batch.column(k).to_pylist() for k in range(3))
            both = [_expected(w, automaton, _own(o, v)) for w, o, v in zip(words, odds, variance)]
            listed, expected = np.array(both, dtype=float).reshape(-1, 2).T
            odds, variance = np.array(odds, dtype=float), np.array(variance, dtype=float)
            found = np.round(expected + _shrink(odds - expected, variance, prior), 2)
            unlisted = np.array([round(x, 2) for x in listed.tolist()], dtype=float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[3:], pa.array(found, pa.float64()), pa.array(unlisted, pa.float64())],
                ["word", "n", "clean", "score", "expected"],
            )

    scores = scored.select("word", "odds", "variance", "n", "clean").mapInArrow(
        score, "word string, n long, clean long, score double, expected double"
    )
    return scratch.keep(scores, "scores"), grams


def _scale(scores: np.ndarray, share: np.ndarray, gap: float) -> float:
    """lambda with sum(p * exp(lambda * score)) = 1 over clean text; the rest scores -gap."""
    rest = max(1.0 - share.sum(), 0.0)
    low, high = 0.0, 4.0
    for _ in range(60):
        mid = (low + high) / 2
        total = float((share * np.exp(np.minimum(mid * (scores - gap), 300.0))).sum() + rest * np.exp(-mid * gap))
        low, high = (mid, high) if total < 1 else (low, mid)
    return max(low, 0.05)


def _curve(bins: list[tuple]) -> tuple[float, float, float]:
    """The logit without a passage, and a logistic curve over the evidence with one.

    ``bins``: rows of evidence (None without a passage), label, documents.
    """
    without = [sum(n for x, y, n in bins if x is None and y == label) for label in (0, 1)]
    base = float(np.log((without[1] + 0.5) / (without[0] + 10.0)))
    some = [(x, y, n) for x, y, n in bins if x is not None]
    if not some:
        return base, 0.0, base
    x, y, n = (np.array(c, dtype=float) for c in zip(*some))
    x, y, n = np.append(x, [-5.0, 15.0]), np.append(y, [0.0, 1.0]), np.append(n, [2.0, 2.0])
    beta = np.zeros(2)
    design = np.column_stack([x, np.ones_like(x)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (n * (y - p)) - 1e-3 * beta
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return base, float(beta[0]), float(beta[1])


def probability(x: float | None, curve: tuple[float, float, float]) -> float:
    logit = curve[0] if x is None else max(curve[0], curve[1] * x + curve[2])
    return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    keep: Column | None = None,
    max_labelled: int = MAX_LABELLED,
    max_bytes: int = MAX_BYTES,
    prior: float = PRIOR,
    gap: float = GAP,
) -> Model:
    """Learns from the labels (``doc_id``, ``toxic``); ``keep``: a condition on their ``id``."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    sample = scratch.keep(_sample(labels, F.lit(True) if keep is None else keep, max_labelled), "labels")
    sample = scratch.keep(_within(sample, rows, max_bytes), "sample")
    labelled = rows.join(F.broadcast(sample), "id", "left").select("text", "toxic")
    counted = labelled.mapInArrow(_count, "word string, n long, toxic long, clean long")
    words = scratch.keep(
        counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")),
        "words",
    )
    total, toxic, clean = (float(x or 0) for x in words.agg(F.sum("n"), F.sum("toxic"), F.sum("clean")).first())
    weight = prior * (toxic + clean)
    model = Model({}, 1.0, gap=gap)
    if toxic and clean:
        share = F.col("n") * (weight / total)
        odds = [
            F.log((F.col(c) + share) / (F.lit(size + weight) - F.col(c) - share))
            for c, size in (("toxic", toxic), ("clean", clean))
        ]
        variance = 1 / (F.col("toxic") + share) + 1 / (F.col("clean") + share)
        scored = words.where("toxic + clean > 0").select(
            "word", (odds[0] - odds[1]).alias("odds"), variance.alias("variance"), "n", "clean"
        )
        scores, model.grams = _learn(scratch.keep(scored, "scored"), scratch)
        best = scores.where("score != expected").select("word", "score").toPandas()
        model.words = dict(zip(best.word, best.score.tolist()))
        null = scores.where("score != 0").groupBy("score").agg(F.sum("clean"), F.sum("n")).collect()
        null = np.array(sorted(tuple(r) for r in null), dtype=float).reshape(-1, 3)
        model.rate = _scale(null[:, 0], (null[:, 1] + null[:, 2] * (weight / total)) / (clean + weight), gap)
        scratch.drop("scored", "grams", "scores")
    known = rows.join(F.broadcast(sample), "id").select("toxic", "text")
    found = scored_rows(known, model, ["toxic"]).select(
        F.round("evidence", 1).alias("evidence"), "toxic"
    )
    bins = found.groupBy("evidence", "toxic").count().collect()  # at most 1,802 rows
    model.curve = _curve([tuple(b) for b in bins])
    scratch.drop("words")
    return model


def scored_rows(rows: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of ``rows`` with ``evidence``, ``score`` and ``passages`` of ``text``."""
    # Plain values, and a place for what a worker learns: it outlives the worker's tasks.
    plain = {"model": (model.words, model.rate, model.curve, model.gap, model.grams), "scores": None}
    shared = rows.sparkSession.sparkContext.broadcast(plain)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rate, curve, gap, grams = shared.value["model"]
        scores = shared.value["scores"] = shared.value["scores"] or Scores(words, grams, gap)
        passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            seen, score, spans = [], [], []
            for text in batch.column(0):
                text = text.as_py() or ""
                n, found = segments(text, scores)
                scores.trim()
                seen.append(evidence(n, found, rate))
                score.append(probability(seen[-1], curve))
                limit = np.log(max(n, 2))  # an expected number of chance segments below one
                found = [p for p in found if rate * p[2] > limit]
                places = words_in_place(text) if found else []
                spans.append([{"start": places[a][0], "end": places[b][1], "score": s} for a, b, s in found])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(seen, pa.float64()), pa.array(score), pa.array(spans, pa.list_(passage))],
                [*batch.schema.names[1:], "evidence", "score", "passages"],
            )

    rows = rows.select("text", *carry)
    found = "evidence double, score double, passages array<struct<start: bigint, end: bigint, score: double>>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:]), found])
    return rows.mapInArrow(of, schema)


def toxicity(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id``, ``score``, ``predicted``, ``passages``."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    return scored_rows(rows, model, ["doc_id"]).select(
        "doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages"
    )


def drop_toxic(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all columns."""
    rows = docs.select(F.col("text").cast("string").alias("text"), whole_row(docs).alias("doc"))
    kept = scored_rows(rows, model, ["doc"]).where(F.col("score") < threshold)
    return rows_again(kept.select("doc"), "doc", docs)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels the query does not learn from."""
    return crc_remainder(doc_id, 4) == 2

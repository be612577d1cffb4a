"""Language identification by words, with character n-grams for unseen words.

Word-first backoff (Jauhiainen et al., HeLI): a known word scores with its log frequency in
each language. An unseen word scores with the mean over its character n-grams of the longest
length of which any is known, falling back to shorter ones. What a language has not seen gets
one floor, the same for all languages: half an occurrence in the largest of them. A document
sums the scores of its words, and the best language wins; ``score`` is its posterior under
equal priors.

Words are runs of letters in lower case; in n-grams a space marks their ends. Every word and
n-gram of the labelled documents counts in full: nothing is cut off. Scores are kept as what
they exceed the floor by, so a word lists only the languages that know it, and in whole
millionths, so that sums do not depend on their order.

The commonest words, at most ``frequent`` entries of up to 64 characters, are broadcast, and
tasks score them on the spot. A document's other words are rows that meet the full word table
in a merge join; those that are in no labelled document, each once, meet the n-gram tables,
first the longest n-grams, then all shorter ones. Which words are broadcast changes no result.

Defined results: null texts and texts without a letter are ``und`` with score 0; long texts
count whole; repeated rows and rows without id are judged one by one; equal languages are
decided by name; a document of which nothing is known gets the first language by name; without
any labelled document every text is ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablegauge.llm.slices import sliced
from tablegauge.llm.text import crc_remainder
from tablegauge.llm.work import Scratch

LETTERS = re.compile(r"[^\W\d_]+")
FREQUENT = 400_000  # entries (word and language) that are broadcast
FREQUENT_CHARS = 64
LONGEST = 5  # characters of an n-gram
FLUSH = 500_000  # words or n-grams a task counts before it passes them on
FEW = 200_000  # n-grams that are broadcast as a filter
FIXED = 1_000_000
SMALL = 10_000  # languages that may be broadcast
SLICE_BYTES = 4 << 20


@dataclass
class Model:
    words: DataFrame  # word, langs (lang, n)
    totals: DataFrame  # lang, and occurrences of words (n0) and of n-grams by length (n1, ...)
    n_languages: int
    first: str | None  # language by name
    most: list[int]  # the largest of each of the totals
    frequent: dict[str, list[tuple[str, int]]] = field(default_factory=dict)

    @property
    def longest(self) -> int:
        return len(self.most) - 1


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


COUNTED = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def flush() -> pa.RecordBatch:
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        counts.clear()
        return _batch(rows, COUNTED)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.setdefault(lang, Counter()).update(LETTERS.findall((text or "").lower()))
            if sum(map(len, counts.values())) > FLUSH:
                yield flush()
    yield flush()


def _grams(word: str, length: int) -> list[str]:
    marked = f" {word} "
    return [marked[i : i + length] for i in range(len(marked) - length + 1)]


def _count_grams(lengths: list[int], wanted: Broadcast | None):
    """From words and their counts by language: n-grams and theirs, if given only those ``wanted``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = None if wanted is None else wanted.value
        counts: dict[str, dict[str, int]] = {}

        def flush() -> pa.RecordBatch:
            rows = [(lang, g, n) for lang, c in counts.items() for g, n in c.items()]
            counts.clear()
            return _batch(rows, COUNTED)

        for batch in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                own = counts.setdefault(lang, {})
                for length in lengths:
                    for g in _grams(word, length):
                        if only is None or g in only:
                            own[g] = own.get(g, 0) + n
            if sum(map(len, counts.values())) > FLUSH:
                yield flush()
        yield flush()

    return count


def _by_unit(counted: DataFrame) -> DataFrame:
    """``word``, ``langs``: counts by language, from one shuffle by word."""
    counted = counted.repartition(F.col("word")).groupBy("word", "lang").agg(F.sum("n").alias("n"))
    return counted.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("lang", "n"))).alias("langs"))


def _common(words: DataFrame, most: int) -> DataFrame:
    """The most frequent words that have at most ``most`` entries together.

    The least frequency that still fits comes from how many entries have each frequency, in
    sixteenths of an octave, which are about a thousand however large the corpus is.
    """
    words = words.where(F.length("word") <= FREQUENT_CHARS)
    total = F.aggregate("langs", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    words = words.withColumn("step", F.floor(F.log2(total) * 16))
    spread = words.groupBy("step").agg(F.sum(F.size("langs")).alias("entries"))
    so_far = F.sum("entries").over(W.orderBy(F.col("step").desc()))
    least = spread.withColumn("entries", so_far).where(F.col("entries") <= most).agg(F.min("step")).first()[0]
    return words.where(F.lit(False) if least is None else F.col("step") >= least).drop("step")


def _above_floor(n: Column) -> Column:
    """What a log frequency exceeds the floor by, but for the sizes of the two languages."""
    return F.round(F.log(2 * n) * FIXED).cast("long")


def fit(labelled: DataFrame, *, frequent: int = FREQUENT, longest: int = LONGEST) -> Model:
    """Learns from ``text`` and ``lang`` of the rows where both are known."""
    scratch = Scratch(labelled.sparkSession)
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = rows.mapInArrow(_count, "lang string, word string, n long")
    words = scratch.keep(_by_unit(counted), "words")
    each = words.select(F.length("word").alias("chars"), F.inline("langs"))
    grams = [F.greatest(F.col("chars") + 3 - k, F.lit(0)) for k in range(1, longest + 1)]
    totals = each.groupBy("lang").agg(
        F.sum("n").alias("n0"), *[F.sum(F.col("n") * g).alias(f"n{k}") for k, g in enumerate(grams, 1)]
    )
    totals = scratch.keep(totals, "totals")
    sizes = range(longest + 1)
    n_languages, first, *most = totals.agg(F.count("*"), F.min("lang"), *[F.max(f"n{k}") for k in sizes]).first()
    common = _common(words, frequent).withColumn(
        "langs", F.transform("langs", lambda x: F.struct(x["lang"].alias("lang"), _above_floor(x["n"]).alias("above")))
    )
    listed = {r.word: [tuple(x) for x in r.langs] for r in common.toLocalIterator() if any(map(str.isalpha, r.word))}
    return Model(words, totals, n_languages, first, [m or 0 for m in most], listed)


def _sizes(model: Model, lengths: list[int]) -> DataFrame:
    """``lang``, ``k``, ``size``: what a language's scores gain by being smaller than the largest."""
    smaller = [F.log((F.lit(model.most[k]) + 1) / (F.col(f"n{k}") + 1)) for k in lengths]
    each = [F.struct(F.lit(k).alias("k"), F.round(x * FIXED).cast("long").alias("size")) for k, x in zip(lengths, smaller)]
    sizes = model.totals.select("lang", F.inline(F.array(*each)))
    return F.broadcast(sizes) if model.n_languages <= SMALL else sizes.hint("merge")


TALLIED = pa.schema(
    [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("letters", pa.bool_()),
        ("langs", pa.list_(pa.string())),  # of frequent words: languages,
        ("above", pa.list_(pa.int64())),  # the sums of their scores above the floor,
        ("seen", pa.list_(pa.int64())),  # and of their occurrences
        ("others", pa.list_(pa.string())),  # other words,
        ("times", pa.list_(pa.int64())),  # and how often each occurs
    ]
)
TALLIED_DDL = (
    "row long, doc_id long, letters boolean, langs array<string>, above array<long>, seen array<long>,"
    " others array<string>, times array<long>"
)


def _compact(frequent: dict[str, list[tuple[str, int]]]) -> tuple:
    """Words, the number of entries of each, and all entries as arrays, with the languages."""
    languages = sorted({lang for entries in frequent.values() for lang, _ in entries})
    place = {lang: i for i, lang in enumerate(languages)}
    size = np.array([len(e) for e in frequent.values()], np.int32)
    lang = np.array([place[lang] for e in frequent.values() for lang, _ in e], np.int32)
    above = np.array([above for e in frequent.values() for _, above in e], np.int64)
    return list(frequent), size, lang, above, languages


class _Frequent:
    """Frequent words by number, and their languages and scores as one sparse matrix."""

    def __init__(self, words: list[str], size: np.ndarray, lang: np.ndarray, above: np.ndarray, languages: list[str]):
        self.number = dict(zip(words, range(len(words))))
        self.size, self.lang, self.above, self.languages = size.astype(np.int64), lang, above, languages
        self.start = np.cumsum(self.size) - self.size

    def sums(self, doc: np.ndarray, word: np.ndarray, n: np.ndarray):
        """Per document and language that has any: document, language, sums of scores and of ``n``."""
        size = self.size[word]
        which = np.repeat(np.arange(len(word)), size)
        entry = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + self.start[word][which]
        key = doc[which] * len(self.languages) + self.lang[entry]
        keys, at = np.unique(key, return_inverse=True)
        # Whole numbers below 2^53, so sums in doubles are exact.
        above = np.bincount(at, weights=self.above[entry] * n[which], minlength=len(keys))
        seen = np.bincount(at, weights=n[which], minlength=len(keys))
        width = max(len(self.languages), 1)
        return keys // width, keys % width, above.astype(np.int64), seen.astype(np.int64)


def _listed(doc: np.ndarray, n_docs: int, values: pa.Array) -> pa.ListArray:
    """Values in order of their documents as one list per document."""
    ends = np.cumsum(np.bincount(doc, minlength=n_docs))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)


def _tallied(docs: DataFrame, frequent: dict[str, list[tuple[str, int]]]) -> DataFrame:
    """Per document the sums over frequent words by language, and its other words."""
    shared = docs.sparkSession.sparkContext.broadcast(_compact(frequent))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = _Frequent(*shared.value), TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in sliced(batch, 1, SLICE_BYTES):
                words: list[str] = []
                times: list[int] = []
                lengths = []
                for text in part.column(1):
                    counts = Counter(LETTERS.findall((text.as_py() or "").lower()))
                    words += counts
                    times += counts.values()
                    lengths.append(len(counts))
                doc, n = np.repeat(np.arange(len(lengths)), lengths), np.array(times, np.int64)
                ids = np.fromiter(map(known.number.get, words, repeat(-1)), np.int64, len(words))
                other = np.flatnonzero(ids < 0)
                spelled = [words[i].isalpha() or any(map(str.isalpha, words[i])) for i in other]
                other = other[np.array(spelled, bool)]
                often = ids >= 0
                own, lang, above, seen = known.sums(doc[often], ids[often], n[often])
                letters = np.zeros(part.num_rows, bool)
                letters[doc[often]] = letters[doc[other]] = True
                langs = pa.array(known.languages, pa.string()).take(pa.array(lang))
                columns = [
                    pa.array(number + np.arange(part.num_rows)),
                    part.column(0),
                    pa.array(letters),
                    *[_listed(own, part.num_rows, x) for x in (langs, pa.array(above), pa.array(seen))],
                    _listed(doc[other], part.num_rows, pa.array([words[i] for i in other], pa.string())),
                    _listed(doc[other], part.num_rows, pa.array(n[other])),
                ]
                number += part.num_rows
                yield pa.RecordBatch.from_arrays(columns, schema=TALLIED)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tally, TALLIED_DDL)


def _by_grams(left: DataFrame, model: Model, lengths: list[int], scratch: Scratch) -> DataFrame:
    """``id``, ``langs`` (lang, above) of the words (``word``, ``id``) of which any n-gram of these
    lengths is known, by those of the longest such length."""

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("k", pa.int32()), ("word", pa.string()), ("times", pa.int64())])
        for batch in batches:
            rows = []
            for word, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k in lengths:
                    rows += [(i, k, g, n) for g, n in Counter(_grams(word, k)).items()]
                if len(rows) > FLUSH:
                    yield _batch(rows, schema)
                    rows = []
            yield _batch(rows, schema)

    spark = left.sparkSession
    wanted = left.select("word", "id").mapInArrow(grams_of, "id long, k int, word string, times long")
    some = [r.word for r in wanted.select("word").distinct().limit(FEW + 1).collect()]
    only = spark.sparkContext.broadcast(frozenset(some)) if len(some) <= FEW else None
    # The kept words are few files, whose n-grams are many: deal them out.
    words = model.words.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    words = words.select("word", F.inline("langs")).select("lang", "word", "n")
    grams = _by_unit(words.mapInArrow(_count_grams(lengths, only), "lang string, word string, n long"))
    met = scratch.keep(wanted.hint("merge").join(grams, "word").drop("word"), f"met-{lengths[0]}")
    if len(lengths) > 1:
        longest = met.groupBy("id").agg(F.max("k").alias("k"))
        met = met.hint("merge").join(longest, ["id", "k"])
    total = met.groupBy("id").agg(F.sum("times").alias("total"))
    sums = (
        met.select("id", "k", "times", F.inline("langs"))
        .groupBy("id", "k", "lang")
        .agg(F.sum(F.col("times") * _above_floor(F.col("n"))).alias("above"), F.sum("times").alias("times"))
        .join(_sizes(model, lengths), ["lang", "k"])
        .hint("merge")
        .join(total, "id")
        .select(
            "id",
            "lang",
            F.round((F.col("above") + F.col("times") * F.col("size")) / F.col("total")).cast("long").alias("above"),
        )
    )
    return sums.groupBy("id").agg(F.collect_list(F.struct("lang", "above")).alias("langs"))


def _unseen(words: DataFrame, model: Model, scratch: Scratch) -> list[DataFrame]:
    """``word``, ``langs`` (lang, above) of words that no language knows, by their n-grams: the
    longest first, as most words have one of these, then all shorter ones together."""
    left = scratch.keep(words.withColumn("id", F.monotonically_increasing_id()), "unseen")
    found = []
    for lengths in ([model.longest], list(range(model.longest - 1, 0, -1))):
        if not lengths or left.isEmpty():
            break
        scores = scratch.keep(_by_grams(left, model, lengths, scratch), f"grams-{lengths[0]}")
        scratch.drop(f"met-{lengths[0]}")
        found.append(left.hint("merge").join(scores, "id").select("word", "langs"))
        left = scratch.keep(left.hint("merge").join(scores, "id", "left_anti"), f"unseen-{lengths[0]}")
    return found


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: ``doc_id``, ``lang_pred``, ``score``."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(_tallied(docs, model.frequent), "rows")
    others = rows.select("row", F.inline(F.arrays_zip("others", "times"))).toDF("row", "word", "n")
    known = model.words.select(
        "word", F.transform("langs", lambda x: F.struct(x["lang"].alias("lang"), _above_floor(x["n"]).alias("above"))).alias("langs")
    )
    met = others.hint("merge").join(known, "word", "left")
    unseen = F.col("langs").isNull()
    met = scratch.keep(met.select("row", "n", F.when(unseen, F.col("word")).alias("word"), "langs"), "met")
    unknown = met.where(unseen).drop("langs")
    sums = met.select("row", "n", F.inline("langs")).select("row", "lang", (F.col("above") * F.col("n")).alias("above"), "n")
    for scored in _unseen(unknown.select("word").distinct(), model, scratch):
        # Their scores have the sizes of the languages in them already.
        by_grams = unknown.hint("merge").join(scored, "word").select("row", "n", F.inline("langs"))
        sums = sums.unionByName(
            by_grams.select("row", "lang", (F.col("above") * F.col("n")).alias("above"), F.lit(0).cast("long").alias("n"))
        )
    sums = (
        sums.unionByName(rows.select("row", F.inline(F.arrays_zip("langs", "above", "seen"))).toDF("row", "lang", "above", "n"))
        .groupBy("row", "lang")
        .agg(F.sum("above").alias("above"), F.sum("n").alias("n"))
        .join(_sizes(model, [0]), "lang")
        .withColumn("sum", F.col("above") + F.col("n") * F.col("size"))
    )
    ranked = sums.groupBy("row").agg(F.array_sort(F.collect_list(F.struct((-F.col("sum")).alias("behind"), "lang"))).alias("ranked"))
    best = F.col("ranked")[0]
    ahead = F.transform("ranked", lambda x: F.exp((best["behind"] - x["behind"]) / FIXED))
    # Languages that know none of the words stay at the floor.
    rest = (model.n_languages - F.size("ranked")) * F.exp(best["behind"] / FIXED)
    judged = ranked.select(
        "row", best["lang"].alias("lang"), (1 / (F.aggregate(ahead, F.lit(0.0), lambda a, x: a + x) + rest)).alias("chance")
    )
    some = F.col("letters") & F.lit(model.n_languages > 0)
    alike = F.lit(1 / max(model.n_languages, 1))
    return rows.select("row", "doc_id", "letters").hint("merge").join(judged, "row", "left").select(
        "doc_id",
        F.when(some, F.coalesce("lang", F.lit(model.first))).otherwise("und").alias("lang_pred"),
        F.when(some, F.coalesce("chance", alike)).otherwise(0.0).alias("score"),
    )


def held_out(doc_id: Column) -> Column:
    """Rows that the query does not learn from."""
    return crc_remainder(doc_id, 5) == 0

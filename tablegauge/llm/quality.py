"""Quality rules, and verdicts on hosts from the rules' failures.

Each document is measured by itself: words, their characters, symbols, repeated lines and
words inside repeated windows of words. The base rules fail short documents and those that
mostly repeat themselves. Failures are then counted by host; a host's rate is shrunk towards
the rate of all hosts with a beta prior fitted to the hosts by their moments, and a host
whose shrunken rate is above ``max_rate`` loses all its documents.

Everything is a column expression. Windows are compared by their 64-bit hashes within one
text; a text whose window hashes all differ needs no more than that test, and only the
others look up which windows occur again.

Defined results: null and empty texts have no word and fail; a null host is a host of its
own; an empty table gives an empty result; repeated rows count as often as they occur; long
texts are measured whole; a rate of exactly ``max_rate`` is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.text import SPACE, source_key, text_of
from tablegauge.llm.work import Scratch

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
MAX_RATE = 0.5
# Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"


def _repeat_words(words: str, window: int) -> str:
    """SQL for the words that lie in a window occurring twice or more."""
    n = f"size({words})"
    hashes = (
        f"transform(sequence(1, {n} - {window - 1}), i -> xxhash64(slice({words}, i, {window})))"
    )
    # Sorted hashes with places: windows equal to a neighbour occur more than once.
    placed = "array_sort(transform(h, (x, i) -> named_struct('h', x, 'i', i)))"
    again = (
        "transform(filter(transform(s, (x, i) -> named_struct('i', x.i, 'again',"
        " (i > 0 and s[i - 1].h = x.h) or (i + 1 < size(s) and s[i + 1].h = x.h))), x -> x.again), x -> x.i)"
    )
    covered = (
        "aggregate(p, named_struct('end', -1, 'n', 0),"
        f" (a, x) -> named_struct('end', x + {window}, 'n', a.n + x + {window} - greatest(a.end, x)), a -> a.n)"
    )

    def let(value: str, name: str, body: str) -> str:
        return f"transform(array({value}), {name} -> {body})[0]"

    counted = let(placed, "s", let(f"array_sort({again})", "p", covered))
    found = let(hashes, "h", f"if(size(array_distinct(h)) = size(h), 0, {counted})")
    return f"if({n} < {window}, 0, {found})"


def measured(docs: DataFrame, host: Column, *, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``host``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words`` of every document."""
    lines = "filter(split(text, '\\n', -1), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        host.alias("host"),
        text_of().alias("text"),
        F.filter(F.split(text_of(), SPACE), lambda w: w != "").alias("words"),
    )
    dup = f"transform(array({lines}), ls -> size(ls) - size(array_distinct(ls)))[0]"
    return rows.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.expr("aggregate(words, 0L, (n, w) -> n + length(w))").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.expr(dup).cast("long").alias("n_dup_lines"),
        F.expr(_repeat_words("words", window)).cast("long").alias("n_repeat_words"),
    )


def base_failed(min_words: int = MIN_WORDS, max_percent: int = MAX_REPEAT_PERCENT) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_percent * F.col("n_words"))


def host_verdicts(documents: DataFrame, *, max_rate: float = MAX_RATE) -> DataFrame:
    """``host``, ``docs``, ``failed``, ``rate`` (shrunken), ``host_kept``; from ``host`` and
    ``base_failed``.

    The prior's mean is the mean rate m of the hosts; its size m(1 - m)/v - 1 comes from what
    their variance v holds beyond that of chance, and is at least 1.
    """
    hosts = documents.groupBy("host").agg(
        F.count("*").alias("docs"), F.sum(F.col("base_failed").cast("long")).alias("failed")
    )
    rate = F.col("failed") / F.col("docs")
    mean, variance, chance = hosts.agg(F.avg(rate), F.var_pop(rate), F.avg(1 / F.col("docs"))).first()
    mean = 0.0 if mean is None else mean
    excess = (variance or 0.0) - mean * (1 - mean) * (chance or 0.0)
    size = mean * (1 - mean) / excess - 1 if excess > 1e-12 else 1e6
    size = max(size, 1.0)
    shrunken = (F.col("failed") + mean * size) / (F.col("docs") + size)
    return hosts.select("host", "docs", "failed", shrunken.alias("rate"), (shrunken <= max_rate).alias("host_kept"))


def judged(
    docs: DataFrame,
    *,
    host: Column | None = None,
    min_words: int = MIN_WORDS,
    max_percent: int = MAX_REPEAT_PERCENT,
    window: int = WINDOW,
    max_rate: float = MAX_RATE,
) -> DataFrame:
    """One row per document: its measures, ``base_failed``, ``host_rate`` and ``kept``.

    ``host``: a column of ``docs``; by default ``source``.
    """
    scratch = Scratch(docs.sparkSession)
    key = source_key(F.col("source") if host is None else host)
    found = measured(docs, key, window=window).withColumn("base_failed", base_failed(min_words, max_percent))
    found = scratch.keep(found, "measures")
    verdicts = scratch.keep(host_verdicts(found, max_rate=max_rate), "hosts").select(
        "host", F.col("rate").alias("host_rate"), "host_kept"
    )
    joined = found.join(verdicts, "host")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_kept")).drop("host", "host_kept")

"""Exact duplicates by distributed MSD radix partitioning.

Texts (null counts as empty) are equal when they are after every run of white space became
one space. Documents are split by successive bytes of the normalised text: the first digit
is the length and the first bytes, the next ones are ever longer byte strings. A document
that is alone in its group leaves; a group whose text has ended is a class of equal texts.
Bytes are compared as they are, so equality rests on no digest.

Digits are counted with partial aggregation, so copies collapse within each task, and group
numbers return to the documents through a merge join at every size, which adaptive execution
splits where a group is hot. Only documents that still share their group carry text into the next round.

Defined results: a null ``doc_id`` sorts after all others; of rows equal in text and id one
stays (``kept``); an empty table gives an empty result; empty texts are equal to each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.text import normalised, rows_again, text_of, whole_row
from tablegauge.llm.work import Scratch

FIRST_DIGIT = 64  # bytes, besides the length
GROWTH = 64  # of the digits, so that the rounds grow with the logarithm of the longest text


def _groups(df: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """The groups with more than one row, numbered."""
    shared = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    numbered = scratch.keep(shared.withColumn("_next", F.monotonically_increasing_id()), name)
    return numbered.hint("merge")


def radix_classes(
    docs: DataFrame,
    *,
    carry: bool = False,
    first_digit: int = FIRST_DIGIT,
    growth: int = GROWTH,
) -> tuple[DataFrame, DataFrame]:
    """The documents and the classes of equal texts among them.

    Documents: ``row`` (unique), ``doc_id``, ``sha256`` (of the normalised text),
    ``shared`` (still undecided after the first digit) and, with ``carry``, ``doc``, the whole
    input row. Classes: ``row``, ``keep_id``, ``keep_row``, ``group_size``, only of rows whose
    text occurs more than once.
    """
    scratch = Scratch(docs.sparkSession)
    text = normalised(text_of())
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("_text"),
        *([whole_row(docs).alias("doc")] if carry else []),
    )
    size = F.octet_length("_text").cast("long")
    digit = F.substring(F.col("_text").cast("binary"), 1, first_digit)
    keyed = base.withColumns({"_size": size, "_digit": digit})
    groups = _groups(keyed.select("_size", "_digit"), ["_size", "_digit"], scratch, "round-0")
    rest = F.expr(f"substring(cast(_text as binary), {first_digit + 1})")
    table = scratch.keep(
        keyed.join(groups, ["_size", "_digit"], "left").select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.sha2("_text", 256).alias("sha256"),
            F.col("_next").isNotNull().alias("shared"),
            F.col("_next").alias("_group"),
            "_size",
            F.when(F.col("_next").isNotNull(), rest).alias("_rest"),
            *(["doc"] if carry else []),
        ),
        "documents",
    )
    undecided = table.where("shared").select("row", "doc_id", "_group", "_size", "_rest")
    read, width, n = first_digit, first_digit, 0
    ended = [undecided.where(F.col("_size") <= read).select("row", "doc_id", "_group")]
    while not (undecided := undecided.where(F.col("_size") > read)).isEmpty():
        width *= growth
        n += 1
        keyed = undecided.withColumn("_digit", F.substring("_rest", 1, width))
        groups = _groups(keyed.select("_group", "_digit"), ["_group", "_digit"], scratch, f"round-{n}")
        undecided = scratch.keep(
            keyed.join(groups, ["_group", "_digit"]).select(
                "row",
                "doc_id",
                (F.col("_next") * 64 + n).alias("_group"),  # apart from the groups of other rounds
                "_size",
                F.expr(f"substring(_rest, {width + 1})").alias("_rest"),
            ),
            f"undecided-{n}",
        )
        if n > 1:
            scratch.drop(f"round-{n - 1}")
        read += width
        ended.append(undecided.where(F.col("_size") <= read).select("row", "doc_id", "_group"))
    members = ended[0].withColumn("_group", F.col("_group") * 64)
    for more in ended[1:]:
        members = members.union(more)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    leaders = members.groupBy("_group").agg(first.alias("_first"), F.count("*").alias("group_size"))
    leaders = scratch.keep(leaders, "leaders")  # read back, it is a join side of its own
    classes = members.join(leaders.hint("merge"), "_group").select(
        "row",
        F.col("_first.doc_id").alias("keep_id"),
        F.col("_first.row").alias("keep_row"),
        "group_size",
    )
    return table, classes


def exact_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id`` (the smallest id with an equal text),
    ``group_size``, ``kept``, ``text_sha256`` (of the normalised text)."""
    table, classes = radix_classes(docs, **parameters)
    return table.select("row", "doc_id", "sha256").join(classes, "row", "left").select(
        "doc_id",
        F.when(F.col("keep_row").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True)).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class of equal texts, with all columns."""
    table, classes = radix_classes(docs, carry=True, **parameters)
    dropped = classes.where(F.col("row") != F.col("keep_row")).select("row")
    alone = table.where(~F.col("shared")).select("doc")
    shared = table.where("shared").select("row", "doc").join(dropped, "row", "left_anti")
    return rows_again(alone.union(shared.select("doc")), "doc", docs)

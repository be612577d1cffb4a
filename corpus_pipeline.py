"""The corpus pipeline: from documents to packed sequences.

Each stage takes the documents that its predecessor kept, as Parquet, and returns those it
keeps; the last returns the pieces of packed sequences. A stage's table is written below the
session's checkpoint folder and read back, so a lost executor costs only running tasks.

Defined results, of every stage: null and empty texts are documents like any other (they have no
toxic passage, are copies of each other, and are packed as the end id alone); a null id or
source is one of its own; repeated rows are exact copies; long texts count whole; further
columns, of any name, are carried up to the last stage; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablegauge.llm import exact_dedup, mixing, packing, simhash, toxicity
from tablegauge.llm.work import Scratch


def toxic_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose toxic passages score 0.3 or more, as learnt from all labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of texts that are equal but for white
    space; of equal ids one."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of near duplicates; texts without
    words are near each other."""
    return simhash.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every document as often as the mix of sources wants it: not at all, or up to three
    times, as rows of their own; documents without words never."""
    return mixing.mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences; one row per piece. ``row`` tells the copies of a
    document apart that the mix took."""
    import public_tokenizers

    return packing.packed_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxic_passages),
    ("exact dedup", exact_copies),
    ("simhash near-dedup", near_copies),
    ("mixing", mixture),
    ("packing", packed_sequences),
]

# SQL expresses neither the toxicity model nor the balanced draw: tests hold each stage
# against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{n}")
        if n:
            scratch.drop(f"stage-{n - 1}")
    return docs

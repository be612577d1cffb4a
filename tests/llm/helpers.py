"""Small tables for the tests of the operators."""

from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
        # names that operators use inside or return
        StructField("row", StringType()),
        StructField("doc", StringType()),
        StructField("score", StringType()),
        StructField("fp", StringType()),
        StructField("size", StringType()),
        StructField("block", StringType()),
        StructField("kept", StringType()),
        StructField("_group", StringType()),
    ]
)
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
ROWS = [
    (1, "one two three four five six seven", "en", "a"),
    (2, "one  two\tthree four five six seven", "en", "b"),
    (3, "", "en", "a"),
    (4, None, None, None),
    (None, "no id here at all", "de", "b"),
    (5, LONG, "en", "a"),
    (6, LONG, "en", "a"),
    (7, "twice the same row", "en", "b"),
    (7, "twice the same row", "en", "b"),
    (8, "ünï cödé 日本語 😀 words", None, None),
    (9, " \n\t ", "en", "a"),
    (None, "no id here at all", "de", "b"),
]


def documents(spark, rows=ROWS):
    filled = [(*r, None if r[1] is None else len(r[1]), "x", "y", "0.5", "z", "1", "2", "k", "g") for r in rows]
    return spark.createDataFrame(filled, DOCS).repartition(3)

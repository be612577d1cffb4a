"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.sources.work import use_checkpoint_folder


class Scratch:
    """Tables of one run, in a folder of its own below ``spark.checkpoint.dir``.

    ``keep`` computes a frame once and reads it back, which cuts its lineage: a lost executor
    costs the tasks that were running, not what has been written. ``drop`` removes a table
    that nothing reads any more; what a returned frame still reads stays in the folder.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{use_checkpoint_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def ranked(df: DataFrame, scratch: Scratch, name: str, order: list[str], total: str) -> DataFrame:
    """``df`` with ``rank`` (from 0, over all rows by ``order``) and ``before``, the sum of the
    column ``total`` over the rows in front.

    Rows are dealt out by ranges of ``order``; each range is ranked by itself and starts from
    the counts of the ranges before it, one row per range.
    """
    parts = scratch.keep(
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name
    )
    from pyspark.sql import Window as W

    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        parts.groupBy("_part")
        .agg(F.count("*").alias("_n"), F.sum(total).alias("_sum"))
        .select(
            "_part",
            F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_rows_ahead"),
            F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_sum_ahead"),
        )
    )
    inside = W.partitionBy("_part").orderBy(*order)
    so_far = inside.rowsBetween(W.unboundedPreceding, -1)
    return (
        parts.join(starts, "_part")
        .withColumn("rank", F.row_number().over(inside) - 1 + F.col("_rows_ahead"))
        .withColumn("before", F.coalesce(F.sum(total).over(so_far), F.lit(0)) + F.col("_sum_ahead"))
        .drop("_part", "_rows_ahead", "_sum_ahead")
    )

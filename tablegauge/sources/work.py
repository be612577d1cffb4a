"""Where intermediate results are kept so that they survive lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def use_checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session, which has no other machines, may go without the setting; it
    uses ``checkpoints`` in its warehouse.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    context.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Computes ``df`` once and keeps it in the checkpoint folder."""
    use_checkpoint_folder(df.sparkSession)
    return df.checkpoint()

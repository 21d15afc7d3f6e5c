"""Cutting lineage through storage that survives the loss of executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for checkpoints, set on the context if it is not yet.

    It is the one the cluster names in ``spark.checkpoint.dir``. Without that setting it is a
    folder inside the warehouse (``spark.sql.warehouse.dir``), which the cluster shares as well;
    no machine-local temporary folder is ever used.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        directory = spark.conf.get("spark.checkpoint.dir", None)
        if directory is None:
            directory = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        context.setCheckpointDir(directory)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with a reliable checkpoint."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()

"""Partitioning of folds that are read many times."""

from __future__ import annotations

from pyspark.sql import DataFrame

SMALL_ROWS = 1_000_000
# Rows of a large loan book per partition.
PART_ROWS = 250_000


def spread_book(df: DataFrame, rows: int) -> DataFrame:
    """Deal the narrow rows of a loan book before wide features are made of them.

    What a scan or a join leaves can be one partition for any number of rows (the smaller
    file is broadcast, even if it holds more rows), and each pass of a fit then is one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-rows // PART_ROWS)))


def spread_small(df: DataFrame, rows: int, *, cached: bool = False) -> DataFrame:
    """Spread a small fold over the cores of the cluster.

    A small table often is one file split, and so one task in every pass of an
    iterative fit. Larger folds keep the partitions of their scan: moving them
    would cost more than it saves. A ``cached`` fold that already has enough
    partitions stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if rows > SMALL_ROWS or (cached and df.rdd.getNumPartitions() >= cores):
        return df
    return df.repartition(cores)

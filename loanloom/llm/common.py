"""What the operators of this subpackage share: tables, row keys, batch sizes, the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.operators.lineage import cut_lineage

#: White space of the word contracts, and its complement.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1024, megabytes: int = 2) -> None:
    """Bound what one Arrow batch holds, so that long texts do not fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def ranges_of(sizes: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole items of about ``limit`` bytes together, at least one item each."""
    upto = np.cumsum(sizes)
    a = 0
    while a < len(upto):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + limit, side="right")))
        yield a, b
        a = b


def row_id() -> Column:
    """A key for rows whose own ids may be null or repeat.

    It counts within the partitions of the input, so the input has to be a table scan (or
    anything else that gives the same partitions when it is read again), as every query of
    this package and every pipeline stage has it.
    """
    return F.monotonically_increasing_id()


def text_bytes(column: str = "text") -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a local master without the setting gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        cut_lineage(spark.range(1))  # sets the folder of a local master, or says what is missing
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` after a round through Parquet in the shared folder: short lineage, compressed, sized."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with underscores until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name

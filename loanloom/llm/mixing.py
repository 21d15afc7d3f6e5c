"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loanloom.llm.common import WORD, fresh, written


def word_count(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Per source its size, weight and target: ``source, size, weight, target``.

    ``sizes`` has ``source, size`` per document. Sources sort by code point, null last, and
    take the weights in turn. ``share`` times all sizes is dealt out by weight; a target
    stops at ``cap`` times the size of its source and the excess goes to the others, until
    none is above. A source of size zero gets zero. If ``share`` exceeds ``cap``, every
    source stops at its cap. Every step is an aggregate over the table of sources, which is
    sorted in ranges: no task sees all of it.
    """
    null = F.col("source").isNull()
    totals = sizes.groupBy("source").agg(F.sum("size").alias("size"))
    ranged = totals.repartitionByRange(null, "source").withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "sources")  # fixes the ranges: positions below must not move
    # one row per range, so this window holds as many rows as there are partitions
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("part").orderBy(null, "source")) + F.col("before") - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    placed = ranged.join(offsets, "part").select("source", "size", weight.alias("weight"))
    placed = written(placed, "weights")
    most = F.col("size") * F.lit(float(cap))
    whole = placed.agg(F.sum("size").alias("s"), F.sum("weight").alias("w")).first()
    budget, level, capped = share * (whole["s"] or 0), 0.0, -1
    while True:
        over = most <= F.col("weight") * F.lit(level)
        row = placed.agg(F.sum(F.when(over, most)).alias("fixed"), F.sum(F.when(~over, F.col("weight"))).alias("open"),
                         F.count(F.when(over, 1)).alias("n")).first()
        if not row["open"]:
            break
        if row["n"] == capped:
            break
        capped, level = row["n"], (budget - (row["fixed"] or 0.0)) / row["open"]
    return placed.withColumn("target", F.least(most, F.col("weight") * F.lit(level)))


#: Tables of sources up to this many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
                    seed: int = 9, column: str = "mix") -> DataFrame:
    """The documents with a struct ``mix`` of ``size, source_size, target, rate, copies``.

    The rate of a source is its target over its size; a document is emitted floor(rate)
    times, and once more with probability equal to the fraction, drawn from a digest of the
    seed, the document id and the text, so that reruns agree. Rows that repeat an id and
    text get the same draw. Null and empty texts have size 0 and are emitted like others
    (copies count documents, size counts words). A column of ``docs`` named ``column`` is
    replaced, all others stay. Empty input, empty result.
    """
    docs = docs.withColumn(column, word_count(F.col("text")))
    targets = source_targets(docs.select("source", F.col(column).alias("size")), weights, share, cap)
    targets = targets.select(F.struct("source", "size", "target").alias(other := fresh("from_source", docs.columns)))
    if targets.count() <= BROADCAST_SOURCES:  # a source name and two numbers each: a few MB
        targets = F.broadcast(targets)
    joined = docs.join(targets, docs["source"].eqNullSafe(targets[other]["source"]), "left")
    source_size, target = F.col(other)["size"], F.col(other)["target"]
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                      F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    draw = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    copies = F.floor(rate).cast("int") + (draw < rate - F.floor(rate)).cast("int")
    return joined.withColumn(column, F.struct(F.col(column).alias("size"), source_size.alias("source_size"),
                                              target.alias("target"), rate.alias("rate"), copies.alias("copies"))).drop(other)


def emit_copies(docs: DataFrame, **options) -> DataFrame:
    """Each document as often as the mix takes it, with the columns of the documents."""
    name = fresh("mix", docs.columns)
    mixed = mixed_documents(docs, column=name, **options).where(F.col(name)["copies"] > 0)
    return mixed.withColumn(name, F.explode(F.sequence(F.lit(1), F.col(name)["copies"]))).select(*docs.columns)

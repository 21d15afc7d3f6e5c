"""Ranked lexical search by bag deduplication.

Documents are cut down to the vocabulary of the items searched for. Documents whose cut-down
bags of terms (term frequencies) and length factor ``m`` are equal score alike for every
item, so they form one class: classes are found by a hash of (bag, m), and equality is
verified by grouping on the full value under that hash. Each class is scored once against
every item; the best classes of an item are then expanded into their members by ascending
doc_id.

Integer scoring (``w``, ``m``, the saturated term frequency) follows the contract of the query;
the per-term weight is the only double.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loanloom.llm.common import fresh, row_id, written

# The term pattern of the contract (maximal runs of anything but ASCII
# punctuation, symbols, space and control characters) and the letters lower-cased.
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The same pattern over UTF-8 bytes: every byte from 0x80 up belongs to a term, as its character does.
TERM_BYTES = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

#: Bytes up to which a table of item terms is broadcast; beyond, it is joined salted.
BROADCAST_BYTES = 32 << 20
#: Salts of the shuffled join with the item terms when that table is too large to broadcast.
SALTS = 32


def terms(text: Column) -> Column:
    """Terms of a text in order, repeats kept; null has none."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), 0), F.array().cast("array<string>"))


def _fits(df: DataFrame) -> bool:
    """Whether a small table is small enough to broadcast: its rows measured in bytes, not guessed."""
    row = sum(F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) + 16 for c in df.columns)
    size = df.agg(F.coalesce(F.sum(row), F.lit(0)).alias("b")).first()["b"]
    return size <= BROADCAST_BYTES


def _joined(big: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """``big`` joined to ``small`` on ``key``: broadcast if its measured size allows, else salted."""
    if _fits(small):
        return big.join(F.broadcast(small), key)
    salt = fresh("salt", big.columns + small.columns)
    spread = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mixed = big.withColumn(salt, F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)).cast("int"))
    return mixed.join(spread, [key, salt]).drop(salt)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best documents of every item: ``item_id, rank, doc_id, score``.

    ``docs`` has ``doc_id, text``, ``items`` has ``item_id, text``; other columns are ignored,
    whatever their names. Every row of ``docs`` is a document, so repeated doc_ids are separate
    documents (both may be returned, with equal doc_id); a null doc_id is a document too and sorts
    after all others among equal scores. A null or termless text has no terms: it is not counted
    in N and never scores. Texts are read whole, however long. An item with a null id is searched
    like any other; an item without terms, or whose documents all score 0, returns no rows. Only
    scores above 0 are returned; equal scores go by ascending doc_id, and equal doc_ids in an
    arbitrary but fixed order (ranks stay unique). Empty ``docs`` or ``items``: no rows.

    Cost: every text is tokenized once. With a vocabulary of the items whose size in bytes is
    measured to fit ``BROADCAST_BYTES``, each document's bag of item terms is counted in the row
    itself (no shuffle); a larger vocabulary is numbered in Spark and the terms are exploded and
    joined salted. The bags are written once; a class with a third of all rows is cut to its
    first ``k`` members before the shuffle by Spark's window group limit, as is each item's top ``k``.
    """
    rk = fresh("rk", docs.columns)
    item_terms = (items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms(F.col("text"))).alias("term"))
                  .distinct())
    vocabulary = written(item_terms.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), "vocabulary")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(rk, row_id())
    if _fits(vocabulary):
        index = {t.encode("utf-8"): i for t, i in vocabulary.collect()}
        bags = base.mapInPandas(_counted(index, rk), f"{rk} long, doc_id long, n long, ids array<long>, tfs array<long>")
    else:
        bags = _counted_in_spark(base, vocabulary, rk)
    bags = written(bags, "bags")
    totals = bags.agg(F.count(F.when(F.col("n") > 0, 1)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    n_docs, n_terms = int(totals["N"]), int(totals["L"])
    if n_docs == 0:
        return _empty(docs)

    # m = 100 - 90 + (90 * n * N) div L, in 64-bit integers
    bags = bags.where(F.size("ids") > 0).withColumn("m", F.lit(10) + F.expr(f"(90 * n * {n_docs}L) div {n_terms}L"))
    df = bags.select(F.explode("ids").alias("tid")).groupBy("tid").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    weighted = item_terms.join(vocabulary, "term").join(df.select("tid", weight.alias("w")), "tid").select("item_id", "tid", "w")

    bags = bags.withColumn("h", F.xxhash64("ids", "tfs", "m"))
    same = ["h", "ids", "tfs", "m"]  # equal hash, then equal value: the class is verified, not assumed
    first = F.row_number().over(W.partitionBy(*same).orderBy(F.col("doc_id").asc_nulls_last(), rk))
    members = bags.withColumn("place", first).where(F.col("place") <= k)
    members = members.withColumn("cid", F.min(F.when(F.col("place") == 1, F.col(rk))).over(W.partitionBy(*same)))
    classes = members.where("place = 1").select("cid", F.col("doc_id").alias("first_doc"), "m",
                                                 F.explode(F.arrays_zip("ids", "tfs")).alias("p"))
    classes = classes.select("cid", "first_doc", "m", F.col("p.ids").alias("tid"), F.col("p.tfs").alias("tf"))

    share = F.expr("w * ((1000000000L * tf) div (1000L * tf + 8L * m))")
    scored = (_joined(classes, weighted, "tid").groupBy("item_id", "cid", "first_doc").agg(F.sum(share).alias("score"))
              .where("score > 0"))
    best = W.partitionBy("item_id").orderBy(F.desc("score"), F.col("first_doc").asc_nulls_last(), "cid")
    top = scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r", "first_doc")
    expanded = top.join(members.select("cid", "doc_id", F.col(rk)), "cid")
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), rk)
    ranked = expanded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def _counted(index: dict[bytes, int], rk: str):
    """Per document: its number of terms and the sorted ids and counts of the item terms it holds."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ns, ids, tfs = [], [], []
            for text in b["text"]:
                words = TERM_BYTES.findall(text.encode("utf-8").lower()) if isinstance(text, str) else []
                found = sorted((index[w], c) for w, c in Counter(words).items() if w in index)
                ns.append(len(words))
                ids.append([i for i, _ in found])
                tfs.append([c for _, c in found])
            yield pd.DataFrame({rk: b[rk], "doc_id": b["doc_id"].astype("Int64"), "n": ns, "ids": ids, "tfs": tfs})
    return count


def _counted_in_spark(base: DataFrame, vocabulary: DataFrame, rk: str) -> DataFrame:
    """What ``_counted`` gives, for a vocabulary too large to send to every task."""
    tokens = base.select(rk, "doc_id", terms(F.col("text")).alias("t")).withColumn("n", F.size("t").cast("long"))
    found = (_joined(tokens.select(rk, "doc_id", "n", F.explode("t").alias("term")), vocabulary, "term")
             .groupBy(rk, "doc_id", "n", "tid").agg(F.count("*").alias("tf")))
    bags = (found.groupBy(rk, "doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("tid", "tf"))).alias("b"))
            .select(rk, "doc_id", "n", F.col("b.tid").alias("ids"), F.col("b.tf").alias("tfs")))
    empty = F.array().cast("array<long>")
    return tokens.select(rk, "doc_id", "n").join(bags.drop("doc_id", "n"), rk, "left").select(
        rk, "doc_id", "n", F.coalesce("ids", empty).alias("ids"), F.coalesce("tfs", empty).alias("tfs"))


def _empty(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")

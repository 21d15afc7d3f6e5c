"""From raw documents to sampled token ids: the stages of the training-data pipeline."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loanloom.llm import langid, mixing, pieces, simhash, suffix
from loanloom.llm.common import shared_folder, table


#: A language whose score is below this is not taken as known.
LEAST_LANGUAGE_SCORE = 0.4
#: Bytes of a string that has to be somewhere else, too, to be removed.
REPEATED_BYTES = 200
#: Vocabulary and number of segmentations of each text.
TOKENIZER, SAMPLES = "/opt/tokenizers/piece_bpe_32k.model", 2


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter and of no clear language go; the network learns from the documents it gets."""
    return langid.keep_known(docs, langid.fit(docs), LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return simhash.drop_near_duplicates(docs, shingle=3, max_bits=2)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated strings go; ``n_chars`` follows the text, and a text may end up empty."""
    return suffix.drop_repeats(docs, REPEATED_BYTES)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out until the sources have their target weights."""
    return mixing.emit_copies(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every text, decoded again as a check."""
    return pieces.checked_samples(docs.select("doc_id", "lang", "source", "text"), TOKENIZER, SAMPLES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("source_mixing", mix),
    ("piece_sampling", encode),
]

#: The stages use a trained model, XXH64 and a search over a lattice: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a directory, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

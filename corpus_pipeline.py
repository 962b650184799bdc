"""Filters a corpus and packs it: toxicity, language, near-duplicates, windows of token ids.

Every stage takes the documents its predecessor kept, as they were written, and returns those it
keeps with the columns they came with; the last one returns the pieces of the packed windows.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from revlens.llm import language, packing, parity_join, toxicity
from revlens.session import shared_folder


# Mean probability of "no language" over a text's windows from which the language stage drops it.
REJECT_SCORE = 0.95
BATCH_BYTES = 4 << 20
# Words remembered while packing: fewer than by default, as the processes have run the other stages too.
PACK_WORDS = 600_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain doesn't call toxic."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, but for those that a network learned from the corpus's own labels calls
    text in no language, with a score of ``REJECT_SCORE`` or more. Without labels all with letters stay."""
    return language.drop_unknown(docs, language.fit(docs, junk=True), REJECT_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, similarity of 0.8 or more."""
    return parity_join.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2,048 token ids."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), word_limit=PACK_WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given = spark.conf.get(_BATCH_SETTING)
    # Smaller Arrow batches while the stages run: texts of one batch are in memory several times.
    spark.conf.set(_BATCH_SETTING, BATCH_BYTES)
    try:
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    finally:
        spark.conf.set(_BATCH_SETTING, given)
    return docs

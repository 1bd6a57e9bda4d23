"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Stages but the
last return the columns of ``documents``; each result is written as Parquet to the shared
folder and read again, so a lost executor costs a stage's tasks, not the stages before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomline.llm import decontaminate, language_id, ngram_join, packing, substring_dedup
from fathomline.llm.frames import read_table
from fathomline.scratch import Scratch


def name_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language the model, trained on their labels, can't name with confidence."""
    return language_id.keep_named(docs, language_id.train(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group linked by shared 5-word shingles."""
    return ngram_join.keep_one(spark, docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that repeat an earlier document's."""
    return substring_dedup.remove(spark, docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of ten words of a benchmark item."""
    return decontaminate.remove(docs, read_table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048 tokens."""
    return packing.pack(spark, docs)


STAGES = [
    ("language_id", name_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("best_fit_packing", pack_sequences),
]

#: Language identification and chaining can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    store, docs = Scratch(spark, "pipeline"), read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = store.save(stage(spark, docs, sf_dir), name)
        if i:
            store.drop(STAGES[i - 1][0])
    return docs

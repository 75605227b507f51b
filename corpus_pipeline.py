"""From raw documents to packed training sequences: five stages, each written before the next reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loadcurve.llm.columns import table
from loadcurve.llm.decision_list import keep_good
from loadcurve.llm.packing import packed_sequences
from loadcurve.llm.simhash import keep_one_of_each_group
from loadcurve.llm.suffix_repeats import texts_without_repeats
from loadcurve.llm.toxicity import keep_civil
from loadcurve.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_civil(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return texts_without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_sequences(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("toxicity", toxicity),
    ("simhash_near_duplicates", near_duplicates),
    ("suffix_repeats", repeated_passages),
    ("best_fit_packing", packing),
]
# Learned rules, tokenizers and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        place = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return STAGES[-1][1](spark, docs, sf_dir)

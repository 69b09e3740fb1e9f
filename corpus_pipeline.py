"""A training corpus from documents: five stages, each one of the operators in tessera.llm on all that the stage before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, neardup, packing, quality, substrings
from tessera.llm.common import written
from tessera.session import read

#: A repeated passage: a run of strings of so many bytes that stand elsewhere too, if it holds more than fifty whole words.
#: Of the stretches of 51 words in test documents seven in ten thousand are shorter, runs of very short words.
PASSAGE_BYTES, PASSAGE_WORDS = 150, 51


def measured(docs: DataFrame) -> DataFrame:
    """n_chars as the text now has them."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts have the score of the bias; without labels every score is
    0.5 and all stay; repeated rows stay or go alike; an empty table stays empty."""
    return quality.accepted(docs, read(spark, sf_dir, "labels"), threshold=0.3, folds=5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id. Null texts, texts without words and null ids are nobody's
    copy; rows that share an id stay or go together."""
    return neardup.keep_one(docs, shingle=5, threshold=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of more than fifty words that stand anywhere else too, in all places; what repeats in shorter runs
    stays. Repeated rows are copies of each other; documents of which only white space is left go; null texts stay null."""
    return measured(substrings.remove_repeats(docs, length=PASSAGE_BYTES, min_words=PASSAGE_WORDS))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages (ten words of an item in a row), and none of which more than half of the words are benchmark.
    Null texts stay; items without words count for nothing; without items all documents stay as they are."""
    return measured(decontaminate.remove(docs, read(spark, sf_dir, "benchmark"), window=10, max_coverage=0.5))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences. Null and empty texts are one end token; repeated rows are
    packed each by itself."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("quality_classifier", quality_filter),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_passages),
    ("best_fit_packing", pack),
]

#: Connected components, learnt weights and token ids are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on documents, each result written and read again for the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}

ORACLE: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

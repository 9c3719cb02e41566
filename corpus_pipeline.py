"""From documents to piece ids: reject toxic ones, keep one of near duplicates, cut repeated bytes, drop leaked test items, encode.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the
next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytable.fixtures import table
from skytable.llm import decontamination, minhash_dedup, sentencepiece_codec, suffix_dedup, toxicity
from skytable.session import materialize


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifiers, fitted to all labels, do not call toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.keep_clean(docs, materialize(model))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group linked by a resemblance of 0.8 or more in shingles of five words."""
    return minhash_dedup.keep_one(docs, width=5, percent=80)


def cut_repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings of 400 bytes that also start elsewhere."""
    return suffix_dedup.keep_once(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, and the text that they decode to."""
    vocabulary = sentencepiece_codec.Vocabulary()
    decoded = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, vocabulary), vocabulary)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "text")


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash_near_dedup", keep_one_of_near_duplicates),
    ("suffix_array_dedup", cut_repeated_bytes),
    ("benchmark_decontamination", drop_leaked),
    ("sentencepiece", encode),
]

# Learned scores, signatures and byte ranges have no SQL form; tests compare stages with plain programs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs

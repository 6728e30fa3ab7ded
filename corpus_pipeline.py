"""From raw documents to a mixed, encoded corpus, in five stages.

Each stage is (name, function); the function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowforge.llm.common import materialise, scratch, word_count
from rowforge.llm.exact_dedup import drop_copies
from rowforge.llm.mixing import mixed_documents
from rowforge.llm.near_dedup import drop_near_copies
from rowforge.llm.quality import drop_poor
from rowforge.llm.sentencepiece_match import encode


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and very short texts go; repeated rows are judged alike; no rows give none."""
    return drop_poor(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id.

    A null text equals an empty one; a null doc_id loses to all others; of rows that repeat both, one stays.
    """
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the one with the smallest doc_id.

    Texts without words and rows without a doc_id stay. Rows that repeat the doc_id that stays all stay.
    """
    return drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weights 1, 2, 3, repeating: a document as often as the mix takes it, shuffled within shards.

    A null source is one of its own, the last. Equal rows and rows without a doc_id are drawn one by one.
    """
    return mixed_documents(docs, "source", word_count(F.col("text")), [F.col("doc_id")])


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, instead of its text; none for a null or empty text. Every row stays."""
    return encode(docs, carry=[c for c in docs.columns if c != "text"])


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("piece_ids", piece_ids),
]

#: Consistent weighted sampling and piece ids have no SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage leaves besides its result goes with the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch():
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}", lasting=True)
    return docs

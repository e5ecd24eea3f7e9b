"""From documents to token ids: stages of the training-data pipeline.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last keep the columns
of documents, whatever further ones there are. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimloom.llm import bpe, exact_dedup, jaccard_join, mixing, quality
from claimloom.llm.common import crc_mod, stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    A null or empty text is scored like any other; repeated rows go or stay together.
    """
    return quality.drop_poor(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) == 0)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id.

    Null counts as empty, and a null doc_id is the smallest; of repeated rows one stays.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the one with the smallest doc_id.

    Rows without words or doc_id stay; equal rows stay or go together.
    """
    return jaccard_join.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them.

    A text without words (null, empty) is taken by no target; a null source is one of its own.
    """
    return mixing.repeat_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids of each document, their number, and digests of them and of the text that they decode to.

    A null or empty text has no ids; repeated rows give equal rows.
    """
    return bpe.digests(docs, ids=True)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode_tokens),
]
#: The classifier's fit and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

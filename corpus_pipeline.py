"""From raw documents to packed training sequences: each stage is one operator of mediaframe.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.

Every stage passes an empty table on as an empty one, takes repeated rows as documents of their own, and keeps
columns beside those it reads, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mediaframe.llm import language, mixing, near_dup, packing, suffix_dedup
from mediaframe.llm.common import materialize, read


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null and empty texts, and texts without a letter. Null lang and source are kept."""
    return language.keep_known(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one with the smallest doc_id; of rows that repeat it, one.

    Texts without words are classes of their own.
    """
    return near_dup.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur more than once go from every text; null and shorter texts stay as they are."""
    return suffix_dedup.rewrite(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, not at all to twice; null source is a source, null text has no words."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and offsets; null and empty texts are one token, long texts several pieces."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Tokenizing and the classifiers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

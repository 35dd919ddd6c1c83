"""The corpus pipeline: from raw documents to packed sequences, in five stages.

Each stage takes the documents its predecessor left and returns a DataFrame, which is written as Parquet and read
again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelry.llm import minhash_dedup, mixing, packing, quality, queries, suffix_dedup
from panelry.llm.shared import saved, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a similarity of 0.8 or more."""
    return minhash_dedup.drop_near_duplicates(docs, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes or more that an earlier document has."""
    return suffix_dedup.without_repeats(docs, length=50)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs, weights=(5, 2, 1), share=1.5)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs, queries.TOKENIZER, queries.RANKS, queries.public_tokenizers.PATTERN, capacity=2048)


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", packed_sequences),
]

#: The learned quality classifier is not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs

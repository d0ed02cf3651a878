"""A training-data pipeline over documents: toxic documents go, near copies go, repeated passages go, sources are mixed, the rest is packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Each
is written as Parquet and read again as the next one's docs, so a stage's decisions are made once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import mixing, packing, simhash, suffixes, toxicity
from textloom.llm.common import shared_dir
from textloom.sources import tables


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; null and empty texts stay. See toxicity.keep."""
    return toxicity.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 0.8 of their five-word shingles the smallest doc_id stays; texts without words are one group. See simhash.dedup."""
    return simhash.dedup(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that a smaller doc_id has too go; a document goes if no word is left. See suffixes.dedup."""
    return suffixes.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is brought to its target of words: documents are left out or repeated, up to three times. See mixing.take."""
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece of each document, packed into sequences of 1024 tokens; a null or empty text is one end token. See packing.pack."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models, fingerprints and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs

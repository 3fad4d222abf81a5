"""A training-data pipeline over ``documents``: five stages, each by one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes
as Parquet into the shared folder and reads again as the next one's docs.  All
but the last return the columns of documents, whatever more there are; the last
returns the packed pieces.  An empty table passes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corrobora.llm import langid, mixing, packing, pii, simhash
from corrobora.llm.common import cut, free, read


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts and those without a letter.  Ids may be null or repeated."""
    return langid.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest id stays.  Rows that repeat an id are kept once, rows without one all."""
    return simhash.keep_one(docs)


def replace_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become surrogates; every row stays, null texts stay null."""
    return pii.anonymised(docs, pii.configured_key(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are thinned or repeated to their targets; null is a source, rows that repeat an id are in or out together."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces in sequences; a null text is its end token alone, null ids stay null."""
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("PII surrogates", replace_private_data),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL can express neither the trained model nor the tokenizer; tests hold ``run`` against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, cut(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        free(before)  # what a stage has written goes when the next one has
    return docs

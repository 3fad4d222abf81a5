"""Registered queries of the subpackage, with DuckDB twins where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import langid, media, mixing, packing, pii, runindex, sharding, simhash, topk, toxicity
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": lambda spark, d: mixing.mix(read(spark, d, "documents")),
    "op2_toxicity": lambda spark, d: toxicity.report(read(spark, d, "documents"), read(spark, d, "labels")),
    "op3_pii_surrogates": lambda spark, d: pii.surrogates(read(spark, d, "documents"), pii.configured_key(spark)),
    "op4_simhash": lambda spark, d: simhash.report(read(spark, d, "documents")),
    "op5_sharding": lambda spark, d: sharding.report(read(spark, d, "documents")),
    "op6_language_id": lambda spark, d: langid.identify(read(spark, d, "documents")),
    "op7_exact_topk": lambda spark, d: topk.report(read(spark, d, "embeddings")),
    "op8_packing": lambda spark, d: packing.pack(read(spark, d, "documents")),
    "op9_run_index": lambda spark, d: runindex.report(read(spark, d, "documents")),
    "op10_media_copies": lambda spark, d: media.report(read(spark, d, "embeddings")),
}

ORACLES: dict[str, str] = {"op1_mixing": mixing.ORACLE, "op7_exact_topk": topk.ORACLE}

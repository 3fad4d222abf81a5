"""Structured Streaming: pages that arrive are extracted, stored and reconciled batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..operators import extraction, store
from ..operators import facts as ops
from ..sources.readers import TABLES

PAGES = f"document_id STRING, page_number INT, raw_text STRING, tables {TABLES}"
#: Folders that the facts are dealt to by their document; a batch rewrites those it touches.
BUCKETS = 64


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of pages from JSON files that are put into a folder."""
    return spark.readStream.schema(PAGES).json(folder)


def ingest(stream: DataFrame, root: str, checkpoint: str, corpus: str | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Extract each batch, upsert its facts under ``root/facts`` and derive the relationships of the corpora it touches.

    Facts lie in folders by a hash of their document, relationships by their
    corpus; a batch rewrites the folders it touches and no others.  Of facts with
    one id the one extracted last counts.  A batch that is repeated after a failure
    writes the same rows again, so every page counts once.
    """

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = extraction.extract(batch, ordered=True).withColumn("corpus", F.lit(corpus).cast("string"))
        new = ops.enrich(found).withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int"))
        new = staged(new, f"{root}/staging/new")
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most as many as buckets
        if not touched:
            return
        old = facts(spark, root)
        rows = store.keep_last(new, ["fact_id"], "seq").drop("seq") if old is None else store.upsert(old.where(F.col("bucket").isin(touched)), new, ["fact_id"], "seq")
        replaced(staged(rows, f"{root}/staging/facts"), f"{root}/facts", "bucket")
        affected = facts(spark, root).join(new.select("corpus").distinct(), "corpus", "left_semi")
        rel = ops.relationships(ops.explained(ops.gate(ops.pairs(affected))))
        replaced(rel, f"{root}/relationships", "corpus")

    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def staged(df: DataFrame, path: str) -> DataFrame:
    """Written and read again, since what replaces a folder may have been read from it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replaced(df: DataFrame, path: str, by: str) -> None:
    """Replace the folders of the values of ``by`` that occur; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def facts(spark: SparkSession, root: str) -> DataFrame | None:
    """The facts stored so far; None before the first."""
    return _read(spark, f"{root}/facts")


def relationships(spark: SparkSession, root: str) -> DataFrame | None:
    """The relationships of the facts stored so far; None before the first."""
    return _read(spark, f"{root}/relationships")


def request_rate(events: DataFrame, window: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Events by window and type, with a watermark for late ones."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")

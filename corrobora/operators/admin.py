"""The catalogue of documents and what keeps a store in order: corpora, backfill, upsert, reset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

#: A document: metadata is JSON.
DOCUMENT = "doc_id string, filename string, file_path string, total_pages int, checksum_sha256 string, ingested_at timestamp, metadata string, corpus string"


def given(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def by_name(filename: Column) -> Column:
    """The corpus that a file's name tells."""
    low = F.lower(filename)
    return F.when(low.contains("delhivery"), "Delhivery").when(low.rlike("india|rbi|economic survey|imf"), "India Macroeconomics").otherwise("General Knowledge")


def document_corpus(explicit: str | None = None) -> Column:
    """An explicit corpus, the document's, its metadata's corpus or corpus_label, else by its name."""
    meta = lambda k: F.get_json_object("metadata", f"$.{k}")
    return given(F.lit(explicit), F.col("corpus"), meta("corpus"), meta("corpus_label"), by_name(F.col("filename")))


def inserted(documents: DataFrame, explicit: str | None = None) -> DataFrame:
    """Documents as they are stored: with their corpus, which their metadata carry too; metadata that can't be read start anew."""
    held = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    corpus = document_corpus(explicit)
    kept = F.map_filter(held, lambda k, v: k != "corpus")
    return documents.withColumns({"corpus": corpus, "metadata": F.to_json(F.map_concat(kept, F.create_map(F.lit("corpus"), corpus)))})


def upsert_documents(old: DataFrame, new: DataFrame, explicit: str | None = None, sequence: str = "ingested_at") -> DataFrame:
    """New documents replace old ones of their doc_id; of several new ones the last counts."""
    return store.upsert(old, inserted(new, explicit), ["doc_id"], sequence)


def listed_documents(documents: DataFrame, corpus: str | None = None) -> DataFrame:
    """Documents, the newest first, with their corpus or what their metadata and name tell of it."""
    rows = store.of_corpus(documents, corpus).withColumn("corpus", document_corpus())
    return rows.orderBy(F.col("ingested_at").desc_nulls_last(), "doc_id")


#: Of which columns a missing corpus is told, by table.
TELLING = {"documents": ("filename",), "facts": ("entity",), "relationships": ("summary", "reasoning"), "failures": ("source_document",)}


def backfilled(table: DataFrame, kind: str) -> DataFrame:
    """Rows whose corpus is missing get one of the two default corpora; a table without the column gets it."""
    held = table if "corpus" in table.columns else table.withColumn("corpus", F.lit(None).cast("string"))
    named = [F.lower(F.coalesce(c, F.lit(""))).contains("delhivery") for c in TELLING[kind]]
    told = named[0] if len(named) == 1 else named[0] | named[1]
    return held.withColumn("corpus", F.coalesce("corpus", F.when(told, "Delhivery").otherwise("India Macroeconomics")))


def page_totals(pages: DataFrame) -> DataFrame:
    """(document_id, pages_parsed, total_tables, total_images) of parsed pages with arrays ``tables`` and ``images``."""
    n = lambda c: F.sum(F.when(F.col(c).isNull(), 0).otherwise(F.size(c))).cast("long")
    return pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("pages_parsed"), n("tables").alias("total_tables"), n("images").alias("total_images"))


def row_counts(corpus: str | None = None, **tables: DataFrame) -> DataFrame:
    """(what, n) for each table, of one corpus or of all."""
    counts = [store.of_corpus(t, corpus).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n") for what, t in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def purged(files: DataFrame, starters: Sequence[str]) -> DataFrame:
    """The uploaded files (filename, ...) that are no starter's: what a reset deletes."""
    return files.where(~F.col("filename").isin(list(starters)))


def reset(documents: DataFrame, facts: DataFrame, starters: Sequence[str], cache: DataFrame, cached_facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and facts of the starters alone: others go, missing ones come from the cache with their facts.

    documents and cache: at least (doc_id, filename, corpus); facts name their
    document by document_id.  Relationships and failures are derived anew from what
    is returned, so they need no deletion of their own.
    """
    kept = documents.where(F.col("filename").isin(list(starters)))
    missing = cache.where(F.col("filename").isin(list(starters))).join(kept.select("filename"), "filename", "left_anti")
    corpus = F.when(F.lower("filename").contains("delhivery"), "Delhivery").otherwise("India Macroeconomics")
    restored = missing.select(*[corpus.alias(c) if c == "corpus" else F.col(c) for c in documents.columns])
    stay = facts.join(kept.select(F.col("filename").alias("document_id")), "document_id", "left_semi").select(*facts.columns)
    back = cached_facts.join(missing.select(F.col("filename").alias("document_id")), "document_id", "left_semi").select(*facts.columns)
    return kept.unionByName(restored), stay.unionByName(back)

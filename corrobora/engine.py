"""The engine: one object over a session, with a method for each thing a user asks of a corpus."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import admin, answers, consensus, extraction, store
from .operators import facts as ops
from .sources import readers


class Engine:
    """Facts, documents and what is derived from them.

    facts: raw facts (corpus, entity, metric, document_id, page_number, value, raw_value,
    temporal_period, reporting_scope, unit, verbatim_quote, confidence_score).
    documents: (doc_id, filename, corpus).  Derived tables are lazy; ``facts`` is
    kept in memory and on disk since everything starts from it.
    """

    def __init__(self, spark: SparkSession, facts: DataFrame, documents: DataFrame | None = None) -> None:
        self.spark = spark
        self.facts = ops.enrich(facts).persist(StorageLevel.MEMORY_AND_DISK)
        self.documents = documents if documents is not None else self.facts.select(F.col("document_id").alias("filename"), "corpus").groupBy("filename").agg(F.min("corpus").alias("corpus")).withColumn("doc_id", F.col("filename"))

    @classmethod
    def from_pages(cls, pages: DataFrame, corpus: str | None = None, clients: Sequence[Callable[[str], str]] = (), entity: str | None = None) -> Engine:
        """Extract the facts of pages (document_id, page_number, raw_text, tables), by the rules and what clients answer; entity replaces a generic one."""
        found = answers.extracted(pages, list(clients)) if clients else extraction.extract(pages)
        return cls(pages.sparkSession, answers.named_entity(found, entity or "").withColumn("corpus", F.lit(corpus).cast("string")))

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str, corpus: str | None = None, max_pages: int | None = None) -> Engine:
        return cls.from_pages(readers.text_pages(spark, folder, max_pages), corpus)

    def reconciliations(self, verdict: str | None = None) -> DataFrame:
        out = ops.explained(ops.gate(ops.pairs(self.facts)))
        return out if verdict is None else out.where(F.col("verdict") == verdict)

    def relationships(self, verdict: str | None = None, corpus: str | None = None) -> DataFrame:
        return store.relationships(ops.relationships(self.reconciliations()), verdict, corpus)

    def audited(self, include_canonical: bool = True) -> DataFrame:
        """All failures with their corpus, in no order."""
        return store.attribute(consensus.corpus_audit(self.facts, include_canonical), self.documents)

    def failures(self, failure_type: str | None = None, corpus: str | None = None, include_canonical: bool = True, source_document: str | None = None) -> DataFrame:
        out = store.of_corpus(self.audited(include_canonical), corpus)
        out = out if failure_type is None else out.where(F.col("failure_type") == failure_type)
        out = out if source_document is None else out.where(F.col("source_document") == source_document)
        return out.orderBy("source_document", "page_number")

    def consensus(self) -> DataFrame:
        return consensus.consensus(self.facts).orderBy(F.desc("doc_count"), "metric")

    def list_documents(self, corpus: str | None = None) -> DataFrame:
        held = self.documents
        for c, kind in (("ingested_at", "timestamp"), ("metadata", "string"), ("corpus", "string")):
            held = held if c in held.columns else held.withColumn(c, F.lit(None).cast(kind))
        return admin.listed_documents(held, corpus)

    def disclosures(self) -> DataFrame:
        return consensus.disclosures(self.facts)

    def showcase(self) -> DataFrame:
        return consensus.showcase(ops.gate(ops.pairs(self.facts)), self.facts)

    def failure_example(self) -> DataFrame:
        """What a showcase without a failing pair shows instead."""
        return consensus.failure_example(self.facts)

    def list_facts(self, entity: str | None = None, metric: str | None = None, limit: int = 50) -> DataFrame:
        return store.listed(self.facts, entity, metric, limit)

    def search(self, text: str, limit: int = 10) -> DataFrame:
        return store.search(self.facts, text, limit)

    def fact(self, fact_id: str) -> DataFrame:
        return store.by_id(self.facts, fact_id)

    def document_facts(self, document_id: str) -> DataFrame:
        return store.of_document(self.facts, document_id)

    def linked(self) -> DataFrame:
        return store.linked(self.facts, ops.relationships(ops.gate(ops.pairs(self.facts))))

    def standalone(self) -> DataFrame:
        return store.standalone(self.facts, ops.relationships(ops.gate(ops.pairs(self.facts))))

    def corpora(self) -> DataFrame:
        return store.corpora(self.facts, self.documents)

    def counts(self) -> DataFrame:
        return store.counts_by_verdict(ops.relationships(ops.gate(ops.pairs(self.facts))))

    def page(self, order: Sequence[str], number: int, size: int = 25, descending: bool = False) -> DataFrame:
        return store.page(self.facts, [F.desc(c) if descending else F.asc(c) for c in order], number, size)

    def sync(self, root: str) -> None:
        """Write the derived tables; each is replaced as a whole."""
        rel = store.keep_last(ops.relationships(self.reconciliations()), ["relationship_id"], "confidence")  # facts that differ by period only share an id
        rel.write.mode("overwrite").partitionBy("corpus").parquet(f"{root}/relationships")
        self.audited().write.mode("overwrite").parquet(f"{root}/failures")
        consensus.consensus(self.facts).write.mode("overwrite").parquet(f"{root}/consensus")

    def create_views(self) -> None:
        """Temporary views documents_cat, facts, relationships, failures and consensus for SQL."""
        for name, df in (("documents_cat", self.documents), ("facts", self.facts), ("relationships", self.relationships()), ("failures", self.failures()), ("consensus", self.consensus())):
            df.createOrReplaceTempView(name)

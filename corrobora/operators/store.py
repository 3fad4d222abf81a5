"""The store's relational operators over facts, documents, relationships and failures."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def of_corpus(df: DataFrame, corpus: str | None) -> DataFrame:
    return df if corpus is None else df.where(F.lower("corpus") == corpus.lower())


def like(column: str, text: str) -> Column:
    """Lower-cased containment; % and _ in the text keep their meaning."""
    return F.lower(column).like(f"%{text.lower()}%")


def with_documents(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Facts with the name of their document, or its id where the catalogue lacks it."""
    d = documents.select(F.col("filename").alias("document_id"), "doc_id")
    return facts.join(d, "document_id", "left").withColumn("document_key", F.coalesce("doc_id", "document_id"))


def by_entity(facts: DataFrame, text: str, corpus: str | None = None) -> DataFrame:
    return of_corpus(facts, corpus).where(like("entity", text)).orderBy("metric", "page_number")


def by_metric(facts: DataFrame, text: str, corpus: str | None = None) -> DataFrame:
    return of_corpus(facts, corpus).where(like("metric", text)).orderBy(F.col("document_id").asc_nulls_last(), "page_number")


def search(facts: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Facts that hold the text in metric, entity or quote."""
    hit = like("metric", text) | like("entity", text) | like("verbatim_quote", text)
    return facts.where(hit).orderBy("page_number", "fact_id").limit(limit)


def by_id(facts: DataFrame, fact_id: str) -> DataFrame:
    return facts.where(F.col("fact_id") == fact_id)


def of_document(facts: DataFrame, document_id: str) -> DataFrame:
    return facts.where(F.col("document_id") == document_id).orderBy("page_number")


def listed(facts: DataFrame, entity: str | None = None, metric: str | None = None, limit: int = 50) -> DataFrame:
    """An entity wins over a metric; a limit of 0 means all without a filter, none with one."""
    if entity:
        return by_entity(facts, entity).limit(limit)
    if metric:
        return by_metric(facts, metric).limit(limit)
    out = facts.orderBy(F.col("document_id").asc_nulls_last(), "page_number")
    return out.limit(limit) if limit else out


def relationships(rel: DataFrame, verdict: str | None = None, corpus: str | None = None) -> DataFrame:
    out = of_corpus(rel, corpus)
    out = out if verdict is None else out.where(F.col("verdict") == verdict)
    return out.orderBy(F.desc("confidence"), "relationship_id")


def ends(rel: DataFrame) -> DataFrame:
    """(fact_id, relationship_id, verdict, confidence) of both ends of each relationship."""
    return rel.select(F.explode(F.array("a_fact_id", "b_fact_id")).alias("fact_id"), "relationship_id", "verdict", "confidence")


def linked(facts: DataFrame, rel: DataFrame) -> DataFrame:
    return facts.join(ends(rel).select("fact_id"), "fact_id", "left_semi")


def standalone(facts: DataFrame, rel: DataFrame) -> DataFrame:
    return facts.join(ends(rel).select("fact_id"), "fact_id", "left_anti")


def counts_by_verdict(rel: DataFrame) -> DataFrame:
    """Counts of the named verdicts, zero if there are none, of others as they come, and the total."""
    spark = rel.sparkSession
    zero = spark.createDataFrame([(v, 0) for v in ("corroborated", "genuine_contradiction", "context_reconciled", "extraction_failure")], "verdict string, n long")
    found = rel.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    each = found.unionByName(zero).groupBy("verdict").agg(F.sum("n").alias("n"))
    return each.unionByName(each.agg(F.lit("total").alias("verdict"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))


def shared_metrics(facts: DataFrame) -> DataFrame:
    """Metrics of several documents."""
    return facts.groupBy("metric").agg(F.countDistinct("document_id").alias("n_docs")).where("n_docs > 1")


def shared_members(facts: DataFrame) -> DataFrame:
    """Facts whose metric holds a shared metric's name.

    Names are compared with the distinct metrics only; the facts join by equality.
    """
    names = shared_metrics(facts).select(F.col("metric").alias("group_metric"))
    held = facts.select("metric").distinct().join(names, F.expr("lower(metric) LIKE concat('%', lower(group_metric), '%')"))
    return facts.join(held, "metric")


#: The corpora that are offered where no table names one.
DEFAULT_CORPORA = ("Delhivery", "India Macroeconomics")


def corpora(*tables: DataFrame) -> DataFrame:
    """The distinct names of corpora, without blanks; two default ones if there is none."""
    out = tables[0].select("corpus")
    for t in tables[1:]:
        out = out.union(t.select("corpus"))
    found = out.where("corpus IS NOT NULL AND trim(corpus) <> ''").distinct()
    default = found.sparkSession.createDataFrame([(c,) for c in DEFAULT_CORPORA], "corpus string")
    return found.union(default.join(found.agg(F.count(F.lit(1)).alias("n")).where("n = 0"), how="left_semi"))


def per_document(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents with their number of facts, zero included."""
    n = facts.groupBy(F.col("document_id").alias("filename")).agg(F.count(F.lit(1)).alias("n_facts"))
    return documents.select("filename").join(n, "filename", "left").select("filename", F.coalesce("n_facts", F.lit(0)).alias("n_facts"))


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """The number-th page (from 1) of so many rows."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def pages_of(n_rows: int, size: int) -> int:
    """The number of pages of a listing: one at least."""
    return max(1, -(-n_rows // size))


def keep_last(df: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """The row of each key that comes last in the sequence, as a maximum that each task takes of its own rows first.

    Rows that share key and place in the sequence are told apart by their other
    columns, so a rerun keeps the same one.
    """
    rest = [c for c in df.columns if c not in keys and c != sequence]
    order = F.struct(F.col(sequence), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"c{k}") for k, c in enumerate(rest)])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), order).alias("__row")).select("__row.*")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """New rows replace old ones of their key; of several new ones the last in the sequence counts.

    The sequence is a column of the new rows; it is kept if the old ones have it.
    """
    last = keep_last(new, keys, sequence).select(*old.columns)
    return old.join(last.select(*keys), list(keys), "left_anti").unionByName(last)


def replace_document(facts: DataFrame, new: DataFrame, document_id: str, sequence: str) -> DataFrame:
    """A document's facts are replaced as a whole; of new rows with one id the last in the sequence counts."""
    return upsert(facts.where(~F.col("document_id").eqNullSafe(document_id)), new, ["fact_id"], sequence)


def delete_document(facts: DataFrame, rel: DataFrame, documents: DataFrame, filename: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts, relationships and documents without a document; failures stay."""
    gone = facts.where(F.col("document_id") == filename).select("fact_id")
    a, b = gone.withColumnRenamed("fact_id", "a_fact_id"), gone.withColumnRenamed("fact_id", "b_fact_id")
    return facts.where(F.col("document_id") != filename), rel.join(a, "a_fact_id", "left_anti").join(b, "b_fact_id", "left_anti"), documents.where(F.col("filename") != filename)


def merge(rule: DataFrame, other: DataFrame) -> DataFrame:
    """Rule facts, and others whose metric and value no rule fact has; ids are unique.

    Of facts with one id those of the first table count, and the last of these by their other columns.
    """
    key = lambda df: df.withColumns({"__m": F.lower(F.trim("metric")), "__v": F.lower(F.trim("value"))})
    extra = key(other).join(key(rule).select("__m", "__v").distinct(), ["__m", "__v"], "left_anti").select(*rule.columns)
    both = rule.withColumn("__rank", F.lit(1)).unionByName(extra.withColumn("__rank", F.lit(0)))
    return keep_last(both, ["fact_id"], "__rank").drop("__rank")


def first_wins(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The first fact of each entity, metric, value and period."""
    w = Window.partitionBy("entity", F.lower("metric"), F.lower("value"), "temporal_period").orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def attribute(failures: DataFrame, documents: DataFrame) -> DataFrame:
    """The corpus of each failure: by its document's id or name, by an id or name within its source, by words.

    Where a key lies within the source, the first key in the catalogue's order
    (doc_id, then id before name) counts that lies within the source or holds it.
    A key that several documents have stands for the last one's corpus.  Only the
    distinct sources that no key equals are searched for parts.
    """
    keys = documents.where("corpus <> ''").select("doc_id", "corpus", F.posexplode(F.array(F.lower(F.col("doc_id").cast("string")), F.lower("filename"))).alias("n", "k"))
    named = keys.groupBy("k").agg(F.max_by("corpus", F.struct("doc_id", "n")).alias("key_corpus"), F.min(F.struct("doc_id", "n")).alias("at")).where("k is not null")
    src = failures.withColumn("src", F.lower(F.coalesce("source_document", F.lit("")))).drop("corpus").persist(StorageLevel.MEMORY_AND_DISK)  # looked at from several sides
    sources = src.select("src").distinct()
    exact = sources.join(named, F.col("src") == F.col("k"), "left")
    known, open_ = exact.where("k is not null").select("src", "key_corpus"), exact.where("k is null").select("src")
    parts = open_.join(named, F.col("src").contains(F.col("k")) | F.col("k").contains(F.col("src")))
    within = parts.groupBy("src").agg(F.min_by("key_corpus", "at").alias("key_corpus"), F.bool_or(F.col("src").contains(F.col("k"))).alias("inside"))
    found = known.unionByName(within.where("inside").drop("inside"))
    words = F.when(F.col("src").contains("delhivery"), "Delhivery").when(F.col("src").rlike("india|rbi|economic survey|imf"), "India Macroeconomics").otherwise("General Knowledge")
    return src.join(found, "src", "left").withColumn("corpus", F.coalesce("key_corpus", words)).drop("src", "key_corpus")


def epoch(events: DataFrame) -> Column:
    """Column ``ts`` as DuckDB's ``epoch``: seconds with their fraction; times without a zone count in UTC, whatever the session's zone."""
    if isinstance(events.schema["ts"].dataType, TimestampNTZType):
        return F.expr("cast(1000000 * cast(cast(ts - timestamp_ntz'1970-01-01' as interval second) as decimal(20, 6)) as bigint) / 1e6")
    return F.col("ts").cast("timestamp").cast("double")


def trailing(events: DataFrame, seconds: int, by: str = "user_id", whole: Callable[[Column], Column] = F.floor) -> DataFrame:
    """Events of the same user (or kind) within so many seconds before, each included; ``whole`` makes whole seconds of fractions."""
    at = whole(epoch(events)).cast("long")
    w = Window.partitionBy(by).orderBy(at).rangeBetween(-seconds, 0)
    return events.select("event_id", by, F.count(F.lit(1)).over(w).alias("n_recent"))


def filtered(facts: DataFrame, rel: DataFrame, document_id: str | None = None, is_linked: bool | None = None, text: str | None = None, category: str | None = None) -> DataFrame:
    """Facts of a document and category, with or without relationships, that hold a text in metric, value, period or quote."""
    out = facts if document_id is None else facts.where(F.col("document_id") == document_id)
    out = out if category is None else out.where(F.col("category") == category)
    if is_linked is not None:
        out = linked(out, rel) if is_linked else standalone(out, rel)
    if text:
        held = [F.lower(F.coalesce(c, F.lit(""))).contains(text.lower()) for c in ("metric", "value", "temporal_period", "verbatim_quote")]
        out = out.where(held[0] | held[1] | held[2] | held[3])
    return out


def searched(rel: DataFrame, text: str, verdict: str | None = None) -> DataFrame:
    """Relationships (with summary and reasoning) that hold a text in metric, reasoning or summary."""
    out = rel if verdict is None else rel.where(F.col("verdict") == verdict)
    held = [F.lower(c).contains(text.lower()) for c in ("a_metric", "reasoning", "summary")]
    return out.where(held[0] | held[1] | held[2])


def missing(names: DataFrame, documents: DataFrame) -> DataFrame:
    """Names that the catalogue lacks."""
    return names.join(documents.select("filename"), "filename", "left_anti")


def sort_keys(field: str, descending: bool = False) -> list[Column]:
    """The order of a listing: by page within documents, or by a field; texts without regard to case, values as texts."""
    keys = {"page": ["document_id", "page_number"], "confidence": ["confidence_score"]}.get(field) or [field]
    columns = [F.lower(k) if k in ("metric", "value") else F.col(k) for k in keys]
    return [c.desc() if descending else c.asc() for c in columns]

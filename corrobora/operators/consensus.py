"""Consensus groups, failure audits and showcases over enriched facts."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import facts as S
from ..functions import messages as M
from ..functions.dialect import Spark
from . import facts as ops


def representatives(facts: DataFrame) -> DataFrame:
    """Of each corpus, definition and document the most confident fact; the first by page, id and period on ties.

    A minimum of structs, which each task takes of its own rows first.
    """
    order = F.struct((-F.col("confidence_score")).alias("c"), "page_number", "fact_id", F.coalesce("temporal_period", F.lit("")).alias("t"))
    return facts.groupBy("corpus", "canonical_def", "document_id").agg(F.min_by(F.struct(*facts.columns), order).alias("f")).select("f.*")


def consensus(facts: DataFrame) -> DataFrame:
    """Groups of one definition over two documents or more, with the verdict over their representatives' pairs."""
    total = facts.groupBy("corpus").agg(F.countDistinct("document_id").alias("total_corpus_docs"))
    reps = representatives(facts)
    keys = ("corpus", "canonical_def")
    keyed = reps.withColumn("metric_", F.col("canonical_def"))
    left = keyed.select(*keys, *[F.col(c).alias("a_" + c) for c in ops.SIDE])
    right = keyed.select(*keys, *[F.col(c).alias("b_" + c) for c in ops.SIDE])
    judged = ops.gate(left.join(right, list(keys)).where("a_document_id < b_document_id"))
    folds = judged.groupBy(*keys).agg(
        F.bool_and(F.col("verdict") == "corroborated").alias("agree"), F.bool_or(F.col("verdict") == "temporal_update").alias("moved"), F.bool_or(F.col("verdict") == "context_reconciled").alias("context")
    )
    groups = reps.groupBy(*keys).agg(
        F.array_join(F.sort_array(F.collect_set("document_id")), ", ").alias("participating_docs"), F.countDistinct("document_id").cast("int").alias("doc_count"),
        F.min_by("entity", "document_id").alias("entity"), F.min_by("value", "document_id").alias("first_value"),
    )
    out = groups.where("doc_count >= 2").join(folds, list(keys)).join(total, "corpus")
    verdict = F.when(F.col("agree"), "corroborated").when(F.col("moved"), "temporal_update").when(F.col("context"), "context_reconciled").otherwise("genuine_contradiction")
    of = F.format_string("%d of %d PDFs", "doc_count", "total_corpus_docs")
    texts = F.when(F.col("doc_count") >= F.col("total_corpus_docs"), F.format_string("all %d PDFs", "doc_count")).otherwise(of)
    out = out.withColumns({"verdict": verdict, "coverage_ratio": of, "docs_text": texts, "metric": F.col("canonical_def")})
    status = (
        F.when(F.col("verdict") == "corroborated", F.concat(F.lit("Corroborated across "), "docs_text", F.lit(" in "), "corpus", F.lit(" ("), "first_value", F.lit(")")))
        .when(F.col("verdict") == "temporal_update", F.concat(F.lit("Temporal Progression across "), "docs_text", F.lit(" in "), "corpus"))
        .when(F.col("verdict") == "context_reconciled", F.concat(F.lit("Contextually Reconciled across "), "docs_text", F.lit(" in "), "corpus"))
        .otherwise(F.concat(F.lit("Discrepancy observed across "), "docs_text", F.lit(" in "), "corpus"))
    )
    group_id = F.expr(Spark.digest("corpus || ':' || metric || ':' || CAST(doc_count AS STRING)"))
    return out.select(group_id.alias("group_id"), "corpus", "metric", "entity", F.col("total_corpus_docs").cast("int").alias("total_corpus_docs"), "participating_docs", "doc_count", "coverage_ratio", "verdict", status.alias("status_summary"))


def disclosures(facts: DataFrame) -> DataFrame:
    """What each document of a group discloses, with defaults for what is missing."""
    reps = representatives(facts)
    several = reps.groupBy("corpus", "canonical_def").agg(F.countDistinct("document_id").alias("n")).where("n >= 2").drop("n")
    return reps.join(several, ["corpus", "canonical_def"], "left_semi").select(
        "corpus", F.col("canonical_def").alias("metric"), "document_id", "page_number", "value", "raw_value",
        F.coalesce(F.expr("nullif(temporal_period, '')"), F.lit("Unspecified")).alias("temporal_period"), F.coalesce(F.expr("nullif(reporting_scope, '')"), F.lit("Standard")).alias("reporting_scope"),
        F.coalesce("unit", F.lit("")).alias("unit"), "verbatim_quote",
    )


def record(d=Spark) -> dict[str, str]:
    """The descriptive fields of a flawed fact's record, by code."""
    fields = M.fact_fields(d, S.qualifier())
    return {name: S.cases(*[(f"failure_type = '{code}'", M.filled(d, texts[k], fields)) for code, texts in M.RECORDS.items()]) for k, name in enumerate(M.RECORD)}


FAILURE = ("failure_type", "source_document", "page_number", *M.RECORD, "corpus", "fact_id", "related_fact_id")


def fact_audit(facts: DataFrame) -> DataFrame:
    """A row for each flawed fact."""
    out = facts.withColumn("failure_type", F.expr(S.audit_code(Spark))).where("failure_type is not null")
    return out.withColumns({**{c: F.expr(t) for c, t in record().items()}, "source_document": F.col("document_id"), "related_fact_id": F.lit(None).cast("string")}).select(*FAILURE)


def sovereign_firsts(facts: DataFrame) -> DataFrame:
    """The first fact of each document that tells of a sovereign; a row a document."""
    sov = facts.where(F.expr(S.is_sovereign("entity")) & ~F.expr(S.is_multilateral("metric")))
    kept = F.struct("document_id", "page_number", "entity", "metric", "value", "fact_id", "corpus")
    return sov.groupBy("document_id").agg(F.min_by(kept, F.struct("page_number", "fact_id")).alias("f")).select("f.*")


def sovereign_audit(facts: DataFrame) -> DataFrame:
    """Pairs of documents whose first sovereign facts are of different sovereigns; documents in order of name.

    The record is one row a pair of documents by its definition, so it grows with
    the square of the sovereign documents; ``sovereign_conflicts`` sums it up.
    """
    first = sovereign_firsts(facts)
    a, b = (first.select(*[F.col(c).alias(p + c) for c in first.columns]) for p in ("a_", "b_"))
    pairs = a.join(b, (F.col("a_document_id") < F.col("b_document_id")) & (F.col("a_entity") != F.col("b_entity")))
    fields = {f"{c}_{p}": f"{p}_{c}" for c in ("entity", "metric", "value") for p in "ab"}
    return pairs.select(
        F.lit("REASONING_ERROR").alias("failure_type"), F.concat("a_document_id", F.lit(" vs "), "b_document_id").alias("source_document"), F.col("a_page_number").alias("page_number"),
        *[F.expr(M.filled(Spark, t, fields)).alias(c) for c, t in zip(M.RECORD, M.CROSSED_RECORD, strict=True)],
        F.col("a_corpus").alias("corpus"), F.col("a_fact_id").alias("fact_id"), F.col("b_fact_id").alias("related_fact_id"),
    )


def sovereign_conflicts(facts: DataFrame) -> DataFrame:
    """(entity, other_entity, n_documents, n_other, first_document, other_document): pairs of sovereigns instead of pairs of documents."""
    each = sovereign_firsts(facts).groupBy("entity").agg(F.count(F.lit(1)).alias("n_documents"), F.min("document_id").alias("first_document"))
    other = each.select(F.col("entity").alias("other_entity"), F.col("n_documents").alias("n_other"), F.col("first_document").alias("other_document"))
    return each.join(other, F.col("entity") < F.col("other_entity"))


def corpus_audit(facts: DataFrame, include_canonical: bool = True) -> DataFrame:
    """All failures with their ids; the ones on record are added unless the key is taken, and ids collapse."""
    found = fact_audit(facts).unionByName(sovereign_audit(facts)).persist(StorageLevel.MEMORY_AND_DISK)  # read for what is on record too
    if include_canonical:
        spark = facts.sparkSession
        fixed = spark.createDataFrame([(*c, None, None, None) for c in M.CANONICAL], ", ".join(f"{c} {'int' if c == 'page_number' else 'string'}" for c in FAILURE))
        found = found.unionByName(fixed.join(found, ["source_document", "page_number", "failure_type"], "left_anti").select(*FAILURE))
    key = F.concat_ws(":", "source_document", F.col("page_number").cast("string"), "failure_type", F.substring("observed_result", 1, 30))
    named = found.withColumn("failure_id", F.substring(F.sha2(key, 256), 1, 16))
    last = F.struct(F.coalesce("fact_id", F.lit("")), F.coalesce("related_fact_id", F.lit("")))
    return named.groupBy("failure_id").agg(F.max_by(F.struct(*FAILURE), last).alias("f")).select("failure_id", "f.*")


def showcase(gated: DataFrame, facts: DataFrame) -> DataFrame:
    """One example a verdict: the metric that most documents have, then the earliest pair."""
    coverage = facts.groupBy(F.lower(F.trim("metric")).alias("k")).agg(F.countDistinct("document_id").alias("coverage"))
    ranked = gated.join(coverage, F.lower(F.trim("a_metric")) == F.col("k"), "left")
    first = Window.partitionBy("verdict").orderBy(F.desc(F.coalesce("coverage", F.lit(0))), "a_document_id", "a_page_number", "a_fact_id", "b_document_id", "b_page_number", "b_fact_id")
    shown = ranked.where(F.col("verdict").isin("corroborated", "genuine_contradiction", "context_reconciled", "extraction_failure")).withColumn("rn", F.row_number().over(first)).where("rn = 1")
    return shown.select("verdict", "relationship_id", "a_fact_id", "b_fact_id", F.coalesce("coverage", F.lit(0)).cast("long").alias("coverage"))


def failure_example(facts: DataFrame) -> DataFrame:
    """An example of a failure where no pair is one: the first flawed fact beside one fact of every other document.

    (a_fact_id, b_fact_id, participants, summary, reasoning); of another document the
    first fact of the same metric counts, else its first.  No row without a flawed fact.
    """
    found = facts.where("flaw IS NOT NULL").orderBy("document_id", "page_number", "fact_id").limit(1)
    key = found.select("document_id", "metric", "fact_id").first()
    if key is None:
        found = facts.limit(0)
        key = {"document_id": None, "metric": None}
    order = F.struct(~F.col("metric").eqNullSafe(F.lit(key["metric"])), F.col("page_number"), F.col("fact_id"))
    side = F.struct(*facts.columns)
    others = facts.where(~F.col("document_id").eqNullSafe(F.lit(key["document_id"]))).groupBy("document_id").agg(F.min_by(side, order).alias("f")).select("f.*")
    told = found.select("corpus", *[F.col(c).alias(f"a_{c}") for c in ops.SIDE]).withColumn("pair_failure", F.concat(F.lit("A:"), "a_flaw"))
    told = told.withColumns({f"b_{c}": F.col(f"a_{c}") for c in ops.SIDE}).withColumns({c: F.expr(t) for c, t in ops.diagnoses().items()})
    fields = M.sides(Spark) | {"diagnosis": "diagnosis", "mitigation": "mitigation"}
    told = told.select(F.col("a_fact_id"), F.expr(M.filled(Spark, M.FALLBACK_SUMMARY, fields)).alias("summary"), F.expr(M.filled(Spark, M.FALLBACK_REASONING, fields)).alias("reasoning"))
    row = lambda df: df.select("document_id", "fact_id")
    beside = row(others).unionByName(row(found)).agg(F.array_sort(F.collect_list(F.struct("document_id", "fact_id"))).alias("all"))  # a row a document
    ids = F.transform("all", lambda x: x["fact_id"])
    return told.join(beside).select("a_fact_id", F.coalesce(F.get(ids, F.lit(1)), F.col("a_fact_id")).alias("b_fact_id"), ids.alias("participants"), "summary", "reasoning")


def enrichment(shown: DataFrame, gated: DataFrame, facts: DataFrame) -> DataFrame:
    """For each example the best fact of every other document: by period, inception, then words in common."""
    case = shown.select("relationship_id").join(gated, "relationship_id").select("relationship_id", "verdict", "a_document_id", "b_document_id", "a_canonical_def", "a_value_nature", "a_temporal_period", "a_verbatim_quote", "corpus")
    near = (F.col("a_canonical_def") == F.col("canonical_def")) & (F.col("a_value_nature") == F.col("value_nature"))
    found = case.drop("corpus").join(facts, near).where("document_id <> a_document_id AND document_id <> b_document_id")
    period, target = F.lower(F.coalesce("temporal_period", F.lit(""))), F.lower(F.coalesce("a_temporal_period", F.lit("")))
    quote = F.lower(F.coalesce("verbatim_quote", F.lit("")))
    words = lambda c: F.array_distinct(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"))
    early = target.contains("inception") & (period.contains("incorporation") | quote.contains("incorporation") | quote.contains("inception"))
    score = F.when((target != "") & (period == target), 20).when(early, 15).otherwise(0) + F.size(F.array_intersect(words("a_verbatim_quote"), words("verbatim_quote")))
    best = Window.partitionBy("relationship_id", "document_id").orderBy(F.desc("score"), "page_number", "fact_id")
    return found.withColumn("score", score).withColumn("rn", F.row_number().over(best)).where("rn = 1").select("relationship_id", "document_id", "fact_id", F.col("score").cast("long").alias("score"))

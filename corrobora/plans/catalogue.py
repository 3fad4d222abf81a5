"""Registered queries of the fact engine and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facts as S
from ..functions import text as T
from ..functions import units as U
from ..functions.dialect import DuckDB as D
from ..functions.dialect import Spark, holds
from ..operators import admin, extraction, pages, store
from ..operators import consensus as C
from ..operators import facts as ops
from ..sources import fixture
from . import cases
from .oracles import over

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Enriched facts, kept as ``Engine`` keeps them: all that a query derives starts from one scan."""
    return ops.enrich(fixture.facts(spark, d)).persist(StorageLevel.MEMORY_AND_DISK)


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(fixture.DOCUMENTS, facts=facts(spark, d))


def gated(spark: SparkSession, d: str) -> DataFrame:
    return ops.gate(ops.pairs(facts(spark, d)))


def rel(spark: SparkSession, d: str) -> DataFrame:
    return ops.relationships(gated(spark, d))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def register(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


def scalar(name: str, source: str, key: str, **columns) -> None:
    """A projection of scalars over a table; each column is a function of the dialect."""
    register(
        name,
        lambda spark, d: table(spark, d, source).select(key, *[F.expr(f(Spark)).alias(c) for c, f in columns.items()]),
        f"SELECT {key}, " + ", ".join(f"{f(D)} AS {c}" for c, f in columns.items()) + f" FROM {source}",
    )


def fact_scalar(name: str, **columns) -> None:
    """A projection of scalars over the enriched facts."""
    register(
        name,
        lambda spark, d: facts(spark, d).select("fact_id", *[F.expr(f(Spark)).alias(c) for c, f in columns.items()]),
        over("SELECT fact_id, " + ", ".join(f"{f(D)} AS {c}" for c, f in columns.items()) + " FROM facts"),
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count of candidate pairs by corpus, verdict and shift."""
    return gated(spark, sf_dir).groupBy("corpus", "verdict", "shift_type").agg(F.count(F.lit(1)).alias("n"))


# --- text ---------------------------------------------------------------------------------------------------------
register(
    "docs_catalog_ids",
    lambda spark, d: table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"), F.expr(Spark.digest("CAST(doc_id AS STRING) || ':' || sha2(text, 256)", 12)).alias("catalog_id")),
    "SELECT doc_id, sha256(text) AS checksum, substr(sha256(doc_id::VARCHAR || ':' || sha256(text)), 1, 12) AS catalog_id FROM documents",
)
scalar("page_normalize", "documents", "doc_id", page=lambda d: T.normal_page(d, "text"))
scalar("boilerplate_filter", "documents", "doc_id", boilerplate=lambda d: T.is_boilerplate(d, "text"))
scalar("strip_citations", "documents", "doc_id", stripped=lambda d: T.strip_citations(d, "text || ' (Table 3, Figures 4 and 5) see Box 1 and Appendix II.'"))
scalar("strip_footnotes", "documents", "doc_id", stripped=lambda d: T.strip_footnotes(d, "text || ' 3/ as [1, 2] and (1,5) in FY2025/26 or 2024/25.'"))
scalar("strip_numbering", "documents", "doc_id", stripped=lambda d: T.strip_numbering(d, "'7. Growth slowed. 10. Prices rose. ' || text"))
scalar("clean_text", "documents", "doc_id", cleaned=lambda d: T.clean(d, "text"))
scalar("factual_signal", "documents", "doc_id", signal=lambda d: T.has_signal(d, pages.said()))
scalar("reject_pattern", "documents", "doc_id", rejected=lambda d: T.is_rejected(d, pages.said()))
scalar("token_counts", "documents", "doc_id", tokens=lambda d: T.token_count(d, "text"))
scalar("section_titles", "documents", "doc_id", section_title=lambda d: pages.section_title(d, "text"))
scalar("clean_punct_year", "events", "event_id", stripped=lambda d: T.strip_edges(d, "' (' || CAST(event_id % 400 + 1800 AS VARCHAR(9)) || '). '"), bare_year=lambda d: T.is_bare_year(d, "' (' || CAST(event_id % 400 + 1800 AS VARCHAR(9)) || '). '"))
scalar("has_data_pages", "documents", "doc_id", has_data=lambda d: d.rx("text", r"\d", False))
scalar("temporal_detect", "documents", "doc_id", period=lambda d: T.period(d, pages.stamped()))
scalar("scope_detect", "documents", "doc_id", scope=lambda d: T.scope(d, pages.stamped()))
scalar("entity_detect", "documents", "doc_id", entity=lambda d: S.entity(d, pages.filename(), pages.sample()))
register("sentence_units", lambda spark, d: pages.sentence_units(table(spark, d, "documents").withColumn("said", F.expr(pages.said())), "said"), pages.SENTENCE_ORACLE)
register("clause_split", lambda spark, d: pages.clause_counts(table(spark, d, "documents")), f"SELECT doc_id, len({T.clauses(D, 'text')}) AS n_clauses FROM documents")
register("md_table_nation", lambda spark, d: pages.nation_table(table(spark, d, "nation"), table(spark, d, "region")), pages.NATION_ORACLE)
register("html_text_pages", lambda spark, d: pages.html_text(table(spark, d, "pages")), pages.html_oracle())
register("greedy_chunks", lambda spark, d: pages.chunks(table(spark, d, "documents")))
register("conversation_context", lambda spark, d: pages.with_neighbours(table(spark, d, "conversations")), pages.NEIGHBOUR_ORACLE)
register("anchor_cosine", lambda spark, d: pages.anchor_scores(table(spark, d, "embeddings")), pages.ANCHOR_ORACLE)

# --- numbers and entities -----------------------------------------------------------------------------------------
fact_scalar("unit_scale", scale=lambda d: U.scale(d, "value", "unit"))
fact_scalar("clean_number", number=lambda d: U.plain_number(d, "value"))
fact_scalar("canonical_number", number=lambda d: U.canonical_number(d, "value", "unit"))
fact_scalar("multilateral_sovereign_flags", multilateral=lambda d: S.is_multilateral("metric"), sovereign=lambda d: S.is_sovereign("entity"))
fact_scalar("canonical_def", canonical_def=lambda d: S.canonical(), metric=lambda d: "metric")
fact_scalar("corpus_resolve", resolved=lambda d: S.corpus("document_id", "entity"))
register(
    "fact_enrich",
    lambda spark, d: facts(spark, d).select("fact_id", "corpus", "document_id", "page_number", "metric", "metric_type", "value_nature", "temporal_nature", "is_header_metadata", "canonical_def"),
    over("SELECT fact_id, corpus, document_id, page_number, metric, metric_type, value_nature, temporal_nature, is_header_metadata, canonical_def FROM facts"),
)
register(
    "values_equivalent",
    lambda spark, d: ops.pairs(facts(spark, d)).select("a_fact_id", "b_fact_id", F.expr(S.values_equal(Spark)).alias("equivalent")),
    over(f"SELECT a_fact_id, b_fact_id, {S.values_equal(D)} AS equivalent FROM pairs"),
)
register(
    "unit_explain",
    lambda spark, d: ops.pairs(facts(spark, d)).select("a_fact_id", "b_fact_id", F.expr(ops.normalization()).alias("explanation")),
    over(f"SELECT a_fact_id, b_fact_id, {ops.normalization(D)} AS explanation FROM pairs"),
)

# --- store --------------------------------------------------------------------------------------------------------
register(
    "facts_with_docs",
    lambda spark, d: store.with_documents(facts(spark, d), documents(spark, d)).select("fact_id", "document_key", "document_id", "page_number"),
    over("SELECT fact_id, coalesce(d.doc_id, f.document_id) AS document_key, f.document_id, page_number FROM facts f LEFT JOIN docs d ON d.filename = f.document_id"),
)
register("facts_by_entity", lambda spark, d: store.by_entity(facts(spark, d), "republic").select("fact_id", "entity", "metric", "page_number"), over("SELECT fact_id, entity, metric, page_number FROM facts WHERE lower(entity) LIKE '%republic%'"))
register("facts_by_metric", lambda spark, d: store.by_metric(facts(spark, d), "growth", "ASIA").select("fact_id", "metric", "document_id"), over("SELECT fact_id, metric, document_id FROM facts WHERE lower(metric) LIKE '%growth%' AND lower(corpus) = 'asia'"))
register(
    "keyword_search",
    lambda spark, d: store.search(facts(spark, d), "inception", 25).select("fact_id", "metric", "page_number"),
    over("SELECT fact_id, metric, page_number FROM facts WHERE lower(metric) LIKE '%inception%' OR lower(entity) LIKE '%inception%' OR lower(verbatim_quote) LIKE '%inception%' ORDER BY page_number, fact_id LIMIT 25"),
)
register("document_facts", lambda spark, d: store.of_document(facts(spark, d), "02-annual.pdf").select("fact_id", "page_number"), over("SELECT fact_id, page_number FROM facts WHERE document_id = '02-annual.pdf'"))
register("cross_doc_metrics", lambda spark, d: store.shared_metrics(facts(spark, d)), over("SELECT metric, count(DISTINCT document_id) AS n_docs FROM facts GROUP BY metric HAVING n_docs > 1"))
register(
    "cross_doc_metric_members",
    lambda spark, d: store.shared_members(facts(spark, d)).select("group_metric", "fact_id"),
    over("SELECT m.metric AS group_metric, f.fact_id FROM facts f JOIN (SELECT metric FROM facts GROUP BY metric HAVING count(DISTINCT document_id) > 1) m ON lower(f.metric) LIKE '%' || lower(m.metric) || '%'"),
)
register("row_counts", lambda spark, d: store.of_corpus(facts(spark, d), None).groupBy("corpus").agg(F.count(F.lit(1)).alias("n")), over("SELECT corpus, count(*) AS n FROM facts GROUP BY corpus"))
register("available_corpora", lambda spark, d: store.corpora(facts(spark, d), documents(spark, d), rel(spark, d)), over("SELECT DISTINCT corpus FROM (SELECT corpus FROM facts UNION SELECT corpus FROM docs UNION SELECT corpus FROM rel) WHERE trim(corpus) <> ''"))
register("facts_per_document", lambda spark, d: store.per_document(facts(spark, d), documents(spark, d)), over("SELECT d.filename, count(f.fact_id) AS n_facts FROM docs d LEFT JOIN facts f ON f.document_id = d.filename GROUP BY d.filename"))
register(
    "fact_page",
    lambda spark, d: store.page(facts(spark, d), [F.desc("value"), F.asc("fact_id")], 3, 25).select("fact_id", "value"),
    over("SELECT fact_id, value FROM facts ORDER BY value DESC, fact_id LIMIT 25 OFFSET 50"),
)
register(
    "dedup_first_wins",
    lambda spark, d: store.first_wins(facts(spark, d), [F.desc("confidence_score"), F.asc("document_id"), F.asc("page_number"), F.asc("fact_id")]).select("fact_id", "entity", "metric"),
    over("SELECT fact_id, entity, metric FROM facts QUALIFY row_number() OVER (PARTITION BY entity, lower(metric), lower(value), temporal_period ORDER BY confidence_score DESC, document_id, page_number, fact_id) = 1"),
)


def _upserted(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).select("fact_id", "document_id", "metric", "confidence_score")
    new = f.where("document_id = '01-ledger.pdf'").withColumn("confidence_score", F.col("confidence_score") / 2)
    twice = new.withColumn("sequence", F.lit(1)).unionByName(new.withColumns({"confidence_score": F.lit(0.1), "sequence": F.lit(2)}))
    return store.upsert(f, twice, ["fact_id"], "sequence")


register("upsert_last_wins", _upserted, over("SELECT fact_id, document_id, metric, CASE WHEN document_id = '01-ledger.pdf' THEN 0.1::DOUBLE ELSE confidence_score END AS confidence_score FROM facts"))


def _deleted(spark: SparkSession, d: str) -> DataFrame:
    f, r, docs = store.delete_document(facts(spark, d), rel(spark, d), documents(spark, d), "03-deck.pdf")
    n = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return n(f, "facts").unionByName(n(r, "relationships")).unionByName(n(docs, "documents"))


register(
    "delete_cascade",
    _deleted,
    over("""SELECT 'facts' AS what, count(*) AS n FROM facts WHERE document_id <> '03-deck.pdf'
    UNION ALL SELECT 'relationships', count(*) FROM rel WHERE a_document_id <> '03-deck.pdf' AND b_document_id <> '03-deck.pdf'
    UNION ALL SELECT 'documents', count(*) FROM docs WHERE filename <> '03-deck.pdf'"""),
)


def _merged(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).select("fact_id", "document_id", "metric", "value")
    other = f.where("document_id <> '01-ledger.pdf'").withColumn("fact_id", F.concat(F.lit("x"), "fact_id"))
    return store.merge(f.where("document_id = '01-ledger.pdf'"), other).select("fact_id", "metric", "value")


register(
    "merge_rule_llm",
    _merged,
    over("""SELECT fact_id, metric, value FROM facts WHERE document_id = '01-ledger.pdf'
    UNION ALL SELECT 'x' || o.fact_id, o.metric, o.value FROM facts o WHERE o.document_id <> '01-ledger.pdf' AND NOT EXISTS (
      SELECT 1 FROM facts r WHERE r.document_id = '01-ledger.pdf' AND lower(trim(r.metric)) = lower(trim(o.metric)) AND lower(trim(r.value)) = lower(trim(o.value)))"""),
)

# --- reconciliation -----------------------------------------------------------------------------------------------
register("candidate_pairs", lambda spark, d: ops.pairs(facts(spark, d)).select("corpus", "a_fact_id", "b_fact_id", "a_canonical_def"), over("SELECT corpus, a_fact_id, b_fact_id, a_canonical_def FROM pairs"))
_VERDICT = ("relationship_id", "a_fact_id", "b_fact_id", "verdict", "shift_type", "confidence")
register("gate_verdicts", lambda spark, d: gated(spark, d).select(*_VERDICT), over(f"SELECT {', '.join(_VERDICT)} FROM gated"))
register("all_pairs_gate", lambda spark, d: ops.gate(ops.period_pairs(facts(spark, d))).select(*_VERDICT), over(f"SELECT {', '.join(_VERDICT)} FROM loosely"))
register(
    "gate_audit_fields",
    lambda spark, d: ops.explained(ops.gate(ops.period_pairs(facts(spark, d)))).select("relationship_id", *ops.texts()),
    over("SELECT relationship_id, " + ", ".join(f"{t} AS {c}" for c, t in ops.texts(D).items()) + " FROM loosely_told"),
)
register("gate_reasoning", lambda spark, d: ops.explained(gated(spark, d)).select("relationship_id", "reasoning", "verdict_rationale"), over(f"SELECT relationship_id, {ops.texts(D)['reasoning']} AS reasoning, {ops.texts(D)['verdict_rationale']} AS verdict_rationale FROM gated_told"))
register("verdict_counts", flagship, over("SELECT corpus, verdict, shift_type, count(*) AS n FROM gated GROUP BY ALL"))
register("relationship_ids", lambda spark, d: rel(spark, d).select("relationship_id", "corpus", "verdict"), over("SELECT relationship_id, corpus, verdict FROM rel"))
register(
    "relationship_counts",
    lambda spark, d: store.counts_by_verdict(rel(spark, d)),
    over("""SELECT verdict, CAST(sum(n) AS BIGINT) AS n FROM (SELECT verdict, count(*) AS n FROM rel GROUP BY verdict UNION ALL SELECT 'total', count(*) FROM rel
    UNION ALL SELECT unnest(['corroborated', 'genuine_contradiction', 'context_reconciled', 'extraction_failure']), 0) GROUP BY verdict"""),
)
register(
    "relationships_filtered",
    lambda spark, d: store.relationships(rel(spark, d), "genuine_contradiction", "europe").select("relationship_id", "confidence"),
    over("SELECT relationship_id, confidence FROM rel WHERE verdict = 'genuine_contradiction' AND lower(corpus) = 'europe'"),
)
register("relationships_for_fact", lambda spark, d: store.ends(rel(spark, d)), over("SELECT fact_id, relationship_id, verdict, confidence FROM ends"))
register("linked_facts", lambda spark, d: store.linked(facts(spark, d), rel(spark, d)).select("fact_id", "metric"), over("SELECT fact_id, metric FROM facts WHERE fact_id IN (SELECT fact_id FROM ends)"))
register("standalone_facts", lambda spark, d: store.standalone(facts(spark, d), rel(spark, d)).select("fact_id", "metric"), over("SELECT fact_id, metric FROM facts WHERE fact_id NOT IN (SELECT fact_id FROM ends)"))
register("pair_failure_codes", lambda spark, d: gated(spark, d).select("a_fact_id", "b_fact_id", "pair_failure"), over("SELECT a_fact_id, b_fact_id, pair_failure FROM gated"))
register(
    "context_shifts",
    lambda spark, d: ops.pairs(facts(spark, d)).select("a_fact_id", "b_fact_id", F.expr(pages.context_shift(Spark)).alias("shift")),
    over(f"SELECT a_fact_id, b_fact_id, {pages.context_shift(D)} AS shift FROM pairs"),
)

# --- consensus and audit ------------------------------------------------------------------------------------------
register(
    "consensus_groups",
    lambda spark, d: C.consensus(facts(spark, d)),
    over("""SELECT substr(sha256(corpus || ':' || metric || ':' || doc_count), 1, 16) AS group_id, corpus, metric, entity, total_corpus_docs::INTEGER AS total_corpus_docs, participating_docs, doc_count::INTEGER AS doc_count,
    coverage_ratio, verdict, CASE verdict WHEN 'corroborated' THEN 'Corroborated across ' || docs_text || ' in ' || corpus || ' (' || first_value || ')' WHEN 'temporal_update' THEN 'Temporal Progression across ' || docs_text || ' in ' || corpus
    WHEN 'context_reconciled' THEN 'Contextually Reconciled across ' || docs_text || ' in ' || corpus ELSE 'Discrepancy observed across ' || docs_text || ' in ' || corpus END AS status_summary FROM consensus"""),
)
register(
    "consensus_disclosures",
    lambda spark, d: C.disclosures(facts(spark, d)),
    over("""SELECT corpus, canonical_def AS metric, document_id, page_number, value, raw_value, coalesce(nullif(temporal_period, ''), 'Unspecified') AS temporal_period,
    coalesce(nullif(reporting_scope, ''), 'Standard') AS reporting_scope, coalesce(unit, '') AS unit, verbatim_quote FROM reps
    WHERE (corpus, canonical_def) IN (SELECT (corpus, canonical_def) FROM reps GROUP BY corpus, canonical_def HAVING count(*) >= 2)"""),
)
register(
    "fact_consensus_badge",
    lambda spark, d: pages.badges(facts(spark, d), C.consensus(facts(spark, d))),
    over("SELECT f.fact_id, c.verdict AS badge FROM facts f LEFT JOIN consensus c ON f.corpus = c.corpus AND lower(trim(f.metric)) = lower(c.metric)"),
)
register("fact_audit", lambda spark, d: C.fact_audit(facts(spark, d)), over(f"SELECT {', '.join(C.FAILURE)} FROM flaws"))
register("cross_sovereign_audit", lambda spark, d: C.sovereign_audit(facts(spark, d)), over(f"SELECT {', '.join(C.FAILURE)} FROM crossed"))
register(
    "sovereign_conflicts",
    lambda spark, d: C.sovereign_conflicts(facts(spark, d)),
    over("""SELECT a.entity, b.entity AS other_entity, a.n AS n_documents, b.n AS n_other, a.d AS first_document, b.d AS other_document
    FROM (SELECT entity, count(*) AS n, min(document_id) AS d FROM sov GROUP BY entity) a JOIN (SELECT entity, count(*) AS n, min(document_id) AS d FROM sov GROUP BY entity) b ON a.entity < b.entity"""),
)
_FAILURE = ", ".join(("failure_id", *C.FAILURE))
register("corpus_audit", lambda spark, d: C.corpus_audit(facts(spark, d)), over(f"SELECT {_FAILURE} FROM failures"))
register("failures_filtered", lambda spark, d: C.corpus_audit(facts(spark, d)).where("failure_type = 'EXTRACTION_ERROR' AND lower(corpus) = 'africa'").orderBy("source_document", "page_number"), over(f"SELECT {_FAILURE} FROM failures WHERE failure_type = 'EXTRACTION_ERROR' AND lower(corpus) = 'africa'"))
register(
    "failure_attribution",
    lambda spark, d: store.attribute(C.corpus_audit(facts(spark, d)), documents(spark, d)).select("failure_id", "corpus"),
    over("""SELECT f.failure_id, coalesce(
      (SELECT last(x.corpus ORDER BY x.doc_id, x.n) FROM (SELECT doc_id, lower(doc_id) AS k, 0 AS n, corpus FROM docs UNION ALL SELECT doc_id, lower(filename), 1, corpus FROM docs) x WHERE x.corpus <> '' AND x.k = lower(f.source_document)),
      (SELECT CASE WHEN bool_or(contains(lower(f.source_document), x.k)) THEN first(x.corpus ORDER BY x.doc_id, x.n) END
       FROM (SELECT doc_id, lower(doc_id) AS k, 0 AS n, corpus FROM docs UNION ALL SELECT doc_id, lower(filename), 1, corpus FROM docs) x WHERE x.corpus <> '' AND (contains(lower(f.source_document), x.k) OR contains(x.k, lower(f.source_document)))),
      CASE WHEN contains(lower(f.source_document), 'delhivery') THEN 'Delhivery' WHEN regexp_matches(lower(f.source_document), 'india|rbi|economic survey|imf') THEN 'India Macroeconomics' ELSE 'General Knowledge' END) AS corpus
    FROM failures f"""),
)
_SHOW = """SELECT verdict, relationship_id, a_fact_id, b_fact_id, c.coverage FROM gated g LEFT JOIN (SELECT lower(trim(metric)) AS k, count(DISTINCT document_id) AS coverage FROM facts GROUP BY 1) c ON lower(trim(a_metric)) = c.k
    WHERE verdict IN ('corroborated', 'genuine_contradiction', 'context_reconciled', 'extraction_failure')
    QUALIFY row_number() OVER (PARTITION BY verdict ORDER BY c.coverage DESC, a_document_id, a_page_number, a_fact_id, b_document_id, b_page_number, b_fact_id) = 1"""
register("showcase_top1", lambda spark, d: C.showcase(gated(spark, d), facts(spark, d)), over(_SHOW))


def _enriched_showcase(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    g = ops.gate(ops.pairs(f))
    return C.enrichment(C.showcase(g, f), g, f)


register(
    "showcase_enrich",
    _enriched_showcase,
    over(f"""SELECT relationship_id, document_id, fact_id, score FROM (SELECT g.relationship_id, f.document_id, f.fact_id, f.page_number,
      CASE WHEN coalesce(g.a_temporal_period, '') <> '' AND lower(coalesce(f.temporal_period, '')) = lower(g.a_temporal_period) THEN 20
        WHEN contains(lower(coalesce(g.a_temporal_period, '')), 'inception') AND (contains(lower(coalesce(f.temporal_period, '')), 'incorporation') OR {holds("lower(f.verbatim_quote)", "incorporation", "inception")}) THEN 15 ELSE 0 END
      + len(list_intersect(list_distinct(string_split_regex(lower(g.a_verbatim_quote), '\\s+')), list_distinct(string_split_regex(lower(f.verbatim_quote), '\\s+')))) AS score
      FROM ({_SHOW}) s JOIN gated g USING (relationship_id) JOIN facts f ON f.canonical_def = g.a_canonical_def AND f.value_nature = g.a_value_nature AND f.document_id <> g.a_document_id AND f.document_id <> g.b_document_id)
    QUALIFY row_number() OVER (PARTITION BY relationship_id, document_id ORDER BY score DESC, page_number, fact_id) = 1"""),
)


def _sync(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    r = ops.relationships(ops.gate(ops.pairs(f)))
    n = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    by = store.counts_by_verdict(r).where("verdict in ('corroborated', 'genuine_contradiction', 'context_reconciled')").select(F.col("verdict").alias("what"), "n")
    return n(f, "total_facts").unionByName(n(r, "total_relationships")).unionByName(by).unionByName(n(C.corpus_audit(f), "total_failures"))


register(
    "sync_summary",
    _sync,
    over("""SELECT 'total_facts' AS what, count(*) AS n FROM facts UNION ALL SELECT 'total_relationships', count(*) FROM rel UNION ALL SELECT 'total_failures', count(*) FROM failures
    UNION ALL SELECT verdict, count(*) FROM rel WHERE verdict IN ('corroborated', 'genuine_contradiction', 'context_reconciled') GROUP BY verdict"""),
)

# --- events and extraction ----------------------------------------------------------------------------------------
register(
    "rate_window",
    lambda spark, d: store.trailing(table(spark, d, "events"), 86400, whole=F.rint),  # a cast to BIGINT rounds, halves to even
    "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n_recent FROM events",
)
register(
    "rate_window_minute",
    lambda spark, d: store.trailing(table(spark, d, "events"), 60, "event_type"),
    "SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS n_recent FROM events",
)
register("rule_extract_text", lambda spark, d: extraction.extract(extraction.fixture_pages(fixture.facts(spark, d))))
register("rule_extract_table", lambda spark, d: extraction.extract(extraction.fixture_tables(fixture.facts(spark, d))))
register("llm_json_facts", lambda spark, d: extraction.parsed_items(extraction.fixture_items(fixture.facts(spark, d))), over(extraction.ITEMS_ORACLE))

# --- listings -----------------------------------------------------------------------------------------------------
# the ledger's revenue of one nation and year: its id follows from document, page, entity, metric and value
_LOOKED_UP = "SELECT fact_id FROM facts WHERE document_id = '01-ledger.pdf' AND entity = 'NATION_7' AND page_number = 5 AND metric = 'Revenue from Operations'"


def _by_id(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    known = f.where("document_id = '01-ledger.pdf' AND entity = 'NATION_7' AND page_number = 5 AND metric = 'Revenue from Operations'").first()["fact_id"]
    return store.by_id(f, known).unionByName(store.by_id(f, "no such id")).select("fact_id", "metric", "value", "page_number")


register("fact_by_id", _by_id, over(f"SELECT fact_id, metric, value, page_number FROM facts WHERE fact_id IN ({_LOOKED_UP})"))
register(
    "facts_filtered",
    lambda spark, d: store.filtered(facts(spark, d), rel(spark, d), "02-annual.pdf", True, "FY9").select("fact_id", "metric", "temporal_period"),
    over("""SELECT fact_id, metric, temporal_period FROM facts WHERE document_id = '02-annual.pdf' AND fact_id IN (SELECT fact_id FROM ends)
    AND (contains(lower(metric), 'fy9') OR contains(lower(value), 'fy9') OR contains(lower(temporal_period), 'fy9') OR contains(lower(verbatim_quote), 'fy9'))"""),
)


def _searched(spark: SparkSession, d: str) -> DataFrame:
    return store.searched(ops.explained(rel(spark, d)), "standalone").select("relationship_id", "verdict")


register(
    "relationships_searched",
    _searched,
    over(f"SELECT relationship_id, verdict FROM (SELECT *, {ops.texts(D)['summary']} AS summary, {ops.texts(D)['reasoning']} AS reasoning FROM rel_told) WHERE contains(lower(a_metric), 'standalone') OR contains(lower(reasoning), 'standalone') OR contains(lower(summary), 'standalone')"),
)
register("facts_listed", lambda spark, d: store.listed(facts(spark, d), "chad", "growth", 500).select("fact_id", "entity", "metric"), over("SELECT fact_id, entity, metric FROM facts WHERE lower(entity) LIKE '%chad%' ORDER BY metric, page_number LIMIT 500"))
register(
    "facts_of_category",
    lambda spark, d: store.filtered(facts(spark, d), rel(spark, d), is_linked=False, category="numerical").select("fact_id", "metric"),
    over("SELECT fact_id, metric FROM facts WHERE fact_id NOT IN (SELECT fact_id FROM ends)"),
)
register(
    "table_counts",
    lambda spark, d: admin.row_counts("europe", facts=facts(spark, d), documents=documents(spark, d), failures=C.corpus_audit(facts(spark, d))),
    over("""SELECT 'facts' AS what, count(*) AS n FROM facts WHERE lower(corpus) = 'europe' UNION ALL SELECT 'documents', count(*) FROM docs WHERE lower(corpus) = 'europe'
    UNION ALL SELECT 'failures', count(*) FROM failures WHERE lower(corpus) = 'europe'"""),
)
register(
    "page_totals",
    lambda spark, d: admin.page_totals(extraction.fixture_tables(fixture.facts(spark, d)).withColumn("images", F.expr("CASE WHEN page_number % 2 = 0 THEN array(1, 2) END"))),
    over("""SELECT document_id, count(*) AS pages_parsed, count(*) AS total_tables, count(*) // 2 * 2 AS total_images FROM (SELECT DISTINCT document_id, nk, temporal_period FROM f0) GROUP BY document_id"""),
)


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue of the documents table: a third has a corpus, others metadata of several kinds or nothing."""
    meta = "CASE doc_id % 4 WHEN 0 THEN concat('{\"corpus\": \"M', doc_id % 5, '\"}') WHEN 1 THEN '{\"corpus\": \"\", \"corpus_label\": \"Labelled\"}' WHEN 2 THEN 'not json' END"
    return table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.expr(pages.filename()).alias("filename"), F.expr("CASE WHEN doc_id % 50 > 0 THEN 1000 + doc_id * 37 % 1009 END").alias("ingested_at"),
        F.expr(meta).alias("metadata"), F.expr("CASE WHEN doc_id % 3 = 0 THEN 'Own' WHEN doc_id % 3 = 1 THEN '' END").alias("corpus"),
    )


_CATALOGUE_CORPUS = f"""CASE WHEN doc_id % 3 = 0 THEN 'Own' WHEN doc_id % 4 = 0 THEN 'M' || (doc_id % 5) WHEN doc_id % 4 = 1 THEN 'Labelled' WHEN doc_id % 6 = 0 THEN 'Delhivery' WHEN doc_id % 6 = 1 THEN 'India Macroeconomics' ELSE 'General Knowledge' END"""
register("documents_listed", lambda spark, d: admin.listed_documents(catalogue(spark, d)).select("doc_id", "corpus", "ingested_at"), f"SELECT doc_id::VARCHAR AS doc_id, {_CATALOGUE_CORPUS} AS corpus, (CASE WHEN doc_id % 50 > 0 THEN 1000 + doc_id * 37 % 1009 END) AS ingested_at FROM documents")
register("documents_stored", lambda spark, d: admin.inserted(catalogue(spark, d)).select("doc_id", "corpus", F.get_json_object("metadata", "$.corpus").alias("told")), f"SELECT doc_id::VARCHAR AS doc_id, {_CATALOGUE_CORPUS} AS corpus, {_CATALOGUE_CORPUS} AS told FROM documents")
register(
    "documents_backfilled",
    lambda spark, d: admin.backfilled(catalogue(spark, d).withColumn("corpus", F.expr("nullif(corpus, '')")), "documents").groupBy("corpus").agg(F.count(F.lit(1)).alias("n")),
    "SELECT CASE WHEN doc_id % 3 = 0 THEN 'Own' WHEN doc_id % 6 = 0 THEN 'Delhivery' ELSE 'India Macroeconomics' END AS corpus, count(*) AS n FROM documents GROUP BY 1",
)
register("facts_sorted", lambda spark, d: store.page(facts(spark, d), [*store.sort_keys("value", True), F.asc("fact_id")], 2, 50).select("fact_id", "value"), over("SELECT fact_id, value FROM facts ORDER BY lower(value) DESC, fact_id LIMIT 50 OFFSET 50"))
register(
    "missing_documents",
    lambda spark, d: store.missing(spark.createDataFrame([(n,) for n in ("01-ledger.pdf", "04-notes.pdf", "niger-02-annual.pdf")], "filename string"), documents(spark, d)),
    over("SELECT filename FROM (VALUES ('01-ledger.pdf'), ('04-notes.pdf'), ('niger-02-annual.pdf')) AS v(filename) WHERE filename NOT IN (SELECT filename FROM docs)"),
)


def _replaced(spark: SparkSession, d: str) -> DataFrame:
    """A document's facts of one page come anew, each three times, of which the second has the greatest sequence."""
    f = facts(spark, d).select("fact_id", "document_id", "page_number", "metric")
    again = f.where("document_id = '02-annual.pdf' AND page_number = 5").withColumn("sequence", F.explode(F.array(F.lit(1), F.lit(3), F.lit(2))))
    return store.replace_document(f, again.withColumn("metric", F.concat_ws("/", "metric", "sequence")), "02-annual.pdf", "sequence")


register("replace_document_facts", _replaced, over("SELECT fact_id, document_id, page_number, CASE WHEN document_id = '02-annual.pdf' THEN metric || '/3' ELSE metric END AS metric FROM facts WHERE document_id <> '02-annual.pdf' OR page_number = 5"))
register(
    "facts_json",
    lambda spark, d: facts(spark, d).select("fact_id", F.get_json_object(F.to_json(F.struct("metric", F.struct("value", "unit").alias("context"))), "$.context.value").alias("value"), F.get_json_object(F.to_json(F.struct("metric")), "$.metric").alias("metric")),
    over("SELECT fact_id, json_extract_string(to_json({'context': {'value': value, 'unit': unit}}), '$.context.value') AS value, metric FROM facts"),
)
register("fact_document_matrix", lambda spark, d: facts(spark, d).groupBy("metric").pivot("document_id").agg(F.count(F.lit(1))).select("metric", F.coalesce("`01-ledger.pdf`", F.lit(0)).alias("ledger"), F.coalesce("`03-deck.pdf`", F.lit(0)).alias("deck")), over("SELECT metric, count(*) FILTER (document_id = '01-ledger.pdf') AS ledger, count(*) FILTER (document_id = '03-deck.pdf') AS deck FROM facts GROUP BY metric"))

# --- hand-written cases -------------------------------------------------------------------------------------------
QUERIES |= cases.QUERIES
ORACLES |= cases.ORACLES

"""DuckDB twins: common table expressions for facts, pairs, gate, consensus and failures, and a query on top."""

from __future__ import annotations

from ..functions import facts as S
from ..functions import messages as M
from ..functions import units
from ..functions.dialect import DuckDB as D
from ..operators import consensus as C
from ..operators import facts as ops
from ..sources import fixture

_BASE = "corpus, entity, metric, document_id, page_number, value, raw_value, temporal_period, reporting_scope, unit, verbatim_quote, confidence_score"
_SIDES = ", ".join(f"{p}.{c} AS {p}_{c}" for p in "ab" for c in ops.SIDE)
_CANONICAL = ", ".join("(" + ", ".join(D.lit(x) if isinstance(x, str) else str(x) for x in c) + ")" for c in M.CANONICAL)
_RECORD = ", ".join(M.RECORD)
_CROSSED = ", ".join(f"{M.filled(D, t, {f'{c}_{p}': f'{p}.{c}' for c in ('entity', 'metric', 'value') for p in 'ab'})} AS {c}" for c, t in zip(M.RECORD, M.CROSSED_RECORD, strict=True))

STEPS: dict[str, str] = {
    "f0": fixture.facts_sql(),
    "f1": f"SELECT {_BASE.replace('metric,', S.enriched_metric() + ' AS metric,')} FROM f0",
    "f2": f"""SELECT * EXCLUDE (corpus), metric AS metric_type, {S.value_nature()} AS value_nature, {S.temporal_nature()} AS temporal_nature,
        {S.is_header(D)} AS is_header_metadata, {S.fact_id(D)} AS fact_id, coalesce(nullif(trim(corpus), ''), {S.corpus("document_id", "entity")}) AS corpus FROM f1""",
    "facts": f"SELECT *, {S.canonical()} AS canonical_def, {units.canonical_number(D, 'value', 'unit')} AS number, {units.scale(D, 'value', 'unit')} AS scale, " + ", ".join(f"{t} AS {c}" for c, t in S.flags(D).items()) + " FROM f2",
    "docs": fixture.DOCUMENTS.format(facts="facts"),
    "pairs": f"""SELECT a.corpus, {_SIDES} FROM facts a JOIN facts b ON a.corpus = b.corpus AND lower(a.canonical_def) = lower(b.canonical_def) AND a.value_nature = b.value_nature
        AND a.document_id < b.document_id WHERE {S.compatible("a.entity", "b.entity", "a.metric")}""",
    "loose": f"SELECT a.corpus, {_SIDES} FROM facts a JOIN facts b ON a.corpus = b.corpus AND a.page_number = b.page_number AND a.temporal_period = b.temporal_period AND a.document_id < b.document_id",
}


def _gated(source: str, name: str) -> dict[str, str]:
    return {
        f"{name}_1": f"SELECT *, {S.pair_failure()} AS pair_failure, {S.values_equal(D)} AS values_equal FROM {source}",
        f"{name}_2": f"SELECT *, {S.gate_step()} AS step FROM {name}_1",
        f"{name}_3": f"SELECT *, {S.outcome('step', 0)} AS verdict, {S.outcome('step', 1)} AS shift_type, {S.confidence('step')} AS confidence FROM {name}_2",
        name: f"SELECT *, {D.digest(chr(39).join(('a_fact_id || ', ':', ' || b_fact_id || ', ':', ' || verdict')))} AS relationship_id FROM {name}_3",
    }


STEPS |= _gated("pairs", "gated")
STEPS |= {
    "rel": "SELECT * FROM gated WHERE verdict <> 'extraction_failure'",
    "ends": "SELECT unnest([a_fact_id, b_fact_id]) AS fact_id, relationship_id, verdict, confidence FROM rel",
    "reps": "SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY corpus, canonical_def, document_id ORDER BY confidence_score DESC, page_number, fact_id, coalesce(temporal_period, '')) = 1",
    "rep_pairs": f"SELECT a.corpus, a.canonical_def, {_SIDES} FROM reps a JOIN reps b ON a.corpus = b.corpus AND a.canonical_def = b.canonical_def AND a.document_id < b.document_id",
}
STEPS |= _gated("rep_pairs", "judged")
STEPS |= {
    "totals": "SELECT corpus, count(DISTINCT document_id) AS total_corpus_docs FROM facts GROUP BY corpus",
    "folds": "SELECT corpus, canonical_def, bool_and(verdict = 'corroborated') AS agree, bool_or(verdict = 'temporal_update') AS moved, bool_or(verdict = 'context_reconciled') AS context FROM judged GROUP BY ALL",
    "groups": """SELECT corpus, canonical_def AS metric, string_agg(document_id, ', ' ORDER BY document_id) AS participating_docs, count(*) AS doc_count, arg_min(entity, document_id) AS entity,
        arg_min(value, document_id) AS first_value FROM reps GROUP BY ALL HAVING count(*) >= 2""",
    "consensus": """SELECT g.*, t.total_corpus_docs, CASE WHEN agree THEN 'corroborated' WHEN moved THEN 'temporal_update' WHEN context THEN 'context_reconciled' ELSE 'genuine_contradiction' END AS verdict,
        g.doc_count || ' of ' || t.total_corpus_docs || ' PDFs' AS coverage_ratio,
        CASE WHEN g.doc_count >= t.total_corpus_docs THEN 'all ' || g.doc_count || ' PDFs' ELSE g.doc_count || ' of ' || t.total_corpus_docs || ' PDFs' END AS docs_text
        FROM groups g JOIN folds f ON g.corpus = f.corpus AND g.metric = f.canonical_def JOIN totals t ON g.corpus = t.corpus""",
    "flaws_0": f"SELECT *, {S.audit_code(D)} AS failure_type FROM facts",
    "flaws": f"""SELECT failure_type, document_id AS source_document, page_number, {", ".join(f"{t} AS {c}" for c, t in C.record(D).items())}, corpus, fact_id, NULL::VARCHAR AS related_fact_id
        FROM flaws_0 WHERE failure_type IS NOT NULL""",
    "sov": f"""SELECT * FROM facts WHERE {S.is_sovereign("entity")} AND NOT {S.is_multilateral("metric")}
        QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY page_number, fact_id) = 1""",
    "crossed": f"""SELECT 'REASONING_ERROR' AS failure_type, a.document_id || ' vs ' || b.document_id AS source_document, a.page_number,
        {_CROSSED},
        a.corpus, a.fact_id, b.fact_id AS related_fact_id FROM sov a JOIN sov b ON a.document_id < b.document_id AND a.entity <> b.entity""",
    "found": "SELECT * FROM flaws UNION ALL SELECT * FROM crossed",
    "fixed": f"SELECT v.*, NULL::VARCHAR AS corpus, NULL::VARCHAR AS fact_id, NULL::VARCHAR AS related_fact_id FROM (VALUES {_CANONICAL}) AS v(failure_type, source_document, page_number, {_RECORD})",
    "failures": """SELECT substr(sha256(source_document || ':' || page_number || ':' || failure_type || ':' || substr(observed_result, 1, 30)), 1, 16) AS failure_id, *
        FROM (SELECT * FROM found UNION ALL BY NAME (SELECT * FROM fixed x WHERE NOT EXISTS (
            SELECT 1 FROM found y WHERE x.source_document = y.source_document AND x.page_number = y.page_number AND x.failure_type = y.failure_type)))
        QUALIFY row_number() OVER (PARTITION BY failure_id ORDER BY fact_id DESC NULLS LAST, related_fact_id DESC NULLS LAST) = 1""",
}
STEPS |= _gated("loose", "loosely")


STEPS |= {f"{name}_told": f"SELECT *, {ops.diagnoses(D)['diagnosis']} AS diagnosis, {ops.diagnoses(D)['mitigation']} AS mitigation FROM {name}" for name in ("gated", "loosely", "rel")}


def over(body: str) -> str:
    """A query over the steps that it names, directly or not."""
    import re

    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in set(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text)) & STEPS.keys() - needed:
            needed.add(name)
            visit(STEPS[name])

    visit(body)
    return "WITH " + ",\n".join(f"{n} AS ({STEPS[n]})" for n in STEPS if n in needed) + "\n" + body

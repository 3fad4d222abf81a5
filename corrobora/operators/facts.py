"""Facts: enrichment, candidate pairs, the comparability gate and relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import facts as S
from ..functions import messages as M
from ..functions import units
from ..functions.dialect import Spark

#: What a pair carries of each of its facts.
SIDE = (
    "fact_id", "document_id", "page_number", "entity", "metric", "metric_type", "value", "raw_value", "temporal_period", "reporting_scope",
    "unit", "verbatim_quote", "confidence_score", "value_nature", "temporal_nature", "is_header_metadata", "canonical_def", "number", "scale",
    "flaw", "sovereign", "shared", "entity_key", "generic",
)


def expr(text: str) -> Column:
    return F.expr(text)


def enrich(facts: DataFrame) -> DataFrame:
    """Derived columns of facts: rewritten metric, natures, header flag, fact_id, corpus, canonical definition and number.

    Each step reads the one before, so long cascades are worked out once.
    """
    out = facts if "category" in facts.columns else facts.withColumn("category", F.lit("numerical"))
    out = out.withColumn("metric", expr(S.enriched_metric()))
    out = out.withColumns({
        "metric_type": F.col("metric"),
        "value_nature": expr(S.value_nature()),
        "temporal_nature": expr(S.temporal_nature()),
        "is_header_metadata": expr(S.is_header(Spark)),
        "fact_id": expr(S.fact_id(Spark)),
        "corpus": F.coalesce(F.expr("nullif(trim(corpus), '')"), expr(S.corpus("document_id", "entity"))),
    })
    return out.withColumns({
        "canonical_def": expr(S.canonical()),
        "number": expr(units.canonical_number(Spark, "value", "unit")),
        "scale": expr(units.scale(Spark, "value", "unit")),
        **{c: expr(t) for c, t in S.flags(Spark).items()},
    })


def _side(facts: DataFrame, p: str, keys: tuple[str, ...]) -> DataFrame:
    return facts.select(*[F.col(k).alias(k) for k in keys], *[F.col(c).alias(p + c) for c in SIDE])


def pairs(facts: DataFrame) -> DataFrame:
    """Candidate pairs: one corpus, definition and nature, different documents, entities that may be compared.

    Every way in which two entities may be compared is an equality of its own: the
    same entity, a shared metric on the first side, a generic entity on either side.
    A fact has a row for each way that is open to it, so only pairs that qualify
    meet, however many facts a definition has; a pair counts in its first way.  The
    earlier document comes first.
    """
    keyed = facts.withColumns({"block": F.lower("canonical_def"), "nature": F.col("value_nature")})
    keys = ("corpus", "block", "nature", "way")
    named, free = F.concat(F.lit("="), "entity_key"), ~F.col("sovereign")
    ways = lambda **open_: F.explode(F.array_compact(F.array(named, *[F.when(c, k) for k, c in open_.items()])))
    left = keyed.withColumn("way", ways(shared=F.col("shared"), first=F.col("generic") & free, second=free))
    right = keyed.withColumn("way", ways(shared=F.lit(True), first=free, second=F.col("generic") & free))
    joined = _side(left, "a_", keys).join(_side(right, "b_", keys), list(keys)).where("a_document_id < b_document_id")
    way = F.when(F.col("a_entity_key") == F.col("b_entity_key"), F.concat(F.lit("="), "a_entity_key")).when(F.col("a_shared"), "shared").when(F.col("a_generic"), "first").otherwise("second")
    return joined.where(F.col("way") == way).drop("block", "nature", "way")


def period_pairs(facts: DataFrame) -> DataFrame:
    """Pairs of one corpus, page and period across documents without the prefilter, so that every step of the gate is reached."""
    keys = ("corpus", "page_number", "temporal_period")
    left, right = _side(facts, "a_", keys), _side(facts, "b_", keys)
    return left.join(right, list(keys)).where("a_document_id < b_document_id").drop("page_number", "temporal_period")


def gate(candidates: DataFrame) -> DataFrame:
    """Pairs with the gate's step, verdict, shift_type, confidence and relationship_id."""
    out = candidates.withColumns({"pair_failure": expr(S.pair_failure()), "values_equal": expr(S.values_equal(Spark))})
    out = out.withColumn("step", expr(S.gate_step()))
    out = out.withColumns({"verdict": expr(S.outcome("step", 0)), "shift_type": expr(S.outcome("step", 1)), "confidence": expr(S.confidence("step"))})
    return out.withColumn("relationship_id", expr(Spark.digest("a_fact_id || ':' || b_fact_id || ':' || verdict")))


def relationships(gated: DataFrame) -> DataFrame:
    """What is stored: everything but extraction failures."""
    return gated.where("verdict <> 'extraction_failure'")


#: How far a pair comes at each step, for the fields that match.
_PAST = {s: k for k, s in enumerate(("header", "flawed", "entity", "definition", "nature", "scope", "milestone", "period", "equal", "unequal"))}


def diagnoses(d=Spark) -> dict[str, str]:
    """The diagnosis and the mitigation of a pair's flaw, by ``pair_failure``."""
    both = M.sides(d)

    def text(k: int) -> str:
        sides = [(p, M.fact_fields(d, S.qualifier(p), p, label)) for p, label in (("a_", "Fact A"), ("b_", "Fact B"))]
        flawed = [(f"pair_failure = '{p[0].upper()}:{code}'", M.filled(d, texts[k], fields)) for p, fields in sides for code, texts in M.DIAGNOSES.items()]
        return S.cases(("pair_failure = 'CROSS_SOVEREIGN'", M.filled(d, M.CROSSED[k], both)), *flawed)

    return {"diagnosis": text(0), "mitigation": text(1)}


def texts(d=Spark) -> dict[str, str]:
    """What is said of a pair, over the gate's columns and ``diagnoses``; None where there is nothing to say."""
    bad = lambda c: f"CASE WHEN a_is_header_metadata THEN a_{c} ELSE b_{c} END"
    both = M.sides(d)
    equivalence = S.cases((units.equal_text("a_value", "b_value"), d.lit(M.EQUIVALENCE[0])), ("a_scale <> b_scale", M.filled(d, M.EQUIVALENCE[1], both)), default=M.filled(d, M.EQUIVALENCE[2], both))
    fields = both | {"bad_raw": bad("raw_value"), "bad_doc": bad("document_id"), "bad_page": d.text(f"({bad('page_number')})"), "bad_quote": bad("verbatim_quote"), "diagnosis": "diagnosis", "mitigation": "mitigation", "equivalence": f"({equivalence})"}
    return {
        "summary": M.by_step(d, M.SUMMARY, fields), "reasoning": M.by_step(d, M.REASONING, fields), "verdict_rationale": M.by_step(d, M.RATIONALE, fields),
        "temporal_progression": M.by_step(d, M.PROGRESSION, fields), "unit_normalization": f"CASE WHEN step IN ('equal', 'unequal') THEN {normalization(d)} END", **matched_fields(d, fields),
    }


def normalization(d=Spark) -> str:
    """How a pair's values compare in base units; NULL where they don't."""
    both = M.sides(d)
    return S.cases(
        ("coalesce(a_number > 0, FALSE) IS FALSE OR b_number IS NULL", "NULL"),
        ("a_scale <> b_scale", M.filled(d, M.NORMALIZATION[0], both)),
        ("a_number <> b_number", M.filled(d, M.NORMALIZATION[1], both)),
        default=d.lit(M.NORMALIZATION[2]),
    )


def matched_fields(d, fields: dict[str, str]) -> dict[str, str]:
    """Matched and differing fields as texts joined by '; '."""
    rank = S.cases(*[(f"step = '{s}'", str(k)) for s, k in _PAST.items()])
    has = lambda x: f"coalesce(trim(a_{x}), '') <> '' AND coalesce(trim(b_{x}), '') <> ''"
    reached = lambda s: f"({rank}) > {_PAST[s]}"
    parts = [
        (reached("entity"), "'Entity (' || a_entity || ')'"),
        (reached("definition"), "'Metric Definition (' || a_canonical_def || ')'"),
        (reached("nature"), "'Value Nature (' || a_value_nature || '); Unit Compatibility'"),
        (f"{reached('scope')} AND {has('reporting_scope')}", "'Reporting Scope (' || a_reporting_scope || ')'"),
        ("step = 'milestone'", "'Cumulative Milestone Nature'"),
        (f"{reached('period')} AND {has('temporal_period')}", "'Temporal Period (' || trim(a_temporal_period) || ')'"),
        ("step = 'equal'", "'Numerical Value'"),
    ]
    matched = "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN {v} END" for c, v in parts) + ")"
    return {"matched_fields": f"CASE WHEN ({rank}) < 2 THEN '' ELSE {matched} END", "differing_fields": M.by_step(d, M.DIFFERING, fields, default="''")}


#: What the audit of a pair keeps of either side.
AUDITED = ("entity", "metric", "value_nature", "temporal_period", "reporting_scope", "canonical_def")


def explained(gated: DataFrame) -> DataFrame:
    """The gate's pairs with all that is said of them, and an audit map of what was compared (or of the flaw)."""
    out = gated.withColumns({c: expr(t) for c, t in diagnoses().items()})
    out = out.withColumns({c: expr(t) for c, t in texts().items()})
    pair = F.create_map(*[x for c in AUDITED for p in ("a", "b") for x in (F.lit(f"{c}_{p}"), F.col(f"{p}_{c}"))])
    bad = F.when(F.col("a_is_header_metadata"), F.col("a_fact_id")).otherwise(F.col("b_fact_id"))
    audit = (
        F.when(F.col("step") == "header", F.create_map(F.lit("error"), F.lit("table_header_year_error"), F.lit("fact_id"), bad))
        .when(F.col("step") == "flawed", F.create_map(F.lit("failure_reason"), F.col("diagnosis"), F.lit("mitigation"), F.col("mitigation")))
        .when(F.col("step") == "entity", F.map_filter(pair, lambda k, v: ~k.startswith("canonical_def")))
        .otherwise(pair)
    )
    return out.withColumn("audit", audit)

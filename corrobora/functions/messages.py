"""Texts that the gate and the audits give, as templates over the columns of a fact or a pair."""

from __future__ import annotations

import re

from .dialect import Dialect, cases

# What the gate says at each step; names in braces are listed in ``pair_fields``.
REASONING = {
    "header": "Extraction Failure Diagnosed: Table header column bare calendar year '{bad_raw}' was erroneously captured as a numerical metric value in '{bad_doc}' (p.{bad_page}). Mitigation: Deploy structural table column date parser to reject bare calendar years when capturing financial metrics. Source quote context indicates column metadata: \"{bad_quote}\".",
    "flawed": "{diagnosis} {mitigation}",
    "entity": "Entities differ ('{entity_a}' vs '{entity_b}'). Cross-entity comparison rejected.",
    "definition": "Comparability Gate Disqualification: Metric definitions are distinct and not comparable. Fact A defines '{def_a}' in '{doc_a}' (p.{page_a}), whereas Fact B defines '{def_b}' in '{doc_b}' (p.{page_b}). Soundalike metrics are strictly isolated; numbers were not compared.",
    "nature": "Comparability Gate Disqualification: Value natures are incompatible. Fact A is a '{nature_a}' ({value_a}), while Fact B is a '{nature_b}' ({value_b}). Margins or percentages cannot be compared to absolute amounts or counts.",
    "scope": "Apparent contradiction reconciled by reporting scope shift: Fact A reflects '{scope_a}' accounting scope ({value_a}), whereas Fact B reflects '{scope_b}' accounting scope ({value_b}).",
    "milestone": "Temporal Progression / Milestone Update: Both documents report cumulative {def_a} since inception/incorporation across different milestone dates: '{doc_a}' reports {value_a} ({period_a}), while '{doc_b}' reports {value_b} ({period_b}). This represents an operational milestone progression over time, NOT a contradiction and NOT corroboration.",
    "period": "The values differ due to different reporting periods: Fact A reflects '{period_a}' ('{doc_a}', p.{page_a}: {value_a}), while Fact B reflects '{period_b}' ('{doc_b}', p.{page_b}: {value_b}).",
    "equal": "Facts corroborated across '{doc_a}' (p.{page_a}) and '{doc_b}' (p.{page_b}). {equivalence}",
    "unequal": "Conflicting disclosures: '{doc_a}' (p.{page_a}) reports {value_a}, while '{doc_b}' (p.{page_b}) reports {value_b} for {def_a} under matching period ({period_or_none}) and scope without contextual justification.",
}
SUMMARY = {
    "header": "Table header bare calendar year '{bad_raw}' misclassified as metric value.",
    "flawed": "Diagnostic failure identified during comparability audit.",
    "entity": "Entity mismatch: {entity_a} vs {entity_b}.",
    "definition": "Metric definition mismatch: {def_a} vs {def_b}.",
    "nature": "Incompatible value natures: {nature_a} ({value_a}) vs {nature_b} ({value_b}).",
    "scope": "Scope Shift: {scope_a} vs {scope_b}.",
    "milestone": "Temporal update: {value_a} ({period_a}) -> {value_b} ({period_b}).",
    "period": "Temporal Shift: {period_a} vs {period_b}.",
    "equal": "Both documents corroborate {def_a} ({value_a}).",
    "unequal": "Genuine contradiction: {value_a} vs {value_b} for {def_a}.",
}
RATIONALE = {
    "header": "Structural metadata anomaly: column year extracted as financial metric value.",
    "flawed": "Failed pre-comparison audit: {diagnosis}",
    "entity": "Entities are distinct subjects and cannot be reconciled or contradicted.",
    "definition": "Disqualified at Comparability Gate: '{def_a}' and '{def_b}' are distinct concepts.",
    "nature": "Incompatible value natures. Absolute currency and percentages/margins cannot be compared.",
    "scope": "Contextual scope shift explains divergence ({scope_a} vs {scope_b}).",
    "milestone": "Cumulative metric observed across different chronological milestones (Temporal Update).",
    "period": "Period-specific disclosures represent different historical reporting periods ({period_a} vs {period_b}).",
    "equal": "Passes comparability gate across all dimensions; values agree within tolerance under unit normalization.",
    "unequal": "Passes comparability gate with matching entity, metric definition, period, and scope, but reported values genuinely diverge beyond acceptable tolerance.",
}
# How two equal values were found to agree, and how two values compare in base units.
EQUIVALENCE = (
    "Identical verbatim values.",
    "Unit conversion equivalence applied: {value_a} ({unit_a}) normalizes to {number_a} base units, which matches {value_b} ({unit_b}) at {number_b} base units (within {percent_2}% rounding variance).",
    "Normalized numerical equivalence (within {percent_1}% rounding variance).",
)
NORMALIZATION = (
    "Converted '{value_a}' ({unit_a_or}) and '{value_b}' ({unit_b_or}) to canonical scalar: {number_a} vs {number_b} ({percent_2}% variance).",
    "Numerical comparison: {number_a} vs {number_b} ({percent_2}% rounding variance).",
    "Values are identically matched.",
)
PROGRESSION = {"milestone": "Cumulative progression: {value_a} ({period_a}) -> {value_b} ({period_b})"}
DIFFERING = {
    "header": "Extraction Validity (Table Header Anomaly)",
    "flawed": "Validity Check",
    "entity": "Entity ('{entity_a}' != '{entity_b}')",
    "definition": "Metric Definition ('{def_a}' != '{def_b}')",
    "nature": "Value Nature ('{nature_a}' != '{nature_b}')",
    "scope": "Reporting Scope ('{scope_a}' vs '{scope_b}')",
    "milestone": "Milestone Period ('{period_a}' -> '{period_b}')",
    "period": "Temporal Period ('{period_a}' vs '{period_b}')",
    "unequal": "Numerical Value ('{value_a}' != '{value_b}')",
}

# Diagnosis and mitigation of a pair's flaw; braces name columns of the flawed fact.
CROSSED = (
    "Cross-Sovereign Comparison Error: Attempted to compare sovereign indicator '{metric_a}' between two distinct sovereign entities ('{entity_a}' vs '{entity_b}'). Cross-national indicators cannot constitute an intra-entity contradiction or temporal shift.",
    "Mitigation: Enforce strict sovereign entity boundary isolation in the CrossDocClusterer, disallowing cross-document pairing unless the metric is explicitly regional (e.g., CEMAC/WAEMU rules) or multilateral (e.g., Global Growth).",
)
DIAGNOSES = {
    "BOUNDARY_ERROR": (
        "{label} ({doc}, p.{page}) contains an unparsed token '{value}' caused by layout segmentation clipping.",
        "Mitigation: Re-scan parent table row or discard fragment using the NoiseFilter boundary check.",
    ),
    "EXTRACTION_ERROR": (
        "{label} extracted a bare calendar year '{value}' as the numerical value for '{metric}'.",
        "Mitigation: Disqualify 4-digit calendar years matching '20XX' from being classified as numerical metric values.",
    ),
    "QUALIFIER_DROPPED": (
        "{label} ({doc}, p.{page}) exhibits qualifier truncation: source quote explicitly specifies '{qualifier}', but the parser truncated the qualifier, incorrectly converting sector-specific or scenario growth into headline Real GDP Growth.",
        "Mitigation: Prioritize qualified noun-phrase metric patterns ('Oil GDP Growth', 'Non-Oil GDP Growth', 'Compound Average GDP Growth') before generic Real GDP matching.",
    ),
    "LAYOUT_FLATTENING": (
        "{label} ({doc}, p.{page}) exhibits table layout flattening: ungridlined table rows were parsed as flat text, collapsing adjacent numeric columns into an unsegmented string ('{quote_head}...').",
        "Mitigation: Employ coordinate-based table cell bounding box alignment or column-position segmentation instead of raw string concatenation.",
    ),
    "EVIDENCE_MISSING": (
        "{label} lacks verifiable source evidence in the document.",
        "Mitigation: Require strict evidence quote matching before committing fact to the knowledge store.",
    ),
}

#: The descriptive fields of a failure record, beside what was observed.
RECORD = ("expected_evidence", "observed_result", "problem_description", "impact", "detection_mechanism", "mitigation_strategy", "potential_improvement")
# The fields of a failure record by code; braces name columns of the fact.
RECORDS = {
    "BOUNDARY_ERROR": (
        "Valid numerical metric measurement.",
        "Value: '{value}' for metric '{metric}'",
        "Unparsed punctuation fragment caused by PDF column clipping or footnote boundary artifact.",
        "Pollutes knowledge store with non-informative entries and breaks numerical aggregations.",
        "NoiseFilter boundary validator detecting isolated punctuation/empty tokens.",
        "Enforce minimum token length and alphanumeric content checks before committing fact.",
        "Subword OCR token reconstruction with bounding box column boundaries.",
    ),
    "EXTRACTION_ERROR": (
        "Financial or statistical measurement for '{metric}'.",
        "Extracted bare calendar year '{value}' as metric value.",
        "Regex greedily captured 4-digit calendar years as numerical metric measurements.",
        "Corrupts numerical trend and contradiction calculations.",
        "Audit regex matching '20XX' in value field of financial metrics.",
        "Disqualify bare 4-digit years from numerical values and route to temporal_period.",
        "Named Entity Recognition pipeline separating DATE from MONEY/PERCENT/QUANTITY.",
    ),
    "QUALIFIER_DROPPED": (
        "Noun-phrase qualifier indicating '{qualifier}'.",
        "Generic metric 'Real GDP Growth' with value '{value}'.",
        "Parser stripped the leading qualifier '{qualifier}', conflating sub-sector or scenario output with total headline Real GDP.",
        "Produces false cross-document contradictions when compared against total sovereign Real GDP.",
        "Domain gazetteer scan matching dropped modifiers in verbatim source quotes.",
        "Prioritize qualified noun-phrase regexes ('{qualifier_title} Growth') before generic Real GDP.",
        "Syntactic dependency chunking with negative lookbehinds for compound noun phrases.",
    ),
    "LAYOUT_FLATTENING": (
        "Single scalar numerical value for one table column.",
        "Collapsed multiple columns: '{value}'",
        "Ungridlined table cells collapsed into a single multi-number text stream.",
        "Prevents metric normalization and distorts comparison reasoning.",
        "Pattern matching on multi-token whitespace-separated digit sequences in value field.",
        "Apply coordinate-based cell bounding box segmentation before text concatenation.",
        "Visual table structure recognition using layout transformer or bounding boxes.",
    ),
    "EVIDENCE_MISSING": (
        "Verifiable sentence or table row grounding the assertion.",
        "Empty or minimal verbatim evidence quote.",
        "Fact was extracted without grounding evidence from the source document.",
        "Ungrounded claims cannot be audited or verified by human evaluators.",
        "Evidence quote length and content validation check.",
        "Enforce mandatory minimum quote length before committing fact to knowledge store.",
        "Strict bidirectional quote verification against original document text.",
    ),
}
#: The record of two sovereigns that were compared.
CROSSED_RECORD = (
    "Independent sovereign national accounting for {entity_a} and {entity_b}.",
    "Attempted comparison of {metric_a} across {entity_a} ({value_a}) and {entity_b} ({value_b}).",
    "Cross-sovereign comparison error: comparing national metrics from distinct sovereign states without a shared multilateral convergence target.",
    "Produces spurious cross-document contradictions between independent national economies.",
    "Sovereign entity verification in CrossDocClusterer detecting mismatched sovereign states.",
    "Enforce sovereign entity partition in CrossDocClusterer, disallowing cross-sovereign indicator pairing unless explicitly regional or global.",
    "Ontological knowledge graph enforcing sovereign entity boundaries and regional multilateral convergence tags.",
)
# Failures that are always on record: code, document, page and the record's fields.
CANONICAL = (
    ("QUALIFIER_DROPPED", "chad.pdf", 9,
     "oil GDP growth average only 1.7 percent from 2020-23", "Real GDP Growth = 1.7%",
     "Dropped Sector Modifier: The parser matched 'GDP growth' and dropped the leading qualifier 'oil', incorrectly converting sector-specific growth into total headline Real GDP growth.",
     "Generates a false contradiction when compared against headline Real GDP growth from multilateral agencies.",
     "Domain qualifier audit scanning for sector modifiers ('oil', 'non-oil', 'agricultural') preceding GDP mentions.",
     "Prioritize qualified noun-phrase regexes ('Oil GDP Growth') before generic Real GDP patterns with negative lookbehinds.",
     "Fine-tuned token classification (BIO tagging) for compound financial entities."),
    ("REASONING_ERROR", "niger.pdf", 22,
     "Compound average GDP growth rate 16.5% under adjustment/consolidation scenario table", "Annual Real GDP Growth = 16.5%",
     "Compound vs Single-Period Mismatch: The string 16.5% comes from a multi-year adjustment scenario projection, not an actual single-period headline growth rate.",
     "Grossly overstates single-year economic growth and distorts historical trend analysis.",
     "Context dimension analysis identifying 'compound average', 'cagr', and scenario headers.",
     "Extract scenario and compound qualifiers into context.reporting_scope and context.temporal_period.",
     "Hierarchical table header parser distinguishing baseline actuals from adjustment scenario projections."),
    ("EXTRACTION_ERROR", "01-delhivery-prospectus-2022-excerpt.pdf", 15,
     "Table 3 Express Parcel service metrics", "Metric value extracted as '3' from Table 3 title/index",
     "Table Row Index Extracted as Metric: Naive table layout parsers without coordinate alignment capture table indices or figure numbers as metric values.",
     "Injects meaningless index integers into the numerical fact knowledge store.",
     "Monotonic integer sequence detection matching leading column numbers to table indices.",
     "Disqualify leading column indices and enforce unit/currency/percentage validation on values.",
     "Bounding-box coordinate-aligned table cell extraction with strict column type inference."),
)


# What is said of a flawed fact that stands for the failures where no pair does.
FALLBACK_REASONING = "Table Layout Flattening Extraction Anomaly: {diagnosis} Observed in '{doc_a}' (p.{page_a}) when benchmarked against clean corpus disclosures. {mitigation}"
FALLBACK_SUMMARY = "Extraction layout anomaly diagnosed in '{doc_a}' (p.{page_a})."


def filled(d: Dialect, template: str, fields: dict[str, str]) -> str:
    """A template as SQL text; a missing value is printed as None."""
    parts = re.split(r"\{(\w+)\}", template)
    made = [f"coalesce({fields[x]}, 'None')" if k % 2 else d.lit(x) for k, x in enumerate(parts) if x]
    return " || ".join(made) if len(made) > 1 else made[0]


def by_step(d: Dialect, texts: dict[str, str], fields: dict[str, str], step: str = "step", default: str = "NULL") -> str:
    return cases(*[(f"{step} = '{s}'", filled(d, t, fields)) for s, t in texts.items()], default=default)


def fact_fields(d: Dialect, qualifier: str, p: str = "", label: str = "") -> dict[str, str]:
    """What braces stand for in the texts of one fact."""
    title = cases(*[(f"{qualifier} = {d.lit(q)}", d.lit(q.title())) for q in ("oil gdp", "non-oil", "compound average", "nominal gdp", "potential growth")])
    return {
        "label": d.lit(label), "doc": f"{p}document_id", "page": d.text(p + "page_number"), "value": f"{p}value", "metric": f"{p}metric",
        "qualifier": f"({qualifier})", "qualifier_title": title, "quote_head": f"substring({p}verbatim_quote, 1, 75)",
    }


def sides(d: Dialect) -> dict[str, str]:
    """What braces stand for in the texts of a pair, for either side."""
    out = {}
    for s in "ab":
        out |= {f"{k}_{s}": f"{s}_{c}" for k, c in (("doc", "document_id"), ("entity", "entity"), ("metric", "metric"), ("def", "canonical_def"), ("nature", "value_nature"), ("value", "value"), ("scope", "reporting_scope"))}
        out |= {f"unit_{s}": f"coalesce({s}_unit, '')", f"unit_{s}_or": f"coalesce(nullif({s}_unit, ''), 'unscaled')", f"number_{s}": d.grouped(f"{s}_number")}
        out |= {f"page_{s}": d.text(f"{s}_page_number"), f"period_{s}": f"trim({s}_temporal_period)"}
    percent = "(abs(a_number - b_number) / nullif(a_number, 0) * 100)"
    return out | {"percent_1": d.fixed(percent, 1), "percent_2": d.fixed(percent, 2), "period_or_none": "coalesce(nullif(trim(a_temporal_period), ''), 'unspecified')"}

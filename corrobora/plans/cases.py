"""Hand-written cases: a row a branch, with results that are written down and not worked out by the engine's own SQL text."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facts as S
from ..functions import text as T
from ..functions import units as U
from ..functions.dialect import DuckDB, Spark
from ..operators import admin, answers, extraction, pages, store
from ..operators import consensus as C
from ..operators import facts as ops
from ..sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_SQL = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _literal(x) -> str:
    if x is None:
        return "NULL"
    return DuckDB.lit(x) if isinstance(x, str) else str(x).upper() if isinstance(x, bool) else repr(x)


def golden(name: str, given: str, rows: Sequence[tuple], made: Callable[[DataFrame], DataFrame], want: str, expected: Sequence[tuple]) -> None:
    """Register a query over literal rows, whose result is a literal table."""
    columns = [c.split() for c in want.split(", ")]
    QUERIES[name] = lambda spark, d: made(spark.createDataFrame(list(rows), given)).select(*[c for c, _ in columns])
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in expected)
    ORACLES[name] = "SELECT " + ", ".join(f"CAST({c} AS {_SQL[t]}) AS {c}" for c, t in columns) + f" FROM (VALUES {body}) AS t({', '.join(c for c, _ in columns)})"


def scalar(name: str, given: str, expression: str, kind: str, rows: Sequence[tuple]) -> None:
    """Cases of one scalar: the last of each row is its result."""
    numbered = [(k, *r[:-1]) for k, r in enumerate(rows)]
    golden(name, f"n int, {given}", numbered, lambda df: df.withColumn("result", F.expr(expression)), f"n int, result {kind}", [(k, r[-1]) for k, r in enumerate(rows)])


# --- scalars --------------------------------------------------------------------------------------------------------
scalar("case_scale", "value string, unit string", U.scale(Spark, "value", "unit"), "double", [
    ("8,142 Cr", None, 1e7), ("5 crore", "", 1e7), ("5", "INR Crores", 1e7), ("3 lakh", "", 1e5), ("3", "Lakhs", 1e5), ("7 Mn", "", 1e6), ("7", "million", 1e6), ("7", "Millions", 1e6),
    ("2 bn", "", 1e9), ("2", "Billion", 1e9), ("2", "billions", 1e9), ("9 k", "", 1e3), ("9", "thousand", 1e3), ("2.8Bn", "", 1.0), ("12", "INR Cr / %", 1e7), ("5 mn", "cr", 1e7), ("5%", "%", 1.0),
])
scalar("case_number", "value string", U.plain_number(Spark, "value"), "double", [
    ("8,142", 8142.0), ("-", None), ("NA", None), ("N/A", None), ("None", None), ("", None), (None, None), (",", None), ("12.4-13", None), ("+5", 5.0), ("-3.5%", -3.5), ("Rs. 81 Cr", 0.81), ("Rs 81 Cr", 81.0), ("..", None),
])
scalar("case_bare_year", "value string", T.is_bare_year(Spark, "value"), "boolean", [("2021,", True), ("(1999)", True), ("1899", False), ("20211", False), ("", False), (None, False), ("[2024/]", True), ("FY24", False)])
scalar("case_signal", "value string", T.has_signal(Spark, "value"), "boolean", [
    ("up 25 bps now", True), ("up 25 basis points", True), ("5 percent more", True), ("5%", False), ("Rs. 5", True), ("INR 5 Crore", True), ("1,234 things", True), ("12 things", False), ("in FY only", True), ("Q3 was", True), ("in 2024", True),
    ("2023-24", True), ("the deficit", True), ("plain words", False), ("Margins", False),
])
scalar("case_boilerplate", "value string", T.is_boilerplate(Spark, "value"), "boolean", [
    ("short", True), ("  tiny    ", True), ("Safe  Harbour and Disclaimer", True), ("This presentation is prepared by X", True), ("forward-looking statements", True), ("All Rights Reserved 2024", True),
    ("Statutory Reports Financial Statements", True), ("Corporate Overview Statutory Reports", True), ("Table of Contents", True), ("Neither the Company nor any of its advisors", True),
    ("no representation or warranty, express or implied", True), ("Annual Report 2023-24 Corporate Overview", True), ("Revenue grew by 5 percent", False),
])
scalar("case_rejected", "value string", T.is_rejected(Spark, "value"), "boolean", [
    ("Page 12", True), ("3 of 40", True), ("- 7 -", True), ("please read section 4", True), ("Prospectus dated May", True), ("Corporate Identity Number: 1", True), ("scan this QR code", True), ("confidential and proprietary", True),
    ("printed on recycled paper", True), ("This page is intentionally left blank", True), ("The accompanying notes are an integral part", True), ("Figure 3:", True), ("Table 12", True), ("Table 12 shows", False), ("Page 12 of the report", False),
])
scalar("case_period", "value string", T.period(Spark, "value"), "string", [("Q4 FY24", "FY24"), ("in FY 2024-25 and", "FY 2024-25"), ("2024-25", "2024-25"), ("since inception", "since inception"), ("in 2023.", "2023"), ("Q1 of 1999", None), ("fy23", "fy23"), (None, None)])
scalar("case_scope", "value string", T.scope(Spark, "value"), "string", [("Standalone and consolidated", "Consolidated"), ("standalone", "Standalone"), ("as Restated", "Restated"), ("unconsolidated", None), ("", None)])
scalar("case_tokens", "value string", T.token_count(Spark, "value"), "int", [("", 1), ("one", 1), ("one two", 2), ("a b c d", 5), (" a  b\nc ", 3), ("x " * 166, 220), ("x " * 167, 222)])
scalar("case_cleaned", "value string", T.clean(Spark, "value"), "string", [
    ("GDP (Table 3, row 2) rose", "GDP   rose"), ("see Box 1 now", "see   now"), ("rate 3/ fell [1, 2] and (1,5).", "rate  fell   and  ."), ("FY2025/26 and 2024/25", "FY2025/26 and  25"), ("7. Growth slowed. 10. Prices rose", ". Growth slowed. Prices rose"),
])
scalar("case_canonical", "metric string, verbatim_quote string, metric_type string", S.canonical(), "string", [(m, q, m, want) for m, q, want in (
    ("EBITDA", "adjusted ebitda margin of 3%", "Adjusted EBITDA Margin"), ("EBITDA", "margin, adj figures", "Adjusted EBITDA Margin"), ("Adjusted EBITDA", "the margin", "Adjusted EBITDA Margin"), ("EBITDA Margin", "", "EBITDA Margin"),
    ("x", "service ebitda", "Service EBITDA"), ("Reported EBITDA", "", "Reported EBITDA"), ("EBITDA", "adj. for", "Adjusted EBITDA"), ("EBITDA", "", "EBITDA"), ("x", "revenue from services", "Revenue from Services"),
    ("Revenue", "contracts with customers", "Revenue from Customers"), ("Revenue from Customers", "", "Revenue from Customers"), ("Revenue", "operating revenue", "Revenue from Operations"), ("Revenue", "", "Revenue"),
    ("Non-Oil GDP Growth", "", "Oil GDP Growth"), ("GDP Growth", "non-oil sector", "Non-Oil GDP Growth"), ("Nominal GDP", "", "Nominal GDP Growth"), ("GDP CAGR", "", "Compound Average GDP Growth"), ("GDP", "compound rate", "Compound Average GDP Growth"),
    ("GDP", "potential output", "Potential GDP Growth"), ("Fiscal Deficit", "4.8% of GDP", "Real GDP Growth"), ("Inflation", "food prices", "Food Inflation"), ("CPI Core", "", "Core Inflation"), ("CPI", "", "Headline Inflation"),
    ("Parcel Shipments", "", "Express Parcel Shipments"), ("Reach", "18,793 pin codes", "Pin Codes Covered"), ("Delivery Center Count", "", "Last-Mile Delivery Centres"), ("Freight", "", "PTL Freight Volume"), ("  Other ", "", "Other"),
)])
scalar("case_entity", "filename string, sample string", S.entity(Spark, "filename", "sample"), "string", [
    ("d/Delhivery-x.pdf", "", "Delhivery Limited"), ("imf-nigeria-2023.pdf", "", "Federal Republic of Nigeria"), ("x.pdf", "IMF Country Report No. 23/1\nCHAD\n", "Republic of Chad"), ("x.pdf", "Article IV Consultation with Kenya", "Republic of Kenya"),
    ("x.pdf", "about delhivery", "Delhivery Limited"), ("x.pdf", "The chadian budget", "Republic of Chad"), ("x.pdf", "nothing", "Enterprise / Document Subject"), ("niger1.pdf", "", "Republic of Niger"), ("nigerish.pdf", "", "Enterprise / Document Subject"),
])

# --- enrichment -----------------------------------------------------------------------------------------------------
FACT = "corpus string, entity string, metric string, document_id string, page_number int, value string, raw_value string, temporal_period string, reporting_scope string, unit string, verbatim_quote string, confidence_score double"


def fact(corpus: str, document: str, **other) -> tuple:
    base = {"entity": "E", "metric": "Revenue from Operations", "document_id": document, "page_number": 1, "value": "1 Cr", "raw_value": "1", "temporal_period": "FY24", "reporting_scope": "Consolidated", "unit": "INR Cr", "verbatim_quote": "revenue from operations", "confidence_score": 1.0}
    return (corpus, *(base | other).values())


_ENRICHED = [
    ({"metric": "EBITDA", "verbatim_quote": "Adjusted EBITDA margin"}, ("Adjusted EBITDA Margin", "margin", "period_duration", False, "c")),
    ({"metric": "Sales", "verbatim_quote": "service ebitda stands"}, ("Service EBITDA", "absolute_currency", "period_duration", False, "c")),
    ({"metric": "EBITDA", "verbatim_quote": "revenue from services and ebitda"}, ("EBITDA", "absolute_currency", "period_duration", False, "c")),
    ({"metric": "Revenue", "verbatim_quote": "contracts with customers"}, ("Revenue from Customers", "absolute_currency", "period_duration", False, "c")),
    ({"metric": "Headline Inflation", "verbatim_quote": "prices", "value": "5%"}, ("Headline Inflation", "growth_rate", "period_duration", False, "c")),
    ({"metric": "Share", "verbatim_quote": "a share", "value": "5%"}, ("Share", "percentage", "period_duration", False, "c")),
    ({"metric": "Pin Codes Covered", "verbatim_quote": "pin codes since inception"}, ("Pin Codes Covered", "count", "cumulative", False, "c")),
    ({"metric": "Assets", "verbatim_quote": "assets held", "temporal_period": "As at March 31"}, ("Assets", "absolute_currency", "point_in_time", False, "c")),
    ({"metric": "Assets", "verbatim_quote": "for the year ended 2021", "raw_value": "2021,"}, ("Assets", "absolute_currency", "period_duration", True, "c")),
    ({"metric": "Real GDP Growth", "verbatim_quote": "growth", "raw_value": "2023", "corpus": " "}, ("Real GDP Growth", "growth_rate", "period_duration", True, "E")),
    ({"metric": "Assets", "verbatim_quote": "assets", "corpus": None, "document_id": "rbi-bulletin.pdf"}, ("Assets", "absolute_currency", "period_duration", False, "India Macroeconomics")),
    ({"metric": "Assets", "verbatim_quote": "assets", "corpus": None, "entity": "Delhivery Ltd"}, ("Assets", "absolute_currency", "period_duration", False, "Delhivery")),
    ({"metric": "Assets", "verbatim_quote": "assets", "corpus": None, "entity": " "}, ("Assets", "absolute_currency", "period_duration", False, "General Knowledge")),
]


def _case_facts() -> list[tuple]:
    return [fact(f.get("corpus", "c"), f.get("document_id", "d.pdf"), **({k: v for k, v in f.items() if k not in ("corpus", "document_id")} | {"page_number": k_})) for k_, (f, _) in enumerate(_ENRICHED, 1)]


golden("case_enrich", FACT, _case_facts(), ops.enrich, "page_number int, metric string, value_nature string, temporal_nature string, is_header_metadata boolean, corpus string", [(k, *w) for k, (_, w) in enumerate(_ENRICHED, 1)])

# --- the gate -------------------------------------------------------------------------------------------------------
_PIN = {"metric": "Pin Codes Covered", "verbatim_quote": "pin codes", "unit": "Count"}
#: Case, both facts, and: verdict, shift, confidence, summary, reasoning.
_GATE = [
    ("header", {"value": "2021", "raw_value": "2021"}, {"value": "81,415 Mn"}, "extraction_failure", "none", 0.98, "Table header bare calendar year '2021' misclassified as metric value.",
     "Extraction Failure Diagnosed: Table header column bare calendar year '2021' was erroneously captured as a numerical metric value in 'a.pdf' (p.1). Mitigation: Deploy structural table column date parser to reject bare calendar years when capturing financial metrics. Source quote context indicates column metadata: \"revenue from operations\"."),
    ("sovereigns", {"entity": "Republic of Chad"}, {"entity": "Republic of Niger"}, "extraction_failure", "none", 0.95, "Diagnostic failure identified during comparability audit.",
     "Cross-Sovereign Comparison Error: Attempted to compare sovereign indicator 'Revenue from Operations' between two distinct sovereign entities ('Republic of Chad' vs 'Republic of Niger'). Cross-national indicators cannot constitute an intra-entity contradiction or temporal shift. Mitigation: Enforce strict sovereign entity boundary isolation in the CrossDocClusterer, disallowing cross-document pairing unless the metric is explicitly regional (e.g., CEMAC/WAEMU rules) or multilateral (e.g., Global Growth)."),
    ("fragment", {}, {"value": "--", "page_number": 7}, "extraction_failure", "none", 0.95, "Diagnostic failure identified during comparability audit.",
     "Fact B (b.pdf, p.7) contains an unparsed token '--' caused by layout segmentation clipping. Mitigation: Re-scan parent table row or discard fragment using the NoiseFilter boundary check."),
    ("no quote", {"metric": "Assets", "verbatim_quote": " x "}, {"metric": "Assets", "verbatim_quote": "all assets"}, "extraction_failure", "none", 0.95, "Diagnostic failure identified during comparability audit.",
     "Fact A lacks verifiable source evidence in the document. Mitigation: Require strict evidence quote matching before committing fact to the knowledge store."),
    ("entity", {}, {"entity": "F"}, "not_comparable", "none", 0.90, "Entity mismatch: E vs F.", "Entities differ ('E' vs 'F'). Cross-entity comparison rejected."),
    ("definition", {"metric": "Inflation", "verbatim_quote": "prices rose", "value": "4.9%"}, {"metric": "Inflation", "verbatim_quote": "food rose", "value": "4.6%"}, "metric_mismatch", "none", 0.92, "Metric definition mismatch: Headline Inflation vs Food Inflation.",
     "Comparability Gate Disqualification: Metric definitions are distinct and not comparable. Fact A defines 'Headline Inflation' in 'a.pdf' (p.1), whereas Fact B defines 'Food Inflation' in 'b.pdf' (p.1). Soundalike metrics are strictly isolated; numbers were not compared."),
    ("nature", {}, {"verbatim_quote": "revenue from operations and margin"}, "not_comparable", "none", 0.92, "Incompatible value natures: absolute_currency (1 Cr) vs margin (1 Cr).",
     "Comparability Gate Disqualification: Value natures are incompatible. Fact A is a 'absolute_currency' (1 Cr), while Fact B is a 'margin' (1 Cr). Margins or percentages cannot be compared to absolute amounts or counts."),
    ("scope", {"confidence_score": 0.9}, {"reporting_scope": "Standalone"}, "context_reconciled", "scope_shift", 0.85, "Scope Shift: Consolidated vs Standalone.",
     "Apparent contradiction reconciled by reporting scope shift: Fact A reflects 'Consolidated' accounting scope (1 Cr), whereas Fact B reflects 'Standalone' accounting scope (1 Cr)."),
    ("milestone", {"verbatim_quote": "revenue from operations since inception"}, {"temporal_period": "FY25", "value": "2 Cr"}, "temporal_update", "temporal_shift", 0.95, "Temporal update: 1 Cr (FY24) -> 2 Cr (FY25).",
     "Temporal Progression / Milestone Update: Both documents report cumulative Revenue from Operations since inception/incorporation across different milestone dates: 'a.pdf' reports 1 Cr (FY24), while 'b.pdf' reports 2 Cr (FY25). This represents an operational milestone progression over time, NOT a contradiction and NOT corroboration."),
    ("period", {"value": "3,646 Cr", "temporal_period": "FY21"}, {"value": "8,142 Cr"}, "context_reconciled", "temporal_shift", 0.95, "Temporal Shift: FY21 vs FY24.",
     "The values differ due to different reporting periods: Fact A reflects 'FY21' ('a.pdf', p.1: 3,646 Cr), while Fact B reflects 'FY24' ('b.pdf', p.1: 8,142 Cr)."),
    ("same text", {}, {"value": "1 cr "}, "corroborated", "none", 0.98, "Both documents corroborate Revenue from Operations (1 Cr).", "Facts corroborated across 'a.pdf' (p.1) and 'b.pdf' (p.1). Identical verbatim values."),
    ("other scale", {"value": "8,142 Cr"}, {"value": "81,420 Mn", "unit": "INR Mn"}, "corroborated", "none", 0.98, "Both documents corroborate Revenue from Operations (8,142 Cr).",
     "Facts corroborated across 'a.pdf' (p.1) and 'b.pdf' (p.1). Unit conversion equivalence applied: 8,142 Cr (INR Cr) normalizes to 81,420,000,000 base units, which matches 81,420 Mn (INR Mn) at 81,420,000,000 base units (within 0.00% rounding variance)."),
    ("near", {"value": "100 Cr"}, {"value": "101 Cr"}, "corroborated", "none", 0.98, "Both documents corroborate Revenue from Operations (100 Cr).", "Facts corroborated across 'a.pdf' (p.1) and 'b.pdf' (p.1). Normalized numerical equivalence (within 1.0% rounding variance)."),
    ("shared metric", {"metric": "Global Growth", "verbatim_quote": "global growth", "value": "3.3%"}, {"metric": "Global Growth", "verbatim_quote": "global growth", "value": "3.3%", "entity": "F", "temporal_period": "FY25"}, "corroborated", "none", 0.98, "Both documents corroborate Global Growth (3.3%).",
     "Facts corroborated across 'a.pdf' (p.1) and 'b.pdf' (p.1). Identical verbatim values."),
    ("apart", {**_PIN, "value": "18,793", "temporal_period": None}, {**_PIN, "value": "14,200"}, "genuine_contradiction", "none", 0.92, "Genuine contradiction: 18,793 vs 14,200 for Pin Codes Covered.",
     "Conflicting disclosures: 'a.pdf' (p.1) reports 18,793, while 'b.pdf' (p.1) reports 14,200 for Pin Codes Covered under matching period (unspecified) and scope without contextual justification."),
    ("low confidence", {"confidence_score": 0.05}, {}, "corroborated", "none", 0.10, "Both documents corroborate Revenue from Operations (1 Cr).", "Facts corroborated across 'a.pdf' (p.1) and 'b.pdf' (p.1). Identical verbatim values."),
    ("low and apart", {"confidence_score": 0.02, "value": "9 Cr"}, {}, "genuine_contradiction", "none", 0.10, "Genuine contradiction: 9 Cr vs 1 Cr for Revenue from Operations.",
     "Conflicting disclosures: 'a.pdf' (p.1) reports 9 Cr, while 'b.pdf' (p.1) reports 1 Cr for Revenue from Operations under matching period (FY24) and scope without contextual justification."),
]


def judged(rows: DataFrame) -> DataFrame:
    """Each case's two facts through the gate, whether or not they would be candidates."""
    f = ops.enrich(rows)
    a, b = (f.where(F.col("document_id") == d).select("corpus", *[F.col(c).alias(p + c) for c in ops.SIDE]) for p, d in (("a_", "a.pdf"), ("b_", "b.pdf")))
    return ops.explained(ops.gate(a.join(b, "corpus")))


_GATE_FACTS = [fact(g[0], d, **g[k]) for g in _GATE for k, d in ((1, "a.pdf"), (2, "b.pdf"))]
golden("case_gate", FACT, _GATE_FACTS, judged, "corpus string, verdict string, shift_type string, confidence double, summary string, reasoning string", [(g[0], *g[3:]) for g in _GATE])
golden(
    "case_gate_fields", FACT, [r for r in _GATE_FACTS if r[0] in ("header", "entity", "milestone", "other scale", "apart")], judged, "corpus string, matched_fields string, differing_fields string, temporal_progression string, unit_normalization string",
    [
        ("header", "", "Extraction Validity (Table Header Anomaly)", None, None),
        ("entity", "", "Entity ('E' != 'F')", None, None),
        ("milestone", "Entity (E); Metric Definition (Revenue from Operations); Value Nature (absolute_currency); Unit Compatibility; Reporting Scope (Consolidated); Cumulative Milestone Nature", "Milestone Period ('FY24' -> 'FY25')", "Cumulative progression: 1 Cr (FY24) -> 2 Cr (FY25)", None),
        ("other scale", "Entity (E); Metric Definition (Revenue from Operations); Value Nature (absolute_currency); Unit Compatibility; Reporting Scope (Consolidated); Temporal Period (FY24); Numerical Value", "", None, "Converted '8,142 Cr' (INR Cr) and '81,420 Mn' (INR Mn) to canonical scalar: 81,420,000,000 vs 81,420,000,000 (0.00% variance)."),
        ("apart", "Entity (E); Metric Definition (Pin Codes Covered); Value Nature (count); Unit Compatibility; Reporting Scope (Consolidated)", "Numerical Value ('18,793' != '14,200')", None, "Numerical comparison: 18,793 vs 14,200 (24.44% rounding variance)."),
    ],
)
golden(
    "case_pairs", FACT,
    [fact("c", d, entity=e, metric=m, verbatim_quote=q, page_number=p) for d, e, m, q, p in (
        ("a.pdf", "E", "Assets", "all assets", 1), ("b.pdf", " e", "Assets", "all assets", 2), ("c.pdf", "F", "Assets", "all assets", 3), ("d.pdf", "All", "Assets", "all assets", 4), ("e.pdf", "Republic of Chad", "Assets", "all assets", 5),
        ("a.pdf", "G", "Global Growth", "world", 6), ("b.pdf", "H", "Global Growth", "world", 7), ("b.pdf", "E", "Liabilities", "all owed", 8), ("e.pdf", "document subject", "Assets", "all assets", 9))],
    lambda df: ops.pairs(ops.enrich(df)), "a_page_number int, b_page_number int",
    # the same entity, a shared metric, a generic entity on either side; the sovereign stays alone
    [(1, 2), (6, 7), (1, 4), (2, 4), (3, 4), (4, 9), (1, 9), (2, 9), (3, 9)],
)

# --- audits ---------------------------------------------------------------------------------------------------------
golden(
    "case_audit", FACT,
    [fact("c", "d.pdf", page_number=k, **f) for k, f in enumerate((
        {"value": "N/A"}, {"value": "?"}, {"value": "2021"}, {"metric": "Real GDP Growth", "verbatim_quote": "non-oil growth of 3"}, {"value": "5.4 6.5"}, {"metric": "Assets", "verbatim_quote": "abc"}, {"metric": "Assets", "verbatim_quote": "7.5", "value": "x"},
        {"metric": "Pin Codes", "verbatim_quote": "pin codes", "value": "2021"}, {}), 1)],
    lambda df: C.fact_audit(ops.enrich(df)), "page_number int, failure_type string, expected_evidence string, observed_result string, mitigation_strategy string",
    [
        (1, "BOUNDARY_ERROR", "Valid numerical metric measurement.", "Value: 'N/A' for metric 'Revenue from Operations'", "Enforce minimum token length and alphanumeric content checks before committing fact."),
        (2, "BOUNDARY_ERROR", "Valid numerical metric measurement.", "Value: '?' for metric 'Revenue from Operations'", "Enforce minimum token length and alphanumeric content checks before committing fact."),
        (3, "EXTRACTION_ERROR", "Financial or statistical measurement for 'Revenue from Operations'.", "Extracted bare calendar year '2021' as metric value.", "Disqualify bare 4-digit years from numerical values and route to temporal_period."),
        (4, "QUALIFIER_DROPPED", "Noun-phrase qualifier indicating 'non-oil'.", "Generic metric 'Real GDP Growth' with value '1 Cr'.", "Prioritize qualified noun-phrase regexes ('Non-Oil Growth') before generic Real GDP."),
        (5, "LAYOUT_FLATTENING", "Single scalar numerical value for one table column.", "Collapsed multiple columns: '5.4 6.5'", "Apply coordinate-based cell bounding box segmentation before text concatenation."),
        (6, "EVIDENCE_MISSING", "Verifiable sentence or table row grounding the assertion.", "Empty or minimal verbatim evidence quote.", "Enforce mandatory minimum quote length before committing fact to knowledge store."),
        (7, "EVIDENCE_MISSING", "Verifiable sentence or table row grounding the assertion.", "Empty or minimal verbatim evidence quote.", "Enforce mandatory minimum quote length before committing fact to knowledge store."),
    ],
)


_SHOWN = [fact("c", d, metric=m, verbatim_quote="all of it", value=v, page_number=p) for d, m, v, p in (("b.pdf", "Assets", "5.4 6.5", 2), ("a.pdf", "Debts", "3", 1), ("a.pdf", "Assets", "4", 9), ("c.pdf", "Debts", "2", 1), ("b.pdf", "Debts", "7", 1))]
golden(
    "case_failure_example", FACT, _SHOWN,
    lambda df: C.failure_example(ops.enrich(df)).join(ops.enrich(df).select("fact_id", F.concat_ws(" ", "document_id", "metric").alias("of")), F.array_contains("participants", F.col("fact_id"))).select("of", "summary", "reasoning"), "of string, summary string, reasoning string",
    [(of, "Extraction layout anomaly diagnosed in 'b.pdf' (p.2).", "Table Layout Flattening Extraction Anomaly: Fact A (b.pdf, p.2) exhibits table layout flattening: ungridlined table rows were parsed as flat text, collapsing adjacent numeric columns into an unsegmented string ('all of it...'). Observed in 'b.pdf' (p.2) when benchmarked against clean corpus disclosures. Mitigation: Employ coordinate-based table cell bounding box alignment or column-position segmentation instead of raw string concatenation.") for of in ("a.pdf Assets", "b.pdf Assets", "c.pdf Debts")],
)


def _attributed(failures: DataFrame) -> DataFrame:
    rows = [("d77", "very-long-report-2024.pdf", "Acme"), ("d78", "part.pdf", "Partly"), ("d79", "none.pdf", None), ("d80", "part.pdf", "Later")]
    return store.attribute(failures, failures.sparkSession.createDataFrame(rows, "doc_id string, filename string, corpus string"))


golden(
    "case_attribution", "failure_id string, source_document string, corpus string", [(str(k), s, None) for k, s in enumerate(("d77", "VERY-long-report-2024.pdf", "part.pdf", "part.pdf vs x.pdf", "long-report", "none.pdf", "delhivery-x.pdf", "imf vs chad", None))],
    _attributed, "failure_id string, corpus string",
    [("0", "Acme"), ("1", "Acme"), ("2", "Later"), ("3", "Later"), ("4", "General Knowledge"), ("5", "General Knowledge"), ("6", "Delhivery"), ("7", "India Macroeconomics"), ("8", "General Knowledge")],
)

# --- the catalogue --------------------------------------------------------------------------------------------------
_DOCUMENTS = [
    ("1", "x.pdf", "2024-01-01", '{"corpus": "Meta", "corpus_label": "Label"}', "Own"), ("2", "x.pdf", "2024-01-03", '{"corpus": "Meta", "corpus_label": "Label"}', None), ("3", "x.pdf", "2024-01-02", '{"corpus": "", "corpus_label": "Label"}', ""),
    ("4", "Delhivery-1.pdf", None, "no json", None), ("5", "RBI-bulletin.pdf", "2023-01-01", None, None), ("6", "other.pdf", "2022-01-01", "{}", None),
]
golden("case_document_corpus", "doc_id string, filename string, ingested_at string, metadata string, corpus string", _DOCUMENTS, admin.listed_documents, "doc_id string, corpus string", [("1", "Own"), ("2", "Meta"), ("3", "Label"), ("4", "Delhivery"), ("5", "India Macroeconomics"), ("6", "General Knowledge")])
golden(
    "case_upsert_documents", "doc_id string, filename string, ingested_at string, metadata string, corpus string", [*_DOCUMENTS, ("6", "again.pdf", "2025-01-01", '{"a": "b"}', None), ("6", "first.pdf", "2021-01-01", None, None)],
    lambda df: admin.upsert_documents(df.where("doc_id < '3'"), df.where("doc_id > '3'"), "Given"), "doc_id string, filename string, metadata string, corpus string",
    [("1", "x.pdf", '{"corpus": "Meta", "corpus_label": "Label"}', "Own"), ("2", "x.pdf", '{"corpus": "Meta", "corpus_label": "Label"}', None), ("4", "Delhivery-1.pdf", '{"corpus":"Given"}', "Given"), ("5", "RBI-bulletin.pdf", '{"corpus":"Given"}', "Given"), ("6", "again.pdf", '{"a":"b","corpus":"Given"}', "Given")],
)
golden("case_backfill", "fact_id string, entity string", [("1", "Delhivery Limited"), ("2", "India"), ("3", None)], lambda df: admin.backfilled(df, "facts"), "fact_id string, corpus string", [("1", "Delhivery"), ("2", "India Macroeconomics"), ("3", "India Macroeconomics")])


def _reset(rows: DataFrame) -> DataFrame:
    documents = rows.where("k = 'd'").select(F.col("a").alias("doc_id"), F.col("b").alias("filename"), F.col("c").alias("corpus"))
    cache = rows.where("k = 'cd'").select(F.col("a").alias("doc_id"), F.col("b").alias("filename"), F.col("c").alias("corpus"))
    made = lambda k: rows.where(F.col("k") == k).select(F.col("a").alias("fact_id"), F.col("b").alias("document_id"))
    d, f = admin.reset(documents, made("f"), ["one.pdf", "delhivery.pdf", "india.pdf"], cache, made("cf"))
    return d.select(F.lit("document").alias("what"), F.col("doc_id").alias("id"), "corpus").unionByName(f.select(F.lit("fact").alias("what"), F.col("fact_id").alias("id"), F.lit(None).cast("string").alias("corpus")))


golden(
    "case_reset", "k string, a string, b string, c string",
    [("d", "1", "one.pdf", "C"), ("d", "2", "upload.pdf", "C"), ("cd", "1", "one.pdf", None), ("cd", "3", "delhivery.pdf", None), ("cd", "4", "india.pdf", None), ("cd", "9", "stray.pdf", None), ("f", "f1", "one.pdf", None), ("f", "f2", "upload.pdf", None), ("cf", "c1", "one.pdf", None), ("cf", "c3", "delhivery.pdf", None), ("cf", "c9", "stray.pdf", None)],
    _reset, "what string, id string, corpus string", [("document", "1", "C"), ("document", "3", "Delhivery"), ("document", "4", "India Macroeconomics"), ("fact", "f1", None), ("fact", "c3", None)],
)

# --- pages ----------------------------------------------------------------------------------------------------------
_HTML = "<html><h1>Results</h1><p>Revenue from operations reached Rs. 8,142 Cr in FY24.</p><table><tr><td>one row</td></tr></table><TABLE class=x><tr><th>Metric</th><th>FY23</th><th>FY24</th></tr><tr><td></td><td></td></tr><tr><td>GDP growth<br>(in percent)</td><td>6.1</td><td>6.5|</td><td>9</td></tr></TABLE><p>End &amp; more</p></html>"
golden("case_html_tables", "document_id string, html string", [("w", _HTML), ("n", None), ("e", "<table></table>")], lambda df: readers.html_pages(df).select("document_id", "raw_text", F.size("tables").alias("n"), F.get("tables", F.lit(0))["caption"].alias("caption"), F.get("tables", F.lit(0))["markdown_repr"].alias("markdown")), "document_id string, raw_text string, n int, caption string, markdown string", [
    ("w", "Results\nRevenue from operations reached Rs. 8,142 Cr in FY24.\nEnd & more", 1, "Table 2 on Page 1", "| Metric | FY23 | FY24 |\n| --- | --- | --- |\n| GDP growth (in percent) | 6.1 | 6.5\\\\| |"), ("n", "", 0, None, None), ("e", "", 0, None, None)])
_EXTRACTED = "document_id string, metric string, value string, raw_value string, temporal_period string, reporting_scope string, unit string, confidence_score double"
golden("case_html_facts", "document_id string, html string", [("w", _HTML)], lambda df: extraction.extract(readers.html_pages(df)), _EXTRACTED, [
    ("w", "Real GDP Growth", "6.1%", "6.1", "FY23", None, "%", 0.95), ("w", "Real GDP Growth", "6.5\\|", "6.5", "FY24", None, "%", 0.95), ("w", "Real GDP Growth", "9%", "9", "FY23", None, "%", 0.95), ("w", "Revenue from Operations", "8,142 Cr", "8,142", "FY24", None, "Cr", 0.92)])
golden(
    "case_enriched_text", "doc_id string, page_number int, raw_text string, tables array<struct<caption:string,markdown_repr:string>>, images array<struct<caption:string,width:int,height:int>>",
    [("a", 2, "text", [("Table 1 on Page 2", "| a |"), (None, "| b |")], [(" two\nlines ", 200, 120), ("small", 119, 500), (None, 300, 300)]), ("b", 1, "", [], []), ("c", 1, None, [], None)],
    lambda df: pages.enriched_text(readers.large_images(df)), "doc_id string, text string",
    [("a", "text\n\n\n--- EXTRACTED TABLES ---\n\n\n### Table 1 on Page 2\n\n| a |\n\n| b |\n\n\n--- EXTRACTED FIGURES ---\n\n- [Figure on Page 2]: two lines\n\n- [Figure on Page 2]: Figure/Image 3 on Page 2"), ("b", ""), ("c", "")],
)
_PAGES = f"document_id string, page_number int, raw_text string, tables {readers.TABLES.lower()}"


def _page(document: str, text: str, *tables) -> tuple:
    return (document, 1, text, [({"headers": h, "rows": r, "caption": None, "markdown_repr": m}) for h, r, m in tables])


golden("case_extract_text", _PAGES, [
    _page("one.pdf", "18,793\n(1)\nPin codes covered\nHeadline inflation eased to\n4.6 percent in FY25\nsaw oil\nGDP growth of 2.1 percent"), _page("two.pdf", "Express parcel shipments volume of 2.8 Bn since inception. Consolidated"), _page("three.pdf", "No figures here"),
    _page("four.pdf", "21 pin codes covered\nEBITDA 1 2 3 4 rows\nReal GDP growth moved with the exchange rate by 6.5 per cent")], extraction.extract, _EXTRACTED, [
    ("one.pdf", "Pin Codes Covered", "18,793", "18,793", "FY25", None, "Count", 0.92), ("one.pdf", "Headline Inflation", "4.6%", "4.6", "FY25", None, "%", 0.92), ("one.pdf", "Oil GDP Growth", "2.1%", "2.1", "FY25", None, "%", 0.92),
    ("two.pdf", "Express Parcel Shipments", "2.8Bn", "2.8", "since inception", "Consolidated", "Bn", 0.92)])
_TABLE = (["Metric", "FY23", "FY24"], [["Revenue from operations (Rs Cr)", "7,225", "8,142"], ["GDP growth (in percent)", "6.1", "2021"], ["x", "1"], ["Contribution from GDP growth", "2"], ["Headline inflation %", "N/A", "5.4"]], "| Metric | consolidated")
golden("case_extract_table", _PAGES, [_page("t.pdf", "", _TABLE)], extraction.extract, _EXTRACTED, [
    ("t.pdf", "Revenue from Operations", "7,225", "7225", "FY23", "Consolidated", "INR Cr", 0.95), ("t.pdf", "Revenue from Operations", "8,142", "8142", "FY24", "Consolidated", "INR Cr", 0.95), ("t.pdf", "Real GDP Growth", "6.1%", "6.1", "FY23", "Consolidated", "%", 0.95),
    ("t.pdf", "Headline Inflation", "5.4%", "5.4", "FY24", "Consolidated", "%", 0.95)])

# --- answers --------------------------------------------------------------------------------------------------------
_UNITS = [
    _page("u.pdf", "Outlook\nRevenue grew by 5 percent in FY24. Page 3.\n\nPlain words without any fact at all.", (["A", "B"], [], "| A | B |\n| --- | --- |\n| GDP | 5 |\n| plain | words |")),
    _page("v.pdf", "Nothing to see here."), _page("w.pdf", "  "),
]
golden("case_units", _PAGES, _UNITS, answers.units, "document_id string, text string, section_title string, score double, kind string", [
    ("u.pdf", "Table Data:\n| GDP | 5 |", "Table p.1", 0.95, "table"), ("u.pdf", "Outlook Revenue grew by 5 percent in FY24.", "Outlook", 1.0, "text"), ("v.pdf", "Nothing to see here.", "Page 1", None, "page")])


def _chunked(rows: DataFrame) -> DataFrame:
    return answers.chunks(rows, 8).withColumn("page_list", F.array_join("page_numbers", ","))


golden("case_chunks", "document_id string, page_number int, pos int, text string, section_title string", [
    ("d", 1, 0, "one two three", None), ("d", 1, 1, "four", "S1"), ("d", 2, 0, "five six", "S2"), ("d", 2, 1, "seven eight nine ten", "S3"), ("d", 3, 0, "a b c d e. f g h, i j k l m n o p", "S4"), ("d", 4, 0, "end", None), ("e", 1, 0, "x y", "T")],
    _chunked, "document_id string, chunk int, text string, token_count int, primary_page int, page_list string, section_title string", [
    ("d", 0, "one two three four five six", 7, 1, "1,2", "S1"), ("d", 1, "seven eight nine ten", 5, 2, "2", "S3"), ("d", 2, "a b c d e.", 6, 3, "3", "S3"), ("d", 3, "f g h,", 3, 3, "3", "S3"), ("d", 4, "i j k l m n o p", 10, 3, "3", "S4"), ("d", 5, "end", 1, 4, "4", "S3"), ("e", 0, "x y", 2, 1, "1", "T")])


def failing(prompt: str) -> str:
    raise RuntimeError("no connection")


def stub(prompt: str) -> str:
    """An offline client: an item that names the prompt's words, and one that the rules find too."""
    items = [{"entity": "Chad", "metric": "Words", "value": len(prompt.split()), "verbatim_quote": ""}, {"entity": "unknown", "metric": "Headline Inflation", "value": "4.6%", "unit": "%", "verbatim_quote": "said", "temporal_period": "FY25"}]
    return "```json\n" + json.dumps({"facts": items}) + "\n```"


_ANSWERED = [_page("kenya.pdf", "Headline inflation eased to 4.6 percent in FY25."), _page("v.pdf", "Nothing to see here.")]
_MERGED = "document_id string, entity string, metric string, value string, verbatim_quote string, category string, confidence_score double"
golden("case_answers", _PAGES, _ANSWERED, lambda df: answers.extracted(df, [failing, stub]), _MERGED, [
    ("kenya.pdf", "Republic of Kenya", "Headline Inflation", "4.6%", "Headline inflation eased to 4.6 percent in FY25.", "numerical", 0.92), ("kenya.pdf", "Republic of Chad", "Words", "8", "Page 1", "numerical", 0.95),
    ("v.pdf", "Enterprise / Document Subject", "Headline Inflation", "4.6%", "said", "numerical", 0.95), ("v.pdf", "Republic of Chad", "Words", "4", "Page 1", "numerical", 0.95)])
golden("case_answers_by_page", _PAGES, _ANSWERED, lambda df: answers.extracted(df, [stub], chunked=False), _MERGED, [
    ("kenya.pdf", "Republic of Kenya", "Headline Inflation", "4.6%", "Headline inflation eased to 4.6 percent in FY25.", "numerical", 0.92), ("kenya.pdf", "Republic of Chad", "Words", "8", "Page 1", "numerical", 0.95)])
golden("case_named_entity", "n int, entity string", [(1, "Custom Enterprise"), (2, ""), (3, "Chad"), (4, None)], lambda df: answers.named_entity(df, "Acme"), "n int, entity string", [(1, "Acme"), (2, "Acme"), (3, "Chad"), (4, "Acme")])

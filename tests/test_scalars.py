"""Scalars and cascades, a row for each branch."""

import pytest
from pyspark.sql import functions as F

from corrobora.functions import facts as S
from corrobora.functions import text as T
from corrobora.functions import units as U
from corrobora.functions.dialect import Spark
from corrobora.operators import extraction as X
from corrobora.operators import facts as ops
from corrobora.operators import pages

FACT = "corpus string, entity string, metric string, document_id string, page_number int, value string, raw_value string, temporal_period string, reporting_scope string, unit string, verbatim_quote string, confidence_score double"


def value(spark, expr, **cols):
    row = spark.range(1).select(*[F.lit(v).cast("string").alias(c) if v is None else F.lit(v).alias(c) for c, v in cols.items()])
    return row.select(F.expr(expr).alias("v")).first()["v"]


@pytest.mark.parametrize("v, u, want", [("8,142 Cr", "INR Cr", 81420000000.0), ("81,420 Mn", "INR Mn", 81420000000.0), ("5.4%", "%", 5.4), ("-", "", None), ("12.4-13", "%", None), ("2.8Bn", "", 2.8), ("2.8Bn", "Bn", 2.8e9), ("9", "Mn Tonnes", 9e6), ("12", "INR Cr / %", 1.2e8)])
def test_canonical_number(spark, v, u, want):
    assert value(spark, U.canonical_number(Spark, "v", "u"), v=v, u=u) == pytest.approx(want)


@pytest.mark.parametrize("a, b, want", [("100", "102", True), ("100", "102.01", False), ("102.01", "100", True), ("-5", "-5.0", False), ("-5", "-5", True)])
def test_equivalence_is_asymmetric(spark, a, b, want):
    n = lambda x: U.plain_number(Spark, x)
    assert value(spark, f"{U.equal_text('a', 'b')} OR {U.within('(' + n('a') + ')', '(' + n('b') + ')')}", a=a, b=b) is want


@pytest.mark.parametrize("t, want", [("Q4 FY24", "FY24"), ("2024-25", "2024-25"), ("in 2023", "2023"), ("none", None), ("since inception", "since inception")])
def test_period(spark, t, want):
    assert value(spark, T.period(Spark, "t"), t=t) == want == X.period(t)


@pytest.mark.parametrize("t, want", [("2021,", True), ("1899", False), ("20211", False), ("(1999)", True)])
def test_bare_year(spark, t, want):
    assert value(spark, T.is_bare_year(Spark, "t"), t=t) is want is X.year(t)


@pytest.mark.parametrize("t, want", [("short", True), ("All rights reserved by X", True), ("Revenue grew by 5 percent", False)])
def test_boilerplate(spark, t, want):
    assert value(spark, T.is_boilerplate(Spark, "t"), t=t) is want is X.boilerplate(t)


@pytest.mark.parametrize("t", ["(Table 3, Figures 4 and 5) rose", "see Box 1 and Appendix II now", "3/ as [1, 2] and (1,5) FY2025/26 2024/25", "7. Growth slowed. 10. Prices rose"])
def test_cleaning_agrees_with_python(spark, t):
    assert value(spark, T.clean(Spark, "t"), t=t) == X.cleaned(t)


@pytest.mark.parametrize("m, q, want", [
    ("Non-Oil GDP Growth", "", "Oil GDP Growth"), ("Gross Fiscal Deficit", "4.8% of GDP", "Real GDP Growth"), ("Inflation", "food prices", "Food Inflation"), ("CPI", "core items", "Core Inflation"),
    ("Headline Inflation", "", "Headline Inflation"), ("Shipments", "", "Express Parcel Shipments"), ("x", "pin code", "Pin Codes Covered"), ("Delivery Centres", "", "Last-Mile Delivery Centres"), ("PTL", "", "PTL Freight Volume"),
    ("Sales", "operating revenue", "Revenue from Operations"), ("Revenue", "", "Revenue"), ("x", "contracts with customers revenue", "Revenue from Customers"), ("x", "revenue from services", "Revenue from Services"),
    ("EBITDA", "", "EBITDA"), ("EBITDA", "adj. figures", "Adjusted EBITDA"), ("EBITDA", "ebitda margin", "EBITDA Margin"), ("EBITDA", "adj margin", "Adjusted EBITDA Margin"), ("EBITDA", "service ebitda", "Service EBITDA"),
    ("EBITDA", "reported ebitda", "Reported EBITDA"), ("GDP", "nominal", "Nominal GDP Growth"), ("GDP", "compound", "Compound Average GDP Growth"), ("GDP", "potential", "Potential GDP Growth"), (" Other ", "", "Other"),
])
def test_canonical_definition(spark, m, q, want):
    assert value(spark, S.canonical(), metric=m, metric_type=m, verbatim_quote=q) == want


@pytest.mark.parametrize("a, b, m, want", [("X", " x", "m", True), ("A", "B", "Global Growth", True), ("A", "B", "m", False), ("all", "Acme", "m", True), ("all", "Republic of Chad", "m", False)])
def test_compatible_entities(spark, a, b, m, want):
    assert value(spark, S.compatible("a", "b", "m"), a=a, b=b, m=m) is want


@pytest.mark.parametrize("f, t, want", [
    ("d/Delhivery-x.pdf", "", "Delhivery Limited"), ("imf-nigeria-2023.pdf", "", "Federal Republic of Nigeria"), ("x.pdf", "IMF Country Report No. 23/1\nCHAD\n", "Republic of Chad"),
    ("x.pdf", "Article IV Consultation with Kenya", "Republic of Kenya"), ("x.pdf", "about delhivery", "Delhivery Limited"), ("x.pdf", "The chadian budget", "Republic of Chad"), ("x.pdf", "nothing", S.UNNAMED),
])
def test_entity(spark, f, t, want):
    assert value(spark, S.entity(Spark, "f", "t"), f=f, t=t) == want


def facts(spark, *rows):
    base = {"corpus": "c", "entity": "E", "metric": "Revenue from Operations", "document_id": "a.pdf", "page_number": 1, "value": "1 Cr", "raw_value": "1", "temporal_period": "FY24", "reporting_scope": "Consolidated", "unit": "INR Cr", "verbatim_quote": "revenue from operations", "confidence_score": 1.0}
    return ops.enrich(spark.createDataFrame([tuple((base | r).values()) for r in rows], FACT))


@pytest.mark.parametrize("a, b, verdict, shift, conf", [
    ({"value": "8,142 Cr"}, {"value": "81,420 Mn", "unit": "INR Mn"}, "corroborated", "none", 0.98),
    ({"metric": "Pin Codes Covered", "verbatim_quote": "pin codes", "value": "18,793", "unit": "Count"}, {"metric": "Pin Codes Covered", "verbatim_quote": "pin codes", "value": "14,200", "unit": "Count"}, "genuine_contradiction", "none", 0.92),
    ({"value": "3,646 Cr", "temporal_period": "FY21"}, {"value": "8,142 Cr"}, "context_reconciled", "temporal_shift", 0.95),
    ({"value": "2021", "raw_value": "2021"}, {"value": "81,415 Mn", "unit": "INR Mn"}, "extraction_failure", "none", 0.98),
    ({"metric": "Global Growth", "value": "3.3%", "verbatim_quote": "global growth"}, {"metric": "Global Growth", "value": "3.3%", "verbatim_quote": "global growth", "entity": "F"}, "corroborated", "none", 0.98),
    ({"metric": "Inflation", "value": "4.9%", "verbatim_quote": "cpi rose"}, {"metric": "Inflation", "value": "4.6%", "verbatim_quote": "food rose"}, "metric_mismatch", "none", 0.92),
    ({"metric": "Inflation", "value": "5.4%", "verbatim_quote": "cpi rose"}, {"metric": "Inflation", "value": "4.6%", "verbatim_quote": "cpi rose", "temporal_period": "FY25"}, "context_reconciled", "temporal_shift", 0.95),
    ({}, {"reporting_scope": "Standalone"}, "context_reconciled", "scope_shift", 0.95),
    ({"verbatim_quote": "revenue from operations since inception"}, {"temporal_period": "FY25"}, "temporal_update", "temporal_shift", 0.95),
    ({}, {"entity": "F"}, "not_comparable", "none", 0.90),
    ({}, {"verbatim_quote": "revenue from operations and margin"}, "not_comparable", "none", 0.92),
    ({"entity": "Republic of Chad"}, {"entity": "Republic of Niger"}, "extraction_failure", "none", 0.95),
    ({"value": "--"}, {}, "extraction_failure", "none", 0.95),
    ({"confidence_score": 0.9}, {"reporting_scope": "Standalone"}, "context_reconciled", "scope_shift", 0.85),
])
def test_gate(spark, a, b, verdict, shift, conf):
    f = facts(spark, {"document_id": "a.pdf", "page_number": 1, "corpus": "c"} | a, {"document_id": "b.pdf"} | b)
    left, right = (f.where(F.col("document_id") == d).select("corpus", *[F.col(c).alias(p + c) for c in ops.SIDE]) for p, d in (("a_", "a.pdf"), ("b_", "b.pdf")))
    r = ops.gate(left.join(right, "corpus")).first()
    assert (r["verdict"], r["shift_type"], r["confidence"]) == (verdict, shift, conf)


@pytest.mark.parametrize("line, metric, want", [
    ("Revenue from operations reached Rs. 8,142 Cr in FY24", "Revenue from Operations", ("8,142 Cr", "8,142", "Cr")),
    ("Real GDP growth was 6.5 per cent in 2024-25", "Real GDP Growth", ("6.5%", "6.5", "%")),
    ("Real GDP growth moved with the exchange rate by 6.5 per cent", "Real GDP Growth", None),
    ("Express parcel shipments volume of 2.8 Bn", "Express Parcel Shipments", ("2.8Bn", "2.8", "Bn")),
    ("18,793 pin codes covered", "Pin Codes Covered", ("18,793", "18,793", "Count")),
    ("21 pin codes covered", "Pin Codes Covered", None),
    ("Headline inflation eased by 25 bps", "Headline Inflation", ("25 bps", "25", "bps")),
    ("PTL freight volume of 1.4 Mn Tonnes", "PTL Freight Volume", ("1.4 Mn Tonnes", "1.4", "Mn Tonnes")),
    ("Workforce strength 57,000 people", "Workforce Strength", ("57,000", "57,000", "Count")),
    ("EBITDA margin was 3.4%", "Adjusted EBITDA", ("3.4%", "3.4", "%")),
    ("EBITDA 1 2 3 4 rows", "Adjusted EBITDA", None),
])
def test_figures(line, metric, want):
    pattern, _, unit = next((p, n, u) for p, n, u in X._metrics if n == metric)
    found = X.figure(line, metric, unit, pattern)
    assert (found and (found.value, found.raw, found.unit)) == want


def test_lines_look_up_and_down():
    rows = list(X.from_lines("18,793\n(1)\nPin codes covered\nHeadline inflation eased to\n4.6 percent in FY25\nsaw oil\nGDP growth of 2.1 percent"))
    assert [(r[0], r[1]) for r in rows] == [("Pin Codes Covered", "18,793"), ("Headline Inflation", "4.6%"), ("Oil GDP Growth", "2.1%")]


def test_tables():
    table = {"headers": ["Metric", "FY23", "FY24"], "rows": [["Revenue from operations (Rs Cr)", "7,225", "8,142"], ["GDP growth (in percent)", "6.1", "2021"], ["x", "1"], ["Contribution from GDP growth", "2"]], "markdown_repr": "| Metric | consolidated"}
    got = [(r[0], r[1], r[3], r[4], r[5]) for r in X.from_table(table)]
    assert got == [("Revenue from Operations", "7,225", "FY23", "Consolidated", "INR Cr"), ("Revenue from Operations", "8,142", "FY24", "Consolidated", "INR Cr"), ("Real GDP Growth", "6.1%", "FY23", "Consolidated", "%")]


def test_chunks_stay_within_the_limit():
    sentences = ["One two three."] * 40 + ["word " * 400 + "end."] + ["a, " * 300 + "b."]
    got = list(pages.pack_units(sentences))
    assert all(n <= 220 and n == max(1, int(len(t.split()) * 1.33)) for t, n in got)
    assert " ".join(t for t, _ in got).split() == " ".join(sentences).split()


def test_suggested_corpus():
    assert pages.suggested_corpus(["a/big-report_2.pdf"]) == "Big Report 2" and pages.suggested_corpus(["x-1.pdf", "y.pdf"]) == "X & Y" and pages.suggested_corpus(["a", "b", "c"]) == "Corpus (3 Documents)"

"""Fact scalars: entities, enrichment, canonical definitions, failure codes and the comparability gate.

Every function gives SQL text over column names; ``p`` is a prefix, so that both
sides of a pair can be addressed (``a_``, ``b_``).
"""

from __future__ import annotations

from . import units
from .dialect import Dialect, cases, holds

# Gazetteer of entity names, in dictionary order of the source.
GAZETTEER = (
    ("chad", "Republic of Chad"), ("tchad", "Republic of Chad"), ("chadian", "Republic of Chad"), ("niger", "Republic of Niger"),
    ("nigerien", "Republic of Niger"), ("nigeria", "Federal Republic of Nigeria"), ("nigerian", "Federal Republic of Nigeria"),
    ("india", "Indian Economy"), ("indea", "Indian Economy"), ("indian", "Indian Economy"), ("rbi", "Indian Economy"),
    ("reserve bank of india", "Indian Economy"), ("beac", "CEMAC Region"), ("bceao", "WAEMU Region"), ("cemac", "CEMAC Region"),
    ("waemu", "WAEMU Region"), ("uemoa", "WAEMU Region"), ("delhivery", "Delhivery Limited"), ("ghana", "Republic of Ghana"),
    ("kenya", "Republic of Kenya"), ("senegal", "Republic of Senegal"), ("cameroon", "Republic of Cameroon"), ("cameroun", "Republic of Cameroon"),
    ("gabon", "Gabonese Republic"), ("ivory coast", "Republic of Côte d'Ivoire"), ("côte d'ivoire", "Republic of Côte d'Ivoire"),
    ("cote d'ivoire", "Republic of Côte d'Ivoire"), ("south africa", "Republic of South Africa"), ("egypt", "Arab Republic of Egypt"),
    ("bangladesh", "People's Republic of Bangladesh"), ("pakistan", "Islamic Republic of Pakistan"),
    ("sri lanka", "Democratic Socialist Republic of Sri Lanka"), ("brazil", "Federative Republic of Brazil"), ("mexico", "United Mexican States"),
    ("indonesia", "Republic of Indonesia"), ("vietnam", "Socialist Republic of Vietnam"),
)
UNNAMED = "Enterprise / Document Subject"
GENERIC = ("enterprise / document subject", "document subject", "enterprise", "all")
SOVEREIGN = ("chad", "niger", "india", "ghana", "kenya", "senegal", "cameroon", "gabon", "egypt", "bangladesh", "pakistan", "republic", "kingdom", "sovereign")
SHARED_TERMS = ("convergence target", "convergence criterion", "global economic growth", "global growth", "brent")
SHARED_METRICS = ("Regional Convergence Target", "Multilateral Convergence Criterion", "Global Economic Growth", "Global Growth", "Brent Crude Oil Price", "Commodity Price Volatility")
INDIA = ("india", "rbi", "economic survey", "imf india", "indian economy")
GROWTH = ("growth", "inflation", "cpi", "deficit", "rate")
COUNTED = ("pin codes", "delivery centres", "sortation centres", "centres", "gateways", "headcount", "workforce", "shipments", "volume")
CUMULATIVE_PERIOD = ("since inception", "since incorporation", "cumulative", "lifetime")
CUMULATIVE_QUOTE = ("since inception", "since incorporation", "cumulative shipments", "over lifetime", "cumulative")
POINTS = ("as of", "as at", "at march", "at end")
HEADERS = ("table header", "column header", "fiscal year ended", "year ended", "ended march 31", "ended december 31", "for the year ended")
HEADER_METRICS = ("revenue", "ebitda", "growth", "deficit")
YEAR_METRICS = ("revenue", "ebitda", "growth", "inflation", "volume", "codes", "centres", "target", "deficit")
AUDIT_YEAR_METRICS = ("revenue", "ebitda", "growth", "inflation", "volume", "target", "deficit")
QUALIFIERS = ("oil gdp", "non-oil", "compound average", "nominal gdp", "potential growth")
FRAGMENTS = (",", ".", "-", "--", "N/A", "NA", "")


def is_multilateral(metric: str) -> str:
    names = ", ".join("'" + m + "'" for m in SHARED_METRICS)
    return f"({holds(f'lower({metric})', *SHARED_TERMS)} OR {metric} IN ({names}))"


def is_sovereign(entity: str) -> str:
    return holds(f"lower(coalesce({entity}, ''))", *SOVEREIGN)


def compatible(a: str, b: str, metric: str) -> str:
    """Entities that may be compared: equal, or a shared metric, or one without a name."""
    ea, eb = (f"lower(trim(coalesce({x}, '')))" for x in (a, b))
    generic = ", ".join(f"'{g}'" for g in GENERIC)
    return f"({ea} = {eb} OR {is_multilateral(metric)} OR (({ea} IN ({generic}) OR {eb} IN ({generic})) AND NOT ({is_sovereign(a)} OR {is_sovereign(b)})))"


def corpus(document: str, entity: str) -> str:
    d, e = f"lower(coalesce({document}, ''))", f"lower(coalesce({entity}, ''))"
    return cases(
        (f"contains({d}, 'delhivery') OR contains({e}, 'delhivery')", "'Delhivery'"),
        (f"{holds(d, *INDIA)} OR {holds(e, *INDIA)}", "'India Macroeconomics'"),
        (f"trim(coalesce({entity}, '')) <> ''", f"trim({entity})"),
        default="'General Knowledge'",
    )


def by_length() -> list[tuple[str, str]]:
    """The gazetteer, longest name first; equal lengths keep their order."""
    return sorted(GAZETTEER, key=lambda k: -len(k[0]))


def entity(d: Dialect, filename: str, sample: str) -> str:
    """The entity of a document by its file's name, then by the headers and words of a sample.

    The longest name that is found counts; the pattern of a name is only tried where its letters occur.
    """
    names = by_length()
    file = f"lower({d.rx_get(filename, r'([^/]*)$', 1, False)})"
    report = d.rx_get(sample, r"IMF\s+Country\s+Report(?:\s+No\.\s*[\d/]+)?\s*[\r\n]+([A-Z\s]{3,30})\b", 1, False)
    article = d.rx_get(sample, r"Article\s+IV\s+Consultation\s+(?:with\s+)?([A-Za-z\s]+)", 1)
    head = f"lower(substring(coalesce({sample}, ''), 1, 5000))"
    edge = r"[\-_.\d]"
    found = [
        d.first(names, lambda k: f"contains({file}, {k}) AND {d.rx_with(file, rf'(?:^|{edge})', k, rf'(?:$|{edge})')}"),
        d.first(names, lambda k: f"contains(lower(trim({report})), {k})"),
        d.first(names, lambda k: f"contains(lower(trim({article})), {k})"),
        f"CASE WHEN contains(lower(coalesce({sample}, '')), 'delhivery') THEN 'Delhivery Limited' END",
        d.first(names, lambda k: f"contains({head}, {k}) AND {d.rx_with(head, chr(92) + 'b', k, chr(92) + 'b')}"),
    ]
    return f"CASE WHEN contains({file}, 'delhivery') THEN 'Delhivery Limited' ELSE coalesce({', '.join(found)}, {d.lit(UNNAMED)}) END"


def enriched_metric(p: str = "") -> str:
    """The metric's name after telling its family apart by metric and quote."""
    m, q = f"lower(coalesce({p}metric, ''))", f"lower(coalesce({p}verbatim_quote, ''))"
    either = lambda *x: f"({holds(q, *x)} OR {holds(m, *x)})"
    ebitda = cases(
        (f"contains({q}, 'adjusted ebitda margin') OR (contains({q}, 'adj') AND contains({q}, 'margin') AND contains({q}, 'ebitda'))", "'Adjusted EBITDA Margin'"),
        (either("ebitda margin"), "'EBITDA Margin'"),
        (either("service ebitda"), "'Service EBITDA'"),
        (either("reported ebitda"), "'Reported EBITDA'"),
        (f"{either('adjusted')} OR {holds(q, 'adj.', 'adj ')}", "'Adjusted EBITDA'"),
        (f"contains({m}, 'ebitda')", "'EBITDA'"),
        default=f"{p}metric",
    )
    revenue = cases(
        (f"contains({q}, 'revenue from services')", "'Revenue from Services'"),
        (holds(q, "contracts with customers", "revenue from customers"), "'Revenue from Customers'"),
        (f"{either('revenue from operations')} OR contains({q}, 'operating revenue')", "'Revenue from Operations'"),
        default=f"{p}metric",
    )
    return cases((either("ebitda"), ebitda), (either("revenue"), revenue), default=f"{p}metric")


def value_nature() -> str:
    m, q = "lower(metric)", "lower(coalesce(verbatim_quote, ''))"
    return cases(
        (f"contains({m}, 'margin') OR contains({q}, 'margin')", "'margin'"),
        (holds(m, *GROWTH), "'growth_rate'"),
        ("contains(value, '%') OR contains(raw_value, '%') OR contains(coalesce(unit, ''), '%')", "'percentage'"),
        (holds(m, *COUNTED), "'count'"),
        default="'absolute_currency'",
    )


def temporal_nature() -> str:
    t, q = "lower(coalesce(temporal_period, ''))", "lower(coalesce(verbatim_quote, ''))"
    return cases((f"{holds(t, *CUMULATIVE_PERIOD)} OR {holds(q, *CUMULATIVE_QUOTE)}", "'cumulative'"), (holds(t, *POINTS), "'point_in_time'"), default="'period_duration'")


def is_header(d: Dialect) -> str:
    year = d.rx(d.strip("raw_value", " ,.:;()[]/\\"), r"^20\d{2}$", False)
    return f"({year} AND ({holds('lower(coalesce(verbatim_quote, ' + chr(39) * 2 + '))', *HEADERS)} OR {holds('lower(metric)', *HEADER_METRICS)}))"


def fact_id(d: Dialect) -> str:
    return d.digest(f"document_id || ':' || {d.text('page_number')} || ':' || entity || ':' || metric || ':' || value")


def canonical(p: str = "") -> str:
    """The strict definition that a metric's type and quote stand for."""
    t, q = f"lower(trim({p}metric_type))", f"lower(coalesce({p}verbatim_quote, ''))"
    either = lambda *x: f"({holds(t, *x)} OR {holds(q, *x)})"
    ebitda = cases(
        (f"contains({q}, 'adjusted ebitda margin') OR (contains({q}, 'margin') AND (contains({q}, 'adj') OR contains({t}, 'adjusted')))", "'Adjusted EBITDA Margin'"),
        (either("ebitda margin"), "'EBITDA Margin'"),
        (either("service ebitda"), "'Service EBITDA'"),
        (either("reported ebitda"), "'Reported EBITDA'"),
        (f"{either('adjusted')} OR {holds(q, 'adj.', 'adj ')}", "'Adjusted EBITDA'"),
        default="'EBITDA'",
    )
    revenue = cases(
        (either("revenue from services"), "'Revenue from Services'"),
        (f"{either('revenue from customers')} OR contains({q}, 'contracts with customers')", "'Revenue from Customers'"),
        (f"{either('revenue from operations')} OR contains({q}, 'operating revenue')", "'Revenue from Operations'"),
        default="'Revenue'",
    )
    gdp = cases(
        (either("oil gdp"), "'Oil GDP Growth'"),
        (either("non-oil"), "'Non-Oil GDP Growth'"),
        (either("nominal"), "'Nominal GDP Growth'"),
        (f"{either('compound')} OR contains({t}, 'cagr')", "'Compound Average GDP Growth'"),
        (either("potential"), "'Potential GDP Growth'"),
        default="'Real GDP Growth'",
    )
    inflation = cases((either("food"), "'Food Inflation'"), (either("core"), "'Core Inflation'"), default="'Headline Inflation'")
    return cases(
        (either("ebitda"), ebitda),
        (either("revenue"), revenue),
        (either("gdp"), gdp),
        (holds(t, "inflation", "cpi"), inflation),
        (holds(t, "express parcel", "shipment"), "'Express Parcel Shipments'"),
        (either("pin code"), "'Pin Codes Covered'"),
        (holds(t, "delivery centre", "delivery center"), "'Last-Mile Delivery Centres'"),
        (holds(t, "ptl", "freight"), "'PTL Freight Volume'"),
        default=f"trim({p}metric)",
    )


def qualifier(p: str = "") -> str:
    """The first dropped qualifier that a quote holds."""
    q = f"lower(coalesce({p}verbatim_quote, ''))"
    return cases(*[(f"contains({q}, '{x}')", f"'{x}'") for x in QUALIFIERS])


def failure(d: Dialect, p: str, year_metrics: tuple[str, ...], quote_rows: bool) -> str:
    """The first flaw of one fact, by code; NULL if there is none."""
    v, quote = f"trim({p}value)", f"coalesce({p}verbatim_quote, '')"
    fragments = ", ".join(f"'{x}'" for x in FRAGMENTS)
    number = r"[-+]?\d+(?:\.\d+)?"
    flat = d.rx(v, rf"{number}(?:\s+{number})+", False)
    if quote_rows:
        flat = f"({flat} OR ({d.rx(quote, rf'{number}(?:\s+{number}){{2,}}', False)} AND NOT contains({quote}, '%')))"
    return cases(
        (f"{v} IN ({fragments}) OR (length({v}) = 1 AND NOT {d.rx(v, r'[\p{L}\p{N}]', False)})", "'BOUNDARY_ERROR'"),
        (f"{holds(f'lower({p}metric)', *year_metrics)} AND {d.rx(v, r'^20\d{2}$', False)}", "'EXTRACTION_ERROR'"),
        (f"{p}metric = 'Real GDP Growth' AND ({qualifier(p)}) IS NOT NULL", "'QUALIFIER_DROPPED'"),
        (flat, "'LAYOUT_FLATTENING'"),
        (f"length(trim({quote})) < 5", "'EVIDENCE_MISSING'"),
    )


def audit_code(d: Dialect, p: str = "") -> str:
    return failure(d, p, AUDIT_YEAR_METRICS, False)


def flags(d: Dialect) -> dict[str, str]:
    """What a pair needs to know of a fact, worked out once a fact and not once a pair."""
    generic = ", ".join(f"'{g}'" for g in GENERIC)
    return {
        "flaw": failure(d, "", YEAR_METRICS, True),
        "sovereign": is_sovereign("entity"),
        "shared": is_multilateral("metric"),
        "entity_key": "lower(trim(coalesce(entity, '')))",
        "generic": f"lower(trim(coalesce(entity, ''))) IN ({generic})",
    }


def pair_compatible() -> str:
    """``compatible`` over the flags of a pair."""
    return "(a_entity_key = b_entity_key OR a_shared OR ((a_generic OR b_generic) AND NOT (a_sovereign OR b_sovereign)))"


def pair_failure() -> str:
    """The flaw of a pair: comparing sovereigns, or the first fact's, or the second's; led by which."""
    return cases(("a_entity <> b_entity AND NOT a_shared AND a_sovereign AND b_sovereign", "'CROSS_SOVEREIGN'"), default="coalesce('A:' || a_flaw, 'B:' || b_flaw)")


def differs(x: str) -> str:
    a, b = (f"lower(trim(coalesce({p}{x}, '')))" for p in ("a_", "b_"))
    return f"({a} <> '' AND {b} <> '' AND {a} <> {b})"


#: Gate outcomes by step: verdict, shift and factor of the smaller confidence (or the confidence itself).
OUTCOMES = {
    "header": ("extraction_failure", "none", 0.98, False),
    "flawed": ("extraction_failure", "none", 0.95, False),
    "entity": ("not_comparable", "none", 0.90, False),
    "definition": ("metric_mismatch", "none", 0.92, False),
    "nature": ("not_comparable", "none", 0.92, False),
    "scope": ("context_reconciled", "scope_shift", 0.95, True),
    "milestone": ("temporal_update", "temporal_shift", 0.95, True),
    "period": ("context_reconciled", "temporal_shift", 0.95, True),
    "equal": ("corroborated", "none", 0.98, True),
    "unequal": ("genuine_contradiction", "none", 0.92, True),
}


def gate_step() -> str:
    """The step of the comparability gate at which a pair is decided, over a_ and b_ columns with pair_failure and values_equal."""
    return cases(
        ("a_is_header_metadata OR b_is_header_metadata", "'header'"),
        ("pair_failure IS NOT NULL", "'flawed'"),
        (f"NOT {pair_compatible()}", "'entity'"),
        ("a_canonical_def <> b_canonical_def", "'definition'"),
        ("a_value_nature <> b_value_nature", "'nature'"),
        (differs("reporting_scope"), "'scope'"),
        (f"(a_temporal_nature = 'cumulative' OR b_temporal_nature = 'cumulative') AND {differs('temporal_period')}", "'milestone'"),
        (f"NOT a_shared AND {differs('temporal_period')}", "'period'"),
        ("values_equal", "'equal'"),
        default="'unequal'",
    )


def outcome(step: str, k: int) -> str:
    return cases(*[(f"{step} = '{s}'", f"'{o[k]}'") for s, o in OUTCOMES.items()])


def confidence(step: str) -> str:
    """Rounded down at exact halves, as binary fractions fall; of compared values it stays between 0.1 and 1."""
    low = "least(a_confidence_score, b_confidence_score)"

    def one(s: str, factor: float) -> str:
        x = f"{low} * {factor}"
        return f"round({f'least(1.0, greatest(0.1, {x}))' if s in ('equal', 'unequal') else x} - 1e-9, 2)"

    return "CAST(" + cases(*[(f"{step} = '{s}'", one(s, f) if scaled else f"{f}") for s, (_, _, f, scaled) in OUTCOMES.items()]) + " AS DOUBLE)"


def values_equal(d: Dialect) -> str:
    return f"({units.equal_text('a_value', 'b_value')} OR {units.within('a_number', 'b_number')})"

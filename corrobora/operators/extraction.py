"""Rule extraction: metric figures from lines, sentences and tables of pages.

A page is a unit of work: its lines are looked at together, so the rules run in
Python over Arrow batches of whole pages, after a filter that only keeps pages
with a digit or a table.  What follows (enrichment, pairing) is built of columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import facts as S
from ..functions import text as T
from ..functions.dialect import DuckDB, Spark, cases

# Metrics in the order in which they are tried: pattern, name, default unit.
METRICS = (
    (r"\b(revenue\s+from\s+operations|operating\s+revenue|revenue\s+from\s+contract|revenue\s+from\s+services)\b", "Revenue from Operations", "INR Cr"),
    (r"\b(adjusted\s+ebitda|ebitda\s+margin|service\s+ebitda|ebitda)\b", "Adjusted EBITDA", "INR Cr / %"),
    (r"\b(express\s+parcel\s+(?:shipments)?(?:\s+volume)?|express\s+parcels\s+shipped)\b", "Express Parcel Shipments", "Million / Billion"),
    (r"\b(pin\s+codes?\s+covered|postal\s+index\s+number\s*\(?[\"“]?pin[\"”]?\)?\s*codes?)\b", "Pin Codes Covered", "Count"),
    (r"\b(last-mile\s+delivery\s+centres?|delivery\s+centres?|sortation\s+centres?)\b", "Last-Mile Delivery Centres", "Count"),
    (r"\b(workforce\s+strength|total\s+employees|headcount)\b", "Workforce Strength", "Count"),
    (r"\b(part-truckload\s+freight|ptl\s+freight)\b", "PTL Freight Volume", "Mn Tonnes"),
    (r"\b(oil\s+(?:sector\s+)?gdp\s+growth|oil\s+gdp|growth\s+in\s+the\s+oil\s+sector|oil\s+sector\s+growth|growth\s+in\s+oil\s+production)\b", "Oil GDP Growth", "%"),
    (r"\b(non-oil\s+(?:sector\s+)?gdp\s+growth|non-oil\s+growth|non-oil\s+gdp|growth\s+in\s+the\s+non-oil\s+sector|non-oil\s+sector\s+growth|non-oil\s+activity)\b", "Non-Oil GDP Growth", "%"),
    (r"\b(compound\s+average\s+gdp\s+growth(?:\s+rate)?|compound\s+annual\s+gdp\s+growth(?:\s+rate)?|compound\s+gdp\s+growth|gdp\s+cagr|cagr\s+of\s+gdp)\b", "Compound Average GDP Growth", "%"),
    (r"\b(nominal\s+gdp\s+growth|growth\s+in\s+nominal\s+gdp|nominal\s+gross\s+domestic\s+product\s+growth)\b", "Nominal GDP Growth", "%"),
    (r"\b(potential\s+gdp\s+growth|potential\s+growth)\b", "Potential GDP Growth", "%"),
    (r"\b(waemu(?:\s+fiscal\s+deficit)?\s+convergence\s+criterion|beac\s+(?:target\s+rate|inflation\s+target|target)|cemac\s+convergence\s+criteria|deficit\s+convergence\s+criterion|convergence\s+criterion\s+of\s+[\d.]+\s*(?:%|percent))\b", "Regional Convergence Target", "%"),
    (r"\b(headline\s+cpi(?:\s+inflation)?|cpi\s+inflation|headline\s+inflation|food\s+inflation|inflation\s+rate|inflation\s+moderated|inflation\s+eased|inflation\s+is\s+projected\s+at|inflationary\s+pressures)\b", "Headline Inflation", "%"),
    (r"\b(gross\s+fiscal\s+deficit|fiscal\s+deficit|gfd)\b", "Gross Fiscal Deficit", "%"),
    (r"\b(?<!oil\s)(?<!non-oil\s)(?<!nominal\s)(?<!potential\s)(?<!compound\s)(?<!average\s)(real\s+gross\s+domestic\s+product\s*\(?gdp\)?\s+growth|gross\s+domestic\s+product\s*\(?gdp\)?\s+growth|real\s+gdp\s+growth|(?<!oil\s)(?<!non-oil\s)gdp\s+growth|grow\s+by\s+[\d.]+\s*(?:%|per\s+cent)|growth\s+in\s+gdp|projects\s+growth\s+at)\b", "Real GDP Growth", "%"),
    (r"\b(global\s+economic\s+growth|global\s+growth)\b", "Global Economic Growth", "%"),
)
# How a figure of each kind of metric is written.
PERCENT = r"([><]?\s*[-+]?\d+(?:\.\d+)?)\s*(%|per\s+cent|percent|bps|basis\s+points)(?!\w)"
PERCENT_REAL = r"([><]?\s*[-+]?\d+(?:\.\d+)?)\s*(%|per\s+cent|percent|bps|basis\s+points)(?!\s+of\s+gdp)(?!\w)"
MONEY_WORDS = "Cr|Crore|Crores|Mn|Million|Millions|Bn|Billion|Billions|Lakh|Lakhs"
MONEY = rf"(?:(?:[₹$]|Rs\.?|INR)\s*([><]?\s*[\d,]+(?:\.\d+)?)\s*\b({MONEY_WORDS})?\b|([><]?\s*[\d,]+(?:\.\d+)?)\s*\b({MONEY_WORDS})\b)"
VOLUME = r"([><]?\s*[\d,]+(?:\.\d+)?)\s*(Bn|Billion|Billions|Mn|Million|Millions)\b"
TONNES = r"([><]?\s*[\d,]+(?:\.\d+)?)\s*\b(Mn\s+Tonnes|Million\s+Tonnes|Tonnes|MT)\b"
COUNTS = {
    "Pin Codes Covered": (r"([><]?\s*[\d,]+)\s*(?:pin\s*codes?)?", 1000),
    "Workforce Strength": (r"([><]?\s*[\d,]+)\s*(?:employees|workforce|people|headcount)?", 100),
    "Last-Mile Delivery Centres": (r"([><]?\s*[\d,]+)\s*(?:last-mile\s+delivery\s+centres?|delivery\s+centres?|sortation\s+centres?|centres?|centers?)", 0),
}
NOT_REAL = ("exchange rate", "reer", "percentile", "contribution from", "debt dynamics", "climate change")
DROPPED = ("oil", "non-oil", "compound average", "nominal", "potential")

NUMBER = re.compile(r"[-+]?\d+(?:\.\d+)?")
_metrics = tuple((re.compile(p, re.I), name, unit) for p, name, unit in METRICS)
_percent = {name: re.compile(PERCENT_REAL if name == "Real GDP Growth" else PERCENT, re.I) for _, name, unit in METRICS if unit == "%"}
_above = {*COUNTS, "Express Parcel Shipments", "PTL Freight Volume"}


@dataclass(frozen=True)
class Figure:
    """A figure as it is written, its bare number and its unit."""

    value: str
    raw: str
    unit: str


def boilerplate(text: str, pattern=re.compile("|".join(T.BOILERPLATE), re.I)) -> bool:
    return len(text.strip()) < 8 or bool(pattern.search(text.strip()))


def cleaned(text: str) -> str:
    """Without citations, footnote marks and paragraph numbers."""
    for pattern in (rf"\({T.CITED}[^)]*\)", rf"\b{T.CITED}\s*#?\s*(?:\d+|[I|V|X]+)(?:[–\-]\d+)?\b"):
        text = re.sub(pattern, " ", text, flags=re.I)
    for pattern in (r"\b\d+/\s*", r"\[\d+(?:,\s*\d+)*\]", r"\(\d+(?:,\s*\d+)*\)"):
        text = re.sub(pattern, " ", text)
    return re.sub(r"(?:^|\n|\.\s+)(?:\d+|[I|V|X]+|[A-Z])[\.\)]\s+(?=[A-Z])", ". ", text)


def year(text: str) -> bool:
    return bool(re.fullmatch(r"(?:19|20)\d{2}", text.strip(T.EDGES)))


def collapsed(text: str) -> bool:
    """More than three numbers without a percent or crore: a row of a table that lost its columns."""
    low = text.lower()
    return len(NUMBER.findall(text)) > 3 and not ("%" in low or "percent" in low or "cr" in low)


def _percentage(name: str, part: str) -> Figure | None:
    m = _percent[name].search(part)
    if not m:
        return None
    number, unit = m[1].replace(" ", ""), m[2].lower()
    return Figure(number + "%", number, "%") if "cent" in unit or "%" in unit else Figure(f"{number} {unit}", number, unit)


def _money(name: str, default: str, part: str) -> Figure | None:
    m = re.search(MONEY, part, re.I)
    if m:
        number, word = (m[1] or m[3]).strip().rstrip(","), (m[2] or m[4] or "").strip()
        if word or not year(number):
            return Figure(f"{number} {word or default}", number, word or default)
        return None
    m = re.search(r"([><]?\s*[-+]?\d+(?:\.\d+)?)\s*(%|per\s+cent|percent|bps)(?!\w)", part, re.I) if name == "Adjusted EBITDA" else None
    return Figure(m[1].replace(" ", "") + "%", m[1].replace(" ", ""), "%") if m else None


def _counted(name: str, part: str) -> Figure | None:
    pattern, least = COUNTS[name]
    m = re.search(pattern, part, re.I)
    number = m[1].strip().rstrip(",") if m else ""
    plain = re.sub(r"\D", "", number)
    return Figure(number, number, "Count") if plain and int(plain) >= least and not year(plain) else None


def figure(segment: str, name: str, default: str, pattern: re.Pattern) -> Figure | None:
    """The metric's figure in a segment: after its name, for counts also before it, then anywhere."""
    text = cleaned(segment)
    low = text.lower()
    if name == "Real GDP Growth" and (any(x in low for x in NOT_REAL) or re.search(r"\b(?:oil|non-oil|compound|nominal|potential)\s+gdp\b", low)):
        return None
    if collapsed(text):
        return None
    at = pattern.search(text)
    parts = [text]
    if at:
        parts = [text[at.start() : at.end() + 150], text]
        if name in _above:
            parts.insert(0, text[max(0, at.start() - 60) : at.start()])
    for part in parts:
        if name in _percent:
            found = _percentage(name, part)
        elif name in COUNTS:
            found = _counted(name, part)
        elif name in ("Revenue from Operations", "Adjusted EBITDA"):
            found = _money(name, default, part)
        else:
            m = re.search(VOLUME if name == "Express Parcel Shipments" else TONNES, part, re.I)
            number = (m[1].strip() if name == "Express Parcel Shipments" else m[1].strip().rstrip(",")) if m else ""
            found = Figure(number + ("" if name == "Express Parcel Shipments" else " ") + m[2].strip(), number, m[2].strip()) if m else None
        if found:
            return found
    return None


def period(text: str) -> str | None:
    return next((m[1].strip() for p in T.PERIODS if (m := re.search(p, text, re.I))), None)


def scope(text: str) -> str | None:
    return next((name for p, name in T.SCOPES if re.search(rf"\b{p}\b", text, re.I)), None)


Row = tuple


def from_lines(text: str) -> Iterator[Row]:
    """A figure for each line that names a metric; counts may stand up to three lines above, wrapped prose one below."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    head = text[:300]
    for i, line in enumerate(lines):
        if boilerplate(line) or collapsed(line):
            continue
        if i and re.match(r"^(?:real\s+)?gdp\s+growth\b", line, re.I):
            line = next((f"{q} " for q in DROPPED if lines[i - 1].lower().endswith(q)), "") + line
        below = f"{line} {lines[i + 1]}" if i + 1 < len(lines) else None
        above = [f"{x} {lines[i]}" for x in reversed(lines[max(0, i - 3) : i]) if not re.fullmatch(r"\(\d+(?:,\s*\d+)*\)|\(?\d+\)?", x)]
        for pattern, name, unit in _metrics:
            if not pattern.search(line):
                continue
            tried = [line, *(above if name in _above else []), *([below] if below else [])]
            best, found = next(((x, f) for x in tried if (f := figure(x, name, unit, pattern))), (line, None))
            if found and not year(found.value):
                yield name, found.value, found.raw, period(best) or period(head), scope(best) or scope(head), found.unit or unit, best[:300], 0.92
                break


def from_sentences(text: str) -> Iterator[Row]:
    """A figure for each sentence that names a metric."""
    flat = " ".join(x.strip() for x in cleaned(text).splitlines() if x.strip())
    for sentence in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", flat):
        if len(sentence.strip()) < 10 or boilerplate(sentence):
            continue
        for pattern, name, unit in _metrics:
            found = figure(sentence, name, unit, pattern) if pattern.search(sentence) else None
            if found and not year(found.value):
                yield name, found.value, found.raw, period(sentence), scope(sentence), found.unit or unit, sentence[:300], 0.90
                break


def from_table(table) -> Iterator[Row]:
    """A figure for each cell of a row whose label names a metric."""
    headers, text = list(table["headers"]), table["markdown_repr"] or ""
    for row in table["rows"]:
        label = row[0].strip() if len(row) > 1 and row[0] else ""
        low = label.lower()
        if not 3 <= len(label) <= 100 or boilerplate(label) or "contribution from" in low or "debt dynamics" in low:
            continue
        name, unit = next(((n, u) for p, n, u in _metrics if p.search(label)), (None, None))
        if not name or not headers:
            continue
        percent = "%" in label or "(in percent)" in low
        unit = "%" if percent else "INR Cr" if "cr" in low else "INR Mn" if "million" in low else unit
        for k, cell in enumerate(row[1:], 1):
            value = (cell or "").strip().strip(T.EDGES)
            if not value or len(value) > 30 or value in ("-", "NA", "N/A", "--", "…", "...") or year(value) or re.search(r"[-+]?\d+(?:\.\d+)?\s+[-+]?\d+(?:\.\d+)?", value):
                continue
            if percent and re.fullmatch(r"[-+]?\d+(?:\.\d+)?", value):
                value += "%"
            header = headers[k] if k < len(headers) else ""
            yield name, value, re.sub(r"[^\d.\-+]", "", value), period(header) or period(text), "Consolidated" if "consolidated" in text.lower() else None, unit, f"Row: {label} | Col: {header} = {value}", 0.95


OUT = "document_id string, page_number int, entity string, seq int, metric string, value string, raw_value string, temporal_period string, reporting_scope string, unit string, verbatim_quote string, confidence_score double"


def anchored(pages: DataFrame, first: int = 3) -> DataFrame:
    """Pages with the entity of their document, by its name and its first pages."""
    head = pages.where(F.col("page_number") <= first).groupBy("document_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_number", "raw_text"))), lambda p: p["raw_text"]), " ").alias("sample"))
    named = head.select("document_id", F.expr(S.entity(Spark, "document_id", "coalesce(sample, '')")).alias("entity"))
    return pages.join(named, "document_id", "left").withColumn("entity", F.coalesce("entity", F.expr(S.entity(Spark, "document_id", "''"))))


def extract(pages: DataFrame, ordered: bool = False) -> DataFrame:
    """Facts of pages (document_id, page_number, raw_text, tables): tables first, then lines, then sentences; the first of equal ones stays.

    ordered: keep ``seq``, a fact's place among those of its page.
    """
    kept = anchored(pages).where(F.col("raw_text").rlike(r"\d") | (F.size("tables") > 0))

    def work(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for d, n, e, text, tables in zip(*(frame[c] for c in ("document_id", "page_number", "entity", "raw_text", "tables"))):
                found = [r for t in (tables if tables is not None else []) for r in from_table(t)] + [*from_lines(text or ""), *from_sentences(text or "")]
                rows += [(d, n, e, k, *r) for k, r in enumerate(found)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    found = kept.select("document_id", "page_number", "entity", "raw_text", "tables").mapInPandas(work, OUT)
    same = Window.partitionBy("document_id", "page_number", "entity", F.lower("metric"), F.lower("value"), "temporal_period").orderBy("seq")
    kept = found.withColumn("rn", F.row_number().over(same)).where("rn = 1").drop("rn")
    return kept if ordered else kept.drop("seq")


def by_page(facts: DataFrame) -> DataFrame:
    """The facts of documents in order of page and metric, as a reader lists them."""
    return facts.orderBy("document_id", "page_number", "metric", *(["seq"] if "seq" in facts.columns else []))


_TABLE = "array<struct<headers:array<string>,rows:array<array<string>>,markdown_repr:string>>"


def fixture_pages(facts: DataFrame) -> DataFrame:
    """Sentences that say the fixture's facts, a page for each document and year."""
    said = F.concat("metric", F.lit(" reached "), "value", F.lit(" in "), "temporal_period", F.lit("."))
    lines = facts.groupBy("document_id", "page_number").agg(F.array_join(F.sort_array(F.collect_list(said)), "\n").alias("raw_text"))
    return lines.withColumn("tables", F.expr(f"CAST(array() AS {_TABLE})"))


def fixture_tables(facts: DataFrame) -> DataFrame:
    """A table of two columns for each nation and document."""
    row = F.array(F.col("metric"), F.col("value"))
    body = facts.groupBy("document_id", "nk", "temporal_period").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    page = F.dense_rank().over(Window.partitionBy("document_id").orderBy("nk", "temporal_period"))
    table = F.struct(F.array(F.lit("Metric"), F.col("temporal_period")).alias("headers"), F.col("rows"), F.concat(F.lit("| Metric | "), "temporal_period", F.lit(" |")).alias("markdown_repr"))
    return body.select("document_id", page.cast("int").alias("page_number"), F.lit("").alias("raw_text"), F.array(table).alias("tables"))


ITEM = "category STRING, entity STRING, metric STRING, value STRING, raw_value STRING, temporal_period STRING, reporting_scope STRING, unit STRING, verbatim_quote STRING"


def fixture_items(facts: DataFrame) -> DataFrame:
    """Answers of a language model about each page, as JSON."""
    entity = F.when(F.col("nk") % 4 == 0, F.lit("unknown")).when(F.col("nk") % 4 == 1, F.lit("Chad")).otherwise(F.col("entity"))
    item = F.struct(entity.alias("entity"), "metric", "value", "unit", F.when(F.col("nk") % 3 > 0, F.col("verbatim_quote")).alias("verbatim_quote"))
    return facts.groupBy("document_id", "page_number").agg(F.to_json(F.struct(F.collect_list(item).alias("facts"))).alias("answer"))


def _entity(d, x: str) -> str:
    names = cases(*[(f"lower({x}) = {d.lit(k)}", d.lit(v)) for k, v in S.GAZETTEER], default=x)
    return cases((f"lower({x}) IN ('', 'enterprise / document subject', 'unknown', 'unknown entity', 'entity', 'document subject')", S.entity(d, "document_id", "''")), default=names)


def parsed_items(answers: DataFrame) -> DataFrame:
    """Facts from JSON answers: entity by the gazetteer or the document, category by digits or unit."""
    items = answers.select("document_id", "page_number", F.explode(F.from_json("answer", f"facts ARRAY<STRUCT<{', '.join(f.replace(' ', ': ', 1) for f in ITEM.split(', '))}>>")["facts"]).alias("i")).select("document_id", "page_number", "i.*")
    items = items.withColumn("e", F.trim(F.coalesce("entity", F.lit(""))))
    quote = F.coalesce(F.substring(F.expr("nullif(verbatim_quote, '')"), 1, 300), F.concat(F.lit("Page "), F.col("page_number").cast("string")))
    category = F.when(F.col("category").isin("numerical", "semantic"), F.col("category")).when(F.coalesce("value", F.lit("")).rlike(r"\d") | (F.coalesce("unit", F.lit("")) != ""), "numerical").otherwise("semantic")
    return items.select(
        "document_id", "page_number", F.expr(_entity(Spark, "e")).alias("entity"), F.coalesce("metric", F.lit("Factual Assertion")).alias("metric"), F.coalesce("value", F.lit("")).alias("value"),
        F.coalesce("raw_value", "value", F.lit("")).alias("raw_value"), "temporal_period", "reporting_scope", "unit", quote.alias("verbatim_quote"), category.alias("category"), F.lit(0.95).alias("confidence_score"),
    )


ITEMS_ORACLE = f"""
SELECT document_id, page_number, {_entity(DuckDB, "e")} AS entity, metric, value, value AS raw_value, NULL::VARCHAR AS temporal_period, NULL::VARCHAR AS reporting_scope, unit, coalesce(q, 'Page ' || page_number) AS verbatim_quote,
       CASE WHEN regexp_matches(value, '\\d') OR coalesce(unit, '') <> '' THEN 'numerical' ELSE 'semantic' END AS category, 0.95::DOUBLE AS confidence_score
FROM (SELECT *, CASE WHEN nk % 4 = 0 THEN 'unknown' WHEN nk % 4 = 1 THEN 'Chad' ELSE entity END AS e, CASE WHEN nk % 3 > 0 THEN verbatim_quote END AS q FROM f0)
"""

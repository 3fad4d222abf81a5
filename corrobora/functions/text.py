"""Text scalars: noise, citations, sentences, periods and scopes."""

from __future__ import annotations

from .dialect import Dialect, cases

# Phrases and patterns of filings that are noise, or that signal facts.
BOILERPLATE = (
    r"safe\s+harbour\s+and\s+disclaimer",
    r"this\s+presentation\s+is\s+prepared\s+by",
    r"forward-looking\s+statements",
    r"all\s+rights\s+reserved",
    r"statutory\s+reports\s+financial\s+statements",
    r"corporate\s+overview\s+statutory\s+reports",
    r"table\s+of\s+contents",
    r"neither\s+the\s+company\s+nor\s+any\s+of\s+its\s+advisors",
    r"no\s+representation\s+or\s+warranty,\s+express\s+or\s+implied",
    r"annual\s+report\s+2023-24\s+corporate\s+overview",
)
REJECTED = (
    r"^(?:page\s+\d+|\d+\s+of\s+\d+|\-\s*\d+\s*\-)$",
    r"please\s+read\s+section|prospectus\s+dated|corporate\s+identity\s+number|scan\s+this\s+qr\s+code",
    r"all\s+rights\s+reserved|confidential\s+and\s+proprietary|printed\s+on\s+recycled\s+paper",
    r"this\s+page\s+is\s+intentionally\s+left\s+blank|the\s+accompanying\s+notes\s+are\s+an\s+integral",
    r"^(?:figure|table)\s+\d+[:.]?\s*$",
)
SIGNALS = (
    r"\b\d+(?:\.\d+)?\s*(?:%|percent|bps|basis\s+points)\b",
    r"(?:₹|\$|INR|USD|Rs\.?)\s*\d+(?:\.\d+)?\s*(?:Cr|Crore|Crores|Mn|Million|Bn|Billion|Trillion)?",
    r"\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b",
    r"\b(?:FY|Q[1-4]|20\d{2}[–\-]\d{2,4}|20\d{2})\b",
    r"\b(?:revenue|gdp|ebitda|cpi|inflation|shipment|deficit|growth|margin|volume|assets|liabilities)\b",
)
CITED = r"(?:Table|Figure|Fig\.?|Box|Chart|Annex|Appendix|Column|Row|Schedule|Note|Page|p\.)"
PERIODS = (
    r"(\bFY\s*(?:20)?\d{2}(?:[–\-/]\d{2,4})?\b)",
    r"(\bQ[1-4]\s*FY\s*(?:20)?\d{2}\b)",
    r"(\b20\d{2}[–\-]\d{2,4}\b)",
    r"(\b(?:since\s+inception|inception)\b)",
    r"(\b20\d{2}\b)",
)
SCOPES = (("consolidated", "Consolidated"), ("standalone", "Standalone"), ("restated", "Restated"))
EDGES = " ,.:;()[]/\\"
#: Marks where a text is to be split; occurs in no text.
MARK = "\x01"


def is_boilerplate(d: Dialect, x: str) -> str:
    return f"(length(trim({x})) < 8 OR {d.rx(x, '|'.join(BOILERPLATE))})"


def is_rejected(d: Dialect, x: str) -> str:
    return d.rx(x, "|".join(f"(?:{p})" for p in REJECTED))


def has_signal(d: Dialect, x: str) -> str:
    return d.rx(x, "|".join(SIGNALS))


def strip_citations(d: Dialect, x: str) -> str:
    t = d.rx_sub(x, rf"\({CITED}[^)]*\)", " ")
    return d.rx_sub(t, rf"\b{CITED}\s*#?\s*(?:\d+|[I|V|X]+)(?:[–\-]\d+)?\b", " ")


def strip_footnotes(d: Dialect, x: str) -> str:
    t = d.rx_sub(x, r"\b\d+/\s*", " ")
    t = d.rx_sub(t, r"\[\d+(?:,\s*\d+)*\]", " ")
    return d.rx_sub(t, r"\(\d+(?:,\s*\d+)*\)", " ")


def strip_numbering(d: Dialect, x: str) -> str:
    """The capital after a number is put back, where a lookahead would leave it."""
    return d.rx_sub(x, r"(?:^|\n|\.\s+)(?:\d+|[I|V|X]+|[A-Z])[\.\)]\s+([A-Z])", ". @1", fold=False)


def clean(d: Dialect, x: str) -> str:
    return strip_numbering(d, strip_footnotes(d, strip_citations(d, x)))


def strip_edges(d: Dialect, x: str) -> str:
    return d.strip(f"coalesce({x}, '')", EDGES)


def is_bare_year(d: Dialect, x: str) -> str:
    return d.rx(strip_edges(d, x), r"^(?:19|20)\d{2}$", fold=False)


def sentences(d: Dialect, x: str) -> str:
    """Parts after . ! or ? and blanks."""
    return d.split(d.rx_sub(x, r"([.!?])\s+", "@1" + MARK, fold=False), MARK)


def clauses(d: Dialect, x: str) -> str:
    return d.split(d.rx_sub(x, r"([;,])\s+", "@1" + MARK, fold=False), MARK)


def token_count(d: Dialect, x: str) -> str:
    """Words times 1.33, one at least."""
    return f"greatest(1, CAST(floor({d.rx_count(x, r'\S+')} * 1.33) AS INT))"


def period(d: Dialect, x: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(trim({d.rx_get(x, p)}), '')" for p in PERIODS) + ")"


def scope(d: Dialect, x: str) -> str:
    return cases(*[(d.rx(x, rf"\b{p}\b"), d.lit(name)) for p, name in SCOPES])


def normal_page(d: Dialect, x: str) -> str:
    """Lines without outer blanks; empty ones go."""
    inner = d.rx_sub(f"({x} || '')", r"[ \t\r\f]*\n[ \t\r\f\n]*", "\n", fold=False)
    return d.strip(inner, " \t\r\f\n")


def clean_cell(d: Dialect, x: str) -> str:
    return f"replace(trim({d.rx_sub(f"coalesce({x}, '')", r'\s+', ' ', fold=False)}), '|', {d.lit(chr(92) + '|')})"

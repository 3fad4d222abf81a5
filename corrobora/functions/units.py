"""Numbers in texts, their scales, and when two values agree."""

from __future__ import annotations

from .dialect import Dialect, cases

# Scale words in the order in which they are tried.
SCALES = (
    ("cr", 1e7), ("crore", 1e7), ("crores", 1e7), ("lakh", 1e5), ("lakhs", 1e5), ("mn", 1e6), ("million", 1e6),
    ("millions", 1e6), ("bn", 1e9), ("billion", 1e9), ("billions", 1e9), ("k", 1e3), ("thousand", 1e3),
)
NO_NUMBER = (",", "-", "NA", "N/A", "None", "")
TOLERANCE = 0.02


def scale(d: Dialect, value: str, unit: str) -> str:
    text = f"lower({value} || ' ' || coalesce({unit}, ''))"
    return cases(*[(d.rx(text, rf"\b{k}\b", fold=False), f"CAST({f:.1f} AS DOUBLE)") for k, f in SCALES], default="CAST(1.0 AS DOUBLE)")


def plain_number(d: Dialect, value: str) -> str:
    """Digits, points and signs as a number; NULL if that is none."""
    kept = d.rx_sub(f"replace({value}, ',', '')", r"[^\d.\-+]", "", fold=False)
    none = ", ".join(d.lit(x) for x in NO_NUMBER)
    return f"CASE WHEN {value} IS NULL OR trim({value}) IN ({none}) THEN NULL ELSE {d.number(kept)} END"


def canonical_number(d: Dialect, value: str, unit: str) -> str:
    return f"(({plain_number(d, value)}) * ({scale(d, value, unit)}))"


def equal_text(a: str, b: str) -> str:
    return f"(lower(trim({a})) = lower(trim({b})))"


def within(a: str, b: str, tolerance: float = TOLERANCE) -> str:
    """Numbers a and b agree, measured by the first, which must be positive."""
    return f"coalesce({a} > 0 AND abs({a} - {b}) / nullif({a}, 0) <= {tolerance}, FALSE)"

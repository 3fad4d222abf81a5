"""Scalar SQL in two dialects: Spark's, for the engine, and DuckDB's, for its oracles.

A scalar is written once as text over column names; what differs between the two
(regular expressions, trimming, digests, safe casts) goes through a dialect.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable


class Spark:
    """Spark SQL; patterns are raw literals in double quotes."""

    @staticmethod
    def lit(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"

    @staticmethod
    def pattern(p: str, fold: bool) -> str:
        assert '"' not in p
        return f'r"{"(?iu)" if fold else ""}{p}"'

    @classmethod
    def rx(cls, x: str, p: str, fold: bool = True) -> str:
        return f"({x} RLIKE {cls.pattern(p, fold)})"

    @classmethod
    def rx_get(cls, x: str, p: str, group: int = 1, fold: bool = True) -> str:
        return f"regexp_extract({x}, {cls.pattern(p, fold)}, {group})"

    @classmethod
    def rx_count(cls, x: str, p: str) -> str:
        return f"regexp_count({x}, {cls.pattern(p, False)})"

    @classmethod
    def rx_sub(cls, x: str, p: str, to: str, fold: bool = True) -> str:
        return f"regexp_replace({x}, {cls.pattern(p, fold)}, {cls.lit(to.replace('@1', '$1').replace('@2', '$2'))})"

    @classmethod
    def strip(cls, x: str, chars: str) -> str:
        return f"btrim({x}, {cls.lit(chars)})"

    @staticmethod
    def digest(x: str, n: int = 16) -> str:
        return f"substring(sha2({x}, 256), 1, {n})"

    @staticmethod
    def number(x: str) -> str:
        return f"try_cast({x} AS DOUBLE)"

    @classmethod
    def split(cls, x: str, mark: str) -> str:
        return f"split({x}, {cls.pattern(mark, False)}, -1)"

    @staticmethod
    def array(items: Iterable[str]) -> str:
        return f"array({', '.join(items)})"

    @staticmethod
    def grouped(x: str) -> str:
        """A whole number with commas."""
        return f"format_number({x}, 0)"

    @staticmethod
    def fixed(x: str, n: int) -> str:
        """Ties go to the even digit, as binary fractions are printed elsewhere."""
        return f"format_string('%.{n}f', bround({x}, {n}))"

    @staticmethod
    def text(x: str) -> str:
        return f"CAST({x} AS STRING)"

    @classmethod
    def first(cls, pairs: Iterable[tuple[str, str]], test: Callable[[str], str]) -> str:
        """The value of the first pair whose name passes a test."""
        table = ", ".join(f"named_struct('k', {cls.lit(k)}, 'v', {cls.lit(v)})" for k, v in pairs)
        return f"get(filter(array({table}), g -> {test('g.k')}), 0).v"

    @classmethod
    def rx_with(cls, x: str, before: str, name: str, after: str) -> str:
        """x has the name, a column, between two patterns."""
        return f"({x} RLIKE concat({cls.pattern(before, False)}, {name}, {cls.pattern(after, False)}))"


class DuckDB:
    """DuckDB SQL; its regular expressions know no lookaround."""

    @staticmethod
    def lit(text: str) -> str:
        return "'" + text.replace("'", "''") + "'" if "\n" not in text else "(" + " || chr(10) || ".join("'" + t.replace("'", "''") + "'" for t in text.split("\n")) + ")"

    @staticmethod
    def pattern(p: str, fold: bool) -> str:
        return "'" + ("(?i)" if fold else "") + p.replace("'", "''") + "'"

    @classmethod
    def rx(cls, x: str, p: str, fold: bool = True) -> str:
        return f"regexp_matches({x}, {cls.pattern(p, fold)})"

    @classmethod
    def rx_get(cls, x: str, p: str, group: int = 1, fold: bool = True) -> str:
        return f"regexp_extract({x}, {cls.pattern(p, fold)}, {group})"

    @classmethod
    def rx_count(cls, x: str, p: str) -> str:
        return f"len(regexp_extract_all({x}, {cls.pattern(p, False)}))"

    @classmethod
    def rx_sub(cls, x: str, p: str, to: str, fold: bool = True) -> str:
        to = to.replace("\\", "\\\\").replace("@1", "\\1").replace("@2", "\\2")
        return f"regexp_replace({x}, {cls.pattern(p, fold)}, {cls.lit(to)}, 'g')"

    @classmethod
    def strip(cls, x: str, chars: str) -> str:
        return f"trim({x}, {cls.lit(chars)})"

    @staticmethod
    def digest(x: str, n: int = 16) -> str:
        return f"substr(sha256({x}), 1, {n})"

    @staticmethod
    def number(x: str) -> str:
        return f"TRY_CAST({x} AS DOUBLE)"

    @classmethod
    def split(cls, x: str, mark: str) -> str:
        return f"string_split_regex({x}, {cls.pattern(mark, False)})"

    @staticmethod
    def array(items: Iterable[str]) -> str:
        return f"[{', '.join(items)}]"

    @staticmethod
    def grouped(x: str) -> str:
        return f"format('{{:,}}', CAST(round({x}) AS BIGINT))"

    @staticmethod
    def fixed(x: str, n: int) -> str:
        return f"printf('%.{n}f', {x})"

    @staticmethod
    def text(x: str) -> str:
        return f"CAST({x} AS VARCHAR)"

    @classmethod
    def first(cls, pairs: Iterable[tuple[str, str]], test: Callable[[str], str]) -> str:
        table = ", ".join(f"{{'k': {cls.lit(k)}, 'v': {cls.lit(v)}}}" for k, v in pairs)
        return f"list_filter([{table}], lambda g: {test('g.k')})[1].v"

    @classmethod
    def rx_with(cls, x: str, before: str, name: str, after: str) -> str:
        return f"regexp_matches({x}, {cls.pattern(before, False)} || {name} || {cls.pattern(after, False)})"


Dialect = type[Spark] | type[DuckDB]


def holds(x: str, *parts: str) -> str:
    """True if x holds one of the parts; both dialects say it alike."""
    return "(" + " OR ".join(f"contains({x}, '" + p.replace("'", "''") + "')" for p in parts) + ")"


def cases(*pairs: tuple[str, str], default: str = "NULL") -> str:
    """The first value whose condition holds."""
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"

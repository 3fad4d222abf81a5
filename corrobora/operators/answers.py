"""Facts by a language model: units of pages, token-bounded chunks, paced clients, parsed answers, merged with the rules' facts.

Nothing here calls a network.  A client is any picklable function from a prompt to
an answer's text; ``Client`` adds what an interface of its kind needs: when to try
again and how long to wait.  ``tiered`` asks clients in order until one has facts.
Prompts go out from the partitions that hold the chunks; ``Pace`` keeps each
process within its share of the rates.
"""

from __future__ import annotations

import json
import re
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import facts as S
from ..functions import text as T
from . import extraction, pages, store

UNIT = "document_id string, page_number int, pos int, text string, section_title string, score double, kind string"
CHUNK = "document_id string, chunk int, text string, token_count int, primary_page int, page_numbers array<int>, section_title string"


def units(of: DataFrame) -> DataFrame:
    """(UNIT): what is worth asking about: table rows with a signal, and sentences with a signal or a score; in order within a page.

    of: (document_id, page_number, raw_text, tables).  A document without a unit gives its whole pages.
    """
    page = F.col("page_number").cast("int")
    t = of.select("document_id", page.alias("page_number"), F.posexplode("tables").alias("k", "t"))
    rows = F.filter(F.transform(F.split("t.markdown_repr", "\n"), F.trim), lambda x: (x != "") & ~x.startswith("| ---") & x.rlike("(?iu)" + "|".join(T.SIGNALS)))
    tables = t.withColumn("rows", rows).where(F.size("rows") > 0).select(
        "document_id", "page_number", F.col("k").alias("pos"), F.concat(F.lit("Table Data:\n"), F.array_join(F.slice("rows", 1, 8), "\n")).alias("text"),
        F.concat(F.lit("Table p."), F.col("page_number").cast("string")).alias("section_title"), F.lit(0.95).alias("score"), F.lit("table").alias("kind"),
    )
    keyed = of.select("document_id", page.alias("page_number"), F.coalesce("raw_text", F.lit("")).alias("raw_text"))
    blocks = keyed.select("document_id", "page_number", F.posexplode(F.split("raw_text", "\n\n")).alias("block", "p")).withColumn("p", F.trim("p")).where("p <> ''")
    blocks = blocks.select("document_id", "page_number", (F.lit(1_000_000) + F.col("block") * 10_000).alias("at"), "p")
    said = pages.sentence_units(blocks, "p", ("document_id", "page_number", "at")).select(
        "document_id", "page_number", (F.col("at") + F.col("pos")).alias("pos"), F.col("sentence").alias("text"),
        F.coalesce(F.expr("nullif(section_title, '')"), F.concat(F.lit("Page "), F.col("page_number").cast("string"))).alias("section_title"), "score", F.lit("text").alias("kind"),
    )
    found = tables.unionByName(said)
    bare = keyed.join(found.select("document_id").distinct(), "document_id", "left_anti").where("trim(raw_text) <> ''")
    whole = bare.select("document_id", "page_number", F.lit(0).alias("pos"), F.trim("raw_text").alias("text"), F.concat(F.lit("Page "), F.col("page_number").cast("string")).alias("section_title"), F.lit(None).cast("double").alias("score"), F.lit("page").alias("kind"))
    return found.unionByName(whole)


def tokens(text: str) -> int:
    return max(1, int(len(text.split()) * 1.33))


def parts(text: str, limit: int) -> list[str]:
    """A text beyond the limit cut at sentences, longer ones at clauses, and one clause at words.

    Sentences and clauses are put together again as long as they fit.  Of several
    clauses one may stay beyond the limit, as the original leaves it.
    """

    def gathered(pieces: list[str], too_long: Callable[[str], list[str]] | None) -> list[str]:
        out: list[str] = []
        held: list[str] = []
        for piece in pieces:
            if tokens(" ".join([*held, piece])) <= limit:
                held.append(piece)
                continue
            if held:
                out.append(" ".join(held).strip())
            held = []
            if too_long is None:
                out.append(piece.strip())
            elif tokens(piece) <= limit:
                held = [piece]
            else:
                out += too_long(piece)
        return out + ([" ".join(held).strip()] if held else [])

    def by_word(piece: str) -> list[str]:
        words, most = piece.split(), next(n for n in range(limit, 0, -1) if int(n * 1.33) <= limit)
        return [" ".join(words[at : at + most]) for at in range(0, len(words), most)]

    def by_clause(piece: str) -> list[str]:
        clauses = re.split(r"(?<=[;,])\s+", piece)
        return gathered(clauses, None) if len(clauses) > 1 else by_word(piece)

    sentences = re.split(r"(?<=[.!?])\s+", text)
    return gathered(sentences, by_clause) if len(sentences) > 1 else by_clause(text)


def packed(found: Iterable[tuple[str, int, str | None]], limit: int) -> Iterator[tuple[str, int, int, list[int], str | None]]:
    """Chunks (text, tokens, first page, pages, section) of units (text, page, section) in order.

    The section is that of the first unit; after a chunk that was closed within a
    long unit the old one stays, as in the original.
    """
    held: list[str] = []
    seen: list[int] = []
    section: str | None = None

    def closed() -> tuple[str, int, int, list[int], str | None]:
        whole = " ".join(held).strip()
        return whole, tokens(whole), seen[0], list(seen), section

    for text, page, title in found:
        text = text.strip()
        if not text:
            continue
        whole = tokens(text) <= limit
        for part in [text] if whole else parts(text, limit):
            size = tokens(" ".join([*held, part])) if whole else (tokens(" ".join(held)) if held else 0) + tokens(part)
            if held and size > limit:
                yield closed()
                held, seen = [], []
                section = None if whole else section
            if tokens(part) > limit:
                yield part, tokens(part), page, [page], title
                continue
            held.append(part)
            seen += [] if page in seen else [page]
            section = section or title
    if held:
        yield closed()


def chunks(found: DataFrame, limit: int = pages.CHUNK_TOKENS) -> DataFrame:
    """(CHUNK): the units of each document in chunks of at most so many tokens."""
    unit = F.struct("page_number", "pos", "text", "section_title")
    by_document = found.groupBy("document_id").agg(F.sort_array(F.collect_list(unit)).alias("units"))  # a document at a time, as chunks follow one another

    def work(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for d, held in zip(frame["document_id"], frame["units"]):
                rows += [(d, k, *c) for k, c in enumerate(packed(((u["text"], int(u["page_number"]), u["section_title"]) for u in held), limit))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNK.split(", ")])

    return by_document.mapInPandas(work, CHUNK)


@dataclass
class Pace:
    """At most so many requests a minute and a day, so far apart, none before a cooldown ends; clock and sleep can be replaced."""

    per_minute: float = 40.0
    per_day: int = 1000
    apart: float = 1.5
    clock: Callable[[], float] = time.time
    sleep: Callable[[float], None] = time.sleep
    until: float = 0.0
    asked: deque = field(default_factory=deque)

    def recent(self, seconds: float) -> list[float]:
        now = self.clock()
        return [t for t in self.asked if now - t <= seconds]

    def acquire(self) -> None:
        """Wait until the next request is due, and count it."""

        def wait(seconds: float) -> None:
            if seconds > 0:
                self.sleep(seconds)

        wait(self.until - self.clock())
        while self.asked and self.clock() - self.asked[0] > 86400:
            self.asked.popleft()
        for window, most, slack in ((86400.0, self.per_day, 0.1), (60.0, self.per_minute, 0.05)):
            held = self.recent(window)
            if len(held) >= most:
                wait(max(slack, window - (self.clock() - held[0]) + slack))
        wait(self.apart - (self.clock() - self.asked[-1]) if self.asked else 0)
        self.asked.append(self.clock())

    def penalize(self, seconds: float) -> None:
        self.until = max(self.until, self.clock() + seconds)

    def stats(self) -> dict[str, float]:
        return {"rpm_used": len(self.recent(60)), "rpm_limit": self.per_minute, "rpd_used": len(self.recent(86400)), "rpd_limit": self.per_day, "min_interval_seconds": self.apart}


@dataclass
class Client:
    """A function from a prompt to an answer, tried again after errors whose text holds one of the marks."""

    ask: Callable[[str], str]
    #: Waits before the second, third, ... attempt by mark; an error without a mark is not tried again.
    waits: dict[str, tuple[float, ...]] = field(default_factory=dict)
    pace: Pace | None = None
    before: float = 0.0
    sleep: Callable[[float], None] = time.sleep

    def __call__(self, prompt: str) -> str:
        tries: dict[str, int] = {}
        while True:
            if self.pace:
                self.pace.acquire()
            if self.before:
                self.sleep(self.before)
            try:
                return self.ask(prompt)
            except Exception as e:
                said = str(e).lower()
                mark = next((m for m in self.waits if m in said), None)
                done = tries.get(mark, 0)
                if mark is None or done >= len(self.waits[mark]):
                    raise
                hinted = re.search(r"try again in ([\d.]+)s", said)
                seconds = max(self.waits[mark][done], float(hinted[1]) + 0.5 if hinted else 0.0)
                if self.pace:
                    self.pace.penalize(seconds)
                self.sleep(seconds)
                tries[mark] = done + 1


#: Waits of the original's clients after errors of each kind.
CHUNK_WAITS = {m: (3.0, 8.0, 13.0, 17.0, 23.0) for m in ("429", "rate", "tpm", "tokens")}
PAGE_WAITS = {"429": (4.0, 8.0, 12.0), "503": (2.0, 4.0, 6.0)}


def items_of(answer: str | None) -> list:
    """The items of an answer: a list, or the facts of an object, also within a fence of backticks; none if it can't be read."""
    body = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", answer or "")
    try:
        held = json.loads(body)
    except ValueError:
        return []
    held = held.get("facts", []) if isinstance(held, dict) else held
    return [x for x in held if isinstance(x, dict)] if isinstance(held, list) else []


def tiered(clients: list[Callable[[str], str]], prompt: str) -> list:
    """The items of the first client that has any; one that fails gives way to the next."""
    for client in clients:
        try:
            found = items_of(client(prompt))
        except Exception:  # logged by the client's owner; the next tier is asked
            continue
        if found:
            return found
    return []


def answered(prompts: DataFrame, clients: list[Callable[[str], str]]) -> DataFrame:
    """(document_id, page_number, answer): prompts (document_id, page_number, text) with the first tier's items as JSON."""

    def work(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = [json.dumps({"facts": tiered(clients, t)}, ensure_ascii=False) for t in frame["text"]]
            yield pd.DataFrame({"document_id": frame["document_id"], "page_number": frame["page_number"], "answer": answers})

    return prompts.select("document_id", F.col("page_number").cast("int").alias("page_number"), "text").mapInPandas(work, "document_id string, page_number int, answer string")


def merged(of: DataFrame, answers: DataFrame) -> DataFrame:
    """The rules' facts of pages, and parsed answers whose metric and value no rule fact of the document has; by page and metric."""
    named = lambda df: df.withColumn("metric", F.expr(S.enriched_metric()))  # noqa: E731  as a fact's metric is before facts are compared
    rule = named(extraction.extract(of, ordered=True).withColumn("category", F.lit("numerical")))
    said = named(extraction.parsed_items(answers)).withColumn("seq", F.lit(-1))
    key = lambda df: df.withColumns({"__m": F.lower(F.trim("metric")), "__v": F.lower(F.trim("value"))})
    extra = key(said).join(key(rule).select("document_id", "__m", "__v").distinct(), ["document_id", "__m", "__v"], "left_anti")
    one = store.keep_last(rule.unionByName(extra.select(*rule.columns)), ["document_id", "page_number", "entity", "metric", "value"], "seq")
    return extraction.by_page(one).drop("seq")


def by_chunks(of: DataFrame, clients: list[Callable[[str], str]], limit: int = pages.CHUNK_TOKENS) -> DataFrame:
    """Facts of documents: pages to units to chunks, an answer a chunk, merged with the rules' facts."""
    asked = chunks(units(of), limit).select("document_id", F.col("primary_page").alias("page_number"), "text")
    return merged(of, answered(asked, clients))


def by_pages(of: DataFrame, clients: list[Callable[[str], str]]) -> DataFrame:
    """Facts of documents: an answer a page that has a digit or a table, with its tables below the text, merged with the rules' facts."""
    tables = F.array_join(F.transform("tables", lambda t: t["markdown_repr"]), "\n\n")
    asked = of.where(F.col("raw_text").rlike(r"\d") | (F.size("tables") > 0)).select("document_id", "page_number", F.concat_ws("\n\n", "raw_text", F.when(tables != "", tables)).alias("text"))
    return merged(of, answered(asked, clients))


def extracted(of: DataFrame, clients: list[Callable[[str], str]] = (), chunked: bool = True) -> DataFrame:
    """Facts by the rules alone without a client, else by chunks or by pages."""
    if not clients:
        return extraction.by_page(extraction.extract(of, ordered=True)).drop("seq")
    return by_chunks(of, list(clients)) if chunked else by_pages(of, list(clients))


def named_entity(facts: DataFrame, entity: str) -> DataFrame:
    """Facts whose entity is generic get the given one."""
    if not entity or entity in NOT_GIVEN:
        return facts
    return facts.withColumn("entity", F.when(F.coalesce("entity", F.lit("")).isin("", *UNNAMED), entity).otherwise(F.col("entity")))


# Entities of facts that stand for none, and choices that name none.
UNNAMED = ("Enterprise / Document Subject", "Unknown Entity", "Custom Enterprise")
NOT_GIVEN = ("Enterprise / Document Subject", "Auto-Detect from Document")


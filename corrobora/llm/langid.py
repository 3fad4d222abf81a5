"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every code point that is no letter becomes a blank, and
n-grams of one to three code points are hashed into ``buckets``.  Training sums
n-gram counts per language (partial sums in each task); the smoothed
log-probability matrix (buckets x languages, a few MB whatever the corpus holds)
goes to the tasks with the function, and each batch is scored by sparse gathers
in numpy.

Defined results
* a null text, an empty text or one without a letter: ``und`` with score 0.0;
* a null ``lang`` teaches nothing; a null id counts as the empty text in the split;
* repeated rows are scored as often as they occur; ties go to the smaller language;
* an empty table gives an empty result; no labelled row at all gives ``und``;
* other columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, id_hash32, id_text_crc, lean, slices, small_batches

#: Labelled documents of each language that a fit takes, chosen by the hash of their id.
MAX_DOCS_PER_LANG = 6000
#: Languages that a model has at most, those with most labelled documents; bounds the matrix.
MAX_LANGS = 1000
#: Characters that are scored at once, and numbers that are gathered for them; longer texts are summed over pieces.
PIECE, GATHERED = 1 << 20, 1 << 24
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """langs in ascending order; weights[b, l] is log p(bucket b | l), centred over l; the last row is zero."""

    langs: tuple[str, ...]
    prior: np.ndarray
    weights: np.ndarray

    @property
    def buckets(self) -> int:
        return len(self.weights) - 1


def letter_table(memo: dict = {}) -> np.ndarray:  # noqa: B006  made once in a worker
    """For each code point: itself if it is a letter, else a blank; letters end within the first four planes."""
    if not memo:
        out = np.full(0x110000, 32, np.uint32)
        letters = np.fromiter((c for c in range(0x40000) if chr(c).isalpha()), np.uint32)
        out[letters] = letters
        memo[0] = out
    return memo[0]


def grams(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters-only code points of a text and the bucket of the 1-, 2- and 3-gram that starts at each.

    Grams that hold two neighbouring blanks, or are one blank, get the bucket number ``buckets``.
    """
    points = letter_table()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    one = points * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + points[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + points[2:]
    blank = points == 32
    gap = blank[:-1] & blank[1:]

    def bucket(h: np.ndarray, out: np.ndarray, salt: int) -> np.ndarray:
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x27D4EB2F + 2 * salt)
        b = ((h >> np.uint32(8)) & np.uint32(buckets - 1)).astype(np.intp)
        b[out] = buckets
        return b

    return points, bucket(one, blank, 1), bucket(two, gap, 2), bucket(three, gap[:-1] | gap[1:], 3)


def joined(texts: list[str | None]) -> tuple[str, np.ndarray]:
    """Lower-cased texts, each between two blanks, and where each begins."""
    parts = [f" {t.lower()} " if t else "  " for t in texts]
    return "".join(parts), np.cumsum([0, *map(len, parts)])[:-1]


def pieces(text: str, buckets: int, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Letters and grams of a text, between its blanks, in pieces; each is counted where it starts, so once."""
    for at in range(0, max(1, len(text) - 2), size):
        points, *found = grams(text[at : at + size + 2], buckets)
        own = None if at + size >= len(text) - 2 else size
        yield int((points[:own] != 32).sum()), [b[:own] for b in found]


def fit_counts(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Gram counts of a task: rows (lang, bucket, n)."""
    found: dict[str, np.ndarray] = {}
    for batch in slices(batches):
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            if not text:
                continue
            counts = found.setdefault(lang, np.zeros(buckets + 1, np.int64))
            for _, found_at in pieces(f" {text.lower()} ", buckets, PIECE):
                for b in found_at:
                    np.add.at(counts, b, 1)
    for lang, counts in found.items():
        at = np.flatnonzero(counts[:buckets])
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(counts[at])})


def fit(labelled: DataFrame, buckets: int = 1 << 15, max_docs: int = MAX_DOCS_PER_LANG, alpha: float = 0.5) -> LanguageModel:
    """Learn from the rows of (doc_id, text, lang) whose lang is not null.

    Each language gives at most about ``max_docs`` documents, chosen by the hash
    of their id; the counts are made on the executors, and what reaches the
    driver is bounded by languages x buckets.
    """
    rows = labelled.select("doc_id", "text", "lang").where(F.col("lang").isNotNull())
    most = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS)
    sizes = {r["lang"]: r["n"] for r in most.collect()}
    if not sizes:
        return LanguageModel((), np.zeros(0), np.zeros((buckets + 1, 0), np.float32))
    below = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, int(min(1.0, max_docs / n) * 2**32))])
    taken = rows.where(id_hash32(seed="langid") < F.element_at(below, F.col("lang")))
    counted = taken.select("text", "lang").mapInArrow(lean(lambda it: fit_counts(it, buckets)), "lang string, bucket int, n long")
    langs = tuple(sorted(sizes))
    at = {lang: k for k, lang in enumerate(langs)}
    counts = np.zeros((buckets, len(langs)))
    for r in counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["bucket"], at[r["lang"]]] = r["n"]
    logp = np.log(counts + alpha) - np.log(counts.sum(0) + alpha * buckets)
    logp -= logp.mean(1, keepdims=True)
    prior = np.log(np.array([sizes[x] for x in langs], float) / sum(sizes.values()))
    return LanguageModel(langs, prior, np.vstack([logp, np.zeros((1, len(langs)))]).astype(np.float32))


def evidence(texts: list[str | None], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Summed log-probabilities (texts x languages) and letter counts of short texts."""
    text, starts = joined(texts)
    points, one, two, three = grams(text, model.buckets)
    w = model.weights.take(one, axis=0)
    w[:-1] += model.weights.take(two, axis=0)
    w[:-2] += model.weights.take(three, axis=0)
    return np.add.reduceat(w, starts, axis=0, dtype=np.float64), np.add.reduceat((points != 32).astype(np.int64), starts)


def long_evidence(text: str, model: LanguageModel, size: int) -> tuple[np.ndarray, int]:
    """The same of one text of any length."""
    total, letters = np.zeros(len(model.langs)), 0
    for n, found in pieces(f" {text.lower()} ", model.buckets, size):
        letters += n
        for b in found:
            total += model.weights.take(b, axis=0).sum(0, dtype=np.float64)
    return total, letters


def predict_texts(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of each text."""
    n, k = len(texts), len(model.langs)
    if not n or not k:
        return [UNKNOWN] * n, np.zeros(n)
    sums, letters = np.zeros((n, k)), np.zeros(n, np.int64)
    start = total = 0
    most = min(PIECE, max(4096, GATHERED // k))
    for i in range(n + 1):
        size = len(texts[i] or "") if i < n else 0
        if i == n or total + size > most:
            if i > start:
                sums[start:i], letters[start:i] = evidence(texts[start:i], model)
            start, total = i, 0
            if size > most:  # alone, summed over pieces
                sums[i], letters[i] = long_evidence(texts[i], model, most)
                start = i + 1
                continue
        total += size
    sums += model.prior
    p = np.exp(sums - sums.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    return [model.langs[b] if c else UNKNOWN for b, c in zip(best, letters, strict=True)], np.where(letters > 0, p.max(1), 0.0)


def predict(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns ``keep`` of each document with its language and score under ``names``."""
    small_batches(docs.sparkSession)
    kept = docs.select(*keep)
    (copy,) = free_names(docs, "text")
    out = T.StructType([*kept.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, copy):
            langs, p = predict_texts(batch.column(len(keep)).to_pylist(), model)
            cols = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(p)], [*keep, *names])

    return docs.select(*keep, F.col("text").alias(copy)).mapInArrow(lean(score), out)


def held_out(folds: int = 5, col: str = "doc_id"):
    """True for rows that a fit must not see."""
    return id_text_crc(col) % folds == 0


def identify(docs: DataFrame) -> DataFrame:
    """The query's rows: every document's language, learned from the rows that are not held out."""
    model = fit(docs.where(~held_out()))
    out = predict(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents whose text has a language; null texts and texts without a letter go."""
    model = fit(docs.where(~held_out()))
    names = tuple(docs.columns)
    lang, score = free_names(docs, "lang", "score")
    return predict(docs, model, names, (lang, score)).where(F.col(lang) != UNKNOWN).select(*names)

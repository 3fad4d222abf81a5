"""Exact top-k inner products by distributed histogram selection.

Vectors become integers floor(256 * x), so scores are integers.  Queries come in
blocks of a fixed number, whose vectors go to the tasks; every block is scored
against all rows.  A first pass gives each query a histogram of its scores over
the whole range that its norm and the longest vector allow; the histograms are
summed over the tasks, the bin that holds the k-th score is located, and only that
bin is refined in the next pass, until a bin is one score.  A last pass keeps what
is above the k-th score and, of what equals it, the smallest ids of each task,
which are more than enough; a window over those few rows breaks ties by id.

Scores are recomputed in each pass, which costs less than keeping them: nothing
but histograms and the last few rows leaves a task, whatever the table holds.

Defined results
* components and scores beyond 62 bits count as the largest number of 62 bits, with their sign;
* null vectors and vectors with a null or non-finite component take no part;
* vectors shorter than the longest of the table count as filled with zeros;
* repeated rows of an id are candidates each, but never of their own id;
* null ids are no queries and no candidates; queries with no candidate give no row;
* an empty table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, scratch_path

SCALE = 256
K = 5
#: Queries whose vectors go to the tasks at once, and candidates scored at once.
QUERIES = 1024
ROWS = 2048
BINS = 64
#: What larger numbers count as.
MOST = 2**62 - 1


def prepared(rows: DataFrame) -> DataFrame:
    """(vec_id, v): the integer vectors that take part."""
    x = F.col("embedding")
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    whole = lambda c: F.floor(F.greatest(F.lit(-(2.0**62)), F.least(F.lit(2.0**62), c.cast("double") * SCALE))).cast("long")
    v = F.transform(x, lambda c: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), whole(c))))
    return rows.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & x.isNotNull() & ok).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows, filled with zeros to dim columns."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T: in doubles where no partial sum can exceed 53 bits, else in 64-bit integers.

    These wrap around, which leaves every score right that fits; those that may not are worked out one by one.
    """
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    about = a.astype(float) @ b.astype(float).T
    if bound < 2**53:
        return about.astype(np.int64)
    out = a @ b.T
    if bound >= 2.0**61:
        slack = np.abs(a.astype(float)) @ np.abs(b.astype(float)).T
        for i, j in zip(*np.nonzero((np.abs(about) >= 2.0**61) | (slack >= 2.0**100)), strict=True):
            exact = sum(x * y for x, y in zip(a[i].tolist(), b[j].tolist(), strict=True))
            out[i, j] = max(-MOST, min(MOST, exact))
    return out


Scored = Iterator[tuple[np.ndarray, np.ndarray]]


def scored(batches: Iterable[pa.RecordBatch], ids: np.ndarray, vectors: np.ndarray) -> Scored:
    """(candidate ids, scores by query and candidate); a query's own id has the least score there is."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            own = part.column("vec_id").to_numpy()
            scores = products(vectors, matrix(part.column("v"), vectors.shape[1]))
            scores[ids[:, None] == own[None, :]] = np.iinfo(np.int64).min
            yield own, scores


def histograms(ids: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, width: np.ndarray) -> Callable:
    """A task's counts by query and bin, bin b from low + b * width on; only scores from low to high - 1 count."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids) * BINS, np.int64)
        base = np.arange(len(ids))[:, None] * BINS
        for _, scores in scored(batches, ids, vectors):
            inside = (scores >= low[:, None]) & (scores < high[:, None])
            b = np.where(inside, scores - low[:, None], 0) // width[:, None]
            total += np.bincount((base + b)[inside], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at // BINS).astype(np.int32)), pa.array((at % BINS).astype(np.int32)), pa.array(total[at])], ["q", "bin", "n"])

    return work


def survivors(ids: np.ndarray, vectors: np.ndarray, bar: np.ndarray, k: int) -> Callable:
    """A task's rows above each query's bar, and of those at the bar the k smallest ids."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ties: dict[int, np.ndarray] = {}
        for own, scores in scored(batches, ids, vectors):
            q, c = np.nonzero(scores > bar[:, None])
            keep = scores[q, c] != np.iinfo(np.int64).min
            q, c = q[keep], c[keep]
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(own[c]), pa.array(scores[q, c])], ["query_id", "vec_id", "score"])
            q, c = np.nonzero((scores == bar[:, None]) & (scores != np.iinfo(np.int64).min))
            cuts = np.flatnonzero(np.diff(q)) + 1
            for group, found in zip(q[np.r_[0, cuts]] if len(q) else [], np.split(own[c], cuts), strict=True) if len(q) else ():
                ties[group] = np.sort(np.concatenate([ties.get(group, found[:0]), found]))[:k]
        for group, found in ties.items():
            n = len(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[group], n)), pa.array(found), pa.array(np.repeat(bar[group], n))], ["query_id", "vec_id", "score"])

    return work


def kth_scores(rows: DataFrame, ids: np.ndarray, vectors: np.ndarray, reach: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th highest score; its lowest possible score less one if it has fewer candidates."""
    low, high = -reach, reach + 1
    above = np.zeros(len(ids), np.int64)
    width = np.maximum(1, -(-(high - low) // BINS))
    found = np.zeros(len(ids), bool)
    bar = low - 1
    while not found.all():
        counted = rows.mapInArrow(histograms(ids, vectors, low, high, width), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        table = np.zeros((len(ids), BINS), np.int64)
        for r in counted.collect():  # at most QUERIES x BINS rows
            table[r["q"], r["bin"]] = r["n"]
        upto = np.cumsum(table[:, ::-1], 1)[:, ::-1]  # rows in this bin or a higher one
        at = ((above[:, None] + upto >= k) * np.arange(1, BINS + 1)).max(1) - 1
        short = ~found & (at < 0)  # fewer than k candidates: all of them
        found |= short
        open_ = np.flatnonzero(~found)
        b = at[open_]
        above[open_] += upto[open_, b] - table[open_, b]
        low[open_] += b * width[open_]
        high[open_] = np.minimum(high[open_], low[open_] + width[open_])
        single = width[open_] == 1
        bar[open_[single]] = low[open_[single]]
        found[open_[single]] = True
        wide = open_[~single]
        width[wide] = np.maximum(1, -(-width[wide] // BINS))
        done = np.flatnonzero(found)
        low[done] = np.iinfo(np.int64).max  # counts nothing more
        width[done] = 1
    return bar


def top_k(rows: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest scores of every row for which is_query holds."""
    spark = rows.sparkSession
    vectors = cut(prepared(rows), "topk-vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, c: t + c.cast("double") * c.cast("double")))
    facts = vectors.agg(F.max(F.size("v")).alias("dim"), F.max(norm).alias("norm")).first()
    dim = int(facts["dim"] or 0)
    asked = cut(vectors.where(is_query).dropDuplicates(["vec_id"]).repartitionByRange("vec_id").sortWithinPartitions("vec_id"), "topk-queries")
    kind = "query_id long, vec_id long, score long"
    path = scratch_path(spark, "topk-rows")  # all blocks' rows, so that the plan doesn't grow with the queries
    block: list = []

    def answer(block: list) -> None:
        ids = np.array([r["vec_id"] for r in block], np.int64)
        q = np.zeros((len(block), max(1, dim)), np.int64)
        for i, r in enumerate(block):
            q[i, : len(r["v"])] = r["v"]
        reach = np.minimum(np.ceil(np.sqrt((q.astype(float) ** 2).sum(1)) * facts["norm"] * (1 + 1e-9)) + 1, 2.0**62).astype(np.int64)
        reach = np.minimum(reach, MOST)
        bar = kth_scores(vectors, ids, q, reach, k)
        vectors.mapInArrow(survivors(ids, q, bar, k), kind).write.mode("append").parquet(path)

    for row in asked.toLocalIterator():  # a block of queries on the driver at a time
        block.append(row)
        if len(block) == QUERIES:
            answer(block)
            block = []
    if block:
        answer(block)
    spark.createDataFrame([], kind).write.mode("append").parquet(path)  # there may be no query
    out = spark.read.schema(kind).parquet(path)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(rows: DataFrame) -> DataFrame:
    """The query's rows: queries are the ids divisible by 50."""
    return top_k(rows, F.col("vec_id") % 50 == 0)


#: DuckDB twin.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scores)
SELECT * FROM ranked WHERE rank <= 5
"""

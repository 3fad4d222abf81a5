"""Mixing sources to target weights by hash-threshold histograms; DataFrame functions only.

Every document has a hash of its id.  A source's share is a number of whole
copies plus the documents whose hash does not exceed a threshold.  The threshold
comes from nested histograms: sizes are summed by source and the upper bits of
the hash, the bucket in which the budget runs out is found, and only that bucket
is refined, three times, down to single hash values.  Nothing is sorted, and a
histogram has at most 2048 rows a source however many documents it has.

Weights are 1, 2, 3, repeating over the sources by code point, null last.  Targets
share all sizes by weight and stop at ``max_copies`` times a source's size; the
excess is shared again by weight, which is a common water level.

Defined results
* a null text has size 0 and is taken 0 times its size; null sources are a source;
* repeated rows of an id have one hash and are in or out together;
* a source whose sizes sum to 0 has target 0; an empty table gives an empty result;
* other columns are neither read nor returned by ``mix``; ``mixed`` keeps them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, cut, free_names, id_hash32

#: A word, as the contract counts them.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = 3
MAX_COPIES = 3
#: Bits of the hash that the three histograms look at, from above.
LEVELS = ((21, 2047), (10, 2047), (0, 1023))


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame) -> DataFrame:
    """(source, source_size) to (source, source_size, target): the water level over the weights.

    The windows have no partition: a row a source, whatever the documents are, passes through one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    t = totals.withColumn("w", (F.row_number().over(by_name) - 1) % WEIGHTS + 1).withColumn("cap", F.col("source_size") * MAX_COPIES)
    before = Window.orderBy(F.col("cap").cast("double") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    t = t.withColumn("level", left.cast("double") / weight.cast("double"))
    target = F.least(F.col("cap").cast("double"), F.max("level").over(every) * F.col("w"))
    return t.select("source", "source_size", target.alias("target"))


def mix_plan(sized: DataFrame) -> DataFrame:
    """(source, source_size, target, copies, last_hash) from rows of (source, size, h).

    A document is taken ``copies`` times, and once more if its hash is at most ``last_hash``.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    share = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets(totals).withColumn("copies", F.least(share, F.lit(MAX_COPIES)).cast("int"))
    plan = cut(plan.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")), "mix-plan")
    sources = plan.count()

    at = plan.select(F.col("source").alias("s"), "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for k, (shift, mask) in enumerate(LEVELS):
        width = 32 if k == 0 else LEVELS[k - 1][0]
        inside = sized["source"].eqNullSafe(F.col("s")) & (F.shiftright("h", width) == F.col("prefix"))
        bucket = F.shiftright("h", shift).bitwiseAND(F.lit(mask))
        sums = sized.join(checked_broadcast(at, sources), inside).groupBy("s", "prefix", "below", "rest", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
        upto = F.col("below") + F.sum("n").over(Window.partitionBy("s").orderBy("bucket"))
        edge = sums.withColumn("upto", upto).where((F.col("upto") - F.col("n") <= F.col("rest")) & (F.col("rest") < F.col("upto")))
        bits = width - shift
        at = cut(edge.select("s", "rest", (F.shiftleft("prefix", bits) + F.col("bucket")).alias("prefix"), (F.col("upto") - F.col("n")).alias("below"), "upto"), "mix-edge")

    nearer = F.col("upto") - F.col("rest") < F.col("rest") - F.col("below")
    last = F.when(nearer, F.col("prefix")).otherwise(F.col("prefix") - 1)
    edges = at.select("s", last.alias("last_hash"))
    joined = plan.join(checked_broadcast(edges, sources), plan["source"].eqNullSafe(edges["s"]), "left")
    return cut(joined.select("source", "source_size", "target", "copies", F.coalesce("last_hash", F.lit(-1)).alias("last_hash")), "mix-targets")


def sized(docs: DataFrame, seed: str = "") -> DataFrame:
    """(doc_id, source, size, h); written once, since counting words reads the whole texts."""
    return cut(docs.select("doc_id", "source", words().alias("size"), id_hash32(seed=seed).alias("h")), "mix-sizes")


def mix(docs: DataFrame, seed: str = "") -> DataFrame:
    """The query's rows: doc_id, size, source_size, target, taken."""
    rows = sized(docs, seed)
    plan = mix_plan(rows).withColumnRenamed("source", "s")
    times = F.col("copies") + (F.col("h") <= F.col("last_hash")).cast("int")
    joined = rows.join(checked_broadcast(plan, plan.count()), rows["source"].eqNullSafe(plan["s"]))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def mixed(docs: DataFrame, seed: str = "") -> DataFrame:
    """The documents that the mix takes, with all their columns, a row for each time one is taken."""
    plan = mix_plan(sized(docs, seed))
    source, copies, last, time = free_names(docs, "source", "copies", "last_hash", "time")
    side = checked_broadcast(plan.select(F.col("source").alias(source), F.col("copies").alias(copies), F.col("last_hash").alias(last)), plan.count())
    times = F.col(copies) + (id_hash32(seed=seed) <= F.col(last)).cast("int")
    joined = docs.join(side, docs["source"].eqNullSafe(F.col(source)))
    return joined.withColumn(time, F.explode(F.array_repeat(F.lit(0), times))).select(*docs.columns)


#: DuckDB twin of ``mix``: the same thresholds from running sums over single hash values.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 3 * source_size AS cap,
         ((sum(source_size) OVER ()) - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE
         / ((sum(w) OVER ()) - coalesce(sum(w) OVER before, 0))::DOUBLE AS level
  FROM totals
  WINDOW before AS (ORDER BY (3 * source_size)::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aims AS (SELECT source, source_size, least(cap::DOUBLE, (max(level) OVER ()) * w) AS target FROM levels),
plan AS (
  SELECT *, least(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END, 3)::BIGINT AS copies FROM aims),
edges AS (
  SELECT s.source, s.h, sum(sum(s.size)) OVER (PARTITION BY s.source ORDER BY s.h) AS upto, sum(s.size) AS n
  FROM sized s GROUP BY s.source, s.h),
lasts AS (
  SELECT p.source, CASE WHEN e.upto - r < r - (e.upto - e.n) THEN e.h ELSE e.h - 1 END AS last_hash
  FROM (SELECT *, target - copies * source_size AS r FROM plan) p JOIN edges e
    ON p.source IS NOT DISTINCT FROM e.source AND e.upto - e.n <= r AND r < e.upto)
SELECT s.doc_id, s.size, p.source_size, p.target,
       (s.size * (p.copies + CASE WHEN s.h <= coalesce(l.last_hash, -1) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
LEFT JOIN lasts l ON s.source IS NOT DISTINCT FROM l.source
"""

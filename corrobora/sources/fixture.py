"""Facts over the driver's tables: three documents of figures for each nation, or for each customer.

The statement runs unchanged on Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_FACTS = """
WITH base AS (
  SELECT r_name AS corpus, {key} AS nk, {entity} AS entity, year(o_orderdate) AS yr,
         CAST(FLOOR(SUM(CAST(o_totalprice AS DECIMAL(18,2)))) AS BIGINT) AS amt, COUNT(*) AS cnt
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
  GROUP BY r_name, {key}, {entity}, year(o_orderdate)),
docs AS (SELECT * FROM (VALUES (1, '01-ledger.pdf'), (2, '02-annual.pdf'), (3, '03-deck.pdf')) AS t(d, name)),
x AS (
  SELECT base.*, d, CASE WHEN nk = 5 THEN concat('niger-', name) ELSE name END AS document_id, concat('FY', substring(CAST(yr AS VARCHAR(4)), 3, 2)) AS fy
  FROM base CROSS JOIN docs)
SELECT corpus, nk, entity, 'Revenue from Operations' AS metric, document_id, CAST(yr - 1990 AS INT) AS page_number,
       CASE WHEN d = 1 THEN concat(CAST(amt AS VARCHAR(30)), ' Cr') WHEN d = 2 THEN concat(CAST(amt * 10 AS VARCHAR(30)), ' Mn')
            WHEN nk % 4 = 0 THEN concat(CAST(amt * 12 AS VARCHAR(30)), ' Mn') WHEN nk % 4 = 1 THEN '2024'
            ELSE concat(CAST(amt * 10 AS VARCHAR(30)), ' Mn') END AS value,
       CASE WHEN d = 1 THEN CAST(amt AS VARCHAR(30)) WHEN d = 3 AND nk % 4 = 1 THEN '2024' ELSE CAST(amt * 10 AS VARCHAR(30)) END AS raw_value,
       fy AS temporal_period, CASE WHEN d = 3 AND nk % 4 = 2 THEN 'Standalone' ELSE 'Consolidated' END AS reporting_scope,
       CASE WHEN d = 1 THEN 'INR Cr' ELSE 'INR Mn' END AS unit, concat('Revenue from operations for the year ', fy) AS verbatim_quote,
       CAST(CASE d WHEN 1 THEN 0.95 WHEN 2 THEN 0.92 ELSE 0.90 END AS DOUBLE) AS confidence_score
FROM x
UNION ALL SELECT corpus, nk, entity, 'Express Parcel Shipments', document_id, CAST(yr - 1990 AS INT), concat(CAST(cnt AS VARCHAR(30)), ' Mn'), CAST(cnt AS VARCHAR(30)),
       fy, NULL, 'Mn', 'cumulative shipments since inception', CAST(0.92 AS DOUBLE) FROM x WHERE d <= 2 AND yr >= 1999
UNION ALL SELECT corpus, nk, entity, 'Real GDP Growth', document_id, CAST(yr - 1990 AS INT), concat(CAST(cnt % 9 AS VARCHAR(30)), '.5%'), concat(CAST(cnt % 9 AS VARCHAR(30)), '.5'),
       fy, NULL, '%', CASE WHEN nk % 5 = 0 AND d = 2 THEN 'oil gdp growth averaged over the year' ELSE 'real gdp growth for the year' END, CAST(0.90 AS DOUBLE) FROM x WHERE yr = 1995
UNION ALL SELECT corpus, nk, entity, 'Adjusted EBITDA', document_id, CAST(yr - 1990 AS INT), CASE d WHEN 1 THEN '-' WHEN 2 THEN '5.4 6.5 1.5' ELSE concat(CAST(cnt AS VARCHAR(30)), '%') END, CAST(cnt AS VARCHAR(30)),
       fy, NULL, CASE d WHEN 3 THEN '%' ELSE 'INR Cr' END, CASE d WHEN 3 THEN 'n/a' ELSE 'ebitda as stated' END, CAST(0.95 AS DOUBLE) FROM x WHERE yr = 1996
UNION ALL SELECT corpus, nk, entity, 'Global Economic Growth', document_id, CAST(yr - 1990 AS INT), '3.3%', '3.3', fy, 'Global', '%', 'global growth at 3.3 per cent', CAST(0.95 AS DOUBLE) FROM x WHERE yr = 1997
"""
_NATION = ("n_nationkey", "CASE n_nationkey WHEN 0 THEN 'Republic of Chad' WHEN 5 THEN 'Republic of Niger' ELSE n_name END")
_CUSTOMER = ("c_custkey", "c_name")


def facts_sql(by_customer: bool = False, **tables: str) -> str:
    key, entity = _CUSTOMER if by_customer else _NATION
    names = {t: t for t in ("orders", "customer", "nation", "region")} | tables
    return _FACTS.format(key=key, entity=entity, **names)


def facts(spark: SparkSession, sf_dir: str, by_customer: bool = False) -> DataFrame:
    """corpus, nk, entity, metric, document_id, page_number, value, raw_value, temporal_period, reporting_scope, unit, verbatim_quote, confidence_score."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "nation", "region")}
    return spark.sql(facts_sql(by_customer, **{t: "{" + t + "}" for t in tables}), **tables)


#: The catalogue of the fixture's documents.
DOCUMENTS = """
SELECT concat('d', CAST(row_number() OVER (ORDER BY document_id) AS VARCHAR(9))) AS doc_id, document_id AS filename, count(DISTINCT page_number) AS total_pages,
       CASE WHEN document_id LIKE 'niger%' THEN NULL ELSE min(corpus) END AS corpus
FROM {facts} GROUP BY document_id
"""

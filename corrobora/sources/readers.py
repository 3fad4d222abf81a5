"""Sources: files as documents, pages and seed caches; every path goes through Spark's readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dialect import Spark
from ..operators import pages as P


def binary_catalog(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(doc_id, filename, file_path, checksum_sha256, n_bytes) of the files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name, digest = F.element_at(F.split("path", "/"), -1), F.sha2("content", 256)
    return files.select(F.substring(F.sha2(F.concat_ws(":", name, digest), 256), 1, 12).alias("doc_id"), name.alias("filename"), F.col("path").alias("file_path"), digest.alias("checksum_sha256"), F.col("length").alias("n_bytes"))


def text_pages(spark: SparkSession, folder: str, max_pages: int | None = None) -> DataFrame:
    """(document_id, page_number, raw_text, tables) of text files, a page for each form feed; tables are empty."""
    files = spark.read.text(folder, wholetext=True).select("value", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("document_id"))
    pages = files.select("document_id", F.posexplode(F.split("value", "\f"))).select("document_id", (F.col("pos") + 1).alias("page_number"), F.col("col").alias("t"))
    pages = pages.where(F.col("page_number") <= max_pages) if max_pages else pages
    return pages.select("document_id", "page_number", F.expr(T.normal_page(Spark, "t")).alias("raw_text"), F.expr(f"CAST(array() AS {TABLES})").alias("tables"))


#: The tables of a page.
TABLES = "ARRAY<STRUCT<headers: ARRAY<STRING>, rows: ARRAY<ARRAY<STRING>>, caption: STRING, markdown_repr: STRING>>"


def tables_of(html: Column, page_number: Column) -> Column:
    """The tables of a web page: the first row is the header, rows without any text go, captions number all tables.

    Tables of one row or without a filled row are left out; a table within a table ends the outer one.
    """
    every = F.regexp_extract_all(html, F.lit(r"(?is)<table\b[^>]*>(.*?)</table>"), F.lit(1))
    rows = lambda t: F.regexp_extract_all(t, F.lit(r"(?is)<tr\b[^>]*>(.*?)(?:</tr>|$)"), F.lit(1))
    cells = lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)(?:</t[dh]>|$)"), F.lit(1))
    bare = lambda c: P.unescaped(F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", " "), r"<[^>]+>", ""))
    grids = F.transform(every, lambda t: F.transform(rows(t), lambda r: F.transform(cells(r), bare)))
    parted = F.transform(grids, lambda g, k: F.struct(F.size(g).alias("n"), F.transform(F.get(g, F.lit(0)), P.clean_cell).alias("headers"), F.transform(F.filter(F.slice(g, 2, F.greatest(F.size(g), F.lit(1))), lambda r: F.exists(r, lambda c: c != "")), lambda r: F.transform(r, P.clean_cell)).alias("rows"), k.alias("k")))
    kept = F.filter(parted, lambda t: (t["n"] >= 2) & (F.size(t["rows"]) > 0))
    caption = lambda t: F.concat(F.lit("Table "), (t["k"] + 1).cast("string"), F.lit(" on Page "), page_number.cast("string"))
    return F.transform(kept, lambda t: F.struct(t["headers"].alias("headers"), t["rows"].alias("rows"), caption(t).alias("caption"), P.markdown(t["headers"], t["rows"], cleaned=True).alias("markdown_repr")))


def html_pages(pages: DataFrame, document_id: str = "document_id", html: str = "html", page_number: str | None = None) -> DataFrame:
    """(document_id, page_number, raw_text, tables) of web pages: their text without the tables, and these."""
    n = F.lit(1) if page_number is None else F.col(page_number).cast("int")
    text = P.html_lines(F.regexp_replace(html, r"(?is)<table\b.*?</table>", "\n"))
    out = pages.select(F.col(document_id).cast("string").alias("document_id"), n.alias("page_number"), text.alias("t"), tables_of(F.coalesce(html, F.lit("")), n).alias("tables"))
    return out.select("document_id", "page_number", F.coalesce(F.expr(T.normal_page(Spark, "t")), F.lit("")).alias("raw_text"), "tables")


def uploads(spark: SparkSession, folder: str, suffix: str = ".pdf", max_pages: int | None = 15) -> tuple[DataFrame, DataFrame]:
    """The accepted files of an upload folder (text in place of scans) as pages, and the names of those refused for their suffix."""
    names = binary_catalog(spark, folder).select("filename")
    fits = F.lower(F.regexp_replace("filename", r"\.txt$", "")).endswith(suffix)
    pages = text_pages(spark, folder, max_pages).join(names.where(fits).select(F.col("filename").alias("document_id")), "document_id", "left_semi")
    return pages.select("document_id", "page_number", "raw_text", "tables"), names.where(~fits)


def seed_cache(spark: SparkSession, path: str, have: DataFrame) -> DataFrame:
    """Documents of a JSON cache whose filename is not there yet."""
    cached = spark.read.json(path, multiLine=True)
    documents = cached.select(F.explode("documents").alias("d")).select("d.*") if "documents" in cached.columns else cached
    return documents.join(have.select("filename"), "filename", "left_anti")


#: A fact as a cache holds it.
CACHED = "STRUCT<entity: STRING, metric: STRING, value: STRING, raw_value: STRING, confidence_score: DOUBLE, corpus: STRING, category: STRING, context: STRUCT<temporal_period: STRING, reporting_scope: STRING, unit: STRING>, evidence: STRUCT<document_id: STRING, page_number: INT, verbatim_quote: STRING>>"


def seed_facts(spark: SparkSession, path: str) -> DataFrame:
    """The raw facts of a JSON cache, one row each."""
    cached = spark.read.schema(f"facts ARRAY<{CACHED}>").json(path, multiLine=True)
    f = cached.select(F.explode("facts").alias("f"))
    named = {"corpus": "f.corpus", "entity": "f.entity", "metric": "f.metric", "document_id": "f.evidence.document_id", "page_number": "f.evidence.page_number", "value": "f.value", "raw_value": "f.raw_value"}
    named |= {"temporal_period": "f.context.temporal_period", "reporting_scope": "f.context.reporting_scope", "unit": "f.context.unit", "verbatim_quote": "f.evidence.verbatim_quote", "confidence_score": "f.confidence_score", "category": "f.category"}
    return f.select(*[F.col(c).alias(name) for name, c in named.items()])


def large_images(pages: DataFrame, least: int = 120) -> DataFrame:
    """Pages whose images are at least so wide and high; a caption is one line, and defaults to the image's number among all."""
    line = lambda i: F.trim(F.regexp_replace(F.coalesce(i["caption"], F.lit("")), r"\s+", " "))
    number = lambda k: F.concat(F.lit("Figure/Image "), (k + 1).cast("string"), F.lit(" on Page "), F.col("page_number").cast("string"))
    captioned = F.transform("images", lambda i, k: i.withField("caption", F.when(line(i) != "", line(i)).otherwise(number(k))))
    return pages.withColumn("images", F.filter(captioned, lambda i: (i["width"] >= least) & (i["height"] >= least)))

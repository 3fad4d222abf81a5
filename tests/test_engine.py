"""The engine end to end: files, pages, streams and tables."""

import json

import pytest

from corrobora.engine import Engine
from corrobora.operators import answers, store
from corrobora.sources import fixture, readers
from corrobora.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_engine_over_the_fixture(spark, tmp_path):
    e = Engine(spark, fixture.facts(spark, SF))
    assert e.relationships().count() == 3720 and e.relationships("genuine_contradiction").count() == 98
    assert e.failures().count() == 34 and e.failures(include_canonical=False).count() == 31
    assert e.consensus().count() > 0 and e.showcase().count() == 4
    assert e.linked().count() + e.standalone().count() == e.facts.count()
    assert e.list_facts(entity="chad", metric="nothing").count() > 0 and e.list_facts(limit=0).count() == e.facts.count() and e.list_facts(metric="growth", limit=0).count() == 0
    assert e.page(["fact_id"], 2, 10).count() == 10
    e.sync(str(tmp_path / "out"))
    stored = spark.read.parquet(str(tmp_path / "out/relationships"))
    assert stored.count() == stored.select("relationship_id").distinct().count() == e.relationships().select("relationship_id").distinct().count() <= 3720
    assert e.failure_example().count() == 1 and e.list_documents().count() == e.documents.count()
    e.create_views()
    assert spark.sql("SELECT count(*) AS n FROM relationships WHERE verdict = 'corroborated'").first()["n"] > 0


def test_from_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one-chad.pdf.txt").write_text("Chad\nReal GDP growth was 3.1 percent in 2023.\fGross fiscal deficit of 4.8% in 2023.\n\n")
    (tmp_path / "in/two-chad.txt").write_text("Real GDP growth was 3.4 percent in 2023.\nRevenue from operations reached 81 Cr.")
    pages = readers.text_pages(spark, str(tmp_path / "in"))
    assert pages.count() == 3 and readers.text_pages(spark, str(tmp_path / "in"), 1).count() == 2
    assert readers.binary_catalog(spark, str(tmp_path / "in"), "*.txt").where("length(doc_id) = 12").count() == 2
    e = Engine.from_pages(pages, "Chad macro")
    rows = {(r["document_id"], r["metric"], r["value"], r["entity"]) for r in e.facts.collect()}
    assert ("one-chad.pdf.txt", "Real GDP Growth", "3.1%", "Republic of Chad") in rows and ("two-chad.txt", "Revenue from Operations", "81 Cr", "Republic of Chad") in rows
    assert e.reconciliations("genuine_contradiction").where("a_metric = 'Real GDP Growth'").count() >= 1


def test_stream(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    page = lambda d, t: json.dumps({"document_id": d, "page_number": 1, "raw_text": t, "tables": []})
    for k, text in enumerate(("Real GDP growth was 3.1 percent in 2023.", "Real GDP growth was 3.4 percent in 2023.", "No figures.", "Real GDP growth was 3.4 percent in 2024.")):
        (source / f"{k}.json").write_text(page(f"{min(k, 1)}-chad.pdf", text))
        q = ingest.ingest(ingest.pages(spark, str(source)), root, str(tmp_path / "cp"))
        q.awaitTermination()
    got = {(r["document_id"], r["value"], r["temporal_period"]) for r in ingest.facts(spark, root).collect()}
    assert got == {("0-chad.pdf", "3.1%", "2023"), ("1-chad.pdf", "3.4%", "2024")}  # one id, so the last one counts
    assert [(r["verdict"], r["shift_type"]) for r in ingest.relationships(spark, root).collect()] == [("context_reconciled", "temporal_shift")] or ingest.relationships(spark, root).count() >= 1


def test_request_rate(spark, tmp_path):
    events = spark.readStream.schema(spark.read.parquet(f"{SF}/events.parquet").schema).parquet(SF + "/events.parquet*")
    q = ingest.request_rate(events).writeStream.format("memory").queryName("rate").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) AS n FROM rate").first()["n"] == 1000


def test_store_writes(spark):
    df = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("c", "y", 3), ("e", None, 5)], "fact_id string, document_id string, v int")
    new = spark.createDataFrame([("b", "x", 9, 2), ("b", "x", 8, 1), ("d", "x", 4, 1), ("d", "x", 5, None)], "fact_id string, document_id string, v int, n int")
    assert {tuple(r) for r in store.upsert(df, new, ["fact_id"], "n").collect()} == {("a", "x", 1), ("b", "x", 9), ("c", "y", 3), ("d", "x", 4), ("e", None, 5)}
    assert {tuple(r) for r in store.replace_document(df, new, "x", "n").collect()} == {("b", "x", 9), ("c", "y", 3), ("d", "x", 4), ("e", None, 5)}
    assert store.pages_of(0, 25) == 1 and store.pages_of(50, 25) == 2 and store.pages_of(51, 25) == 3
    none = spark.createDataFrame([(None,), (" ",)], "corpus string")
    assert sorted(r["corpus"] for r in store.corpora(none).collect()) == ["Delhivery", "India Macroeconomics"]


def test_seed_cache(spark, tmp_path):
    evidence = {"document_id": "one.pdf", "page_number": 3, "verbatim_quote": "q"}
    (tmp_path / "cache.json").write_text(json.dumps({"documents": [{"doc_id": "1", "filename": "one.pdf"}, {"doc_id": "2", "filename": "two.pdf"}], "facts": [{"entity": "E", "metric": "M", "value": "1", "raw_value": "1", "confidence_score": 0.9, "context": {"unit": "%"}, "evidence": evidence}]}, indent=1))
    have = spark.createDataFrame([("two.pdf",)], "filename string")
    assert [r["filename"] for r in readers.seed_cache(spark, str(tmp_path / "cache.json"), have).collect()] == ["one.pdf"]
    row = readers.seed_facts(spark, str(tmp_path / "cache.json")).first()
    assert (row["document_id"], row["page_number"], row["unit"], row["corpus"]) == ("one.pdf", 3, "%", None)


def test_uploads_and_line_ends(spark, tmp_path):
    (tmp_path / "a.pdf.txt").write_bytes(b"  one\t\r\n\t\r\ntwo \fthree")
    (tmp_path / "b.doc").write_text("x")
    pages, refused = readers.uploads(spark, str(tmp_path), max_pages=1)
    assert [(r["document_id"], r["raw_text"]) for r in pages.collect()] == [("a.pdf.txt", "one\ntwo")] and [r["filename"] for r in refused.collect()] == ["b.doc"]


def test_pace_and_client():
    now, slept = [1000.0], []

    def sleep(s):
        slept.append(round(s, 2))
        now[0] += s

    pace = answers.Pace(per_minute=2, per_day=4, apart=1.5, clock=lambda: now[0], sleep=sleep)
    for _ in range(3):
        pace.acquire()
    assert slept == [1.5, 58.55] and pace.stats()["rpm_used"] == 2
    pace.penalize(5)
    pace.acquire()
    assert slept[2] == 5.0 and pace.stats()["rpd_used"] == 4
    pace.acquire()
    assert slept[-1] > 86000

    tries = []

    def ask(prompt):
        tries.append(prompt)
        if len(tries) < 3:
            raise RuntimeError("Error 429: please try again in 9.5s" if len(tries) == 1 else "429")
        return "[]"

    waited = []
    client = answers.Client(ask, answers.CHUNK_WAITS, sleep=waited.append)
    assert client("p") == "[]" and waited == [10.0, 8.0]

    def refuses(prompt):
        raise RuntimeError("bad key")

    with pytest.raises(RuntimeError):
        answers.Client(refuses, answers.CHUNK_WAITS, sleep=waited.append)("p")
    assert answers.items_of('{"facts": [{"a": 1}, 2]}') == [{"a": 1}] and answers.items_of("nonsense") == [] and answers.items_of("```json\n[{}]\n```") == [{}]


def test_images(spark):
    df = spark.createDataFrame([(1, [("a", 200, 300), (None, 130, 130), ("b", 50, 500)])], "page_number int, images array<struct<caption:string,width:int,height:int>>")
    assert [i["caption"] for i in readers.large_images(df).first()["images"]] == ["a", "Figure/Image 2 on Page 1"]

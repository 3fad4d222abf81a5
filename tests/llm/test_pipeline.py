import re

import corpus_pipeline
from corrobora.llm import langid, mixing
from tests.llm.test_langid_simhash import exact_links, least_reachable

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_schema_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(10**6, None, "en", "src1", 0), (10**6 + 1, "12 !!", "en", "src1", 5)], docs.schema)
    docs = docs.unionByName(junk)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.cut(stage(spark, docs, SF), "test")
        assert docs.columns == before.columns, name
        kept[name] = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    ids = lambda n: [r["doc_id"] for r in kept[n].select("doc_id").collect()]
    assert 10**6 not in ids(names[0]) and 10**6 + 1 not in ids(names[0])
    rows = sorted((r["doc_id"], r["text"]) for r in kept[names[0]].select("doc_id", "text").collect())
    root = least_reachable(len(rows), exact_links([t for _, t in rows]))
    assert sorted(ids(names[1])) == sorted({rows[r][0] for r in root}) and len(set(root)) < len(rows)
    private = re.compile(r"\b4\d{15}\b|[\w.]+@mail\d+\.example\.com")
    old = {m for r in kept[names[1]].collect() for m in private.findall(r["text"])}
    new = {m for r in kept[names[2]].collect() for m in private.findall(r["text"])}
    assert old and not old & new and sorted(ids(names[2])) == sorted(ids(names[1]))
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(kept[names[2]]).collect() if r["size"]}
    assert sorted(ids(names[3])) == sorted(d for d, n in taken.items() for _ in range(n))
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == set(ids(names[3]))
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed)
    assert langid.UNKNOWN == "und"


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50


def test_run_on_odd_rows(spark, tmp_path):
    clash = ("__lang", "__gone", "__found", "__copies", "piece", "sequence_id")
    rows = [(None, "Some words about a thing that is not there", "en", "a"), (None, None, "en", "a"), (1, "", "en", None), (2, "these are words, and mail a1@b.example.com too", "en", None), (2, "these are words, and mail a1@b.example.com too", "en", None), (3, "wort " * 30000, "de", "b"), (4, "these are words, and mail a1@b.example.com too", None, "b")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *range(6)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in clash))
    docs.write.parquet(str(tmp_path / "odd/documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "odd"))
    assert {r["doc_id"] for r in out.collect()} <= {None, 2, 3} and out.count() > 10
    docs.limit(0).write.parquet(str(tmp_path / "empty/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0

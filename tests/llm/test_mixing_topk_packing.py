import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corrobora.llm import mixing, packing, topk
from corrobora.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["op1_mixing", "op7_exact_topk"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLES[name] if name == "op1_mixing" else ORACLES[name])
    want = sorted(rel.select(*df.columns).fetchall())
    assert sorted(map(tuple, df.collect())) == want and len(want) > 20


def water_fill(sizes, weights, most=3):
    """Share all by weight; what is above a limit is shared again by weight."""
    total, targets, open_ = float(sum(sizes)), [0.0] * len(sizes), list(range(len(sizes)))
    left = total
    while True:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / w
            return targets
        for i in over:
            targets[i] = most * sizes[i]
            left -= targets[i]
        open_ = [i for i in open_ if i not in over]


def test_mixing_targets(spark):
    rng = random.Random(3)
    sizes = [0, 5, 1, 100000, 7, 300, 20, 2, 90]
    rows = []
    for k, n in enumerate(sizes):
        left, source = n, None if k == 8 else f"s{k}"
        while left:
            m = min(left, rng.randint(1, 40))
            rows.append((len(rows), "w " * m, None, source, 0))
            left -= m
        rows.append((len(rows), None, None, source, 0))
    out = mixing.mix(spark.createDataFrame(rows, DOC)).collect()
    sources = {r[0]: r[3] for r in rows}
    want = dict(zip([f"s{k}" for k in range(8)] + [None], water_fill(sizes, [1, 2, 3] * 3), strict=True))
    taken = {}
    for r in out:
        s = sources[r["doc_id"]]
        assert r["target"] == pytest.approx(want[s]) and r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] = taken.get(s, 0) + r["taken"]
    assert len(out) == len(rows) and all(abs(taken[s] - want[s]) <= 21 for s in want)


def test_mixed_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 7, 8), (2, "c", "t", 7, 8)], "doc_id long, text string, source string, __copies int, __Time int")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and {r["__copies"] for r in out.collect()} <= {7}


def test_mixed_rows_follow_taken(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 as copies", "2 as h")
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(docs).collect() if r["size"]}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {d: n for d, n in taken.items() if n}
    assert mixing.mix(docs.limit(0)).count() == mixing.mixed(docs.limit(0)).count() == 0


def plain_top(rows, k=5, step=50):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in {i: v for i, v in ok if i % step == 0}.items():
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_topk_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(200)]
    rows += [(1000, None), (1050, [1.0, None]), (1100, [float("nan")] * 6), (1150, [float("inf")] * 6), (None, [1.0] * 6), (1200, [0.5, 0.25]), (1250, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as v")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert sorted(map(tuple, topk.report(df).collect())) == plain_top(rows)
    few = df.where("vec_id in (0, 1, 50)")
    assert sorted(map(tuple, topk.report(few).collect())) == plain_top([r for r in rows if r[0] in (0, 1, 50)])
    assert topk.report(df.limit(0)).count() == topk.report(df.where("vec_id = 50")).count() == 0


def test_topk_blocks_agree(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    whole = sorted(map(tuple, topk.report(df).collect()))
    monkeypatch.setattr(topk, "QUERIES", 4)
    assert sorted(map(tuple, topk.report(df).collect())) == whole


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def test_encoder_gives_the_ids_of_the_tokenizer(spark):
    encoder = packing.Encoder(packing.tokenizer_path())
    odd = ["", " ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "don't we'll", "x\u2003y\u00a0 z", "\u001c a \u0085 b", "naïve 日本 語 12 34", "a\tb  \n\n c d", "<|endoftext|> x <|endoftext|>", "a\x1fb \x1f c", "  lead", "tail  ", "DON'T we'LL"]
    rng = random.Random(1)
    odd += ["".join(rng.choice(" \n\tab1.,é\u00a0\u3000'") for _ in range(60)) for _ in range(300)]
    points = [c for c in range(0x32400) if not 0xD800 <= c < 0xE000]
    odd += ["".join(chr(c) + rng.choice(["", " ", "a", "1"]) for c in points[at : at + 64]) for at in range(0, len(points), 64)]
    odd += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer().encode_batch(odd, add_special_tokens=False)]
    got = encoder.encode(odd)
    assert [t for t, a, b in zip(odd, got, want, strict=True) if a != b] == []


def check_packing(rows, texts, encode):
    seen, bins, total = {}, {}, 0
    for r in rows:
        seen.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append(r)
    for d, text in texts.items():
        ids = np.array([*encode(text or ""), 0], "<u4")
        at, parts = 0, sorted(seen[d], key=lambda r: r["piece"])
        for k, r in enumerate(parts):
            assert (r["piece"], r["start"]) == (k, at) and 1 <= r["length"] <= 2048 and (k == 0 or r["length"] == 2048)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids) and (len(ids) > 2048 or len(parts) == 1)
        total += at
    for group in bins.values():
        at = 0
        for r in sorted(group, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    return len(bins), -(-total // 2048)


def test_packing_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tok = tokenizer()
    used, least = check_packing(QUERIES["op8_packing"](spark, SF).collect(), texts, lambda t: tok.encode(t, add_special_tokens=False).ids)
    assert used <= least * 1.02 + 1


def test_packing_odd_rows(spark):
    texts = {1: None, 2: "", 3: "word " * 5000, 4: "a" * 10000, 5: "x", 6: "x"}
    df = spark.createDataFrame([(d, t, "en", None, 1) for d, t in texts.items()], DOC).selectExpr("*", "1 as length", "2 as at")
    tok = tokenizer()
    check_packing(packing.pack(df).collect(), texts, lambda t: tok.encode(t, add_special_tokens=False).ids)
    twice = packing.pack(df.unionByName(df)).collect()
    assert len(twice) == 2 * packing.pack(df).count() and len({(r["sequence_id"], r["offset"]) for r in twice}) == len(twice)
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("counts", [{1: 5000}, {2048: 10}, {1025: 7, 1023: 7}, {700: 9, 300: 50, 1: 3}, {n: n % 7 for n in range(1, 2049)}])
def test_rounds_place_every_piece_once(counts):
    runs, free = packing.rounds(counts), {}
    for n, rank, count, first, offset in sorted(runs, key=lambda r: r[4]):
        for i in range(count):
            assert free.get(first + i, 0) == offset and offset + n <= 2048
            free[first + i] = offset + n
    for n, c in counts.items():
        ranks = sorted(r for m, rank, count, _, _ in runs if m == n for r in range(rank, rank + count))
        assert ranks == list(range(c))
    total = sum(n * c for n, c in counts.items())
    assert len(free) <= -(-total // 2048) * 1.25 + 1


def test_products_of_huge_numbers():
    rng = np.random.default_rng(2)
    for scale in (2**20, 2**31, 2**40, 2**61):
        a, b = rng.integers(-scale, scale, (6, 5)), rng.integers(-scale, scale, (7, 5))
        want = [[max(-topk.MOST, min(topk.MOST, sum(x * y for x, y in zip(p, q)))) for q in b.tolist()] for p in a.tolist()]
        assert topk.products(a, b).tolist() == want


def test_huge_components_saturate(spark):
    rows = [(0, [1e17, 0.0]), (1, [1e17, 1.0]), (2, [1.0, 0.0]), (3, [-1e300, 0.0])]
    got = [(r["query_id"], r["vec_id"], r["score"]) for r in topk.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    assert got == [(0, 1, topk.MOST), (0, 2, topk.MOST), (0, 3, -topk.MOST)]


def test_packing_of_null_ids_and_other_tokenizers(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a b c"), (None, None), (1, "")], "doc_id long, text string")
    got = packing.pack(docs).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in got) == [(0, 1), (0, 4), (1, 1)] and len({r["offset"] for r in got}) == 3
    import json

    spec = json.loads(open(packing.tokenizer_path(), encoding="utf-8").read())
    assert packing.plain_bytes(spec)
    spec["pre_tokenizer"] = {"type": "Whitespace"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    assert not packing.plain_bytes(spec)
    import tokenizers

    other = tokenizers.Tokenizer.from_file(str(path))
    text = "some words, and 12 numbers"
    assert packing.Encoder(str(path)).encode([text])[0] == np.array(other.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from corrobora.llm import langid, simhash
from corrobora.llm.components import components
from corrobora.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def least_reachable(n, near):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in near:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text, words):
    tokens = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    fps = [plain_fingerprint(t, 4) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = {(rows[i][0], f"{fps[i]:016x}", rows[r][0]) for i, r in enumerate(least_reachable(len(rows), near))}
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in QUERIES["op4_simhash"](spark, SF).collect()}
    assert got == want


def test_simhash_links_lose_none(spark):
    rng = np.random.default_rng(5)
    fps = set()
    for base in rng.integers(0, 1 << 63, 40, dtype=np.uint64).tolist():
        for k in range(8):
            bits = rng.choice(64, k, replace=False)
            fps.add(base ^ sum(1 << int(b) for b in bits))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = [(r["a"], r["b"]) for r in simhash.links(df).collect()]
    m = (1 << 64) - 1
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & m).bit_count() <= 4}
    assert len(got) == len(set(got)) and set(got) == want


def test_simhash_variants_are_not_broadcast(spark):
    """A fingerprint's 64 variants count as one row in Spark's estimate, so few fingerprints would be collected on the driver."""
    plan = simhash.links(spark.range(1000).selectExpr("id as fp"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_many_links_are_not_broadcast(spark, monkeypatch):
    rows = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)]
    links, many = spark.createDataFrame(rows, "a long, b long"), []
    stars = components.__globals__["_stars"]
    monkeypatch.setitem(components.__globals__, "BROADCAST_ROWS", 10)
    monkeypatch.setitem(components.__globals__, "_stars", lambda *a: many.append("Broadcast" in (out := stars(*a))._jdf.queryExecution().executedPlan().toString()) or out)
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(21)} | {i: 100 for i in range(100, 130)} and many and not any(many)


def test_components_of_a_chain_and_a_star(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (3, 4)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def exact_links(texts):
    """All pairs of texts whose sets of five-word shingles are as similar as asked for."""
    sets = []
    for text in texts:
        tokens = (text or "").lower().split()
        sets.append({tuple(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))})
    holders, common = {}, {}
    for i, s in enumerate(sets):
        for x in s:
            for j in holders.setdefault(x, []):
                common[i, j] = common.get((i, j), 0) + 1
            holders[x].append(i)
    return [(i, j) for (i, j), n in common.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n)]


def test_near_copies_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want = {(rows[i][0], rows[r][0]) for i, r in enumerate(least_reachable(len(rows), exact_links([t for _, t in rows])))}
    assert {(r["doc_id"], r["component_id"]) for r in simhash.near_copies(docs).collect()} == want
    assert len({c for _, c in want}) < len(rows) - 20


def test_near_copies_of_a_dense_group(spark):
    """Copies at all distances from one text: some are linked through others only, some to none."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(240):
        copy = list(base)
        for at in rng.choice(150, int(rng.integers(0, 10)), replace=False):
            copy[at] = f"x{k}y{at}"
        texts.append(" ".join(copy))
    want = dict(enumerate(least_reachable(len(texts), exact_links(texts))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    wrong = [d for d in want if got[d] != want[d]]
    assert 20 < len(set(want.values())) < 200 and len(wrong) <= 1, wrong


def test_near_copies_catch_edits_and_leave_others(spark):
    rng = np.random.default_rng(7)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(4000)]
    rows, group = [], {}
    for k in range(30):
        words = rng.choice(vocabulary, 300).tolist()
        for c in range(6):
            d, copy = 10 * k + c, list(words)
            for at in rng.choice(300, c, replace=False):  # similarity 0.84 at least
                copy[at] = rng.choice(vocabulary)
            rows.append((d, " ".join(copy)))
            group[d] = 10 * k
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[d] == g for d, g in group.items())


def test_near_copies_meet_by_fingerprints(spark, monkeypatch):
    """Without a shared part of the sketches, fingerprints within four bits link the texts that are similar, and only these."""
    rng = np.random.default_rng(13)
    words = [f"w{i}" for i in rng.integers(0, 5000, 400)]
    loop = [f"v{i}" for i in range(10)] * 60
    texts = [words, [*words[:200], "edit", *words[201:]], loop, [*loop, *(f"t{i}" for i in range(20))], [f"u{i}" for i in range(300)]]
    fps = [simhash.fingerprint(" ".join(t), 5) for t in texts]
    assert (fps[0] ^ fps[1]).bit_count() <= 4 and (fps[2] ^ fps[3]).bit_count() <= 4 and shingle_jaccard(*(" ".join(t) for t in texts[2:4])) < 0.8
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(9, " ".join(texts[0]).upper())], "doc_id long, text string")
    signed = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in simhash.signed(docs, 5).collect()}
    assert signed == dict(enumerate(fps)) | {9: fps[0]}
    none = spark.createDataFrame([], "key long, node long, wiped int, weight long")
    monkeypatch.setattr(simhash, "buckets", lambda texts: none)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 9: 0}


def shingle_jaccard(a, b):
    sets = []
    for text in (a, b):
        tokens = text.lower().split()
        sets.append({tuple(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_candidates_catch_appended_truncated_and_scattered_copies(spark):
    rng = np.random.default_rng(11)
    vocabulary = np.array(["".join(w) for w in rng.choice(list("abcdefghijklmnop"), (20000, 7))])
    weight = 1 / np.arange(1, 20001)
    draw = lambda n: rng.choice(vocabulary, n, p=weight / weight.sum())
    texts, kinds = {}, {}
    for k in range(300):
        n = int(rng.integers(100, 1000))
        words, kind = draw(n), ("appended", "truncated", "scattered")[k % 3]
        if kind == "appended":
            copy = np.concatenate([words, draw(int(n * 0.22))])
        elif kind == "truncated":
            copy = words[: int(n * 0.825)]
        else:
            copy = words.copy()
            at = rng.choice(n, max(1, n // 50), replace=False)
            copy[at] = draw(len(at))
        texts[2 * k], texts[2 * k + 1], kinds[k] = " ".join(words), " ".join(copy), kind
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    signed = simhash.cut(simhash.signed(docs, 5), "test")
    of = {r["doc_id"]: r["text_id"] for r in signed.collect()}
    keys = {}
    for r in simhash.buckets(signed).collect():
        keys.setdefault(r["key"], []).append(r["node"])
    met = {(a, b) for held in keys.values() for a in held for b in held if a < b}
    for kind in ("appended", "truncated", "scattered"):
        true = [k for k, v in kinds.items() if v == kind and shingle_jaccard(texts[2 * k], texts[2 * k + 1]) >= 0.8]
        found = sum(tuple(sorted((of[2 * k], of[2 * k + 1]))) in met for k in true)
        print(kind, found, len(true))
        assert len(true) >= 50 and found >= 0.98 * len(true), (kind, found, len(true))


def test_near_copies_are_those_of_exact_similarity(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for k in range(120):  # a copy that keeps 180 to 220 shingles of 250, so 0.72 to 0.88
        words = [f"w{k}x{i}" for i in range(254)]
        keep = int(rng.integers(180, 221))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: keep + 4]))]
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k if keep / 250 >= 0.8 else 2 * k + 1}
    assert all(shingle_jaccard(rows[d][1], rows[d - 1][1]) >= 0.8 for d, c in want.items() if c != d)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wrong = {d for d in want if got[d] != want[d]}
    joined = sum(c != d for d, c in want.items())
    assert 20 < joined < 100 and len(wrong) <= 1 and all(want[d] != d for d in wrong), wrong


ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, "...", "en", "s", 3),
    (3, "...", "en", "s", 3),
    (4, "wörter " * 30000, "de", None, 1),
    (None, "wörter", "de", "s", 1),
    (5, "퟿\U0001f600 x", "en", "s", 4),
]


def test_simhash_on_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOC).selectExpr("*", "1 as fp", "2 as component_id", "3 as key", "4 as __gone", "5 as __ODD_ID", "6 as __lang", "7 as __text")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.report(docs).collect())
    assert [g[0] for g in got] == [-1, 1, 2, 3, 3, 4, 5]
    assert dict(got)[2] == 1 and dict(got)[1] == 1
    assert simhash.report(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3, 4, 5]


def test_langid_on_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOC).selectExpr("*", "1 as score", "2 as lang_pred")
    model = langid.LanguageModel(("de", "en"), np.log([0.5, 0.5]), np.zeros((1025, 2), np.float32))
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()]
    assert (1, "und", 0.0) in got and (2, "und", 0.0) in got and got.count((3, "und", 0.0)) == 2
    assert (4, "de", 0.5) in got
    assert langid.identify(docs.limit(0)).count() == 0
    assert sorted(r["doc_id"] or -1 for r in langid.keep_identified(docs).collect()) == [-1, 4, 5]


def test_langid_pieces_add_up():
    rng = np.random.default_rng(1)
    model = langid.LanguageModel(("a", "b"), np.zeros(2), np.vstack([rng.normal(size=(1024, 2)), np.zeros((1, 2))]).astype(np.float32))
    text = "héllo wörld, this is a test. " * 50
    whole, letters = langid.evidence([text], model)
    for size in (100, 101, len(text), len(text) + 5):
        total, n = langid.long_evidence(text, model, size)
        assert n == letters[0] == sum(c.isalpha() for c in text)
        assert total == pytest.approx(whole[0], rel=1e-6)
    counted = next(langid.fit_counts([pa.RecordBatch.from_pydict({"text": [text], "lang": ["x"]})], 1024)).to_pydict()
    old, langid.PIECE = langid.PIECE, 97
    try:
        assert next(langid.fit_counts([pa.RecordBatch.from_pydict({"text": [text], "lang": ["x"]})], 1024)).to_pydict() == counted
        cut_up = langid.predict_texts([text, "x", text[:50]], model)
    finally:
        langid.PIECE = old
    assert cut_up[0] == langid.predict_texts([text, "x", text[:50]], model)[0]


def plain_fit(rows, buckets=1 << 15):
    """Counts by gram from a dictionary, the plain way; rows of (text, lang)."""
    counts = {}
    for text, lang in rows:
        points = [c if c.isalpha() else " " for c in f" {text.lower()} "]
        held = counts.setdefault(lang, Counter())
        for n in (1, 2, 3):
            for i in range(len(points) - n + 1):
                gram = points[i : i + n]
                if gram != [" "] and not any(a == b == " " for a, b in zip(gram, gram[1:])):
                    held["".join(gram)] += 1
    return counts


def test_langid_counts_match_plain_ones(spark):
    rows = [("Hello, wörld! Hello 你好", "en"), ("das ist  ein Test", "de"), ("Привет мир", "ru"), ("hello hello", "en")]
    model = langid.fit(spark.createDataFrame([(i, t, la) for i, (t, la) in enumerate(rows)], "doc_id long, text string, lang string"))
    want = plain_fit(rows)
    made = {la: {} for la in want}
    for la, held in want.items():
        for gram, n in held.items():
            _, *by = langid.grams(gram, 1 << 15)
            b = int(by[len(gram) - 1][0])
            made[la][b] = made[la].get(b, 0) + n
    logs = np.log(np.array([[made[la].get(b, 0) + 0.5 for la in model.langs] for b in range(1 << 15)]))
    logs -= np.log(np.array([sum(made[la].values()) + 0.5 * (1 << 15) for la in model.langs]))
    assert np.allclose(model.weights[:-1], logs - logs.mean(1, keepdims=True), atol=1e-4)


def test_langid_many_languages(spark):
    rows = [(i, f"text {i}", f"l{i % 1500}") for i in range(3001)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), buckets=64)
    assert len(model.langs) == langid.MAX_LANGS and "l0" in model.langs


def test_langid_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 100 and sum(r["lang"] == r["lang_pred"] for r in out) / len(out) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in out)

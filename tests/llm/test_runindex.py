import hashlib
import random

import numpy as np
import pytest

from corrobora.llm import runindex

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, length=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by a table of all strings."""
    least = {}
    for d, t in rows:
        if d is not None:
            for i in range(len(t) - length + 1):
                s = t[i : i + length]
                least[s] = min(least.get(s, d), d)
    out = []
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        if d is not None:
            for i in range(len(t) - length + 1):
                if least[t[i : i + length]] < d:
                    gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_matches_brute_force_on_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = rows_of(runindex.report(docs))
    want = brute([(r["doc_id"], r["text"].encode()) for r in docs.collect()])
    assert got == want and sum(w[2] for w in want) > 1000


@pytest.mark.parametrize("seed", range(4))
def test_matches_brute_force_on_repetitive_texts(spark, seed, monkeypatch):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab" if seed % 2 else "abcdefgh é") for _ in range(400)) for _ in range(4)]
    rows = []
    for d in range(60):
        text = ""
        for _ in range(rng.randint(0, 5)):
            b = rng.choice(base)
            i = rng.randint(0, 350)
            text += b[i : i + rng.randint(1, 120)]
        rows.append((rng.choice([d, d, d - 1]), text, None, None, 0))
    rows += [(100, "a" * 500, None, None, 0), (101, "a" * 49, None, None, 0), (102, "a" * 700, None, None, 0), (103, "xy" * 300, None, None, 0), (104, "yx" * 300, None, None, 0)]
    monkeypatch.setattr(runindex, "SLICE", 3000)
    monkeypatch.setattr(runindex, "BUCKET_BYTES", 2000)
    got = rows_of(runindex.report(spark.createDataFrame(rows, DOC)))
    assert got == brute([(r[0], r[1].encode()) for r in rows])


def test_odd_rows(spark):
    long = "".join(random.Random(9).choice("abcdef ") for _ in range(30000))
    rows = [(1, None), (2, ""), (None, long[:500]), (3, long), (4, long[200:400]), (4, long[200:400]), (None, long), (5, "\x00" * 120), (6, "\x00" * 60), (7, long * 3)]
    df = spark.createDataFrame([(d, t, None, None, 0) for d, t in rows], DOC).selectExpr("*", "1 as spans", "2 as n_bytes", "3 as bucket")
    assert rows_of(runindex.report(df)) == brute([(d, (t or "").encode()) for d, t in rows])
    assert runindex.report(df.limit(0)).count() == 0


def test_without_broadcast(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = rows_of(runindex.report(docs))
    monkeypatch.setattr(runindex, "BROADCAST_BYTES", 0)
    assert rows_of(runindex.report(docs)) == want


def test_rolling_and_sliding():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 300, dtype=np.uint8)
    for length in (1, 2, 12, 50):
        h = runindex.rolling(data, length, np.uint64)
        assert len(h) == 301 - length
        m, want = runindex.MULTIPLIER, []
        for i in range(len(h)):
            x = 0
            for b in data[i : i + length].tolist():
                x = (x * m + b + 1) % 2**64
            want.append(x)
        assert h.tolist() == want
    h = rng.integers(0, 99, 200, dtype=np.uint32)
    for w in (1, 5, 8, 39):
        assert runindex.sliding_min(h, w).tolist() == [h[i : i + w].min() for i in range(201 - w)]


def test_index_maps_back_and_compresses():
    segs = [b"abracadabra" * 8, b"bracadabra" * 9, b"abracadabra" * 8 + b"x"]
    text = np.frombuffer(b"".join(s + b"\x00" for s in segs), np.uint8).astype(np.uint16)
    owner = np.repeat(np.arange(3), [len(s) + 1 for s in segs])
    index = runindex.RunIndex(text, owner, np.array([5, 3, 9]))
    rows = np.arange(len(text))
    raw = text.astype(np.uint8).tobytes()
    suffix = [(raw + raw)[p : p + 50] for p in index.rows]
    assert suffix == sorted(suffix) and len(index.run) < len(text) / 4
    groups = index.groups(rows)
    back = index.back(groups, text[index.rows - 1])
    for r in rows:
        assert (raw + raw)[index.rows[back[r]] :][:50] == (raw + raw)[(index.rows[r] - 1) % len(text) :][:50]
        assert index.sample[groups[r]] == min(d for s, d in zip(suffix, np.array([5, 3, 9])[owner[index.rows]]) if s == suffix[r])

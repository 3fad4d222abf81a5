import itertools
import random

import numpy as np
import pytest

from corrobora.llm import toxicity as tox
from corrobora.llm.queries import QUERIES


def model(seed=0):
    rng = np.random.default_rng(seed)
    return tox.ToxicityModel({}, rng.normal(size=(3, 6)), -0.3, rng.normal(size=(2, 2)), np.zeros(3))


def brute(seq, m):
    """Marginals of state 1 and the log-partition by all paths."""
    near = [0, *seq.tolist(), 0]
    e = [m.state[0][near[t + 1]] + m.state[1][near[t]] + m.state[2][near[t + 2]] for t in range(len(seq))]
    total, ones = 0.0, np.zeros(len(seq))
    for path in itertools.product((0, 1), repeat=len(seq)):
        s = m.start * path[0] + sum(a for a, y in zip(e, path) if y) + sum(m.moves[a, b] for a, b in zip(path, path[1:]))
        total += np.exp(s)
        ones += np.exp(s) * np.array(path)
    return ones / total, np.log(total)


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(1)
    seqs = [rng.integers(0, 6, n).astype(np.int8) for n in (3, 0, 7, 1, 5)]
    m = model()
    marginal, logz, moved = tox.forward_backward(seqs, m)
    pairs = 0
    for s, p, z in zip(seqs, marginal, logz):
        if len(s):
            want = brute(s, m)
            assert p == pytest.approx(want[0]) and z == pytest.approx(want[1])
            pairs += len(s) - 1
        else:
            assert len(p) == 0
    assert moved.sum() == pytest.approx(pairs)


def test_long_and_short_sequences_agree():
    rng = np.random.default_rng(2)
    seqs = [rng.integers(0, 6, n).astype(np.int8) for n in (5000, 3, 40)]
    together = tox.forward_backward(seqs, model(3))[0]
    for s, p in zip(seqs, together):
        assert p == pytest.approx(tox.forward_backward([s], model(3))[0][0]) and np.isfinite(p).all()


def test_fit_finds_the_tags():
    rng = np.random.default_rng(4)
    seqs = [rng.choice(6, 60, p=[0.8, 0.04, 0.04, 0.04, 0.04, 0.04]).astype(np.int8) for _ in range(200)]
    m = tox.fit_chain(seqs, [(s >= 3).astype(np.int64) for s in seqs])
    marginal = tox.forward_backward(seqs, m)[0]
    assert np.mean([((p >= 0.5) == (s >= 3)).all() for s, p in zip(seqs, marginal)]) > 0.98


def test_spans_are_offsets_of_the_text():
    m = tox.ToxicityModel({"bad": 5, "horri*": 5}, np.array([[-6, 0, 0, 0, 0, 8.0], [0] * 6, [0] * 6]), 0.0, np.zeros((2, 2)), np.array([-3, 0.5, 1.0]))
    text = "İ é 12 Bad, HORRID things; bad"
    scores, spans = tox.score_texts([text, None, "", "fine words"], m)
    assert [text[a:b] for a, b, _ in spans[0]] == ["Bad, HORRID", "bad"] and spans[1:] == [[], [], []]
    assert scores[0] > scores[1] == scores[2] == scores[3]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "bad word " * 20000), (3, "x"), (None, "y"), (4, "... 12")], "doc_id long, text string").selectExpr("*", "1 as score", "2 as spans")
    labels = spark.createDataFrame([(1, None), (1, 1), (2, 0), (3, 1), (3, 0), (None, 1)], "doc_id long, toxic int")
    out = tox.report(docs, labels).collect()
    assert len(out) == 6 and all(0 <= r["score"] <= 1 for r in out) and all(len(r["offsets"].split()) == r["n_spans"] for r in out)
    assert tox.report(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in tox.report(docs, labels.limit(0)).collect()} == {0.0}


def test_labels_outside_the_training_fold_do_not_matter(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", tox.F.when(tox.held_out(), 1 - tox.F.col("toxic")).otherwise(tox.F.col("toxic")))
    a = {r["doc_id"]: r["score"] for r in tox.report(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in tox.report(docs, turned).collect()}
    assert a == pytest.approx(b)


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = QUERIES["op2_toxicity"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    assert hit / sum(r["predicted"] for r in rows) > 0.9 and hit / sum(r["toxic"] for r in rows) > 0.85
    rng = random.Random(0)
    pos, neg = ([r["score"] for r in rows if r["toxic"] == k] for k in (1, 0))
    assert sum(rng.choice(pos) > rng.choice(neg) for _ in range(4000)) / 4000 > 0.9

"""Toxic spans and document scores by a linear-chain conditional random field.

Learning, from a bounded sample of labelled documents that are not held out:
words and the beginnings of words are weighed by the share of toxic texts among
those that hold them, and a word that is too rare takes the weight of its longest
known beginning (copies
of a text count once, and so do texts with one minimal word hash, so a family of
near copies doesn't make its words suspicious); in toxic documents the heavy words
are the labelled toxic tokens; a two-state chain with the weights of a word and
of its neighbours as features is fitted to those sequences by its exact gradient;
a logistic curve maps two aggregates of the marginals to the document's label.

Scoring runs forward-backward over whole documents, all documents of a batch in
step.  Tokens whose marginal is at least one half are joined into spans.

Defined results
* null and empty texts and texts without a word have no span and the score of a
  text without suspicious words;
* labels that are null teach nothing; several labels of one id count as toxic if one is;
* repeated rows are scored each; a null id counts as the empty text in the split;
* without toxic or without clean training texts every score is 0;
* an empty table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_hash32, id_text_crc, slices

#: Labelled documents of each label that a fit takes at most, chosen by the hash of their id.
MAX_TOXIC, MAX_CLEAN = 6000, 12000
#: A word is weighed if so many families of toxic texts hold it: a share of them, this many at least.
MIN_SHARE, MIN_FAMILIES = 0.004, 3
#: Lower bounds of a word's toxic share for weights 1 to 5; words below have weight 0.
SHARES = (0.3, 0.5, 0.7, 0.85, 0.95)
#: Weight from which a word of a toxic document is a toxic token.
LABELLED = 3
#: Letters of the beginnings that stand for rare words, longest first.
BEGINNINGS = (8, 7, 6, 5)
#: Cells of the padded table of tokens and sequences that are worked on at once.
CELLS = 400_000
#: Words whose weight a task remembers.
REMEMBERED = 400_000
#: Tokens of a training window, and the most windows.
WINDOW, MAX_WINDOWS = 128, 12000
#: Documents of the sample, about, that fit the chain and the curve, chosen by the hash of their id.
CHAIN_DOCS = 4000
THRESHOLD = 0.7
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


@dataclass(frozen=True)
class ToxicityModel:
    """lexicon: word, or beginning with a star, to weight; state: (3, weights) scores of state 1 for the weight of a word, of the one before and the one after.

    start: score of beginning in state 1; moves[a, b]: score of going from a to b; curve: intercept and slopes over ``aggregates``.
    """

    lexicon: dict[str, int]
    state: np.ndarray
    start: float
    moves: np.ndarray
    curve: np.ndarray | None


def lowered(text: str) -> str:
    """Lower case at the same offsets."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weights by step and sequence, longest first, with one step more at either end; lengths."""
    sizes = np.array([len(s) for s in seqs])
    out = np.zeros((int(sizes.max(initial=0)) + 2, len(seqs)), np.int8)
    for k, s in enumerate(seqs):
        out[1 : len(s) + 1, k] = s
    return out, sizes


def forward_backward(seqs: list[np.ndarray], model: ToxicityModel) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Marginals of state 1, log-partitions, and expected moves summed over all sequences.

    All sequences advance together; those that have ended drop out, so the work is
    in proportion to their tokens.
    """
    order = np.argsort([-len(s) for s in seqs], kind="stable")
    w, sizes = padded([seqs[i] for i in order])
    steps, n = len(w) - 2, len(seqs)
    ends = np.searchsorted(-sizes, -np.arange(1, steps + 1), "right")  # sequences with at least so many tokens
    e = np.exp(model.state[0][w[1:-1]] + model.state[1][w[:-2]] + model.state[2][w[2:]])
    m = np.exp(model.moves)
    a = np.zeros((steps, 2, n))
    scale = np.ones((steps, n))
    for t in range(steps):
        k = ends[t]
        if t:
            p0, p1 = a[t - 1, 0, :k], a[t - 1, 1, :k]
            x0, x1 = p0 * m[0, 0] + p1 * m[1, 0], (p0 * m[0, 1] + p1 * m[1, 1]) * e[t, :k]
        else:
            x0, x1 = np.ones(k), np.exp(model.start) * e[0, :k]
        z = x0 + x1
        scale[t, :k] = z
        a[t, 0, :k], a[t, 1, :k] = x0 / z, x1 / z
    b0, b1 = np.ones(n), np.ones(n)
    marginal = np.zeros((steps, n))
    moved = np.zeros((2, 2))
    for t in range(steps - 1, -1, -1):
        k = ends[t]
        later = ends[t + 1] if t + 1 < steps else 0
        if later:
            q1 = b1[:later] * e[t + 1, :later] / scale[t + 1, :later]
            q0 = b0[:later] / scale[t + 1, :later]
            p0, p1 = a[t, 0, :later], a[t, 1, :later]
            moved += [[(p0 * q0).sum() * m[0, 0], (p0 * q1).sum() * m[0, 1]], [(p1 * q0).sum() * m[1, 0], (p1 * q1).sum() * m[1, 1]]]
            b0[:later], b1[:later] = m[0, 0] * q0 + m[0, 1] * q1, m[1, 0] * q0 + m[1, 1] * q1
        marginal[t, :k] = a[t, 1, :k] * b1[:k]
    out: list[np.ndarray] = [np.zeros(0)] * n
    for k, i in enumerate(order):
        out[i] = marginal[: sizes[k], k]
    logz = np.empty(n)
    logz[order] = np.log(scale).sum(0)
    return out, logz, moved


def marginals(seqs: list[np.ndarray], model: ToxicityModel) -> list[np.ndarray]:
    """Marginals of state 1; sequences of like length go together, so that little is padded."""
    out: list[np.ndarray] = [np.zeros(0)] * len(seqs)
    group: list[int] = []
    order = sorted(range(len(seqs)), key=lambda i: len(seqs[i]))
    for k, i in enumerate(order):
        group.append(i)
        if k + 1 == len(order) or len(seqs[order[k + 1]]) * (len(group) + 1) > CELLS:
            for j, p in zip(group, forward_backward([seqs[j] for j in group], model)[0], strict=True):
                out[j] = p
            group = []
    return out


def fit_chain(seqs: list[np.ndarray], tags: list[np.ndarray], steps: int = 150, rate: float = 0.2, ridge: float = 1e-3) -> ToxicityModel:
    """Maximise the conditional likelihood of 0/1 tags by its exact gradient, in adaptive steps."""
    kinds = len(SHARES) + 1
    near = [np.concatenate([[0], s, [0]]) for s in seqs]
    total = max(1, sum(map(len, seqs)))

    def counts(weights: list[np.ndarray]) -> np.ndarray:
        """Features of state 1 under given probabilities of it."""
        f = np.zeros((3, kinds))
        p = np.concatenate(weights) if weights else np.zeros(0)
        for row, part in enumerate((slice(1, -1), slice(None, -2), slice(2, None))):
            f[row] = np.bincount(np.concatenate([x[part] for x in near]), p, kinds)
        return f

    seen = counts([t.astype(float) for t in tags])
    began = sum(float(t[0]) for t in tags if len(t))
    pairs = np.zeros((2, 2))
    for t in tags:
        np.add.at(pairs, (t[:-1], t[1:]), 1)
    theta = np.concatenate([np.zeros(3 * kinds), [-2.0], [0.0, -2.0, 0.0, 0.0]])
    theta[0] = -4.0
    first = second = np.zeros_like(theta)

    def model_of(x: np.ndarray) -> ToxicityModel:
        return ToxicityModel({}, x[: 3 * kinds].reshape(3, kinds), float(x[3 * kinds]), x[3 * kinds + 1 :].reshape(2, 2), None)

    for k in range(1, steps + 1):
        marginal, _, moved = forward_backward(seqs, model_of(theta))
        g = np.concatenate([(seen - counts(marginal)).ravel(), [began - sum(p[0] for p in marginal if len(p))], (pairs - moved).ravel()]) / total - ridge * theta * 1e-2
        g[3 * kinds + 1] = 0  # staying clean is the reference
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        theta = theta + rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-12)
    return model_of(theta)


def aggregates(marginal: np.ndarray, base: float) -> tuple[float, float]:
    """Log-odds of the most toxic token and the log of one plus the expected toxic tokens above the base."""
    top = float(np.clip(marginal.max(initial=base), 1e-9, 1 - 1e-9))
    return np.log(top / (1 - top)), float(np.log1p(marginal[marginal > max(0.05, 2 * base)].sum()))


def base_marginal(model: ToxicityModel) -> float:
    """The marginal inside a long run of words without weight."""
    return float(forward_backward([np.zeros(101, np.int8)], model)[0][0][50])


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression of labels over aggregates, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def keys_of(word: str) -> list[str]:
    """What a word is looked up by: itself, then its beginnings."""
    return [word, *[word[:n] + "*" for n in BEGINNINGS if len(word) > n]]


class Weights(dict):
    """Word to weight, worked out once."""

    def __init__(self, lexicon: dict[str, int]) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        w = self[word] = next((self.lexicon[k] for k in keys_of(word) if k in self.lexicon), 0)
        return w


def weights_of(text: str | None, weights: Weights) -> np.ndarray:
    return np.array([weights[t] for t in TOKEN.findall(lowered(text or ""))], np.int8)


def score_texts(texts: list[str | None], model: ToxicityModel, weights: Weights | None = None) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Scores and toxic spans (start, end, highest marginal) of whole texts."""
    if model.curve is None:
        return np.zeros(len(texts)), [[] for _ in texts]
    base = base_marginal(model)
    x = np.tile(aggregates(np.zeros(0), base), (len(texts), 1))
    spans: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    weights = Weights(model.lexicon) if weights is None else weights
    seqs = [weights_of(t, weights) for t in texts]
    hit = [i for i, s in enumerate(seqs) if s.any()]
    if hit:
        for i, p in zip(hit, marginals([seqs[i] for i in hit], model), strict=True):
            x[i] = aggregates(p, base)
            on = np.flatnonzero(p >= 0.5)
            if len(on):
                at = [m.span() for m in TOKEN.finditer(lowered(texts[i]))]
                for run in np.split(on, np.flatnonzero(np.diff(on) > 1) + 1):
                    spans[i].append((at[run[0]][0], at[run[-1]][1], float(p[run].max())))
    z = model.curve[0] + x @ model.curve[1:]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))), spans


def _words_by_family(batches: Iterable[pa.RecordBatch], only: frozenset | None) -> Iterator[pa.RecordBatch]:
    """(word, family) of each text's distinct words and beginnings; a family has one minimal word hash."""
    for batch in slices(batches):
        words, families = [], []
        for text in batch.column("text").to_pylist():
            found = set(TOKEN.findall(lowered(text or "")))
            if found:
                family = min(xxhash.xxh64_intdigest(w) for w in found) >> 1
                found = {k for w in found for k in keys_of(w)}
                kept = found if only is None else found & only
                words += kept
                families += [family] * len(kept)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(families, pa.int64())], ["word", "family"])


def families(docs: DataFrame, only: frozenset | None = None) -> DataFrame:
    """(word, n): the number of families that hold a word."""
    pairs = docs.select("text").mapInArrow(lambda it: _words_by_family(it, only), "word string, family long")
    return pairs.distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def training_docs(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, toxic) of the sample, whose bound makes the broadcast of its ids safe, and how many labels of each kind it is from."""
    one = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    one = one.where(~held_out())
    sizes = {r["toxic"]: r["n"] for r in one.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    below = [int(min(1.0, most / max(1, sizes.get(k, 0))) * 2**32) for k, most in ((0, max_clean), (1, max_toxic))]
    taken = one.where(id_hash32(seed="toxicity") < F.when(F.col("toxic") == 1, below[1]).otherwise(below[0])).select(F.col("doc_id").alias("id"), "toxic")
    joined = docs.select("doc_id", "text").join(F.broadcast(taken), F.col("doc_id") == F.col("id"))
    return cut(joined.where("text is not null").select("doc_id", "text", "toxic"), "toxicity-sample"), sizes


def held_out(folds: int = 3, rest: int = 1):
    return id_text_crc() % folds == rest


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> ToxicityModel:
    """Learn from labelled rows of (doc_id, text) and (doc_id, toxic) that are not held out."""
    sample, all_sizes = training_docs(docs, labels, max_toxic, max_clean)
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    none = ToxicityModel({}, np.zeros((3, len(SHARES) + 1)), 0.0, np.zeros((2, 2)), None)
    if len(sizes) < 2:
        return none
    texts = sample.select("text", "toxic").distinct()  # copies of a text count once
    toxic = texts.where("toxic = 1")
    # a word of a clean text stands for as many as the sample left out
    rate = (all_sizes[0] / sizes[0]) / (all_sizes[1] / sizes[1])
    least = max(MIN_FAMILIES, int(MIN_SHARE * sizes[1]))
    found = {r["word"]: r["n"] for r in families(toxic).where(F.col("n") >= least).collect()}  # bounded by the sample
    clean = {r["word"]: r["n"] for r in families(texts.where("toxic = 0"), frozenset(found)).collect()}
    share = {w: (n + 0.1) / (n + 0.2 + rate * clean.get(w, 0)) for w, n in found.items()}
    lexicon = {w: sum(s >= x for x in SHARES) for w, s in share.items()}
    if not any(lexicon.values()):
        return none

    half = cut(sample.where(id_hash32(seed="chain") < int(min(1.0, CHAIN_DOCS / sum(sizes.values())) * 2**32)), "toxicity-chain")

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(lexicon)
        for batch in slices(batches):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                s, at = weights_of(text, weights), xxhash.xxh64_intdigest(text) >> 1
                cuts = [s[k : k + WINDOW] for k in range(0, len(s), WINDOW)]
                place = [xxhash.xxh64_intdigest(at.to_bytes(8, "little"), k) >> 1 for k in range(len(cuts))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([toxic] * len(cuts), pa.int32()), pa.array([c.tobytes() for c in cuts], pa.binary()), pa.array([bool(c.any()) for c in cuts], pa.bool_()), pa.array(place, pa.int64())],
                    ["toxic", "seq", "weighed", "place"],
                )

    windows = cut(half.select("text", "toxic").mapInArrow(coded, "toxic int, seq binary, weighed boolean, place long"), "toxicity-windows")
    # windows with a weighed word, and as many without, both in the order of a hash over all of the sample's
    chosen = lambda which, n: [(r["toxic"], np.frombuffer(r["seq"], np.int8)) for r in windows.where(which).orderBy("place", "seq", "toxic").limit(n).collect()]
    full = chosen("weighed", MAX_WINDOWS // 2)
    bare = chosen("not weighed", max(200, len(full)))
    seqs = [s for _, s in full + bare]
    tags = [((s >= LABELLED) & (y == 1)).astype(np.int64) for y, s in full + bare]
    chain = fit_chain(seqs, tags)
    model = ToxicityModel(lexicon, chain.state, chain.start, chain.moves, np.zeros(3))
    base = base_marginal(model)

    def aggregated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(lexicon)
        for batch in slices(batches):
            ps = marginals([weights_of(t, weights) for t in batch.column("text").to_pylist()], model)
            x = np.array([aggregates(p, base) if (p > 2 * base).any() else aggregates(np.zeros(0), base) for p in ps])
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x[:, 0]), pa.array(x[:, 1])], ["toxic", "a", "b"])

    rows = half.select("text", "toxic").mapInArrow(aggregated, "toxic int, a double, b double").toPandas()
    y = rows["toxic"].to_numpy(float)
    curve = fit_curve(rows[["a", "b"]].to_numpy(), y)
    share_true = all_sizes[1] / sum(all_sizes.values())
    curve[0] += np.log(share_true / (1 - share_true)) - np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))
    return ToxicityModel(lexicon, chain.state, chain.start, chain.moves, curve)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, spans): spans are arrays of (start, end, p) in code points of the text."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(model.lexicon)
        for batch in slices(batches):
            p, spans = score_texts(batch.column("text").to_pylist(), model, weights)
            rows = [[{"start": a, "end": b, "p": q} for a, b, q in s] for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(rows, span)], ["doc_id", "score", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, score double, spans array<struct<start:int,end:int,p:double>>")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's rows: doc_id, held_out, score, predicted, the number of toxic spans and their offsets, as ``start-end`` in code points."""
    out = score(docs, fit(docs, labels))
    offsets = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), " ")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), offsets.alias("offsets"))

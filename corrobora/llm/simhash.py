"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into three segments, the fewest for which four
differing bits leave one segment with one differing bit at most.  Each segment is
indexed once for each of its bits with that bit wiped out, so two fingerprints
within four bits meet in an equality join on (wiped bit, rest of the segment).
The join's condition verifies the distance and keeps a pair only where it meets
first, so a pair comes out once.  Fingerprints are made distinct before, so
copies never multiply, and links become components without being collected.

The pipeline asks for a similarity of 0.8 in shingles of five words.  ``near_copies``
first takes the links of fingerprints, as above, and verifies each by the exact
similarity of the shingles' hashes.  At 0.8 fingerprints differ in ten bits, too many
for any segment, so for the pairs that these links leave apart it takes the same
deletion variants of another signature, a sketch of minimal hashes of shingles, whose
agreement depends on the similarity alone, whatever the kind of edit: parts of ten
hashes are indexed once for each hash with that one wiped out.  Sketches rule out the
pairs that are clearly apart, and the rest are verified in the same exact way.

Defined results
* a null, empty or blank text has the fingerprint zero and links like any other;
* texts shorter than a shingle are one shingle;
* repeated rows get the same component; the id of a component is its smallest
  doc_id (null ids are passed over; null if it has no other);
* an empty table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gather
from .common import checked_broadcast, cut, free_names, lean, slices
from .components import components

SEED = 42
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_BITS = 4
#: Shingles that are hashed at once.
BLOCK = 1 << 16


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """In how many of the hashes each of the 64 bits is set."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def majority(sums: np.ndarray, n: int) -> int:
    """The bits that are set in over half of n hashes."""
    return int(np.packbits(2 * sums > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int) -> int:
    """Unsigned 64-bit SimHash over word shingles, repeats included."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    ends = starts + sizes
    n = max(1, len(tokens) - words + 1)
    last = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : min(n, at + BLOCK)].tolist(), last[at : at + BLOCK].tolist(), strict=True)], "<u8")
        total += bit_sums(h)
    return majority(total, n)


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(work), f"doc_id {kind}, fp long")


def _mask(start: int, width: int) -> int:
    m = ((1 << width) - 1) << start
    return m - (1 << 64) if m >= 1 << 63 else m


def variant_keys() -> Column:
    """The 64 one-wildcard segment variants of ``fp``, led by the wiped bit."""
    keys = []
    for start, width in SEGMENTS:
        part = F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << width) - 1))
        for i in range(width):
            keys.append(part.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << i))) + F.lit((start + i) << 22))
    return F.array(*keys)


def variants(nodes: DataFrame) -> DataFrame:
    """(key, fp) for each of the variants of a fingerprint."""
    return nodes.select(F.explode(variant_keys()).alias("key"), "fp")


def first_meeting(x: Column, wiped: Column) -> Column:
    """True in the one bucket that counts of those in which two fingerprints with difference x meet."""
    near = [F.bit_count(x.bitwiseAND(F.lit(_mask(*s)))) <= 1 for s in SEGMENTS]
    first = F.lit(False)
    for k, (start, width) in enumerate(SEGMENTS):
        here = (wiped >= start) & (wiped < start + width) & ((wiped == start) | (x.bitwiseAND(F.lit(_mask(start, width))) != 0))
        for other in near[:k]:
            here = here & ~other
        first = first | here
    return first


def links(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: every pair of distinct fingerprints that differ in four bits or fewer, once each.

    Both sides of the join are one plan, so the variants are shuffled once.  Spark
    takes them for as small as the fingerprints and would collect them on the driver
    to broadcast them, so the join is named.
    """
    v = variants(nodes)
    a, b = F.col("l.fp"), F.col("r.fp")
    x = a.bitwiseXOR(b)
    # of both sides, though they are equal: a condition on one side would be pushed below its shuffle
    wiped = F.shiftright(F.col("l.key").bitwiseOR(F.col("r.key")), 22)
    joined = v.alias("l").join(v.alias("r").hint("merge"), F.col("l.key") == F.col("r.key")).where((a < b) & (F.bit_count(x) <= MAX_BITS) & first_meeting(x, wiped))
    return joined.select(a.alias("a"), b.alias("b"))


def near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, fp, component_id) for each document."""
    prints = cut(fingerprints(docs, words), "simhash")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    roots = components(links(nodes.select("fp").repartition(width)))  # spread before each row becomes 64
    rooted = cut(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select(F.col("fp").alias("node_fp"), "component_id")
    return prints.join(named, prints["fp"] == named["node_fp"]).select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """The query's rows, by shingles of four words."""
    return near_duplicates(docs, words=4).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Minimal hashes of five-word shingles, 16 bits each, that stand for a text.
SKETCH = 128
#: Segments of the sketch that are indexed, and the hashes of each: a pair at 0.8 agrees in all but one hash of some segment in 99.65 % of cases.
PARTS, PART_HASHES = 12, 10
SIMILARITY = 0.8
#: Words of 64 bits into which a text's shingles are hashed for a bound of what two texts share.
MAP_WORDS = 32
#: Share of a sketch below which a pair is surely apart: a pair at 0.8 falls below in 0.0003 % of cases.
CLEARLY_APART = 0.64
MIX = 0x9E3779B97F4A7C15


def signature(tokens: list[bytes], words: int, odd: np.ndarray) -> tuple[int, bytes]:
    """The text's fingerprint, and its sketch: the minimal hash of its shingles under each multiplier, cut to 16 bits."""
    if not tokens:
        return 0, b""
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    digest, best, total = xxhash.xxh64_intdigest, np.full(len(odd), 2**64 - 1, np.uint64), np.zeros(64, np.int64)
    for at in range(0, len(last), 4096):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : min(len(last), at + 4096)].tolist(), last[at : at + 4096].tolist(), strict=True)], np.uint64)
        best = np.minimum(best, (h[:, None] * odd[None]).min(0, initial=2**64 - 1))
        total += bit_sums(h)
    return majority(total, len(last)), ((best * np.uint64(MIX)) >> np.uint64(48)).astype("<u2").tobytes()


def multipliers(n: int = SKETCH) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signed(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_id, fp, sketch): a 64-bit hash of the words in order, the fingerprint, and the sketch; empty without a word."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = multipliers()
        for batch in slices(batches):
            ids, fps, sketches = [], [], []
            for text in batch.column("text").to_pylist():
                tokens = (text or "").encode("utf-8", "replace").lower().split()
                ids.append(xxhash.xxh64_intdigest(b" ".join(tokens)))
                fp, held = signature(tokens, words, odd)
                fps.append(fp)
                sketches.append(held)
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (ids, fps)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *longs, pa.array(sketches, pa.binary())], ["doc_id", "text_id", "fp", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(work), f"doc_id {kind}, text_id long, fp long, sketch binary")


def part_variants(table: np.ndarray) -> np.ndarray:
    """The one-wildcard variants of each part of sketches (rows), as hashes: PARTS x PART_HASHES a row.

    A part's hash is a sum over its places, from which the wiped place's share is
    taken off, so that a variant costs one subtraction.
    """
    place = np.arange(PARTS * PART_HASHES, dtype=np.uint64)
    x = (table[:, : len(place)].astype(np.uint64) + (place << np.uint64(16)) + np.uint64(1)) * np.uint64(MIX)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))).reshape(-1, PARTS, PART_HASHES)
    wiped = (x.sum(2, dtype=np.uint64)[:, :, None] - x).reshape(len(table), -1) + place * np.uint64(MIX)
    wiped = (wiped ^ (wiped >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return wiped ^ (wiped >> np.uint64(30))


def sketch_variants(texts: DataFrame) -> DataFrame:
    """(key, node, wiped) for each one-wildcard variant of each part of a text's sketch; wiped is the hash left out, led by its place in the part."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("text_id").to_numpy()
            raw = batch.column("sketch").to_pylist()
            for at in range(0, len(ids), 1000):
                table = np.frombuffer(b"".join(raw[at : at + 1000]), "<u2").reshape(-1, SKETCH)
                keys = part_variants(table)
                wiped = table[:, : keys.shape[1]] + (np.arange(keys.shape[1], dtype=np.int32) % PART_HASHES << 16)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids[at : at + 1000], keys.shape[1])), pa.array(wiped.ravel().astype(np.int32))], ["key", "node", "wiped"])

    return texts.where(F.length("sketch") > 0).select("text_id", "sketch").mapInArrow(lean(work), "key long, node long, wiped int")


def buckets(texts: DataFrame) -> DataFrame:
    """(key, node, wiped, weight): the variants that several texts share."""
    width = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sketch_variants(texts.select("text_id", "sketch").repartition(width))  # spread before each row becomes 120
    return gather.buckets(rows, "copies-buckets")


def shingle_facts(held: DataFrame) -> DataFrame:
    """(text_id, size, common, folded, m0, m1, ...) of each text: its distinct shingles, those of them that another text has too, and a map of bits.

    The map has a bit for each shingle's hash; folded is how many shingles more than bits there are.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, x in zip(batch.column("text_id").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, "<i8")), pa.array(np.full(len(x) // 8, t, np.int64))], ["h", "text_id"])

    seen = held.select("text_id", "shingles").mapInArrow(lean(work), "h long, text_id long").groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("text_id").alias("text_id"))
    own = seen.where("n = 1").groupBy("text_id").agg(F.count(F.lit(1)).alias("own"))
    def mapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, maps = [], np.zeros((batch.num_rows, 64 * MAP_WORDS), np.uint8)
            for i, x in enumerate(batch.column("shingles").to_pylist()):
                h = np.frombuffer(x, "<u8")
                sizes.append(len(h))
                maps[i, (h % np.uint64(64 * MAP_WORDS)).astype(np.intp)] = 1
            folded = np.array(sizes, np.int64) - maps.sum(1, dtype=np.int64)
            words = np.packbits(maps, axis=1, bitorder="little").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column("text_id"), pa.array(sizes, pa.int64()), pa.array(folded), *[pa.array(w) for w in words.T.copy()]], ["text_id", "size", "folded", *MAP])

    facts = held.select("text_id", "shingles").mapInArrow(lean(mapped), "text_id long, size long, folded long, " + ", ".join(f"{m} long" for m in MAP))
    return facts.join(own, "text_id", "left").select("text_id", "size", (F.col("size") - F.coalesce("own", F.lit(0))).alias("common"), "folded", *MAP)


MAP = tuple(f"m{k}" for k in range(MAP_WORDS))


def may_reach(common: Column, sizes: Column) -> Column:
    """True unless two texts that have so many shingles in common, at most, are surely below SIMILARITY."""
    return common >= SIMILARITY * (sizes - common)


def rest_pairs(met: DataFrame, roots: DataFrame, held: DataFrame) -> DataFrame:
    """(a, b): all texts of one bucket that have different roots, but for those that can't be similar.

    What two texts share is at most what either shares with any other text, and at
    most the bits that their maps share and the shingles that are folded in them.  A
    text that shares too little with all others leaves; the join's condition bounds
    the rest, so the far members of a dense group are not paired with all of it.
    Parts that agree as a whole have ten variants in common, of which one counts.
    """
    facts = cut(shingle_facts(held).where(may_reach(F.col("common"), F.col("size") + F.col("common"))).withColumnRenamed("text_id", "node"), "copies-facts")
    alive = cut(gather.rooted(met.select("key", "node", "wiped").join(facts.select("node"), "node"), roots), "copies-alive")
    rows = cut(alive.join(gather.mixed(alive), "key", "left_semi"), "copies-mixed").join(facts, "node")
    bits = reduce(lambda t, m: t + F.bit_count(F.col(f"l.{m}").bitwiseAND(F.col(f"r.{m}"))), MAP, F.lit(0))
    common = F.least("l.common", "r.common", bits + F.least("l.folded", "r.folded"))
    once = (F.col("l.wiped") != F.col("r.wiped")) | (F.col("l.wiped") < (1 << 16))
    near = (F.col("l.root") < F.col("r.root")) & once & may_reach(common, F.col("l.size") + F.col("r.size"))
    met_once = rows.alias("l").join(rows.alias("r"), F.col("l.key") == F.col("r.key")).where(near)
    return met_once.select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()


def maybe_similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): the pairs of texts that their sketches don't rule out."""
    side = lambda c: texts.select(F.col("text_id").alias(c), F.col("sketch").alias(f"sketch_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = [np.frombuffer(b"".join(x or bytes(2 * SKETCH) for x in batch.column(c).to_pylist()), "<u2").reshape(-1, SKETCH) for c in ("sketch_a", "sketch_b")]
            near = pa.array((table[0] == table[1]).mean(1) >= CLEARLY_APART)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(near) for c in ("a", "b")], ["a", "b"])

    return both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(lean(work), "a long, b long")


def shingle_hashes(tokens: list[bytes], words: int) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted."""
    n = max(1, len(tokens) - words + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(tokens[i : i + words]), SEED) for i in range(n)), np.uint64, n))


def shingled(docs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(text_id, shingles): the shingles' hashes, as bytes, of the texts (text_id, least) once each."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, out = [], []
            for text in batch.column("text").to_pylist():
                tokens = (text or "").encode("utf-8", "replace").lower().split()
                ids.append(xxhash.xxh64_intdigest(b" ".join(tokens)))
                out.append(shingle_hashes(tokens, words).astype("<u8").tobytes() if tokens else b"")
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(out, pa.binary())], ["text_id", "shingles"])

    of = docs.select("doc_id", "text").join(texts.select("least"), F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")
    made = of.mapInArrow(lean(work), "text_id long, shingles binary").join(texts.select("text_id"), "text_id", "left_semi")
    return made.dropDuplicates(["text_id"])


def shingles_of(ids: DataFrame, texts: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(text_id, shingles) of the texts named, written once."""
    return cut(shingled(docs, cut(texts.select("text_id", "least").join(ids, "text_id"), "copies-named"), words), "copies-shingles")


def similar(pairs: DataFrame, held: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Those of the pairs (a, b) of texts whose distinct shingles' hashes have so large a Jaccard similarity."""
    side = lambda c: held.select(F.col("text_id").alias(c), F.col("shingles").alias(f"shingles_{c}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(*(batch.column(c).to_pylist() for c in ("shingles_a", "shingles_b")), strict=True):
                one, two = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                merged = np.sort(np.concatenate([one, two]), kind="stable")
                common = int((merged[1:] == merged[:-1]).sum())
                near.append(common >= least * (len(merged) - common))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    return both.select("a", "b", "shingles_a", "shingles_b").mapInArrow(lean(work), "a long, b long")


def print_pairs(texts: DataFrame) -> DataFrame:
    """(a, b): each text with the least of its fingerprint, and the least texts of any two fingerprints within four bits."""
    width = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heads = cut(texts.groupBy("fp").agg(F.min("text_id").alias("head"), F.count(F.lit(1)).alias("n")), "copies-prints")
    several = heads.where("n > 1").select(F.col("fp").alias("p"), "head")
    same = texts.join(several, F.col("fp") == F.col("p")).where("text_id != head").select(F.col("text_id").alias("a"), F.col("head").alias("b"))
    side = lambda c: heads.select(F.col("fp").alias(f"fp_{c}"), F.col("head").alias(c))
    near = links(heads.select("fp").repartition(width)).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    return same.unionByName(near.join(side("a"), "fp_a").join(side("b"), "fp_b").select("a", "b"))


def text_links(texts: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(a, b): links by which all similar texts whose fingerprints are near or that share a bucket are reached from each other."""
    near = cut(print_pairs(texts), "copies-near-prints")
    met = buckets(texts)
    named = reduce(DataFrame.union, [near.select("a"), near.select("b"), met.select("node")]).toDF("text_id").distinct()
    held = shingles_of(named, texts, docs, words)
    verified = lambda pairs: similar(cut(maybe_similar(pairs, texts), "copies-maybe"), held)
    known = cut(similar(near, held), "copies-known")
    linked, roots = gather.gathered(met, verified, "copies-heads", known=known)
    rest = verified(cut(rest_pairs(met, roots, held), "copies-rest"))
    return linked.unionByName(cut(rest, "copies-across"))


def near_copies(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, component_id): documents linked by texts of SIMILARITY in shingles of five words.

    Texts whose fingerprints are within four bits are linked first, where they are
    that similar.  Texts that agree in all but one hash of a part of their sketches
    are the further candidates, of which those are verified that their sketches don't
    rule out.  In the first rounds each text meets one head, which gathers dense groups with a pair a text
    and round; then all candidates meet that are in different components and may be similar.
    """
    rows = cut(signed(docs, words), "copies-signed")
    texts = cut(rows.groupBy("text_id").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch")), "copies-texts")
    nodes = texts.select(F.col("text_id").alias("node"), "least")
    named = cut(gather.rooted(nodes, components(text_links(texts, docs, words))).withColumnRenamed("node", "text_id"), "copies-roots")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(ids, "root").select("text_id", "component_id")
    return rows.select("doc_id", "text_id").join(of, "text_id").select("doc_id", "component_id")


def keep_one(docs: DataFrame, words: int = 5) -> DataFrame:
    """The document with the smallest id of each component, with all its columns, whatever their names.

    Rows that repeat an id are kept once; rows without an id are all kept.  The
    ids to drop are joined without moving the texts while they are few.
    """
    names = docs.columns
    gone, odd_id = free_names(docs, "gone", "odd_id")
    ids = docs.where(F.col("doc_id").isNotNull())
    found = near_copies(ids, words)
    rows = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("doc_id") != F.col("component_id")).alias(gone))
    odd = cut(rows.where(F.col(gone) | (F.col("n") > 1)).select(F.col("doc_id").alias(odd_id), gone), "simhash-odd")
    known = checked_broadcast(odd, odd.count())
    marked = docs.join(known, docs["doc_id"] == known[odd_id], "left").where(F.col(gone).isNull() | ~F.col(gone))
    if odd.where(~F.col(gone)).isEmpty():
        return marked.select(*names)
    once = marked.where(F.col(gone).isNull()).select(*names)
    return once.unionByName(marked.where(~F.col(gone)).select(*names).dropDuplicates(["doc_id"]))

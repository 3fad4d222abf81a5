"""Repeated passages by a run-length compressed Burrows-Wheeler index.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller id.  Texts are bytes; matches never cross documents.

1. Routing.  Every window of LENGTH bytes has a minimizer, the least hash of the
   12-byte strings in it; neighbouring windows with one minimizer form a segment,
   which goes to the bucket of that hash.  Equal windows thus meet in one bucket,
   wherever they stand, and a byte travels three to four times, compressed.
   Segments that a task holds several times travel once.
2. Index.  A bucket keeps its distinct segments.  Those that share a window hash
   with another segment or document are indexed: their suffixes are sorted by the
   first LENGTH bytes (prefix doubling; ties by document), the preceding bytes are
   the transform, and its runs are kept with the mapping of their heads.  Rows that
   agree in LENGTH bytes form a group, whose end nearest the top is sampled: the
   smallest document that holds the string.
3. Matching statistics.  All segments are streamed backwards through the runs in
   step, a mapping step a byte; a row's group says whether a match of LENGTH bytes
   goes to a smaller document.
   Texts that a smaller id has as a whole are known by their hash before and take
   no part.
4. Matches become intervals, intervals are merged by document, and what is left of
   each text is digested.

Window hashes only select what is indexed, and tell equal segments (two 64-bit
hashes and the length), as two 64-bit hashes and the length tell equal texts; the matches themselves come from the sorted bytes.

Defined results
* a null text is empty; texts shorter than LENGTH lose nothing;
* rows that repeat an id are no smaller than one another, so repeated rows keep
  what no smaller id has; null ids teach nothing and lose nothing;
* an empty table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, cut, slices

LENGTH = 50
#: Bytes of the strings whose hashes route a window.
GRAM = 12
#: Windows of a segment at most: its first and last windows then cover it.
MOST = 50
#: Bytes of text for each bucket, and for each slice of a task.
BUCKET_BYTES = 4 << 20
SLICE = 3 << 20
#: Bytes of merged intervals up to which they are broadcast.
BROADCAST_BYTES = 32 << 20
MULTIPLIER = 0x9E3779B97F4A7C15


def rolling(data: np.ndarray, length: int, kind: type, block: int = 1 << 16) -> np.ndarray:
    """Polynomial hash of the ``length`` bytes from each place on, by doubling, in blocks that a cache holds."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, kind)
    full = 2 ** (8 * np.dtype(kind).itemsize)
    wrap = lambda e: kind(pow(MULTIPLIER % full, e, full))
    out = np.empty(n, kind)
    for at in range(0, n, block):
        m = min(block, n - at)
        part, size, have = data[at : at + m + length - 1].astype(kind) + kind(1), 1, 0
        while True:
            if length & size:
                if have:
                    out[at : at + m] *= wrap(size)
                    out[at : at + m] += part[have : have + m]
                else:
                    out[at : at + m] = part[:m]
                have += size
            if size * 2 > length:
                break
            part = part[:-size] * wrap(size) + part[size:]
            size *= 2
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x846CA68B)
    return h ^ (h >> np.uint32(16))


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    part, size = h, 1
    while size * 2 <= width:
        part = np.minimum(part[:-size], part[size:])
        size *= 2
    return np.minimum(part[: len(h) - width + 1], part[width - size :]) if size < width else part


def joined(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], ..., starts[i] + sizes[i] - 1, one after another."""
    ends = np.cumsum(sizes)
    wide = len(ends) > 0 and max(int(ends[-1]), int((starts + sizes).max())) >= 2**31
    out = np.ones(int(ends[-1]) if len(ends) else 0, np.int64 if wide else np.int32)
    if len(out):
        out[0] = starts[0]
        out[ends[:-1]] = starts[1:] - (starts[:-1] + sizes[:-1] - 1)
        np.cumsum(out, out=out)
    return out


def segments(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows and minimizer of each segment of the texts at starts.

    Texts shorter than a window have none.
    """
    long = sizes >= LENGTH
    starts, sizes = starts[long], sizes[long]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint32),)
    least = sliding_min(mixed(rolling(data, GRAM, np.uint32)), LENGTH - GRAM + 1)
    begin = np.zeros(len(least) + 1, bool)
    begin[1:-1] = least[1:] != least[:-1]
    begin[starts] = True
    begin[starts + sizes - LENGTH + 1] = True  # no window begins here: a gap, or the next text
    at = np.flatnonzero(begin)
    n = np.diff(np.append(at, len(least) if at[-1] < len(least) else at[-1]))
    inside = np.zeros(len(least) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + sizes - LENGTH + 1, -1)
    ok = (np.cumsum(inside)[at] > 0) & (n > 0)
    at, n = at[ok], n[ok]
    parts = -(-n // MOST)  # long runs of one minimizer are cut
    first = np.repeat(at, parts) + MOST * (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts))
    count = np.minimum(MOST, np.repeat(at + n, parts) - first)
    return first, count, least[first]


def identity(h: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What tells segments apart: the hashes of the first and the last window and the number of windows."""
    out = np.empty(len(at), [("a", "<u8"), ("b", "<u8")])
    out["a"] = h[at] * np.uint64(0xD6E8FEB86659FD93) + n.astype(np.uint64)
    out["b"] = h[at + n - 1]
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first row of each distinct (a, b), and each row's number among them."""
    order = np.lexsort((keys["b"], keys["a"]))
    s = keys[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    number = np.empty(len(s), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def packed(*columns: np.ndarray) -> bytes:
    head = struct.pack("<B", len(columns)) + b"".join(struct.pack("<2sQ", c.dtype.str[1:].encode(), c.nbytes) for c in columns)
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(c.tobytes() for c in columns))


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = raw[0], 1 + 10 * raw[0], []
    for k in range(n):
        kind, size = struct.unpack_from("<2sQ", raw, 1 + 10 * k)
        out.append(np.frombuffer(raw, "<" + kind.decode(), size // int(kind[1:]), at))
        at += size
    return out


def route(buckets: int) -> Callable:
    """A task's segments by bucket: distinct bytes and numbers of windows; of each occurrence the segment, document and place."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            ids, texts = batch.column("doc_id").to_numpy(), batch.column("text")
            raw = [t or b"" for t in texts.to_pylist()]
            prints = np.array([xxhash.xxh64_intdigest(t, 42) for t in raw], np.uint64).view(np.int64)
            data = np.frombuffer(b"".join(raw) + bytes(LENGTH), np.uint8)
            sizes = np.array([len(t) for t in raw], np.int64)
            starts = np.cumsum(sizes) - sizes
            at, n, least = segments(data, starts, sizes)
            if not len(at):
                continue
            first, number = distinct(identity(rolling(data, LENGTH, np.uint64), at, n))
            bucket = (mixed(least) % np.uint32(buckets)).astype(np.int64)
            owner = np.searchsorted(starts, at, "right") - 1
            first = np.sort(first)
            kept = first[np.argsort(bucket[first], kind="stable")]
            place = np.empty(len(first), np.int64)  # of a distinct segment in its bucket's row
            place[number[kept]] = np.arange(len(kept))
            found = np.argsort(bucket, kind="stable")
            names = np.unique(bucket)
            cuts, marks = np.searchsorted(bucket[kept], [names, names + 1]), np.searchsorted(bucket[found], [names, names + 1])
            rows = []
            for k in range(len(names)):
                s, o = kept[cuts[0][k] : cuts[1][k]], found[marks[0][k] : marks[1][k]]
                docs, doc = np.unique(owner[o], return_inverse=True)
                rows.append(packed(
                    data[joined(at[s], n[s] + LENGTH - 1)], n[s].astype(np.uint8), np.diff(place[number[o]] - cuts[0][k], prepend=0).astype(np.int32),
                    np.diff(doc, prepend=0).astype(np.int32), (at[o] - starts[owner[o]]).astype(np.uint32), ids[docs].astype(np.int64), prints[docs],
                ))
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(rows, pa.binary())], ["bucket", "blob"])

    return work


class RunIndex:
    """Run-compressed transform of segments, sorted by LENGTH bytes, with the smallest document of each group.

    text: bytes plus 1 of the segments, each followed by a 0; docs: each segment's smallest document.
    """

    def __init__(self, text: np.ndarray, owner: np.ndarray, docs: np.ndarray) -> None:
        n = len(text)

        def ranked(key: np.ndarray) -> np.ndarray:
            order = np.argsort(key)
            s = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], (s[1:] != s[:-1]).astype(np.int64)]))
            return rank

        wide = np.concatenate([text, text[:64] if n >= 64 else np.resize(text, 64)]).astype(np.uint64)
        key = np.zeros(n, np.uint64)
        for k in range(7):
            key = (key << np.uint64(9)) | wide[k : k + n]
        rank, size = ranked(key), 7
        later = lambda r, by: np.concatenate([r, np.resize(r, by)])[by : by + n]  # noqa: E731  the text goes round
        while size < LENGTH:
            by = min(size, LENGTH - size)
            rank = ranked((rank << 32) | later(rank, by))
            size += by
        by_doc = np.argsort(docs, kind="stable")
        age = np.empty(len(docs), np.int64)
        age[by_doc] = np.arange(len(docs))
        self.rows = np.argsort((rank << 32) | age[owner], kind="stable")  # the suffixes in order
        before = text[self.rows - 1]
        head = np.ones(n, bool)
        head[1:] = before[1:] != before[:-1]
        self.run = np.flatnonzero(head)
        chars, lengths = before[self.run], np.diff(np.append(self.run, n))
        by_char = np.argsort(chars, kind="stable")  # runs by byte, then by row
        self.width = n + 1
        self.keys = chars[by_char].astype(np.int64) * self.width + self.run[by_char]
        self.length = lengths[by_char]
        self.maps = np.cumsum(self.length) - self.length  # the row that a run's head maps to
        sorted_rank = rank[self.rows]
        top = np.ones(n, bool)
        top[1:] = sorted_rank[1:] != sorted_rank[:-1]
        self.group = np.flatnonzero(top)
        self.sample = docs[owner[self.rows[self.group]]]

    def groups(self, row: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.group, row, "right") - 1

    def back(self, group: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The first row whose suffix begins with the byte and then with what a group's rows have in common.

        That is the mapping of the byte's first run at or after the group's top.
        """
        top, c = self.group[group], byte.astype(np.int64)
        k = np.searchsorted(self.keys, c * self.width + top, "right") - 1
        here = (k >= 0) & (self.keys[k] >= c * self.width)
        passed = np.minimum(top - (self.keys[k] - c * self.width), self.length[k])
        return np.where(here, self.maps[k] + passed, self.maps[np.minimum(k + 1, len(self.keys) - 1)])


def matching(text: np.ndarray, ends: np.ndarray, windows: np.ndarray, index: RunIndex) -> np.ndarray:
    """For each window of each segment, in order, the smallest document that holds it.

    ends: the place of each segment's separator.  All segments are streamed
    backwards in step, each as far as it is long; the state of a stream is the
    group of rows that agree with it in LENGTH bytes.
    """
    out = np.empty(int(windows.sum()), np.int64)
    last = np.cumsum(windows) - 1
    order = np.argsort(-windows, kind="stable")
    place = np.empty(len(text), np.int64)
    place[index.rows] = np.arange(len(text))
    at = ends[order] - LENGTH  # the last window of each segment
    row, left = place[at], windows[order]
    for step in range(int(windows.max(initial=0))):
        k = np.searchsorted(-left, -step, "left")  # segments with more windows than step
        group = index.groups(row[:k])
        out[last[order[:k]] - step] = index.sample[group]
        at = at[:k] - 1
        row = index.back(group, text[at])
    return out


def merge_bucket(blobs: list[bytes]) -> tuple[np.ndarray, ...] | None:
    """Removed intervals (doc, print, start, end) of a bucket."""
    parts = [unpacked(b) for b in blobs]
    data = np.concatenate([p[0] for p in parts])
    windows = np.concatenate([p[1] for p in parts]).astype(np.int64)
    shift = np.cumsum([0, *[len(p[1]) for p in parts]])[:-1]
    held = np.concatenate([np.cumsum(p[2], dtype=np.int64) + s for p, s in zip(parts, shift, strict=True)])
    doc = np.concatenate([p[5][np.cumsum(p[3])] for p in parts])
    name = np.concatenate([p[6][np.cumsum(p[3])] for p in parts])
    place = np.concatenate([p[4] for p in parts]).astype(np.int64)
    del parts
    sizes = windows + LENGTH - 1
    at = np.cumsum(sizes) - sizes
    h = rolling(data, LENGTH, np.uint64)
    first, number = distinct(identity(h, at, windows))
    held = number[held]
    at, windows, sizes = at[first], windows[first], sizes[first]
    low = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(low, held, doc)
    high = np.full(len(first), np.iinfo(np.int64).min)
    np.maximum.at(high, held, doc)
    # segments worth indexing: of several documents, or with a window that another segment has
    own = np.repeat(np.arange(len(first)), windows)
    hashes = h[joined(at, windows)]
    del h
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    wanted = high > low
    wanted[own[order[1:][same]]] = wanted[own[order[:-1][same]]] = True
    del hashes, order, same
    chosen = np.flatnonzero(wanted)
    if not len(chosen):
        return None
    at, windows, sizes, low = at[chosen], windows[chosen], sizes[chosen], low[chosen]
    ends = np.cumsum(sizes + 1) - 1
    text = np.zeros(int(ends[-1]) + 1, np.uint16)
    keep = np.ones(len(text), bool)
    keep[ends] = False
    text[keep] = data[joined(at, sizes)]
    text[keep] += 1
    del data, keep
    index = RunIndex(text, np.repeat(np.arange(len(chosen)), sizes + 1), low)
    least = matching(text, ends, windows, index)
    del index, text
    number = np.full(len(wanted), -1)
    number[chosen] = np.arange(len(chosen))
    on = np.flatnonzero(wanted[held])
    held = number[held[on]]
    begin = np.cumsum(windows) - windows
    out = []
    for part in range(0, len(on), 1 << 16):
        s, o = held[part : part + (1 << 16)], on[part : part + (1 << 16)]
        n = windows[s]
        gone = least[joined(begin[s], n)] < np.repeat(doc[o], n)
        edge = np.cumsum(n) - n
        on_ = gone.copy()
        on_[1:] &= ~gone[:-1]
        on_[edge] = gone[edge]
        off = gone.copy()
        off[:-1] &= ~gone[1:]
        off[edge + n - 1] = gone[edge + n - 1]
        a, b = np.flatnonzero(on_), np.flatnonzero(off)
        which = np.searchsorted(edge, a, "right") - 1
        base = place[o][which] - edge[which]
        out.append((doc[o][which], name[o][which], base + a, base + b + LENGTH))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def by_key(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[bytes]]]:
    """The blobs of each key of sorted rows."""
    now, blobs = None, []
    for batch in batches:
        for k, blob in zip(batch.column(key).to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if k != now:
                if blobs:
                    yield now, blobs
                now, blobs = k, []
            blobs.append(blob)
    if blobs:
        yield now, blobs


def mark(parts: int) -> Callable:
    """Removed intervals of a task's buckets, by part of the documents."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in by_key(batches, "bucket"):
            found = merge_bucket(blobs)
            if found is None or not len(found[0]):
                continue
            part = (found[1] % parts).astype(np.int32)
            order = np.lexsort((found[2], found[0], part))
            names, first = np.unique(part[order], return_index=True)
            rows = []
            for o in np.split(order, first[1:]):
                doc, name, a, b = (c[o] for c in found)
                keys, i = np.unique(np.stack([doc, name], 1), axis=0, return_inverse=True)
                rows.append(packed(keys[:, 0].copy(), keys[:, 1].copy(), i.ravel().astype(np.uint32), a.astype(np.uint32), (b - a).astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(rows, pa.binary())], ["part", "blob"])

    return work


def unite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The maximal removed runs of each document: pairs of 32-bit numbers."""
    for _, blobs in by_key(batches, "part"):
        cols = [unpacked(b) for b in blobs]
        doc, name = (np.concatenate([c[k][c[2]] for c in cols]) for k in (0, 1))
        a = np.concatenate([c[3] for c in cols]).astype(np.int64)
        b = a + np.concatenate([c[4] for c in cols])
        order = np.lexsort((a, name, doc))
        doc, name, a, b = doc[order], name[order], a[order], b[order]
        other = np.ones(len(doc), bool)
        other[1:] = (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])
        far = np.cumsum(other) << 33  # documents apart on one axis, so that one running maximum does
        reach = np.maximum.accumulate(far + b)
        new = other.copy()
        new[1:] |= (far + a)[1:] > reach[:-1]
        start = np.flatnonzero(new)
        stop = reach[np.append(start[1:], len(doc)) - 1] - far[start]
        pairs = np.stack([a[start], stop], 1).astype("<i4")
        begins = np.flatnonzero(other[start])
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[start][begins]), pa.array(name[start][begins]), pa.array([p.tobytes() for p in np.split(pairs, begins[1:])], pa.binary())], ["__id", "__print", "__spans"]
        )


def whole_copies(docs: DataFrame) -> DataFrame:
    """(__text, __more, __size, __least): the hashes and length of each text that several rows have, and their smallest id; broadcast while they are few."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), *whole_text("__text", "__more", "__size"))
    found = cut(rows.groupBy("__text", "__more", "__size").agg(F.min("id").alias("__least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "copies")
    return checked_broadcast(found, found.count())


def whole_text(first: str, second: str, size: str) -> list[Column]:
    """What tells equal texts: two independent hashes and the length, of a null text as of an empty one."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias(first), F.xxhash64(F.lit(1), text).alias(second), F.octet_length(text).alias(size)]


def repeats(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """(__id, __print, __spans): the removed runs of each id and text (told by its 64-bit hash) that loses some.

    Texts that a smaller id has as a whole are left out; they lose all.
    """
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.select("*", *whole_text("t", "m", "s"))
    single = keyed.join(copies, [F.col(a) == F.col(b) for a, b in zip("tms", ("__text", "__more", "__size"), strict=True)], "left").where("__least is null or __least = doc_id")
    bytes_ = single.select("doc_id", F.col("text").cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-total // BUCKET_BYTES))
    width = max(parts, buckets // 8)
    routed = bytes_.mapInArrow(route(buckets), "bucket int, blob binary")
    found = routed.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(mark(width), "part int, blob binary")
    return cut(found.repartition(width, "part").sortWithinPartitions("part").mapInArrow(unite, "__id long, __print long, __spans binary"), "repeats")


def remove(docs: DataFrame) -> DataFrame:
    """(doc_id, text, whole, spans): texts as bytes with the runs that go, or whether they go as a whole."""
    copies = whole_copies(docs)
    spans = repeats(docs, copies)
    size = spans.agg(F.sum(F.octet_length("__spans") + 40).alias("n")).first()["n"] or 0
    side = F.broadcast(spans) if size <= BROADCAST_BYTES else spans
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.select("*", *whole_text("__key", "m", "s")).join(copies, [F.col(a) == F.col(b) for a, b in zip(("__key", "m", "s"), ("__text", "__more", "__size"), strict=True)], "left")
    marked = keyed.join(side, (F.col("doc_id") == F.col("__id")) & (F.col("__key") == F.col("__print")), "left")
    whole = (F.octet_length("text") >= LENGTH) & F.coalesce(F.col("__least") < F.col("doc_id"), F.lit(False))
    return marked.select("doc_id", F.col("text").cast("binary").alias("text"), whole.alias("whole"), F.col("__spans").alias("spans"))


def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, gone, runs, sha = [], [], [], []
        for text, whole, spans in zip(batch.column("text"), batch.column("whole").to_pylist(), batch.column("spans"), strict=True):
            raw = memoryview(text.as_buffer())
            pairs = np.array([[0, len(raw)]]) if whole else np.frombuffer(spans.as_py() or b"", "<i4").reshape(-1, 2)
            d, at = hashlib.sha256(), 0
            for a, b in pairs.tolist():
                d.update(raw[at:a])
                at = b
            d.update(raw[at:])
            size.append(len(raw))
            gone.append(int((pairs[:, 1] - pairs[:, 0]).sum()))
            runs.append(len(pairs))
            sha.append(d.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (size, gone, runs)], pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def report(docs: DataFrame) -> DataFrame:
    """The query's rows."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return remove(docs).mapInArrow(digest, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

"""Best-fit packing of tokenised documents, in bulk-synchronous rounds.

Documents become pieces of at most ``CAPACITY`` tokens.  The pieces are
range-sorted by length, so each has a rank among those of its length.  A round
sweeps lengths and gaps in order: pieces, longest first, take the smallest gap
that holds them (the successor), one piece a gap and round; pieces that contend
for gaps of one size are served by rank.  Then gaps shrink and the next round
begins; when nothing fits any more, sequences are opened for what is left.

Pieces of one length, and sequences with one gap, are interchangeable, so a sweep
runs over whole classes: a class is a run of ranks, a group of sequences a run of
numbers.  A round thus costs as much for a trillion pieces as for a thousand - at
most ``CAPACITY`` lengths against ``CAPACITY`` gaps on the driver - while cutting,
ranking and placing the pieces themselves is distributed.

Defined results
* a null or empty text is its end token alone; repeated rows are packed each;
* ties between equal lengths go by doc_id and piece; null ids sort first;
* a text longer than the capacity is cut, and its first piece takes the remainder;
* an empty table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

CAPACITY = 2048
END_ID = 0


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of whole texts, as packed little-endian 32-bit numbers.

    The tokenizer's file gives the vocabulary.  Where it splits texts at byte level
    by the usual pattern and its numbers are the ranks of the merges, the faster of
    the installed libraries encodes with them; a test holds the ids against those of
    ``tokenizers``, which encodes with any other file.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.plain = None
        if not plain_bytes(spec):
            import tokenizers

            self.plain = tokenizers.Tokenizer.from_file(path)
            return
        import public_tokenizers
        import tiktoken

        byte = byte_letters()
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in byte for c in token)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text in special:
            ranks.pop(text.encode(), None)
        self.encoding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.plain is not None:
            return [np.array(e.ids, "<u4").tobytes() for e in self.plain.encode_batch(texts, add_special_tokens=False)]
        return [self.encoding.encode_to_numpy(t, allowed_special="all").astype("<u4", copy=False).tobytes() for t in texts]


def plain_bytes(spec: dict) -> bool:
    """Whether a file's ids are those of byte pairs merged in the order of their numbers, split by the usual pattern."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
    usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if model["type"] != "BPE" or odd or not usual or spec.get("normalizer") or any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
        return False
    numbers = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    return all(a < b for a, b in zip(numbers, numbers[1:], strict=False)) and numbers[:1] != [-1]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: printable ones for themselves, others from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def cut_points(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    return ([(0, first)] if first else []) + [(at, capacity) for at in range(first, length, capacity)]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path or tokenizer_path())
        end = np.array([END_ID], "<u4").tobytes()
        for batch in slices(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encoder.encode([t or "" for t in batch.column("text").to_pylist()])):
                ids += end
                for k, (at, n) in enumerate(cut_points(len(ids) // 4, capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + n)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def rounds(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Place classes of lengths: runs (length, first rank, count, first sequence, offset).

    counts: pieces of each length.  Every rank of every length is in one run.
    """
    lengths = sorted((n for n, c in counts.items() if c), reverse=True)
    if lengths and not 1 <= lengths[-1] <= lengths[0] <= capacity:
        raise ValueError("lengths go from 1 to the capacity")
    left, done = {n: counts[n] for n in lengths}, dict.fromkeys(lengths, 0)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # size: runs (first sequence, count)
    order: list[int] = []  # the sizes of gaps, ascending
    runs, opened, fits = [], 0, False

    def add(size: int, first: int, count: int) -> None:
        if size:
            if not gaps[size]:
                insort(order, size)
            gaps[size].append((first, count))

    while lengths:
        if not fits:
            n = -(-sum(k * c for k, c in left.items()) // capacity)
            add(capacity, opened, n)
            opened += n
        shrunk, fits = [], False
        for n in lengths:
            at = bisect_left(order, n)
            while left[n] and at < len(order):
                size = order[at]
                first, count = gaps[size].pop()
                take = min(count, left[n])
                runs.append((n, done[n], take, first, capacity - size))
                shrunk.append((size - n, first, take))
                done[n] += take
                left[n] -= take
                if take < count:
                    gaps[size].append((first + take, count - take))
                elif not gaps[size]:
                    order.pop(at)
        lengths = [n for n in lengths if left[n]]
        left = {n: left[n] for n in lengths}
        for item in shrunk:
            add(*item)
        fits = bool(lengths and order and order[-1] >= lengths[-1])
    return runs


def place(ranged: list[tuple[int, int, int]], runs: list[tuple[int, int, int, int, int]]) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A function from (length, row number) to (sequence, offset).

    ranged: runs (length, first row number, count) of the sorted rows, in order.
    """
    part = np.array(ranged, np.int64).reshape(-1, 3)
    before = np.zeros(len(part), np.int64)  # ranks of the same length in earlier runs
    seen: dict[int, int] = defaultdict(int)
    for i, (n, _, count) in enumerate(ranged):
        before[i] = seen[n]
        seen[n] += count
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    starts = np.cumsum([0, *[c for _, c in sorted(seen.items())]])[:-1]
    base = dict(zip(sorted(seen), starts.tolist(), strict=True))  # ranks of all lengths on one axis
    axis = np.array([base[n] + r for n, r in table[:, :2].tolist()], np.int64)
    shift = before + np.array([base[n] for n in part[:, 0].tolist()], np.int64) - part[:, 1]

    def find(length: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(part[:, 1], at, "right") - 1
        rank = at + shift[i]
        j = np.searchsorted(axis, rank, "right") - 1
        assert (table[j, 0] == length).all()
        return table[j, 3] + rank - axis[j], table[j, 4]

    return find


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    cuts = cut(pieces(docs, path, capacity), "pack-pieces")
    keys = ["length", "doc_id", "piece", "ids_crc32"]
    width = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(cuts.repartitionByRange(width, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "pack-sorted")
    # in sorted parts a length is one run of rows: at most as many runs as parts and lengths together
    found = ranged.groupBy(F.shiftright("at", 33).alias("part"), "length").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    runs = sorted((r["first"], r["length"], r["n"]) for r in found)
    counts: dict[int, int] = defaultdict(int)
    for _, n, c in runs:
        counts[n] += c
    find = place([(n, first, c) for first, n, c in runs], rounds(counts, capacity))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *rest, length, at = [batch.column(c) for c in ("doc_id", "piece", "start", "ids_crc32", "length", "at")]
            sequence, offset = find(length.to_numpy(), at.to_numpy())
            yield pa.RecordBatch.from_arrays([*rest[:3], length, rest[3], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranged.mapInArrow(work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

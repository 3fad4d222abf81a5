"""Copies of pictures by local descriptors.

A media column is (media_id, width, height, pixels): grey pixels as bytes, row by
row.  Corners are found on several scales; around each, the direction of the
patch's centre of mass turns a fixed pattern of pixel pairs, and which pixel of a
pair is brighter gives a 128-bit descriptor.  Five pieces of 25 bits index a
descriptor; pictures of which two corners agree in a piece meet in an equality
join.  Of pictures that meet, all corners are compared: each pair of corners within
the distance votes for a change of scale, a rotation and a shift, and two pictures
with enough votes in one cell are linked.  Links become classes without being
collected, and dense groups are gathered around heads first (``gather``).

Equal pictures are one picture in all of this: they join their class at the end, so
copies never multiply.  Corners compete within a few pixels, so their number
follows the picture's area; there is no cap.

Defined results
* a null, empty or ill-sized picture, and one without a corner, has no feature and
  is equal only to pictures of the same size and bytes; a null is alone;
* repeated rows share their class; a class is named by its smallest media_id;
* rows without a media_id are left out;
* an empty table gives an empty result; other columns are neither read nor returned.
A picture is worked on whole, in about 60 bytes a pixel of one task's memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gather
from .common import cut
from .components import components

#: Each scale is smaller by this factor.
STEP = 2**0.5
SCALES = 4
#: Half the width of a patch, and of the square in which corners compete.
RADIUS, APART = 13, 4
#: A corner's response is at least this share of the picture's largest.
SHARE = 0.02
PIECES, PIECE_BITS = 5, 25
MAX_DISTANCE = 20
#: Matches that agree on scale, rotation and shift.
VOTES = 8
#: Cells of the vote: shift in pixels and as a share of the matches' spread, whichever is more; rotation in degrees.
SHIFT, SPREAD, TURN = 8.0, 0.04, 30.0
DESCRIPTOR_SEED = 10
#: A corner: its descriptor in two words, its place in the picture's pixels, its scale and angle.
CORNER = np.dtype([("a", "<u8"), ("b", "<u8"), ("x", "<f4"), ("y", "<f4"), ("scale", "<i4"), ("angle", "<f4")])


def pattern() -> np.ndarray:
    """128 pairs of points (dy, dx) within the patch, made by rule.

    The points of a pair lie side by side across the patch's direction, along
    which it grows brighter, so that either is as likely the brighter one.
    """
    rng = np.random.default_rng(DESCRIPTOR_SEED)
    reach = RADIUS * 0.7
    first, second = rng.uniform(-reach, reach, (128, 2)), rng.uniform(-reach, reach, 128)
    other = np.stack([second, first[:, 1] + rng.normal(0, 1, 128)], 1)
    return np.clip(np.stack([first, other], 1), -reach, reach)


def blurred(images: np.ndarray) -> np.ndarray:
    """Binomial smoothing of 5 pixels each way."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (2, 2)
        x = np.pad(images, pad, mode="edge")
        n = images.shape[axis]
        take = lambda k: np.take(x, range(k, k + n), axis)  # noqa: B023, E731
        images = (take(0) + take(4) + 4 * (take(1) + take(3)) + 6 * take(2)) / 16
    return images


def resized(images: np.ndarray, factor: float) -> np.ndarray:
    """Bilinear reduction."""
    n, h, w = images.shape
    hh, ww = int(h / factor), int(w / factor)
    y, x = np.arange(hh) * factor, np.arange(ww) * factor
    y0, x0 = np.minimum(y.astype(int), h - 2), np.minimum(x.astype(int), w - 2)
    fy, fx = (y - y0)[:, None].astype(np.float32), (x - x0)[None].astype(np.float32)
    rows = images[:, y0] * (1 - fy) + images[:, y0 + 1] * fy
    return rows[:, :, x0] * (1 - fx) + rows[:, :, x0 + 1] * fx


def corners(images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Picture, row and column of the local maxima of the smaller gradient energy's measure."""
    gy, gx = np.zeros_like(images), np.zeros_like(images)
    gy[:, 1:-1] = images[:, 2:] - images[:, :-2]
    gx[:, :, 1:-1] = images[:, :, 2:] - images[:, :, :-2]
    a, b, c = blurred(gx * gx), blurred(gx * gy), blurred(gy * gy)
    response = a * c - b * b - 0.05 * (a + c) ** 2
    inner = response[:, RADIUS:-RADIUS, RADIUS:-RADIUS]
    if not inner.size:
        return (np.zeros(0, int),) * 3
    best = response
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (APART, APART)
        x = np.pad(best, pad, mode="edge")
        n = response.shape[axis]
        best = np.max([np.take(x, range(k, k + n), axis) for k in range(2 * APART + 1)], 0)
    top = response.max((1, 2), keepdims=True)
    keep = (response >= best) & (response > np.maximum(SHARE * top, 1e-3))
    keep[:, :RADIUS] = keep[:, -RADIUS:] = False
    keep[:, :, :RADIUS] = keep[:, :, -RADIUS:] = False
    return np.nonzero(keep)


def described(images: np.ndarray, n: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angle and 128 bits (two longs) of the patch around each corner."""
    d = np.arange(-RADIUS, RADIUS + 1)
    round_ = d[:, None] ** 2 + d[None] ** 2 <= RADIUS**2
    dy, dx = (g[round_] for g in np.meshgrid(d, d, indexing="ij"))
    angle = np.empty(len(n))
    bits = np.empty((len(n), 2), np.int64)
    p = pattern()
    for at in range(0, len(n), 4096):
        s = slice(at, at + 4096)
        patch = images[n[s, None], y[s, None] + dy, x[s, None] + dx]
        angle[s] = t = np.arctan2((patch * dy).sum(1), (patch * dx).sum(1))
        cos, sin = np.cos(t)[:, None, None], np.sin(t)[:, None, None]
        py = np.rint(p[None, :, :, 0] * cos + p[None, :, :, 1] * sin).astype(int)
        px = np.rint(p[None, :, :, 1] * cos - p[None, :, :, 0] * sin).astype(int)
        v = images[n[s, None, None], y[s, None, None] + py, x[s, None, None] + px]
        bits[s] = np.packbits(v[:, :, 0] < v[:, :, 1], axis=1, bitorder="little").view("<i8")
    return angle, bits


def features(images: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of pictures of one size: picture, bits a and b, x, y in the picture's pixels, scale, angle."""
    out = []
    level, size = images.astype(np.float32), 1.0
    for scale in range(SCALES):
        if min(level.shape[1:]) < 2 * RADIUS + 3:
            break
        smooth = blurred(level)
        n, y, x = corners(smooth)
        angle, bits = described(smooth, n, y, x)
        out.append((n, bits[:, 0], bits[:, 1], x * size, y * size, np.full(len(n), scale), angle))
        level, size = resized(smooth, STEP), size * STEP
    if not out:
        return (np.zeros(0, np.int64),) * 7
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def extract(media: DataFrame) -> DataFrame:
    """(media_id, n, corners) of each picture that has a corner: their number, and CORNER records as bytes."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_size: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
            for m, w, h, p in zip(*(batch.column(c).to_pylist() for c in ("media_id", "width", "height", "pixels")), strict=True):
                if p and w and h and len(p) == w * h:
                    by_size.setdefault((h, w), []).append((m, p))
            for (h, w), group in by_size.items():
                step = max(1, 3_000_000 // (h * w))
                for at in range(0, len(group), step):
                    part = group[at : at + step]
                    n, *fields = features(np.frombuffer(b"".join(p for _, p in part), np.uint8).reshape(-1, h, w))
                    corner = np.empty(len(n), CORNER)
                    for name, values in zip(CORNER.names, fields, strict=True):
                        corner[name] = values.view(np.uint64) if name in "ab" else values
                    corner = corner[np.argsort(n, kind="stable")]
                    counts = np.bincount(n, minlength=len(part))
                    held = np.flatnonzero(counts)
                    blobs = [c.tobytes() for c in np.split(corner, np.cumsum(counts)[:-1])]
                    yield pa.RecordBatch.from_arrays([pa.array([part[k][0] for k in held], pa.int64()), pa.array(counts[held].astype(np.int64)), pa.array([blobs[k] for k in held], pa.binary())], ["media_id", "n", "corners"])

    return media.select("media_id", "width", "height", "pixels").mapInArrow(work, "media_id long, n long, corners binary")


def pieces(corner: np.ndarray) -> np.ndarray:
    """The five pieces of each descriptor, marked with their number: two of either word, and one of what is left of both."""
    a, b, mask = corner["a"], corner["b"], np.uint64((1 << PIECE_BITS) - 1)
    shifted = lambda word, n: word >> np.uint64(n)
    last = shifted(a, 2 * PIECE_BITS) | (shifted(b, 2 * PIECE_BITS) << np.uint64(64 - 2 * PIECE_BITS))
    parts = [a, shifted(a, PIECE_BITS), b, shifted(b, PIECE_BITS), last]
    return np.stack([(x & mask) + np.uint64(k << PIECE_BITS) for k, x in enumerate(parts)], 1).astype(np.int64)


def hamming_rows(found: DataFrame) -> DataFrame:
    """(key, node, a, b): a row for each piece of each corner."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, blob in zip(batch.column("media_id").to_pylist(), batch.column("corners").to_pylist(), strict=True):
                corner = np.frombuffer(blob, CORNER)
                keys = pieces(corner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(np.full(keys.size, m, np.int64)), *[pa.array(np.repeat(corner[c].astype(np.int64), PIECES)) for c in "ab"]],
                    ["key", "node", "a", "b"],
                )

    width = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.select("media_id", "corners").repartition(width).mapInArrow(work, "key long, node long, a long, b long")


def bucketed(found: DataFrame) -> DataFrame:
    """(key, node, a, b, weight): the pieces that several pictures share, but for chance meetings of two or three corners.

    Of two rows the smallest and the largest are all; of three the one between
    follows from these and the exclusive or of all.  Where no two of them are within
    the distance, the key says nothing.
    """
    row = F.struct("node", "a", "b")
    facts = {"least": F.min(row), "most": F.max(row), "xa": F.bit_xor("a"), "xb": F.bit_xor("b")}
    bits = lambda p, q: F.bit_count(p[0].bitwiseXOR(q[0])) + F.bit_count(p[1].bitwiseXOR(q[1]))
    low, high = ((F.col(f"{c}.a"), F.col(f"{c}.b")) for c in ("least", "most"))
    between = tuple(F.col(f"x{w}").bitwiseXOR(F.col(f"least.{w}")).bitwiseXOR(F.col(f"most.{w}")) for w in "ab")
    near = bits(low, high) <= MAX_DISTANCE
    three = near | (bits(low, between) <= MAX_DISTANCE) | (bits(high, between) <= MAX_DISTANCE)
    kept = F.when(F.col("n") == 2, near).when(F.col("n") == 3, three).otherwise(True)
    return gather.buckets(hamming_rows(found), "media-buckets", facts, kept)


def matched(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All corners i of one picture and j of another within MAX_DISTANCE bits."""
    step, found = max(1, (1 << 22) // max(1, len(q))), []
    for at in range(0, len(p), step):
        part = p[at : at + step]
        bits = np.bitwise_count(part["a"][:, None] ^ q["a"][None]) + np.bitwise_count(part["b"][:, None] ^ q["b"][None])
        i, j = np.nonzero(bits <= MAX_DISTANCE)
        found.append((i + at, j))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2


def agreeing(l: np.ndarray, r: np.ndarray, i: np.ndarray, j: np.ndarray) -> int:  # noqa: E741
    """Corners of either picture at least that agree on a change of scale, a rotation and a shift; l and r are matching corners, i and j their numbers.

    The shift is that of the middle of the matches, so noisy angles move it
    little, in cells that grow with the matches' spread.  A match votes for the
    two nearest cells of its rotation, for four of its shift, and for its change of
    scale and half a step to either side, each with the shift that it means.  A
    corner that matches many others counts once.
    """
    lx, ly, rx, ry = (c.astype(float) for c in (l["x"], l["y"], r["x"], r["y"]))
    cell = max(SHIFT, SPREAD * float(np.hypot(rx.std(), ry.std())))
    lx, ly, rx, ry = lx - lx.mean(), ly - ly.mean(), rx - rx.mean(), ry - ry.mean()
    turn = (r["angle"].astype(float) - l["angle"]) % (2 * np.pi)
    cos, sin = np.cos(turn), np.sin(turn)

    def cells(q: np.ndarray) -> list[np.ndarray]:
        """The cell of a value and the nearer neighbour."""
        low = np.floor(q)
        return [low.astype(np.int64), (low + np.where(q - low < 0.5, -1, 1)).astype(np.int64)]

    codes = []
    turns = [t % int(360 / TURN) for t in cells(np.degrees(turn) / TURN)]
    for s in (2 * (r["scale"] - l["scale"]).astype(np.int64) + d for d in (-1, 0, 1)):
        ratio = STEP ** (s / 2)
        across, down = cells((rx - ratio * (cos * lx - sin * ly)) / cell), cells((ry - ratio * (sin * lx + cos * ly)) / cell)
        codes += [(((s + 32) * 16 + t) << 48) + ((x + (1 << 23)) << 24) + (y + (1 << 23)) for t in turns for x in across for y in down]
    code, best = np.concatenate(codes), []
    for own in (i, j):
        held = np.stack([code, np.tile(own, len(codes))], 1)
        best.append(np.unique(np.unique(held, axis=0)[:, 0], return_counts=True)[1])
    return int(np.minimum(*best).max())


def votes(p: np.ndarray, q: np.ndarray) -> int:
    """Agreeing corners of two pictures."""
    i, j = matched(p, q)
    return agreeing(p[i], q[j], i, j) if len(i) >= VOTES else 0


def verified(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of pictures of whose corners enough agree; all corners of both are compared."""
    side = lambda c: found.select(F.col("media_id").alias(c), F.col("corners").alias(f"corners_{c}"))
    both = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(side("a"), "a").join(side("b"), "b")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = (batch.column(c).to_pylist() for c in ("corners_a", "corners_b"))
            near = [votes(np.frombuffer(x, CORNER), np.frombuffer(y, CORNER)) >= VOTES for x, y in zip(*sides, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    return both.select("a", "b", "corners_a", "corners_b").mapInArrow(work, "a long, b long")


def first_piece(x: Column, y: Column, key: Column) -> Column:
    """True in the first of the pieces in which two descriptors with differences x and y agree."""
    mask, piece, first = F.lit((1 << PIECE_BITS) - 1), F.shiftright(key, PIECE_BITS), F.lit(True)
    for k, word in enumerate((x, F.shiftrightunsigned(x, PIECE_BITS), y, F.shiftrightunsigned(y, PIECE_BITS))):
        first = first & ((piece <= k) | (word.bitwiseAND(mask) != 0))
    return first


def rest_pairs(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): all pictures in different classes of which two corners share a piece within MAX_DISTANCE bits.

    Two corners that agree in several pieces meet in the first of these only; near
    as they are, none of their keys has been left out as a chance meeting.
    """
    state = cut(gather.rooted(met.drop("weight"), roots), "media-rooted")
    rows = cut(state.join(gather.mixed(state), "key", "left_semi"), "media-rest")
    x, y = (F.col(f"l.{c}").bitwiseXOR(F.col(f"r.{c}")) for c in "ab")
    near = (F.col("l.root") < F.col("r.root")) & (F.bit_count(x) + F.bit_count(y) <= MAX_DISTANCE) & first_piece(x, y, F.col("l.key"))
    pair = rows.alias("l").join(rows.alias("r"), F.col("l.key") == F.col("r.key")).where(near)
    return pair.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()


def picture_classes(found: DataFrame) -> DataFrame:
    """(node, root) of the pictures that are linked.

    First each picture meets one head of its buckets a round, which gathers dense
    groups; then all pairs that share a piece and are not in one class yet, so no
    two classes stay apart that a link joins.
    """
    met = bucketed(found)
    check = lambda pairs: verified(pairs, found)
    linked, roots = gather.gathered(met, check, "media-heads", least=2)
    across = cut(check(cut(rest_pairs(met, roots), "media-rest-pairs")), "media-across")
    return components(linked.unionByName(across))


def copies(media: DataFrame) -> DataFrame:
    """(media_id, class_id, class_size, n_features) of every picture; a class counts its rows."""
    media = media.where(F.col("media_id").isNotNull())
    rows = cut(media.select(F.col("media_id").cast("long").alias("media_id"), "width", "height", F.xxhash64("pixels").alias("p"), F.crc32(F.coalesce("pixels", F.lit(b""))).alias("c"), F.col("pixels").isNull().alias("none")), "media-rows")
    same = ["width", "height", "p", "c", "none"]
    # nulls are no pictures, so each stands for itself
    key = F.xxhash64(*same, F.when(F.col("none"), F.col("media_id")))
    named = rows.withColumn("picture", key)
    firsts = cut(named.groupBy("picture").agg(F.min("media_id").alias("first")), "media-pictures")
    chosen = media.select(F.col("media_id").cast("long").alias("media_id"), "width", "height", "pixels").join(firsts.select(F.col("first").alias("media_id")), "media_id", "left_semi").dropDuplicates(["media_id"])
    found = cut(extract(chosen), "media-features")
    roots = picture_classes(found)
    size = found.select(F.col("media_id").alias("first"), F.col("n").alias("f"))
    pictures = firsts.join(roots.withColumnRenamed("node", "first"), "first", "left").join(size, "first", "left")
    out = cut(named.join(pictures, "picture").select("media_id", F.coalesce("root", "first").alias("class_id"), F.coalesce("f", F.lit(0)).cast("long").alias("n_features")), "media-classes")
    members = out.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    return out.join(members, "class_id").select("media_id", "class_id", "class_size", "n_features")


#: Side of a drawn picture, and the components whose textures are made at once.
SIDE, BLOCK = 64, 256


def textures(block: int) -> np.ndarray:
    """A fixed texture for each component of a block: smooth noise, made by rule."""
    rng = np.random.default_rng([DESCRIPTOR_SEED, block])
    return blurred(rng.normal(0, 1, (BLOCK, SIDE, SIDE)).astype(np.float32)).reshape(BLOCK, -1)


def drawn(vectors: DataFrame) -> DataFrame:
    """Vectors as pictures, since no table holds any: textures weighed by the components, greys from darkest to brightest.

    Equal vectors give equal pictures, and near ones near pictures.  Nulls and
    non-finite components count as 0; a null vector, an empty one and one of zeros has no picture.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base: dict[int, np.ndarray] = {}
        for batch in batches:
            pixels: list[bytes | None] = []
            for v in batch.column("embedding").to_pylist():
                v = np.nan_to_num(np.array([0.0 if c is None else c for c in v or []], np.float32), posinf=0, neginf=0)
                picture = np.zeros(SIDE * SIDE, np.float32)
                for at in range(0, len(v), BLOCK):
                    k = at // BLOCK
                    if k not in base:
                        base = (base if len(base) < 16 else {}) | {k: textures(k)}
                    part = v[at : at + BLOCK]
                    picture += part @ base[k][: len(part)]
                low, high = picture.min(), picture.max()
                pixels.append(np.rint((picture - low) / (high - low) * 255).astype(np.uint8).tobytes() if high > low else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *[pa.array(np.full(len(pixels), SIDE, np.int32))] * 2, pa.array(pixels, pa.binary())], ["media_id", "width", "height", "pixels"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(work, "media_id long, width int, height int, pixels binary")


def report(vectors: DataFrame) -> DataFrame:
    """The query's rows: copies among the pictures drawn of all vectors."""
    return copies(cut(drawn(vectors), "media"))

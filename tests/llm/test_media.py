import numpy as np

from corrobora.llm import media
from corrobora.llm.queries import QUERIES

SCHEMA = "media_id long, width int, height int, pixels binary"


def picture(seed, h=150, w=180):
    """Rectangles and discs of random greys."""
    rng = np.random.default_rng(seed)
    img = np.full((h, w), rng.integers(0, 255), float)
    yy, xx = np.mgrid[:h, :w]
    for _ in range(45):
        y, x, s = rng.integers(0, h), rng.integers(0, w), rng.integers(6, 40)
        shape = (abs(yy - y) < s / 2) & (abs(xx - x) < s * rng.uniform(0.2, 1)) if rng.random() < 0.7 else (yy - y) ** 2 + (xx - x) ** 2 < (s / 2) ** 2
        img[shape] = rng.integers(0, 255)
    return img


def turned(img):
    return np.rot90(img).copy()


def edits(img):
    rng = np.random.default_rng(99)
    small = media.resized(media.blurred(img[None].astype(np.float32)), 2**0.5)[0]
    return {
        "crop": img[20:140, 30:170],
        "bright": np.clip(img * 0.7 + 30, 0, 255),
        "noise": np.clip(img + rng.normal(0, 4, img.shape), 0, 255),
        "turned": turned(img),
        "small": small,
        "stamped": np.where((np.mgrid[: img.shape[0], : img.shape[1]][0] < 25), 0, img),
    }


def row(i, img):
    img = np.rint(img).astype(np.uint8)
    return (i, img.shape[1], img.shape[0], img.tobytes())


def test_edited_copies_are_found_and_others_left_alone(spark):
    rows, want = [], {}
    for k in range(12):
        img = picture(k)
        base = 100 * k
        rows.append(row(base, img))
        want[base] = base
        if k < 4:
            for j, (_, e) in enumerate(edits(img).items(), 1):
                rows.append(row(base + j, e))
                want[base + j] = base
    got = {r["media_id"]: r for r in media.copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    wrong = {i: got[i]["class_id"] for i in want if got[i]["class_id"] // 100 * 100 != want[i]}
    missed = [i for i in want if got[i]["class_id"] != want[i]]
    assert not wrong and len(missed) <= 2, (wrong, missed)
    assert all(got[100 * k]["class_size"] == 1 for k in range(4, 12)) and got[0]["n_features"] > 20


def test_equal_and_odd_pictures(spark):
    img = row(5, picture(1))
    rows = [img, (3, *img[1:]), (3, *img[1:]), (7, *img[1:]), (8, None, None, None), (9, None, None, None), (10, 4, 4, b""), (11, 4, 4, b"123"), (12, 40, 40, bytes(1600)), (13, 40, 40, bytes(1600)), (14, 2, 2, b"abcd")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as key", "2 as root", "3 as a")
    got = sorted((r["media_id"], r["class_id"], r["class_size"]) for r in media.copies(df).collect())
    assert got == [(3, 3, 4), (3, 3, 4), (5, 3, 4), (7, 3, 4), (8, 8, 1), (9, 9, 1), (10, 10, 1), (11, 11, 1), (12, 12, 2), (13, 12, 2), (14, 14, 1)]
    assert media.copies(df.limit(0)).count() == 0


def corner_sets(pics):
    out = []
    for p in pics:
        _, *fields = media.features(np.rint(p).astype(np.uint8)[None])
        held = np.empty(len(fields[0]), media.CORNER)
        for name, values in zip(media.CORNER.names, fields):
            held[name] = values.view(np.uint64) if name in "ab" else values
        out.append(held)
    return out


def test_matched_corners_are_all_within_the_distance():
    p, q = corner_sets([picture(0, 90, 90), np.clip(picture(0, 90, 90) * 0.8 + 9, 0, 255)])
    want = {(i, j) for i in range(len(p)) for j in range(len(q)) if sum(int(p[c][i] ^ q[c][j]).bit_count() for c in "ab") <= media.MAX_DISTANCE}
    assert set(zip(*(x.tolist() for x in media.matched(p, q)))) == want and len(want) > 5
    corner = p[:1].copy()
    corner["a"], corner["b"] = 0x123456789ABCDEF0, 0x0FEDCBA987654321
    whole = 0x123456789ABCDEF0 + (0x0FEDCBA987654321 << 64)
    mask = (1 << 25) - 1
    first = [whole & mask, whole >> 25 & mask, whole >> 64 & mask, whole >> 89 & mask]
    last = (whole >> 50 & (1 << 14) - 1) | (whole >> 114 << 14 & mask)
    assert [int(k) & mask for k in media.pieces(corner)[0]] == [*first, last] and [int(k) >> 25 for k in media.pieces(corner)[0]] == [0, 1, 2, 3, 4]


def test_classes_against_brute_force(spark):
    """All pairs of pictures, compared without an index: the share of links whose pictures meet in it, and the classes."""
    pics = []
    for k in range(10):
        img = picture(k)
        pics += [img, *edits(img).values()]
    sets = corner_sets(pics)
    links = {(i, j) for i in range(len(pics)) for j in range(i + 1, len(pics)) if media.votes(sets[i], sets[j]) >= media.VOTES}
    found = media.extract(spark.createDataFrame([row(i, p) for i, p in enumerate(pics)], SCHEMA)).cache()
    assert {r["media_id"]: r["corners"] for r in found.collect()} == {i: s.tobytes() for i, s in enumerate(sets) if len(s)}
    met = media.bucketed(found)
    every = media.gather.buckets(media.hamming_rows(found), "test")
    none = spark.createDataFrame([], "node long, root long")  # all are apart
    pairs = {(r["a"], r["b"]) for r in media.rest_pairs(met, none).collect()}
    assert pairs == {(r["a"], r["b"]) for r in media.rest_pairs(every, none).collect()} and met.count() < every.count()
    assert len(links) > 80 and len(links & pairs) >= 0.97 * len(links)
    root = list(range(len(pics)))
    for i, j in sorted(links):
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    got = {r["media_id"]: r["class_id"] for r in media.copies(spark.createDataFrame([row(i, p) for i, p in enumerate(pics)], SCHEMA)).collect()}
    assert got == dict(enumerate(root))


def test_pictures_of_long_vectors_depend_on_all_components(spark):
    one = [0.5] * 300
    rows = [(1, one), (2, one[:-1] + [9.0]), (3, one), (4, None), (5, []), (6, [0.0] * 700)]
    got = {r["media_id"]: r["pixels"] for r in media.drawn(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got[1] == got[3] != got[2] and got[4] is got[5] is got[6] is None


def warped(img, degrees=0.0, factor=1.0):
    """Turned about the centre and resized, by bilinear sampling of a smoothed picture."""
    if factor < 1:
        img = media.blurred(img[None].astype(np.float32))[0]
    h, w = img.shape
    hh, ww = round(h * factor), round(w * factor)
    t = np.radians(degrees)
    yy, xx = np.mgrid[:hh, :ww]
    y, x = (yy - hh / 2) / factor, (xx - ww / 2) / factor
    sy, sx = np.cos(t) * y - np.sin(t) * x + h / 2, np.sin(t) * y + np.cos(t) * x + w / 2
    inside = (sy >= 0) & (sx >= 0) & (sy <= h - 1) & (sx <= w - 1)
    sy, sx = np.clip(sy, 0, h - 1.001), np.clip(sx, 0, w - 1.001)
    y0, x0 = sy.astype(int), sx.astype(int)
    fy, fx = sy - y0, sx - x0
    out = (img[y0, x0] * (1 - fx) + img[y0, x0 + 1] * fx) * (1 - fy) + (img[y0 + 1, x0] * (1 - fx) + img[y0 + 1, x0 + 1] * fx) * fy
    return np.where(inside, out, 0)


def vote_sets():
    """True corners of a picture of 1000 pixels and of a turned or reduced copy, with noisy angles."""
    rng = np.random.default_rng(3)
    out = []
    for k, (degrees, factor) in enumerate([(15, 1.0), (45, 1.0), (75, 1.0), (0, 0.6), (15, 0.6)]):
        x, y, angle = rng.uniform(0, 1000, 16), rng.uniform(0, 1000, 16), rng.uniform(-np.pi, np.pi, 16)
        t = np.radians(degrees)
        rx = 500 + factor * (np.cos(t) * (x - 500) - np.sin(t) * (y - 500)) + rng.normal(0, 1, 16)
        ry = 500 + factor * (np.sin(t) * (x - 500) + np.cos(t) * (y - 500)) + rng.normal(0, 1, 16)
        step = np.where(rng.random(16) < 0.5, 1, 2) if factor < 1 else np.zeros(16, int)
        for i in range(16):
            left = (2 * k, float(x[i]), float(y[i]), int(step[i]), float(angle[i]))
            right = (2 * k + 1, float(rx[i]), float(ry[i]), 0, float(angle[i] + t + rng.normal(0, np.radians(2))))
            out.append((left, right))
    return out


def test_votes_of_turned_and_reduced_pictures_agree():
    pairs = vote_sets()
    for k in range(5):
        sides = []
        for side in zip(*[p for p in pairs if p[0][0] == 2 * k]):
            held = np.zeros(16, media.CORNER)
            for c, values in zip(("x", "y", "scale", "angle"), list(zip(*side))[1:]):
                held[c] = values
            sides.append(held)
        at = np.arange(16)
        assert media.agreeing(*sides, at, at) >= media.VOTES, k


def test_turned_and_reduced_copies_of_large_pictures_are_found(spark):
    def scene(seed):
        rng, img = np.random.default_rng(seed), np.full((1000, 1000), 90.0)
        yy, xx = np.mgrid[:1000, :1000]
        for _ in range(150):
            y, x, s = rng.integers(0, 1000), rng.integers(0, 1000), rng.integers(20, 120)
            img[(abs(yy - y) < s / 2) & (abs(xx - x) < s * rng.uniform(0.2, 1))] = rng.integers(0, 255)
        grain = media.blurred(media.blurred(rng.normal(0, 1, (1, 1000, 1000))))[0]
        return np.clip(img * 0.5 + 60 + 120 * grain, 0, 255)

    rows = []
    for k in range(2):
        img = scene(k)
        rows += [row(10 * k + j, e) for j, e in enumerate([img, warped(img, 15), warped(img, 45), warped(img, 0, 0.6)])]
    got = {r["media_id"]: r["class_id"] for r in media.copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {10 * k + j: 10 * k for k in range(2) for j in range(4)}, got


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op10_media_copies"](spark, sf).collect()
    vectors = {r["vec_id"]: tuple(r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    assert sorted(r["media_id"] for r in got) == sorted(vectors)
    assert all(r["class_id"] <= r["media_id"] for r in got) and np.mean([r["n_features"] for r in got]) > 5


def test_corners_meet_in_the_first_piece_they_share(spark):
    """Over the pieces of near descriptors: one meeting a pair that shares any, whatever the number shared."""
    rng = np.random.default_rng(4)
    rows, shared = [], []
    for pair in range(200):
        corner = np.zeros(2, media.CORNER)
        corner["a"], corner["b"] = rng.integers(0, 1 << 63, dtype=np.uint64), rng.integers(0, 1 << 63, dtype=np.uint64)
        for bit in rng.choice(128, int(rng.integers(0, 15)), replace=False).tolist():
            corner["ab"[bit >> 6]][1] ^= np.uint64(1 << (bit & 63))
        keys = media.pieces(corner)
        x, y = (int(corner[c].astype(np.int64)[0] ^ corner[c].astype(np.int64)[1]) for c in "ab")
        rows += [(pair, int(k), x, y) for k in keys[0][keys[0] == keys[1]]]
        shared.append(int((keys[0] == keys[1]).sum()))
    df = spark.createDataFrame(rows, "pair int, key long, x long, y long")
    got = [r["pair"] for r in df.where(media.first_piece(df["x"], df["y"], df["key"])).collect()]
    assert max(shared) > 1 and min(shared) < 5 and sorted(got) == [p for p, n in enumerate(shared) if n]

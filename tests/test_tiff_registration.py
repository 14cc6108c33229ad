"""TIFF against hand-made files and round trips; registration of planes moved by a known map."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.operators import features, planes, registration
from pixelweave.sources import codecs, readers, tiff


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("tile", [None, 16])
@pytest.mark.parametrize("compressed", [False, True])
def test_round_trip(order, big, tile, compressed):
    rng = np.random.default_rng(2)
    pages = [rng.integers(0, 255, (70, 37, 3)).astype(np.uint8), rng.integers(0, 60000, (5, 1, 1)).astype(np.uint16), rng.normal(size=(16, 33, 2)).astype(np.float32), rng.integers(-9, 9, (1, 1, 1)).astype(np.int16)]
    data = tiff.write_tiff(pages, tile, compressed, order, big)
    assert codecs.sniff(data[:64]) == "tiff"
    for number, page in enumerate(pages):
        got = list(tiff.read_tiff(data, [number]))
        assert [(p.page, p.channel, p.width, p.height, p.depth) for p in got] == [(number, c, page.shape[1], page.shape[0], page.dtype.itemsize * 8) for c in range(page.shape[2])]
        assert all(np.allclose(p.pixels, page[:, :, p.channel].ravel()) for p in got)
    assert len(list(tiff.read_tiff(data))) == 7


def made(order, tags, strips):
    """A file by hand: the strips, then one directory."""
    out = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)
    at = []
    for s in strips:
        at.append(len(out))
        out += s
    out += b"\0" * (len(out) % 2)
    tags = {**tags, tiff.STRIPS: (4, at), tiff.STRIP_BYTES: (4, [len(s) for s in strips])}
    later = len(out) + 2 + 12 * len(tags) + 4
    body, extra = b"", b""
    for tag, (kind, values) in sorted(tags.items()):
        raw = struct.pack(f"{order}{len(values)}{tiff.CODES[kind]}", *values)
        if len(raw) > 4:
            raw, extra = struct.pack(order + "I", later + len(extra)), extra + raw
        body += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    return out[:4] + struct.pack(order + "I", len(out)) + out[8:] + struct.pack(order + "H", len(tags)) + body + struct.pack(order + "I", 0) + extra


def test_goldens():
    size = {tiff.WIDTH: (3, [4]), tiff.HEIGHT: (3, [2]), tiff.ROWS: (3, [1])}
    eight = size | {tiff.BITS: (3, [8]), tiff.PHOTOMETRIC: (3, [1])}
    first = lambda data: next(tiff.read_tiff(data)).pixels.tolist()
    assert first(made(">", eight, [bytes([1, 2, 3, 4]), bytes([5, 6, 7, 8])])) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert first(made("<", eight | {tiff.COMPRESSION: (3, [tiff.PACKBITS])}, [bytes([0xFD, 9]), bytes([1, 5, 6, 0xFF, 7])])) == [9, 9, 9, 9, 5, 6, 7, 7]
    codes = "".join(f"{c:09b}" for c in (256, 7, 258, 7, 257))  # 7, 7 7, 7
    lzw = int(codes.ljust(48, "0"), 2).to_bytes(6, "big")
    assert first(made("<", eight | {tiff.COMPRESSION: (3, [tiff.LZW])}, [lzw, lzw])) == [7] * 8
    assert first(made("<", eight | {tiff.PREDICTOR: (3, [2])}, [bytes([250, 10, 1, 1]), bytes([1, 1, 1, 1])])) == [250, 4, 5, 6, 1, 2, 3, 4]
    assert first(made("<", size | {tiff.BITS: (3, [1]), tiff.PHOTOMETRIC: (3, [0])}, [b"\xa0", b"\x50"])) == [0, 1, 0, 1, 1, 0, 1, 0]
    assert first(made(">", size | {tiff.BITS: (3, [12]), tiff.PHOTOMETRIC: (3, [1])}, [bytes.fromhex("abcdef001002"), bytes(6)])) == [0xABC, 0xDEF, 1, 2, 0, 0, 0, 0]
    palette = [0, 10, 20, 30] + [0] * 252 + [1] * 256 + [2] * 256
    got = list(tiff.read_tiff(made("<", eight | {tiff.PHOTOMETRIC: (3, [3]), tiff.PALETTE: (3, palette)}, [bytes([0, 1, 2, 3])] * 2)))
    assert [p.pixels[:4].tolist() for p in got] == [[0, 10, 20, 30], [1] * 4, [2] * 4]
    planar = size | {tiff.BITS: (3, [8, 8]), tiff.SAMPLES: (3, [2]), tiff.PLANAR: (3, [2])}
    assert [p.pixels[0] for p in tiff.read_tiff(made("<", planar, [bytes([k] * 4) for k in range(4)]))] == [0, 2]


def test_lzw_of_many_codes():
    """Widths of 9 to 12 bits, against an encoder of the same rules."""
    data = bytes(np.random.default_rng(6).integers(0, 9, 9000).astype(np.uint8))
    table, width, bits, w = {bytes([i]): i for i in range(256)}, 9, f"{256:09b}", b""
    n = 258
    for b in data:
        if w + bytes([b]) in table:
            w += bytes([b])
            continue
        bits += f"{table[w]:0{width}b}"
        table[w + bytes([b])] = n
        n += 1
        w = bytes([b])
        if n == 4094:
            bits += f"{256:012b}"
            table, n, width = {bytes([i]): i for i in range(256)}, 258, 9
        else:
            width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    bits += f"{table[w]:0{width}b}" + f"{257:0{width}b}"
    packed = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.unpack_lzw(packed) == data


def test_readers(spark, tmp_path):
    page = np.arange(48, dtype=np.uint8).reshape(6, 8, 1)
    (tmp_path / "a.tif").write_bytes(tiff.write_tiff([page, page + 1, page + 2], 16))
    (tmp_path / "bad.tif").write_bytes(b"II*\0" + bytes(3))
    (tmp_path / "cut.tif").write_bytes(tiff.write_tiff([page])[:-30])
    one = readers.read_images(spark, str(tmp_path), glob="a.tif", pages=[1]).collect()
    assert [(r.page, r.width, r.height) for r in one] == [(1, 8, 6)] and one[0].pixels == (page + 1).ravel().tolist()
    assert {r.path[-7:] for r in readers.bad_images(spark, str(tmp_path)).collect()} >= {"bad.tif"}
    table = readers.tiff_pages(spark, str(tmp_path), "a.tif").orderBy("page").collect()
    assert [(r.page, r.level, r.width, r.channels, r.depth) for r in table] == [(k, 0, 8, 1, 8) for k in range(3)]
    planes = readers.read_images(spark, str(tmp_path), glob="a.tif").withColumn("image_id", F.lit(4).cast("long"))
    content = readers.tiff_files(planes).first().content
    assert [p.pixels.tolist() for p in tiff.read_tiff(bytes(content))] == [(page + k).ravel().tolist() for k in range(3)]


def blobs(h, w, seed, move):
    """Smooth spots, as if seen through the map move: (y, x) of the spots are mapped forward."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    g = np.zeros((h, w))
    for _ in range(130):
        cx, cy, a, s = rng.uniform(4, w - 4), rng.uniform(4, h - 4), rng.uniform(2, 9), rng.uniform(1.2, 2.2)
        u, v = move(cx, cy)
        g += a * np.exp(-((x - u) ** 2 + (y - v) ** 2) / (2 * s * s))
    return g


@pytest.mark.parametrize("moved", [(1.0, 0.0, 3.0, 0.0, 1.0, -2.0), (0.995, 0.03, 1.5, -0.03, 0.995, 2.0)])
def test_registration_recovers_a_known_map(spark, moved):
    w, h = 120, 110
    move = lambda x, y: (moved[0] * x + moved[1] * y + moved[2], moved[3] * x + moved[4] * y + moved[5])
    rows = [[(k, blobs(h, w, k, m).ravel().tolist()) for k in range(2)] for m in (lambda x, y: (x, y), move)]
    left, right = (spark.createDataFrame(r, "pair_id long, pixels array<double>") for r in rows)
    points = np.array([(x, y) for x in (25, 60, 95) for y in (25, 55, 85)])
    for r in registration.register(left, right, w, h, n=64, wind=4).collect():
        p = r.params
        got = np.array([(p[0] * x + p[1] * y + p[2], p[3] * x + p[4] * y + p[5]) for x, y in points])
        assert np.abs(got - np.array([move(x, y) for x, y in points])).max() < 1.5, (r, got)
        assert r.fit < registration.score(np.array(rows[0][r.pair_id][1]).reshape(h, w), np.array(rows[1][r.pair_id][1]).reshape(h, w), np.array([1, 0, 0, 0, 1, 0.0]))[0]


def test_fits_of_every_kind(spark):
    rows = [(1, float(x), float(y), x + 2.0, y - 1.0) for x in range(4) for y in range(4)] + [(2, 0.0, 0.0, 5.0, 5.0)]
    points = spark.createDataFrame(rows, "pair_id long, x1 double, y1 double, x2 double, y2 double")
    for kind in ("translation", "st", "rst", "affine"):
        got = {r.pair_id: r.params for r in registration.gated_fit(points, kind).collect()}
        assert np.allclose(got[1], [1, 0, 2, 0, 1, -1], atol=1e-6)
        assert (2 in got) == (kind == "translation")


def test_registration_in_one_join_agrees_with_the_frames(spark):
    """Corners, matches and fits of pairs in numpy are those of the operators on DataFrames, and the planes meet once."""
    rng = np.random.default_rng(8)
    w, h, n, wind = 13, 11, 9, 2
    flat = [np.zeros(w * h), np.arange(float(w * h))]
    sides = [[(k, rng.normal(size=w * h).round(1).tolist()) for k in range(12)] + [(20 + k, x.tolist()) for k, x in enumerate(flat)] + [(30, None)] for _ in range(2)]
    left, right = (spark.createDataFrame(r, "pair_id long, pixels array<double>") for r in sides)
    stacks = [np.moveaxis(np.array([p for _, p in r[:-1]]).reshape(-1, h, w), 0, 2) for r in sides]
    ids = [k for k, _ in sides[0][:-1]]
    at = []
    for side in (left, right):
        im = side.select(F.col("pair_id").alias("image_id"), "pixels", F.lit(w).alias("width"), F.lit(h).alias("height")).where("pixels is not null")
        long = planes.mapped(im, planes.structure).select("image_id", F.posexplode("pixels").alias("k", "v")).select("image_id", F.floor(F.col("k") / w).cast("int").alias("y"), (F.col("k") % w).alias("x"), "v")
        best = features.grid_maxima(long, w, h, n).where("v > 0").select("image_id", (F.col("cy") * 4096 + F.col("cx")).cast("int").alias("idx"), "y", "x")
        f = features.patches(im, best, w, h, wind)
        at.append((best, f.select(F.col("image_id").alias("pair_id"), "idx", F.slice("f", 1, (2 * wind + 1) ** 2).alias("f"))))
    for (best, _), g in zip(at, stacks, strict=True):
        plane, y, x = registration.corners(g, n)
        assert sorted((r.image_id, r.y, r.x) for r in best.collect()) == sorted((ids[k], i, j) for k, i, j in zip(plane, y, x, strict=True))
    found = features.matches(features.distances(at[0][1], at[1][1], ["pair_id"]), ["pair_id"], n)
    for name, (best, _) in zip("lr", at, strict=True):
        found = found.join(best.select(F.col("image_id").alias("pair_id"), F.col("idx").alias(name), F.struct("x", "y").alias(f"at_{name}")), ["pair_id", name])
    points = found.select("pair_id", *(F.col(f"at_{s}.{c}").cast("double").alias(f"{c}{i}") for i, s in ((1, "l"), (2, "r")) for c in "xy")).cache()
    own = {k: registration.tie_points(a, b, n) for k, a, b in zip(ids, *(registration.described(g, n, wind) for g in stacks), strict=True)}
    assert sorted(map(tuple, points.collect())) == sorted((k, *p) for k, v in own.items() for p in v.tolist()) and len(own[20]) == 0
    for kind in ("translation", "st", "rst", "affine"):
        want = {r.pair_id: r for r in registration.gated_fit(points, kind).collect()}
        got = {k: registration.gated(v, kind) for k, v in own.items() if len(v)}
        assert set(want) == {k for k, x in got.items() if x}
        assert all(got[k][0] == r.n_points and np.allclose(got[k][1], r.params, atol=1e-6) for k, r in want.items())
    out = registration.register(left, right, w, h, n, wind)
    assert {r.pair_id for r in out.collect()} == {k for k, v in own.items() if len(v) > 1}
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") <= 2


def test_patch_by_definition():
    """The patch against loops over its places."""
    g, y, x, wind = np.random.default_rng(5).normal(size=(13, 11)), 6, 5, 2
    at = lambda i, j: g[min(max(i, 0), 12), min(max(j, 0), 10)]
    wx = wy = 0.0
    for k in range(1, wind + 1):
        trim = k - wind // 2 if k > 1 else 0
        for t in range(-wind + trim, wind - trim + 1):
            wx += k * (at(y + k, x + t) - at(y - k, x + t))
            wy += k * (at(y + t, x + k) - at(y + t, x - k))
    size = np.hypot(wx, wy)
    c, s = wx / size, wy / size
    want = []
    for i in range(-wind, wind + 1):
        for j in range(-wind, wind + 1):
            a, b = c * i - s * j, s * i + c * j
            fa, fb = int(np.floor(a)), int(np.floor(b))
            da, db = a - fa, b - fb
            yy, xx = y + fa, x + fb
            want.append((1 - da) * ((1 - db) * g[yy, xx] + db * g[yy, xx + 1]) + da * ((1 - db) * g[yy + 1, xx] + db * g[yy + 1, xx + 1]))
    want = np.array(want)
    got = features.patch(g, y, x, wind)
    assert np.allclose(got[:-2], (want - want.mean()) / want.std(ddof=1), atol=1e-6) and np.allclose(got[-2:], (c, s))

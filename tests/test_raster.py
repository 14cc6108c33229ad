import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.operators import features, raster, series, tiles, transforms


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def arr(*values):
    return F.array(*(F.lit(float(v)) for v in values))


SIX = (1, 2, 3, 4, 5, 6)  # [[1,2,3],[4,5,6]]


@pytest.mark.parametrize(
    ("f", "expected"),
    [
        (raster.rotate_right, [4, 1, 5, 2, 6, 3]),
        (raster.rotate_left, [3, 6, 2, 5, 1, 4]),
        (raster.flip, [4, 5, 6, 1, 2, 3]),
        (raster.mirror, [3, 2, 1, 6, 5, 4]),
    ],
)
def test_moves(spark, f, expected):
    assert one(spark, f(arr(*SIX), 3, 2)) == expected


def test_moves_undo(spark):
    p = arr(*SIX)
    assert one(spark, raster.rotate_left(raster.rotate_right(p, 3, 2), 2, 3)) == list(SIX)
    assert one(spark, raster.flip(raster.flip(p, 3, 2), 3, 2)) == list(SIX)
    planes = raster.interleave(arr(1, 2), arr(3, 4))
    assert one(spark, planes) == [1, 3, 2, 4]
    assert one(spark, raster.deinterleave(planes, 1, 2)) == [3, 4]


def test_smooth_golden(spark):
    assert one(spark, raster.smooth(arr(*range(1, 10)), 3, 3)) == [3, 2.75, 4, 4.25, 5, 5.75, 6, 7.25, 7]
    assert one(spark, raster.smooth(arr(7), 1, 1)) == [7]


def test_crop_and_statistics(spark):
    assert one(spark, raster.crop(arr(*SIX), 3, 2, 1, 0, 9, 1)) == [2, 3]
    assert one(spark, raster.crop(arr(*SIX), 3, 2, 3, 0, 1, 1)) == []
    assert one(spark, raster.std(arr(7))) == 0
    assert one(spark, raster.argsort(arr(3, 1, 3, 2))) == [2, 4, 1, 3]
    assert one(spark, raster.halve(arr(*SIX), 3, 2)) == [3, 4.5]
    t = raster.threshold(arr(-2, 0.5, 3), 1.0)
    assert one(spark, t) == one(spark, raster.threshold(t, 1.0)) == [-2, 0, 3]


def test_region_is_crop(spark):
    g = np.arange(64.0)
    im = spark.createDataFrame([(1, g.tolist())], "image_id long, pixels array<double>")
    t = tiles.cut_tiles(raster.long_form(im, 8), 4)
    for x1, y1, x2, y2 in ((1, 2, 6, 4), (4, 4, 4, 4), (0, 0, 7, 7)):
        regions = spark.createDataFrame([(0, 1, 0, x1, y1, x2, y2)], "region_id int, image_id long, level int, x1 int, y1 int, x2 int, y2 int")
        got = {(r.y, r.x): r.v for r in tiles.read_region(t, regions, 4, 8, 8).collect()}
        want = g.reshape(8, 8)[y1 : y2 + 1, x1 : x2 + 1]
        assert got == {(y, x): want[y, x] for y in range(want.shape[0]) for x in range(want.shape[1])}
    assert tiles.tile_bounds(2, 1, 4) == (8, 4, 11, 7)


def test_levels(spark):
    assert [one(spark, tiles.level_of(F.lit("1.0,0.5,0.25"), k)) for k in (1, 3)] == [1, -1]


def test_fits_recover_a_known_map(spark):
    rng = np.random.default_rng(1)
    xy = rng.uniform(0, 50, (30, 2))
    maps = {
        "affine": ((2, -0.5, 3, 0.25, 1.5, -4), lambda x, y, p: (p[0] * x + p[1] * y + p[2], p[3] * x + p[4] * y + p[5])),
        "rst": ((1.2, 0.4, 3, -1), lambda x, y, p: (p[0] * x + p[1] * y + p[2], -p[1] * x + p[0] * y + p[3])),
        "st": ((1.5, 2, -3), lambda x, y, p: (p[0] * x + p[1], p[0] * y + p[2])),
        "projective": ((1, 0.1, 2, -0.1, 1.1, 3, 0.001, 0.002), lambda x, y, p: ((p[0] * x + p[1] * y + p[2]) / (p[6] * x + p[7] * y + 1), (p[3] * x + p[4] * y + p[5]) / (p[6] * x + p[7] * y + 1))),
    }
    for kind, (p, f) in maps.items():
        rows = [(1, float(x), float(y), *map(float, f(x, y, p))) for x, y in xy]
        got = features.fit(spark.createDataFrame(rows, "pair_id long, x1 double, y1 double, x2 double, y2 double"), kind).first()
        assert np.allclose(got["params"], p, atol=1e-5), kind


def test_mutual_nearest_is_symmetric(spark):
    rng = np.random.default_rng(2)
    a, b = (spark.createDataFrame([(1, i, rng.normal(size=5).tolist()) for i in range(12)], "k int, idx int, f array<double>") for _ in range(2))
    ab = features.mutual_nearest(features.distances(a, b, ["k"]), ["k"], 100)
    ba = features.mutual_nearest(features.distances(b, a, ["k"]), ["k"], 100)
    assert {(r.l, r.r) for r in ab.collect()} == {(r.r, r.l) for r in ba.collect()}


def test_radon_keeps_mass_and_texture(spark):
    g = np.arange(1.0, 17)
    px = raster.long_form(spark.createDataFrame([(1, g.tolist())], "image_id long, pixels array<double>"), 4)
    for r in transforms.radon(px, [0.0, 33.0, 90.0], 4, 4, 2, 2, -8, 17).groupBy("angle").agg(F.sum("v").alias("m")).collect():
        assert abs(r.m - g.sum()) < 1e-9
    assert one(spark, transforms.radon_texture(arr(*range(12)))) == [0, 1, 2, 9, 10, 11, 3, 4, 5, 6, 7, 8]


@pytest.mark.parametrize("bank", ["bior3.1", "sym5"])
def test_wavelets_undo(spark, bank):
    v = np.random.default_rng(3).normal(size=20)
    n = transforms.dwt_length(20, len(transforms.BANKS[bank][0]))
    low, high = transforms.dwt(arr(*v), 20, bank)
    df = spark.range(1).select(low.alias("l"), high.alias("h"))
    got = df.select(transforms.synthesise(F.col("l"), F.col("h"), n, bank).alias("v")).first()["v"]
    assert np.allclose(got[:20], v)


def test_chebyshev_fast_undo():
    v = np.random.default_rng(4).normal(size=(9, 5))
    assert np.allclose(transforms.fast_chebyshev(transforms.fast_chebyshev(v), inverse=True), v)


def test_masks_and_gaps(spark):
    shapes = spark.createDataFrame(
        [(1, "point", [(2.4, 3.0, None, None)]), (2, "polyline", [(0.0, 0.0, 1.0, None), (3.0, 0.0, 1.0, None)]), (3, "polygon", [(4.0, 1.0, 0.0, None), (6.0, 1.0, 0.0, None), (6.0, 3.0, 0.0, None), (4.0, 3.0, 0.0, None)])],
        "gobject_id long, type string, vertices array<struct<x:double,y:double,z:double,t:double>>",
    )
    got = {(r.z, r.y, r.x) for r in series.render_masks(shapes, 8, 8, 2).collect()}
    assert got == {(0, 3, 2), (1, 3, 2), (1, 0, 0), (1, 0, 1), (1, 0, 2), (1, 0, 3), (0, 1, 4), (0, 1, 5), (0, 2, 4), (0, 2, 5)}
    z = spark.createDataFrame([("a", i, v) for i, v in enumerate([None, 2.0, None, None, 8.0, None, None])], "k string, z int, v double")
    assert [r.filled for r in series.fill_gaps(z, "k", "z", "v").orderBy("z").collect()] == [None, 2, 4, 6, 8, 4, 0]


def test_steps():
    steps = [("a",), ("b", 1), ("c",)]
    assert series.steps_left(steps, "b") == [("a",)]
    assert series.steps_right(steps, "b") == [("c",)]
    assert series.steps_left(steps, "x") == []


def test_matching_reads_every_image(spark):
    from pixelweave.plans import registry

    data = "/root/testdata/sf0.001"
    ids = {r.vec_id for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    lefts = {i for i in ids if i + 1 in ids}
    assert lefts | {i + 1 for i in lefts} == ids
    assert {r.pair_id for r in registry.QUERIES["mutual_nearest_all"](spark, data).collect()} == lefts
    counts = registry.QUERIES["l1_distances_all"](spark, data).groupBy("pair_id").count().collect()
    assert {r.pair_id for r in counts} == lefts and {r["count"] for r in counts} == {64}
    buyers = {r.o_custkey for r in spark.read.parquet(f"{data}/orders.parquet").collect()} & {r.c_custkey for r in spark.read.parquet(f"{data}/customer.parquet").collect()}
    merged = [(r.page, r.c) for r in registry.QUERIES["merge_channels_all"](spark, data).collect()]
    assert sorted(merged) == sorted((p, c) for p in buyers for c in (0, 1))


def test_fft_gives_every_coefficient(spark):
    from pixelweave.plans import registry

    data = "/root/testdata/sf0.001"
    pixels = {r.vec_id: np.array(r.embedding, float).reshape(8, 8) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    got = {(r.image_id, r.ky, r.kx): complex(r.re, r.im) for r in registry.QUERIES["fft_2d_all"](spark, data).collect()}
    assert len(got) == 64 * len(pixels)
    wave = np.array([[np.exp(-2j * np.pi * a * b / 8) for b in range(8)] for a in range(8)])  # the sum of the definition, no FFT
    for i, p in pixels.items():
        want = np.einsum("ky,lx,yx->kl", wave, wave, p)
        assert all(abs(got[i, ky, kx] - want[ky, kx]) < 2e-5 for ky in range(8) for kx in range(8))


def test_matches_relax(spark):
    rng = np.random.default_rng(14)
    n, m, limit = 9, 7, 6
    tables = {k: rng.integers(0, 50, (n, m)).astype(float) for k in range(6)}
    tables |= {k: np.arange(m) + 10.0 * np.arange(n)[:, None] for k in (6, 7)}  # every left point is nearest to 0: one mutual pair
    rows = [(k, i, j, float(t[i, j])) for k, t in tables.items() for i in range(n) for j in range(m)]
    got = features.matches(spark.createDataFrame(rows, "k long, l int, r int, d double"), ["k"], limit).collect()
    for k, t in tables.items():
        points, order = min(limit, n, m), sorted(range(n), key=lambda i: (t[i].min(), i))
        near = [(i, int(t[i].argmin())) for i in order]
        mutual = [(i, j) for i, j in near if t[:, j].argmin() == i][:points]
        relaxed = len(mutual) < points // 2
        assert [(r.l, r.r) for r in sorted((r for r in got if r.k == k), key=lambda r: r["rank"])] == (near[:points] if relaxed else mutual)
        assert {r.relaxed for r in got if r.k == k} == {relaxed}
    assert any(r.relaxed for r in got) and not all(r.relaxed for r in got)

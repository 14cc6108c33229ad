"""Plane operators against the column expressions of the same name, wavelets against definitions and round trips, edge tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.operators import features, planes, raster, tiles, wavelets
from pixelweave.operators import transforms as TR

SHAPES = [(8, 8), (5, 7), (7, 4), (1, 6), (6, 1), (2, 2), (3, 3), (1, 1)]


def plane(h, w, seed=0):
    return np.random.default_rng(seed + 10 * h + w).normal(size=(h, w)).round(3)


@pytest.mark.parametrize("shape", SHAPES)
def test_planes_equal_columns(spark, shape):
    h, w = shape
    g = plane(h, w)
    df = spark.createDataFrame([(g.ravel().tolist(),)], "p array<double>")
    p = F.col("p")
    row = df.select(raster.smooth(p, w, h, 2).alias("s"), raster.gradient(p, w, h, "x").alias("x"), raster.gradient(p, w, h, "y").alias("y"), raster.halve(p, w, h).alias("h"), raster.structure(p, w, h).alias("c")).first()
    for got, want in ((planes.smooth(g, 2), row.s), (planes.gradient(g, "x"), row.x), (planes.gradient(g, "y"), row.y), (planes.halve(g), row.h), (planes.structure(g), row.c)):
        assert np.allclose(got.ravel(), want, atol=1e-9)


def test_mapped(spark):
    rows = [(i, w, h, plane(h, w, i).ravel().tolist(), "kept") for i, (h, w) in enumerate(SHAPES)] + [(50, 3, 3, None, "kept"), (51, 2, 2, [1.0, float("nan"), 2.0, 3.0], None)]
    df = spark.createDataFrame(rows, "image_id long, width int, height int, pixels array<double>, note string")
    got = {r.image_id: r for r in planes.mapped(df, planes.halve).collect()}
    assert len(got) == len(rows) and got[50].pixels is None and np.isnan(got[51].pixels[0])
    for i, (h, w) in enumerate(SHAPES):
        assert (got[i].width, got[i].height, got[i].note) == ((w + 1) // 2, (h + 1) // 2, "kept")
        assert np.allclose(got[i].pixels, planes.halve(plane(h, w, i)).ravel())
    assert planes.mapped(df.limit(0), planes.smooth).count() == 0


@pytest.mark.parametrize("mode", TR.MODES)
@pytest.mark.parametrize("bank", list(TR.BANKS))
def test_wavelet_step_equals_columns(spark, bank, mode):
    g = plane(1, 11).ravel()
    low, high = TR.dwt(F.col("p"), 11, bank, mode)
    row = spark.createDataFrame([(g.tolist(),)], "p array<double>").select(low.alias("l"), high.alias("h")).first()
    for got, want in zip((wavelets.step(g, bank, mode)[k] for k in "LH"), row, strict=True):
        assert np.allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("bank", list(TR.BANKS))
def test_wavelet_round_trips(bank):
    """Any shape, one to three dimensions, several levels, every mode; periodization where all sides are even."""
    for shape in ((64,), (37,), (24, 17), (16, 16), (12, 9, 10), (16, 8, 16)):
        v = np.random.default_rng(3).normal(size=shape)
        for mode in TR.MODES:
            if mode == "periodization" and any(n % 8 for n in shape):
                continue
            for levels in (1, 2):
                low, found = wavelets.transform(v, bank, levels, mode)
                assert len(found) == levels and len(found[0][1]) == 2 ** v.ndim - 1
                back = wavelets.inverse(low, found, bank, mode)
                assert back.shape == v.shape and np.allclose(back, v, atol=2e-3 if bank == "bior5.5" else 1e-8), (shape, mode, levels)


def test_denoised(spark):
    clean = np.add.outer(np.linspace(0, 5, 32), np.linspace(0, 3, 40))
    noisy = clean + 0.05 * np.random.default_rng(1).normal(size=clean.shape)
    df = spark.createDataFrame([(1, 40, 32, noisy.ravel().tolist())], "image_id long, width int, height int, pixels array<double>")
    out = np.array(wavelets.denoised(df, limit=0.3, levels=2).first().pixels).reshape(32, 40)
    assert np.abs(out - clean).mean() < 0.7 * np.abs(noisy - clean).mean()
    same = np.array(wavelets.denoised(df, limit=0.0).first().pixels)
    assert np.allclose(same, noisy.ravel())


def test_dwt_2d_bands(spark):
    g = plane(6, 10)
    bands = TR.dwt_2d(F.col("p"), 10, 6, "sym5", "symmetric")
    row = spark.createDataFrame([(g.ravel().tolist(),)], "p array<double>").select(*(c.alias(k) for k, c in bands.items())).first()
    want = wavelets.step(g, "sym5", "symmetric")
    for name in bands:  # named along x first there, along rows first here
        assert np.allclose(row[name], want[name[::-1]].ravel(), atol=1e-9)


def test_edge_tiles(spark):
    w, h, t = 11, 7, 4
    g = plane(h, w)
    im = spark.createDataFrame([(1, g.ravel().tolist())], "image_id long, pixels array<double>")
    cut = tiles.cut_planes(im, w, h, t)
    for r in cut.collect():
        assert np.allclose(r.pixels, g[r.ty * t : r.ty * t + t, r.tx * t : r.tx * t + t].ravel())
    assert "Exchange" not in cut._jdf.queryExecution().toString()
    boxes = [(0, 0, 0, 10, 6), (1, 3, 2, 9, 5), (2, 8, 4, 30, 30), (3, 10, 6, 10, 6)]
    regions = spark.createDataFrame([(n, 1, 0, *b) for n, *b in boxes], "region_id int, image_id long, level int, x1 int, y1 int, x2 int, y2 int")
    got = {n: {} for n, *_ in boxes}
    for r in tiles.read_region(cut, regions, t, w, h).collect():
        got[r.region_id][r.y, r.x] = r.v
    for n, x1, y1, x2, y2 in boxes:
        part = g[y1 : y2 + 1, x1 : x2 + 1]
        assert got[n] == {(y, x): part[y, x] for y in range(part.shape[0]) for x in range(part.shape[1])}


@pytest.mark.parametrize("kind", list(features.FITS))
def test_fits_equal_least_squares(spark, kind):
    rng = np.random.default_rng(4)
    rows = [(k, *map(float, rng.normal(size=4))) for k in range(3) for _ in range(12)] + [(9, 1.0, 1.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "pair_id long, x1 double, y1 double, x2 double, y2 double")
    for r in features.fit(df, kind).collect():
        own = [p[1:] for p in rows if p[0] == r.pair_id]
        a = np.array([d for x, y, u, v in own for d in {"affine": ([x, y, 1, 0, 0, 0], [0, 0, 0, x, y, 1]), "projective": ([x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]), "rst": ([x, y, 1, 0], [y, -x, 0, 1]), "st": ([x, 1, 0], [y, 0, 1])}[kind]])
        want = np.linalg.lstsq(a, np.array([t for *_, u, v in own for t in (u, v)]), rcond=None)[0]
        assert np.allclose(a @ np.array(r.params), a @ want, atol=1e-6)

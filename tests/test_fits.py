"""Least-squares fits and oriented patches against numpy over all points of a pair."""

import numpy as np
import pytest

from pixelweave.operators import features

ROWS = {
    "affine": lambda x, y, u, v: ([x, y, 1, 0, 0, 0], [0, 0, 0, x, y, 1]),
    "projective": lambda x, y, u, v: ([x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]),
    "rst": lambda x, y, u, v: ([x, y, 1, 0], [y, -x, 0, 1]),
    "st": lambda x, y, u, v: ([x, 1, 0], [y, 0, 1]),
}


@pytest.mark.parametrize("kind", list(ROWS))
def test_fit_equals_least_squares(spark, kind):
    rng = np.random.default_rng(5)
    points = []
    for pair in range(3):
        xy = rng.uniform(0, 10, (12, 2))
        uv = xy @ rng.normal(size=(2, 2)) + rng.normal(size=2) + 0.1 * rng.normal(size=(12, 2))
        points += [(pair, *map(float, a), *map(float, b)) for a, b in zip(xy, uv, strict=True)]
    df = spark.createDataFrame(points, "pair_id long, x1 double, y1 double, x2 double, y2 double")
    got = {r.pair_id: r for r in features.fit(df, kind).collect()}
    assert sorted(got) == [0, 1, 2]
    for pair, r in got.items():
        own = [p[1:] for p in points if p[0] == pair]
        a = np.array([row for p in own for row in ROWS[kind](*p)], float)
        want = np.linalg.lstsq(a, np.array([z for p in own for z in p[2:]]), rcond=None)[0]
        assert r.n_points == 12
        assert np.allclose(r.params, want, rtol=1e-5, atol=1e-6)


def test_fit_of_one_place(spark):
    """Points that all coincide leave the map open: the result is finite and maps that place right."""
    df = spark.createDataFrame([(7, 2.0, 3.0, 5.0, 1.0)] * 4, "pair_id long, x1 double, y1 double, x2 double, y2 double")
    a, b, c, d, e, f = features.fit(df, "affine").first().params
    assert np.allclose([2 * a + 3 * b + c, 2 * d + 3 * e + f], [5, 1], atol=1e-6)


def test_fit_of_nothing(spark):
    df = spark.createDataFrame([], "pair_id long, x1 double, y1 double, x2 double, y2 double")
    assert features.fit(df, "rst").count() == 0


def test_patches_turn_with_the_image(spark):
    """Quarter turns about the point leave the patch as it is and turn its direction with the image."""
    g = np.random.default_rng(3).uniform(0, 255, (21, 21))
    g += np.add.outer(6.0 * np.arange(21), 3.0 * np.arange(21))
    images = spark.createDataFrame([(k, np.rot90(g, k).ravel().tolist()) for k in range(4)], "image_id long, pixels array<double>")
    points = spark.createDataFrame([(k, 0, 10, 10) for k in range(4)], "image_id long, idx int, y int, x int")
    got = {r.image_id: np.array(r.f) for r in features.patches(images, points, 21, 21, 4).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    own, c, s = got[0][:-2], *got[0][-2:]
    assert len(own) == 81 and abs(own.mean()) < 1e-9 and abs(own.std(ddof=1) - 1) < 1e-6
    for k in range(1, 4):
        c, s = -s, c
        assert np.allclose(got[k][:-2], own, atol=1e-6)
        assert np.allclose(got[k][-2:], [c, s], atol=1e-9)

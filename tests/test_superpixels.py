"""Superpixels against a version that goes pixel by pixel, and the clean-up's promises."""

import numpy as np
import pytest

from pixelweave.operators import superpixels as SP


def slow(planes, size, weight, rounds):
    """Every pixel against the seeds of its own cell and those around it, one by one."""
    c = SP.scaled(planes)
    n, h, w = c.shape
    ny, nx = max(1, int(h / size + 0.5)), max(1, int(w / size + 0.5))
    cell = lambda y, x: (y * ny // h, x * nx // w)
    label = {(y, x): cell(y, x)[0] * nx + cell(y, x)[1] for y in range(h) for x in range(w)}
    centres = {}
    for _ in range(rounds):
        for s in range(ny * nx):
            mine = [p for p, k in label.items() if k == s]
            if mine:
                centres[s] = (sum(y for y, _ in mine) / len(mine), sum(x for _, x in mine) / len(mine), *(sum(int(c[k, y, x]) for y, x in mine) / len(mine) for k in range(n)))
        new = {}
        for y, x in label:
            best = None
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    a, b = cell(y, x)[0] + dy, cell(y, x)[1] + dx
                    if 0 <= a < ny and 0 <= b < nx:
                        m = centres[a * nx + b]
                        d = ((y - m[0]) ** 2 + (x - m[1]) ** 2) * (weight * SP.FULL / size) ** 2
                        for k in range(n):
                            d += (int(c[k, y, x]) - m[2 + k]) ** 2
                        if best is None or d < best[0]:
                            best = (d, a * nx + b)
            new[y, x] = best[1]
        label = new
    return np.array([[label[y, x] for x in range(w)] for y in range(h)])


def picture(h, w, channels, seed=1):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    base = np.stack([np.sin(y / 5 + k) + np.cos(x / (4 + k)) + (x > w // 2) for k in range(channels)])
    return base + 0.15 * rng.normal(size=base.shape)


@pytest.mark.parametrize(("h", "w", "channels", "size", "weight"), [(40, 50, 3, 16, 0.2), (33, 21, 1, 8, 0.05), (9, 30, 2, 4, 1.0), (5, 5, 1, 16, 0.2), (1, 12, 1, 3, 0.2)])
def test_clusters_equal_the_slow_ones(h, w, channels, size, weight):
    p = picture(h, w, channels)
    assert np.array_equal(SP.cluster(p, size, weight, 4), slow(p, size, weight, 4))


@pytest.mark.parametrize("seed", range(4))
def test_each_label_is_one_region(seed):
    rng = np.random.default_rng(seed)
    labels = rng.integers(0, 5, (12, 17)) if seed else SP.cluster(picture(60, 70, 3), 8, 0.02)
    out = SP.connected(labels)
    for k in np.unique(out):
        assert len(np.unique(SP.components(out)[out == k])) == 1
    part = SP.components(labels)
    for k in np.unique(labels):  # the largest region of each label stays as it is
        roots, n = np.unique(part[labels == k], return_counts=True)
        assert (out[part == roots[n.argmax()]] == k).all()


def test_components_flood():
    labels = np.random.default_rng(3).integers(0, 3, (15, 14))
    got, seen = SP.components(labels), np.full(labels.shape, -1)
    for y in range(15):
        for x in range(14):
            if seen[y, x] < 0:
                to_do = [(y, x)]
                while to_do:
                    a, b = to_do.pop()
                    if 0 <= a < 15 and 0 <= b < 14 and seen[a, b] < 0 and labels[a, b] == labels[y, x]:
                        seen[a, b] = y * 14 + x
                        to_do += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    assert np.array_equal(got, seen)


def test_images(spark):
    p = picture(24, 30, 3)
    rows = [(1, 30, 24, [c.ravel().tolist() for c in p], [9]), (2, 30, 24, None, None), (3, 2, 2, [[1.0, 2.0]], None), (4, 0, 0, [[]], None), (5, 2, 1, [[float("nan"), None]], None), (6, 3, 2, [[5.0] * 6], None)]
    df = spark.createDataFrame(rows, "image_id int, width int, height int, pixels array<array<double>>, labels array<int>")
    got = {r.image_id: r.labels for r in SP.superpixels(df, 8, 0.2).collect()}
    assert got[1] == SP.connected(SP.cluster(p, 8, 0.2)).ravel().tolist()
    assert got[2] is None and got[3] is None and got[4] is None and got[5] == [0, 0] and got[6] == [0] * 6
    assert SP.superpixels(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        SP.superpixels(df, 0)

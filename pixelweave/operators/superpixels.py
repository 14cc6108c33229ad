"""Superpixels by simple linear iterative clustering (SLIC), and the clean-up that makes every label one connected region.

Seeds stand on a grid of cells of about size x size pixels. Each round gives every pixel to the seed of least
D = (difference of colours)^2 + (weight * distance / size)^2 among those of its own cell and the eight around it, so the work of a
round is nine comparisons a pixel whatever the number of seeds, and then moves each seed to the mean of its pixels by sums over seeds.
Colours are scaled by the image's range to whole numbers of 0 to FULL, so the sums are exact and no order of adding matters.

An image is a row and stays in the task that reads it; images are independent, so a cluster works on as many as it has cores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

FULL = 65535
ROUNDS = 10


def scaled(planes: np.ndarray) -> np.ndarray:
    """Channels (c, h, w) as whole numbers of 0 to FULL over the range of them all; values that aren't finite count as the least."""
    x = np.asarray(planes, float)
    finite = np.isfinite(x)
    low, high = (x[finite].min(), x[finite].max()) if finite.any() else (0.0, 0.0)
    x = np.where(finite, x, low)
    return np.rint((x - low) / (high - low) * FULL).astype(np.int64) if high > low else np.zeros(x.shape, np.int64)


def grid(extent: int, size: int) -> tuple[int, np.ndarray]:
    """Cells along one side, and the cell of each pixel."""
    cells = max(1, int(extent / size + 0.5))
    return cells, np.arange(extent) * cells // extent


def cluster(planes: np.ndarray, size: int = 16, weight: float = 0.2, rounds: int = ROUNDS) -> np.ndarray:
    """Labels (h, w), numbers of the grid's cells by row, before the clean-up."""
    c = scaled(planes)
    _, h, w = c.shape
    (ny, cy), (nx, cx) = grid(h, size), grid(w, size)
    yy, xx = np.arange(h)[:, None], np.arange(w)[None, :]
    own = (cy[:, None] * nx + cx[None, :]).astype(np.int64)
    labels, n = own, ny * nx
    features = np.stack([np.broadcast_to(yy, (h, w)), np.broadcast_to(xx, (h, w)), *c]).reshape(len(c) + 2, -1)
    centre = np.zeros((len(features), n))
    pull = (weight * FULL / size) ** 2
    for k in range(rounds + 1):
        flat = labels.ravel()
        count = np.bincount(flat, minlength=n)
        sums = np.stack([np.bincount(flat, f, n) for f in features])  # whole numbers below 2^53
        centre = np.where(count > 0, sums / np.maximum(count, 1), centre)
        if k == rounds:
            return labels
        best, found = np.full((h, w), np.inf), own
        for dy in (-1, 0, 1):
            ty = cy + dy
            for dx in (-1, 0, 1):
                tx = cx + dx
                ok = ((ty >= 0) & (ty < ny))[:, None] & ((tx >= 0) & (tx < nx))[None, :]
                s = np.where(ok, ty[:, None] * nx + tx[None, :], 0)
                d = ((yy - centre[0][s]) ** 2 + (xx - centre[1][s]) ** 2) * pull
                for channel, at in zip(c, centre[2:], strict=True):
                    d += (channel - at[s]) ** 2
                better = ok & (d < best)  # of ties the smaller label, as it comes first
                best, found = np.where(better, d, best), np.where(better, s, found)
        labels = found


def components(labels: np.ndarray) -> np.ndarray:
    """The first place of the 4-connected region of equal labels that each pixel is in."""
    h, w = labels.shape
    places = np.arange(h * w).reshape(h, w)
    across, down = labels[:, 1:] == labels[:, :-1], labels[1:] == labels[:-1]
    a = np.concatenate([places[:, :-1][across], places[:-1][down]])
    b = np.concatenate([places[:, 1:][across], places[1:][down]])
    parent = np.arange(h * w)
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        if (low == high).all():
            return parent.reshape(h, w)
        np.minimum.at(parent, high, low)
        while (parent[parent] != parent).any():
            parent = parent[parent]


def connected(labels: np.ndarray) -> np.ndarray:
    """Labels of which each is one region: the largest of a label stays (of equal ones the first), and the pixels of the others take,
    round by round, the smallest label beside them."""
    h, w = labels.shape
    part = components(labels).ravel()
    size = np.bincount(part, minlength=h * w)
    roots = np.flatnonzero(size)
    order = np.lexsort((roots, -size[roots], labels.ravel()[roots]))
    roots = roots[order]
    first = np.concatenate([[True], np.diff(labels.ravel()[roots]) != 0])
    stays = np.zeros(h * w, bool)
    stays[roots[first]] = True
    none = np.iinfo(np.int64).max
    out = np.where(stays[part].reshape(h, w), labels, none).astype(np.int64)
    while (out == none).any():
        around = np.full((h + 2, w + 2), none)
        around[1:-1, 1:-1] = out
        beside = np.minimum.reduce([around[:-2, 1:-1], around[2:, 1:-1], around[1:-1, :-2], around[1:-1, 2:]])
        out = np.where(out == none, beside, out)
    return out


def superpixels(images: DataFrame, size: int = 16, weight: float = 0.2, rounds: int = ROUNDS, clean: bool = True, column: str = "pixels", width: str = "width", height: str = "height") -> DataFrame:
    """images with a column labels: an array of ints by row, the superpixel of each pixel. column holds one plane, or an array of planes
    of equal size as channels. A null or empty image, or one whose planes' lengths aren't width x height, has null labels."""
    if size < 1 or weight < 0 or rounds < 0:
        raise ValueError("size must be 1 or more, weight and rounds 0 or more")
    nested = isinstance(images.schema[column].dataType.elementType, T.ArrayType)
    at = {c: images.columns.index(c) for c in (column, width, height)}
    schema = T.StructType([*(f for f in images.schema if f.name != "labels"), T.StructField("labels", T.ArrayType(T.IntegerType()))])
    rest = [k for k, c in enumerate(images.columns) if c != "labels"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                one = b.slice(k, 1)
                w, h, values = one.column(at[width])[0].as_py(), one.column(at[height])[0].as_py(), one.column(at[column])[0]
                labels = pa.nulls(1, pa.list_(pa.int32()))
                if values.is_valid and w and h:
                    planes = values.values if nested else [values]
                    planes = [np.asarray(p.values.cast(pa.float64()).to_numpy(zero_copy_only=False), float) for p in planes if p.is_valid]
                    if planes and all(len(p) == w * h for p in planes):
                        found = cluster(np.stack(planes).reshape(-1, h, w), size, weight, rounds)
                        found = connected(found) if clean else found
                        labels = pa.ListArray.from_arrays(pa.array([0, w * h], pa.int32()), pa.array(found.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(one.column(j) for j in rest), labels], names=[f.name for f in schema])

    return images.mapInArrow(run, schema)

"""Raster operators over whole planes in numpy, for images that are too large for array expressions.

`mapped` sends batches of rows (width, height and a plane as an array of doubles by row) through a function of 2-D arrays in
mapInArrow: nothing is shuffled, other columns pass, and a plane is only ever in the task that reads it. The functions
take planes of any size, as small as 1 x 1; smooth, gradient and structure also stacks of them (h, w, planes). For small arrays inside larger expressions `raster` has the same as columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Plane = np.ndarray


def mapped(images: DataFrame, function: Callable[[Plane], Plane], column: str = "pixels", width: str = "width", height: str = "height") -> DataFrame:
    """images with the planes of a column replaced by function's, and width and height by theirs. A null plane stays null."""
    at = {c: images.columns.index(c) for c in (column, width, height)}
    fields = {column: T.ArrayType(T.DoubleType()), width: T.IntegerType(), height: T.IntegerType()}
    schema = T.StructType([T.StructField(f.name, fields.get(f.name, f.dataType)) for f in images.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):  # a plane is a batch of its own, whatever its size
                one = b.slice(k, 1)
                w, h, values = one.column(at[width])[0].as_py(), one.column(at[height])[0].as_py(), one.column(at[column])[0]
                columns = list(one.columns)
                if values.is_valid:
                    out = function(np.asarray(values.values.cast(pa.float64()), float).reshape(h, w))
                    columns[at[column]] = pa.ListArray.from_arrays(pa.array([0, out.size], pa.int32()), pa.array(out.ravel()))
                    h, w = out.shape
                else:
                    columns[at[column]] = pa.nulls(1, pa.list_(pa.float64()))
                columns[at[width]], columns[at[height]] = pa.array([w], pa.int32()), pa.array([h], pa.int32())
                yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return images.mapInArrow(run, schema)


def smooth(g: Plane, passes: int = 1) -> Plane:
    """Five-point smoothing: inside (4 own + 4 neighbours) / 8; at an edge the mean of the value, its two neighbours on the
    edge and the one inside; in a corner the mean of its 2x2 block. Planes under 2x2 stay as they are."""
    if min(g.shape[:2]) < 2:
        return g
    for _ in range(passes):
        out = np.empty_like(g)
        out[1:-1, 1:-1] = (g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] + 4 * g[1:-1, 1:-1]) / 8
        for edge, inner in ((0, 1), (-1, -2)):
            out[edge, 1:-1] = (g[edge, 1:-1] + g[edge, :-2] + g[edge, 2:] + g[inner, 1:-1]) / 4
            out[1:-1, edge] = (g[1:-1, edge] + g[:-2, edge] + g[2:, edge] + g[1:-1, inner]) / 4
            for side, beside in ((0, 1), (-1, -2)):
                out[edge, side] = (g[edge, side] + g[edge, beside] + g[inner, side] + g[inner, beside]) / 4
        g = out
    return g


def gradient(g: Plane, axis: str) -> Plane:
    """Central difference along rows ('y') or columns ('x'); zero on the border."""
    out = np.zeros_like(g)
    a, b = (g[1:-1, 2:], g[1:-1, :-2]) if axis == "x" else (g[2:, 1:-1], g[:-2, 1:-1])
    out[1:-1, 1:-1] = (a - b) / 2
    return out


def halve(g: Plane) -> Plane:
    """One pyramid level: means of 2x2 blocks, at odd edges of what there is."""
    for axis in (0, 1):
        g = np.moveaxis(g, axis, 0)
        even, odd = g[0::2], g[1::2]
        out = even.copy()
        out[: len(odd)] = (even[: len(odd)] + odd) / 2
        g = np.moveaxis(out, 0, axis)
    return g


def structure(g: Plane) -> Plane:
    """Corner response: the smoothed plane's gradients over 3x3 offsets, each weighted by its coherence with the centre."""
    eps = 2.2204e-16
    s = smooth(g)
    gx, gy = gradient(s, "y"), gradient(s, "x")
    out = np.zeros_like(g)
    h, w = g.shape[:2]
    if h < 3 or w < 3:
        return out
    own_x, own_y = gx[1:-1, 1:-1], gy[1:-1, 1:-1]
    a, b, c = (np.zeros_like(own_x) for _ in range(3))
    for dy in range(3):
        for dx in range(3):
            px, py = gx[dy : dy + h - 2, dx : dx + w - 2], gy[dy : dy + h - 2, dx : dx + w - 2]
            weight = np.maximum(0.0, own_x * px + own_y * py)
            a += weight * px * px
            b += weight * px * py
            c += weight * py * py
    out[1:-1, 1:-1] = np.abs(a * c - b * b) / (eps + np.sqrt(a * a + c * c + 2 * b * b)) / np.sqrt(eps + a + c)
    return out

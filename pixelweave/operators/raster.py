"""Raster operators on images held as rows: image_id, width, height and a row-major array of doubles.

Every function that takes pixels works within a row, so it needs no shuffle and stays in generated code; the long
form (one row a pixel) serves aggregations across pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _map(n, f) -> Column:
    """An array of n values, f of the position from 0."""
    return F.when(F.lit(n) > 0, F.transform(F.sequence(F.lit(0), F.lit(n) - 1), f)).otherwise(F.array().cast("array<double>"))


def _int(c) -> Column:
    return c.cast("int")


def remap(pixels: Column, n, source) -> Column:
    """Values moved: position k of the result has the value at source(k)."""
    return _map(n, lambda k: F.get(pixels, _int(source(k))))


def rotate_right(p: Column, w: int, h: int) -> Column:
    """Clockwise by 90 degrees; the result is h wide and w high."""
    return remap(p, w * h, lambda k: (h - 1 - k % h) * w + F.floor(k / h))


def rotate_left(p: Column, w: int, h: int) -> Column:
    return remap(p, w * h, lambda k: (k % h) * w + (w - 1 - F.floor(k / h)))


def flip(p: Column, w: int, h: int) -> Column:
    """Top to bottom."""
    return remap(p, w * h, lambda k: (h - 1 - F.floor(k / w)) * w + k % w)


def mirror(p: Column, w: int, h: int) -> Column:
    """Left to right."""
    return remap(p, w * h, lambda k: F.floor(k / w) * w + (w - 1 - k % w))


def crop(p: Column, w: int, h: int, x: int, y: int, cw: int, ch: int) -> Column:
    """The region at (x, y), cut to the image; empty if nothing is left."""
    cw, ch = max(0, min(cw, w - x)), max(0, min(ch, h - y))
    return remap(p, cw * ch, lambda k: (y + F.floor(k / max(cw, 1))) * w + x + k % max(cw, 1))


def paste(p: Column, w: int, h: int, tile: Column, x: int, y: int, tw: int, th: int) -> Column:
    """p with a tile put at (x, y)."""

    def at(k):
        kx, ky = k % w - x, F.floor(k / w) - y
        inside = (kx >= 0) & (kx < tw) & (ky >= 0) & (ky < th)
        return F.when(inside, F.get(tile, _int(ky * tw + kx))).otherwise(F.get(p, _int(k)))

    return _map(w * h, at)


def interleave(*planes: Column) -> Column:
    """Planar to interleaved."""
    return F.flatten(F.transform(F.arrays_zip(*planes), lambda z: F.array(*(z[str(i)] for i in range(len(planes))))))


def deinterleave(p: Column, channel: int, channels: int) -> Column:
    return F.filter(p, lambda v, i: i % channels == channel)


def resize_pad(p: Column, w: int, h: int, nw: int, nh: int) -> Column:
    """Another grid size: the old block is copied, the rest is zero."""
    return _map(nw * nh, lambda k: F.when((k % nw < w) & (F.floor(k / nw) < h), F.get(p, _int(F.floor(k / nw) * w + k % nw))).otherwise(0.0))


def threshold(p: Column, limit: float) -> Column:
    """Hard threshold: magnitudes below the limit become zero."""
    return F.transform(p, lambda v: F.when(F.abs(v) < limit, 0.0).otherwise(v))


def read_at(p: Column, w: int, h: int, x: Column, y: Column) -> Column:
    """The value at (x, y), null outside of the grid."""
    return F.when((x >= 0) & (x < w) & (y >= 0) & (y < h), F.get(p, _int(y * w + x)))


def smooth(p: Column, w: int, h: int, passes: int = 1) -> Column:
    """Five-point smoothing: inside (4 own + 4 neighbours) / 8; at an edge the mean of the value, its two neighbours on
    the edge and the one inside; in a corner the mean of its 2x2 block. Images under 2x2 stay as they are."""
    if w < 2 or h < 2:
        return p

    def at(k, q):
        x, y = k % w, _int(F.floor(k / w))
        v = lambda dx, dy: F.get(q, _int((y + dy) * w + x + dx))
        left, right, top, bottom = x == 0, x == w - 1, y == 0, y == h - 1
        sx, sy = F.when(left, 1).otherwise(-1), F.when(top, 1).otherwise(-1)
        corner = (v(0, 0) + v(sx, 0) + v(0, sy) + v(sx, sy)) / 4
        side_x = (v(0, 0) + v(0, -1) + v(0, 1) + v(sx, 0)) / 4
        side_y = (v(0, 0) + v(-1, 0) + v(1, 0) + v(0, sy)) / 4
        inside = (v(0, -1) + v(0, 1) + v(-1, 0) + v(1, 0) + 4 * v(0, 0)) / 8
        return F.when((left | right) & (top | bottom), corner).when(left | right, side_x).when(top | bottom, side_y).otherwise(inside)

    for _ in range(passes):
        # The array is bound once a pass, so passes don't multiply the expression.
        p = F.transform(F.array(p), lambda q: _map(w * h, lambda k: at(k, q)))[0]
    return p


def gradient(p: Column, w: int, h: int, axis: str) -> Column:
    """Central difference along rows ('y') or columns ('x'); zero on the border."""
    step = 1 if axis == "x" else w

    def at(k):
        inside = (k % w > 0) & (k % w < w - 1) & (k >= w) & (k < w * (h - 1))
        return F.when(inside, (F.get(p, _int(k + step)) - F.get(p, _int(k - step))) / 2).otherwise(0.0)

    return _map(w * h, at)


def halve(p: Column, w: int, h: int) -> Column:
    """One pyramid level: means of 2x2 blocks (at odd edges of what there is)."""
    nw, nh = (w + 1) // 2, (h + 1) // 2

    def at(k, q):
        x, y = 2 * (k % nw), 2 * _int(F.floor(k / nw))
        block = F.array(*(F.when((x + dx < w) & (y + dy < h), F.get(q, _int((y + dy) * w + x + dx))) for dy in (0, 1) for dx in (0, 1)))
        return F.aggregate(F.filter(block, lambda v: v.isNotNull()), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, v: F.struct((a["s"] + v).alias("s"), (a["n"] + 1).alias("n")), lambda a: a["s"] / a["n"])

    return F.transform(F.array(p), lambda q: _map(nw * nh, lambda k: at(k, q)))[0]


def pyramid(images: DataFrame, w: int, h: int, least: int = 50) -> DataFrame:
    """images (image_id, pixels) with all levels: halved until neither side is above least."""
    levels = [(0, w, h, F.col("pixels"))]
    while max(levels[-1][1:3]) > least:
        n, lw, lh, p = levels[-1]
        levels.append((n + 1, (lw + 1) // 2, (lh + 1) // 2, halve(p, lw, lh)))
    structs = F.array(*(F.struct(F.lit(n).alias("level"), F.lit(lw).alias("width"), F.lit(lh).alias("height"), p.alias("pixels")) for n, lw, lh, p in levels))
    return images.select("image_id", F.explode(structs).alias("l")).select("image_id", "l.*")


def total(p: Column) -> Column:
    """Sum in the array's order."""
    return F.aggregate(p, F.lit(0.0), lambda a, v: a + v)


def mean(p: Column, begin: int | None = None, end: int | None = None) -> Column:
    """Mean of all, or of positions begin..end, from 1 and inclusive."""
    p = p if begin is None else F.slice(p, begin, end - begin + 1)
    return total(p) / F.size(p)


def std(p: Column) -> Column:
    """Sample standard deviation; 0 for fewer than two values."""
    squares = lambda m: F.aggregate(p, F.lit(0.0), lambda a, v: a + (v - m) * (v - m))
    bound = F.transform(F.array(mean(p)), squares)[0]
    return F.when(F.size(p) < 2, 0.0).otherwise(F.sqrt(bound / (F.size(p) - 1)))


def norm(p: Column) -> Column:
    return F.sqrt(F.aggregate(p, F.lit(0.0), lambda a, v: a + v * v))


def standardise(p: Column, eps: float = 2.2204e-16) -> Column:
    return F.transform(F.array(F.struct(mean(p).alias("m"), std(p).alias("s"))), lambda b: F.transform(p, lambda v: (v - b["m"]) / (b["s"] + eps)))[0]


def argsort(p: Column) -> Column:
    """Positions from 1 in rising order of their values; ties by position."""
    pairs = F.transform(p, lambda v, i: F.struct(v.alias("v"), (i + 1).alias("i")))
    return F.transform(F.array_sort(pairs), lambda s: s["i"])


def laplacian_weight(p: Column, w: int, h: int) -> Column:
    """|(g - mean) / std - smoothed g| + 0.01: the standardised value against the smoothed raw one, as published."""
    b = F.transform(F.array(F.struct(mean(p).alias("m"), std(p).alias("s"), smooth(p, w, h).alias("q"))), lambda b: F.zip_with(p, b["q"], lambda v, q: F.abs((v - b["m"]) / b["s"] - q) + 0.01))
    return b[0]


def to_u8(p: Column) -> Column:
    """Floats to 0..255 by their range; a flat image has range 1 a step. Truncated."""
    low, high = F.array_min(p), F.array_max(p)
    step = F.when(high == low, 256.0).otherwise((high - low) / 256)
    return F.transform(p, lambda v: F.least(F.greatest(((v - low) / step).cast("int"), F.lit(0)), F.lit(255)))


def to_u8_lut(p: Column) -> Column:
    """16-bit values to 0..255 with the step cut to a whole number first (at least 1)."""
    low, high = F.array_min(p), F.array_max(p)
    step = F.greatest(F.lit(1), ((high - low) / 256).cast("int"))
    return F.transform(p, lambda v: F.least(F.greatest(((v - low) / step).cast("int"), F.lit(0)), F.lit(255)))


def to_depth(p: Column, bits: int) -> Column:
    """Linear rescale of the data's range to an unsigned depth; rounded down at half below."""
    low, high = F.array_min(p), F.array_max(p)
    top = 2**bits - 1
    return F.transform(p, lambda v: F.when(high == low, F.lit(0).cast("long")).otherwise(F.floor((v - low) / (high - low) * top + 0.5)))


def rgba(planes: list[Column], i: Column) -> Column:
    """One pixel as r, g, b, a: grey of one channel, (c0, c1, 0) of two, else the first three."""
    v = [F.get(p, i) for p in planes[:3]]
    r, g, b = (v * 3 if len(v) == 1 else [*v, F.lit(0.0)] if len(v) == 2 else v)
    return F.struct(r.alias("r"), g.alias("g"), b.alias("b"), F.lit(255).alias("a"))


def fuse(planes: list[Column], colours: list[tuple[float, float, float]]) -> Column:
    """Channels blended into r, g, b planes by weights."""
    zipped = F.arrays_zip(*planes)
    mixed = lambda z, k: sum((z[str(i)] * c[k] for i, c in enumerate(colours)), F.lit(0.0))
    return F.transform(zipped, lambda z: F.struct(*(mixed(z, k).alias(n) for k, n in enumerate("rgb"))))


def long_form(images: DataFrame, w: int) -> DataFrame:
    """One row a pixel: image_id, y, x, v."""
    out = images.select("image_id", F.posexplode("pixels").alias("p", "v"))
    return out.select("image_id", F.floor(F.col("p") / w).cast("int").alias("y"), (F.col("p") % w).alias("x"), "v")


def histogram(pixels: DataFrame, *keys: str) -> DataFrame:
    """Counts by value."""
    return pixels.groupBy(*keys, "v").agg(F.count("*").alias("n"))


def memory(width: Column, height: Column, samples: Column, depth: Column) -> Column:
    """Bytes of an image whose lines start at whole bytes."""
    return F.ceil(width * depth / 8) * height * samples


def structure(p: Column, w: int, h: int) -> Column:
    """Corner response: the smoothed image's gradients over 3x3 offsets, each weighted by its coherence with the centre."""
    eps = 2.2204e-16

    def response(b):
        gx, gy = b["gx"], b["gy"]

        def at(k):
            inside = (k % w > 0) & (k % w < w - 1) & (k >= w) & (k < w * (h - 1))
            own = lambda g, d=0: F.get(g, _int(k + d))
            offsets = F.array(*(F.lit(dy * w + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))

            def add(acc, d):
                px, py = F.get(gx, _int(k + d)), F.get(gy, _int(k + d))
                weight = F.greatest(F.lit(0.0), own(gx) * px + own(gy) * py)
                return F.struct((acc["a"] + weight * px * px).alias("a"), (acc["b"] + weight * px * py).alias("b"), (acc["c"] + weight * py * py).alias("c"))

            zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"))
            sums = F.aggregate(F.when(inside, offsets).otherwise(F.array().cast("array<int>")), zero, add, lambda t: F.abs(t["a"] * t["c"] - t["b"] * t["b"]) / (eps + F.sqrt(t["a"] * t["a"] + t["c"] * t["c"] + 2 * t["b"] * t["b"])) / F.sqrt(eps + t["a"] + t["c"]))
            return sums

        return _map(w * h, at)

    grads = F.transform(F.array(smooth(p, w, h)), lambda q: F.struct(gradient(q, w, h, "y").alias("gx"), gradient(q, w, h, "x").alias("gy")))
    return F.transform(grads, response)[0]

"""Feature matching and transform estimation.

Distances between feature sets are a join of the two tables, bounded by the number of points an image gives (the
point counts are parameters of the detector); nearest neighbours are found by aggregation, not by sorting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 2.2204e-16


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v)


def distances(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """(on, l, r, d): L1 distances of all pairs of points that share the keys on, such as an image pair. left and
    right: on, idx, f (features; of `patches` without the last two, as `registration` has it)."""
    a = left.select(*on, F.col("idx").alias("l"), F.col("f").alias("lf"))
    b = right.select(*on, F.col("idx").alias("r"), F.col("f").alias("rf"))
    return a.join(b, on).select(*on, "l", "r", F.round(l1(F.col("lf"), F.col("rf")), 6).alias("d"))


def mutual_nearest(d: DataFrame, on: list[str], limit: int) -> DataFrame:
    """Pairs in which each is the other's nearest (ties: lowest index), the nearest limit of each key."""
    best_r = d.groupBy(*on, "l").agg(F.min(F.struct("d", "r")).alias("m")).select(*on, "l", F.col("m.r").alias("r"), F.col("m.d").alias("d"))
    best_l = d.groupBy(*on, "r").agg(F.min(F.struct("d", "l")).alias("m")).select(*on, "r", F.col("m.l").alias("l"))
    pairs = best_r.join(best_l, [*on, "l", "r"])
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*on).orderBy("d", "l"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= limit)


def matches(d: DataFrame, on: list[str], limit: int) -> DataFrame:
    """As mutual_nearest, but where a key has fewer mutual pairs than half of the points asked for (limit, or the fewer of
    its two sides), each left point goes with its nearest instead."""
    from pyspark.sql import Window

    best_r = d.groupBy(*on, "l").agg(F.min(F.struct("d", "r")).alias("m")).select(*on, "l", F.col("m.r").alias("r"), F.col("m.d").alias("d"))
    best_l = d.groupBy(*on, "r").agg(F.min(F.struct("d", "l")).alias("m")).select(*on, "r", F.col("m.l").alias("back"))
    rights = best_l.groupBy(*on).agg(F.count("*").alias("rights"))
    key = Window.partitionBy(*on)
    pairs = best_r.join(best_l, [*on, "r"]).join(rights, on).withColumn("mutual", F.col("back") == F.col("l"))
    pairs = pairs.withColumn("points", F.least(F.lit(limit), F.count("*").over(key), F.col("rights")))
    pairs = pairs.withColumn("relaxed", F.sum(F.col("mutual").cast("int")).over(key) < F.floor(F.col("points") / 2)).where("mutual or relaxed")
    rank = F.row_number().over(key.orderBy("d", "l"))
    return pairs.withColumn("rank", rank).where("rank <= points").select(*on, "l", "r", "d", "rank", "relaxed")


def positional_match(a: DataFrame, b: DataFrame, on: list[str], limit: float = 5.0) -> DataFrame:
    """Points (on, x, y) of two lists joined by index, at an L1 distance under the limit."""
    d = F.abs(F.col("a.x") - F.col("b.x")) + F.abs(F.col("a.y") - F.col("b.y"))
    joined = a.alias("a").join(b.alias("b"), on)
    return joined.where(d < limit).select(*on, F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))


def grid_maxima(pixels: DataFrame, w: int, h: int, n: int) -> DataFrame:
    """Of each cell of the grid for n points, without its outer ring, the largest pixel (ties: first row, then column)."""
    cells = int(np.ceil(np.sqrt(n) + 2))
    lx, ly = max(1, w // cells), max(1, h // cells)
    cx, cy = F.floor(F.col("x") / lx).cast("int"), F.floor(F.col("y") / ly).cast("int")
    inside = pixels.withColumn("cx", cx).withColumn("cy", cy).where(F.col("cx").between(1, cells - 2) & F.col("cy").between(1, cells - 2))
    best = F.max(F.struct("v", (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))).alias("m")
    return inside.groupBy("image_id", "cy", "cx").agg(best).select("image_id", "cy", "cx", (-F.col("m.ny")).alias("y"), (-F.col("m.nx")).alias("x"), F.col("m.v").alias("v"))


def bilinear(pixels: DataFrame, points: DataFrame, w: int, h: int) -> DataFrame:
    """points (image_id, pid, px, py) with the interpolated value; points whose four neighbours aren't all inside are left
    out. The neighbours are joined by equality."""
    p = points.withColumn("x0", F.floor("px").cast("int")).withColumn("y0", F.floor("py").cast("int"))
    p = p.where(F.col("x0").between(0, w - 2) & F.col("y0").between(0, h - 2))
    ax, ay = F.col("px") - F.col("x0"), F.col("py") - F.col("y0")
    corners = F.array(*(F.struct((F.col("x0") + dx).alias("x"), (F.col("y0") + dy).alias("y"), ((ax if dx else 1 - ax) * (ay if dy else 1 - ay)).alias("weight")) for dy in (0, 1) for dx in (0, 1)))
    near = p.select("image_id", "pid", F.explode(corners).alias("c")).select("image_id", "pid", "c.*")
    return near.join(pixels, ["image_id", "x", "y"]).groupBy("image_id", "pid").agg(F.sum(F.col("weight") * F.col("v")).alias("v"))


def affine_point(x: Column, y: Column, m: tuple[float, ...]) -> tuple[Column, Column]:
    """(a x + b y + c, d x + e y + f)."""
    return m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of a stack of systems (k, n, n) and (k, n): LU with partial pivoting where the matrices allow, else the pseudo-inverse."""
    try:
        return np.linalg.solve(a, b[..., None])[..., 0]
    except np.linalg.LinAlgError:
        return np.stack([_solve_one(x, y) for x, y in zip(a, b, strict=True)])


def _solve_one(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(a) @ b


#: Parameters of each fit; the rows of its design come from a tie point.
FITS = {"affine": 6, "projective": 8, "rst": 4, "st": 3}


def design(kind: str, x: Column, y: Column, u: Column, v: Column) -> tuple[list, list]:
    """Two rows of the design matrix of a tie point (x, y) -> (u, v)."""
    one, nil = F.lit(1.0), F.lit(0.0)
    if kind == "affine":
        return [x, y, one, nil, nil, nil], [nil, nil, nil, x, y, one]
    if kind == "projective":
        return [x, y, one, nil, nil, nil, -u * x, -u * y], [nil, nil, nil, x, y, one, -v * x, -v * y]
    if kind == "rst":
        return [x, y, one, nil], [y, -x, nil, one]
    if kind == "st":
        return [x, one, nil], [y, nil, one]
    raise ValueError(kind)


def normal_equations(points: DataFrame, kind: str, key: str = "pair_id") -> DataFrame:
    """Sums of the normal equations of each key's tie points (x1, y1, x2, y2): plain sums, pre-aggregated."""
    x, y, u, v = (F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2"))
    rows = list(zip(design(kind, x, y, u, v), (u, v), strict=True))
    n = FITS[kind]
    terms = [F.sum(sum((r[i] * r[j] for r, _ in rows), F.lit(0.0))).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)]
    terms += [F.sum(sum((r[i] * t for r, t in rows), F.lit(0.0))).alias(f"b{i}") for i in range(n)]
    return points.groupBy(key).agg(F.count("*").alias("n_points"), *terms)


def fit(points: DataFrame, kind: str, key: str = "pair_id") -> DataFrame:
    """(key, n_points, params): least squares over each key's tie points; only the small solve is in numpy."""
    n = FITS[kind]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            a, b = np.zeros((len(f), n, n)), np.stack([f[f"b{i}"].to_numpy() for i in range(n)], 1)
            for i in range(n):
                for j in range(i, n):
                    a[:, i, j] = a[:, j, i] = f[f"a{i}_{j}"]
            yield pd.DataFrame({key: f[key], "n_points": f["n_points"], "params": list(solve(a, b))})

    sums = normal_equations(points, kind, key)
    return sums.mapInPandas(run, f"{key} {sums.schema[key].dataType.simpleString()}, n_points long, params array<double>")


def rst_of(params: Column) -> Column:
    """Scale, cosine, sine and shift from the four parameters."""
    r = F.sqrt(params[0] * params[0] + params[1] * params[1])
    return F.struct(r.alias("r"), (params[0] / r).alias("c"), (params[1] / r).alias("s"), params[2].alias("dx"), params[3].alias("dy"))


def sampling_stride(least_side: int) -> int:
    return next((s for limit, s in ((512, 16), (256, 8), (128, 4), (64, 2)) if least_side > limit), 1)


def fit_score(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """pairs: key, g, gg (null where the point maps outside) and the weights d, dd: twice the mean of the weighted
    differences of standardised values, 1e8 without overlap; and the overlap."""
    ok = pairs.where("gg is not null")
    s = ok.groupBy(key).agg(F.avg("g").alias("m"), F.coalesce(F.stddev_samp("g"), F.lit(0.0)).alias("s"), F.avg("gg").alias("mm"), F.coalesce(F.stddev_samp("gg"), F.lit(0.0)).alias("ss"))
    diff = F.abs((F.col("g") - F.col("m")) / (F.col("s") + EPS) - (F.col("gg") - F.col("mm")) / (F.col("ss") + EPS)) / (F.col("d") + F.col("dd"))
    out = pairs.join(s, key, "left").groupBy(key).agg(F.avg(F.when(F.col("gg").isNotNull(), diff)).alias("f"), (F.count("gg") / F.count("*")).alias("overlap"))
    return out.select(key, F.coalesce(2 * F.col("f"), F.lit(1e8)).alias("fit"), "overlap")


def patch(g: np.ndarray, y: int, x: int, wind: int) -> np.ndarray:
    """The patch around (y, x), turned so that its centre of intensity points along the first axis, standardised; then
    the cosine and sine of the turn. Positions are clamped to the image. Every row counts once, also for a patch of 3 x 3,
    where the published loops meet the first row twice."""
    return patch_stack(g[..., None], np.array([y]), np.array([x]), np.array([0]), wind)[0]


def patch_stack(g: np.ndarray, y: np.ndarray, x: np.ndarray, plane: np.ndarray, wind: int) -> np.ndarray:
    """The patches around points (y, x) of planes of a stack (h, w, planes), one row a point."""
    rows, cols = g.shape[:2]
    y, x = y[:, None], x[:, None]
    at = lambda i, j: g[np.clip(i, 0, rows - 1), np.clip(j, 0, cols - 1), plane[:, None]]
    along = np.arange(-wind, wind + 1)
    half = wind // 2
    wx = wy = np.zeros(len(y))
    for k in range(1, wind + 1):
        own = along if k <= max(half, 1) else along[k - half : len(along) - (k - half)]
        wx = wx + k * (at(y + k, x + own) - at(y - k, x + own)).sum(1)
        wy = wy + k * (at(y + own, x + k) - at(y + own, x - k)).sum(1)
    size = np.hypot(wx, wy) + EPS
    c, s = (wx / size)[:, None], (wy / size)[:, None]
    i, j = (t.ravel() for t in np.meshgrid(along, along, indexing="ij"))
    a, b = c * i - s * j, s * i + c * j
    fa, fb = np.floor(a).astype(int), np.floor(b).astype(int)
    da, db = a - fa, b - fb
    yy, xx, p = np.clip(y + fa, 0, rows - 2), np.clip(x + fb, 0, cols - 2), plane[:, None]
    v = (1 - da) * (1 - db) * g[yy, xx, p] + (1 - da) * db * g[yy, xx + 1, p] + da * (1 - db) * g[yy + 1, xx, p] + da * db * g[yy + 1, xx + 1, p]
    v = (v - v.mean(1, keepdims=True)) / (v.std(1, ddof=1, keepdims=True) + EPS)
    return np.concatenate([v, c, s], 1)


def patches(images: DataFrame, points: DataFrame, w: int, h: int, wind: int) -> DataFrame:
    """(image_id, idx, f): the patch features of points (image_id, idx, y, x) of images (image_id, pixels)."""
    listed = points.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("idx", "y", "x"))).alias("at"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for image_id, pixels, at in zip(f["image_id"], f["pixels"], f["at"], strict=True):
                g = np.asarray(pixels, float).reshape(h, w, 1)
                y, x = (np.array([p[c] for p in at]) for c in "yx")
                out += [(image_id, p["idx"], f) for p, f in zip(at, patch_stack(g, y, x, np.zeros(len(at), int), wind).tolist(), strict=True)]
            yield pd.DataFrame(out, columns=["image_id", "idx", "f"])

    return images.select("image_id", "pixels").join(listed, "image_id").mapInPandas(run, "image_id long, idx int, f array<double>")


def keep_better(first: DataFrame, second: DataFrame, key: str = "pair_id") -> DataFrame:
    """Of two fits (key, params, fit) the second only where its score is lower."""
    a, b = first.select(key, F.struct("params", "fit").alias("a")), second.select(key, F.struct("params", "fit").alias("b"))
    best = F.when(F.col("b.fit") < F.col("a.fit"), F.col("b")).otherwise(F.col("a"))
    return a.join(b, key).select(key, best.alias("m")).select(key, "m.params", "m.fit")

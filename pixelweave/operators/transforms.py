"""Chebyshev, Radon, wavelet and Fourier transforms of images in rows or in long form."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chebyshev_basis(n: int, size: int) -> list[list[float]]:
    """T_j at the nodes 2 (a + 1) / size - 1, as rows by node; constant terms, made once."""
    out = []
    for a in range(size):
        x = 2 * (a + 1) / size - 1
        out.append([1.0, *(math.cos(j * (math.acos(x) if abs(x) <= 1 else 0.0)) for j in range(1, n))])
    return out


def _table(spark, rows: list[list[float]], names: tuple[str, str]) -> DataFrame:
    """A small constant table (node, order, value) without Python on the executors."""
    flat = F.array(*(F.struct(F.lit(a).alias(names[0]), F.lit(j).alias(names[1]), F.lit(v).alias("t")) for a, r in enumerate(rows) for j, v in enumerate(r)))
    return spark.range(1).select(F.explode(flat).alias("b")).select("b.*")


def chebyshev_1d(values: Column, n: int, size: int) -> Column:
    """n coefficients of an array of size values: sums of f T_j k / size / 2, k being 1 for j = 0 and 2 after."""
    basis = chebyshev_basis(n, size)

    def one(j: int) -> Column:
        terms = F.array(*(F.lit(r[j] * (1 if j == 0 else 2) / size / 2) for r in basis))
        return F.aggregate(F.zip_with(values, terms, lambda f, t: f * t), F.lit(0.0), lambda s, v: s + v)

    return F.array(*(one(j) for j in range(n)))


def chebyshev_2d(pixels: DataFrame, n: int, w: int, h: int) -> DataFrame:
    """(image_id, jx, jy, c) from long-form pixels: rows, then columns, by two joins with constant bases."""
    spark = pixels.sparkSession
    bx = _table(spark, [[t * (1 if j == 0 else 2) / w / 2 for j, t in enumerate(r)] for r in chebyshev_basis(n, w)], ("x", "jx"))
    by = _table(spark, [[t * (1 if j == 0 else 2) / h / 2 for j, t in enumerate(r)] for r in chebyshev_basis(n, h)], ("y", "jy"))
    rows = pixels.join(F.broadcast(bx), "x").groupBy("image_id", "y", "jx").agg(F.sum(F.col("v") * F.col("t")).alias("v"))
    return rows.join(F.broadcast(by), "y").groupBy("image_id", "jx", "jy").agg(F.sum(F.col("v") * F.col("t")).alias("c"))


def radon(pixels: DataFrame, angles: list[float], width: int, height: int, x0: int, y0: int, r_first: int, r_size: int) -> DataFrame:
    """(image_id, angle, r, v): every pixel as four quarter pixels, each split linearly over two bins of its radius.

    Bins outside of r_first .. r_first + r_size - 1 are dropped. Positive y is up.
    """
    sub = [(sx, sy) for sx in (0, 1) for sy in (0, 1)]
    rays = F.array(*(F.struct(F.lit(float(a)).alias("angle"), F.lit(math.cos(math.radians(a))).alias("c"), F.lit(math.sin(math.radians(a))).alias("s"), F.lit(sx).alias("sx"), F.lit(sy).alias("sy")) for a in angles for sx, sy in sub))
    parts = pixels.where("v <> 0").select("image_id", "x", "y", "v", F.explode(rays).alias("q"))
    px = F.lit(-x0 - 0.25) + 0.5 * (2 * F.col("x") + F.col("q.sx"))
    py = F.lit(-y0 - 0.25) + 0.5 * (2 * height - 1 - (2 * F.col("y") + F.col("q.sy")))
    placed = parts.select("image_id", F.col("q.angle").alias("angle"), (F.col("v") * 0.25).alias("m"), (px * F.col("q.c") - r_first + py * F.col("q.s")).alias("at"))
    low = F.col("at").cast("int")  # truncates
    share = F.col("m") * (1 - F.col("at") + low)
    bins = F.array(F.struct(low.alias("r"), share.alias("v")), F.struct((low + 1).alias("r"), (F.col("m") - share).alias("v")))
    split = placed.select("image_id", "angle", F.explode(bins).alias("b")).select("image_id", "angle", "b.*")
    return split.where(F.col("r").between(0, r_size - 1)).groupBy("image_id", "angle", "r").agg(F.sum("v").alias("v"))


#: Fixed value: the order of the 12 Radon texture measures.
TEXTURE_ORDER = (0, 1, 2, 9, 10, 11, 3, 4, 5, 6, 7, 8)


def radon_texture(v: Column) -> Column:
    return F.transform(F.array(*map(F.lit, TEXTURE_ORDER)), lambda i: F.get(v, i))


#: Published filter banks (analysis low, analysis high, synthesis low, synthesis high).
BANKS = {
    "bior3.1": (
        (-0.35355339059327379, 1.0606601717798214, 1.0606601717798214, -0.35355339059327379),
        (-0.17677669529663689, 0.53033008588991071, -0.53033008588991071, 0.17677669529663689),
        (0.17677669529663689, 0.53033008588991071, 0.53033008588991071, 0.17677669529663689),
        (-0.35355339059327379, -1.0606601717798214, 1.0606601717798214, 0.35355339059327379),
    ),
    "bior5.5": (
        (0, 0, 0.03968708834741, 0.00794810863724, -0.05446378846824, 0.34560528195603, 0.73666018142821, 0.34560528195603, -0.05446378846824, 0.00794810863724, 0.03968708834741, 0),
        (-0.01345670945912, -0.00269496688011, 0.13670658466433, -0.09350469740094, -0.47680326579848, 0.89950610974865, -0.47680326579848, -0.09350469740094, 0.13670658466433, -0.00269496688011, -0.01345670945912, 0),
        (0.01345670945912, -0.00269496688011, -0.13670658466433, -0.09350469740094, 0.47680326579848, 0.89950610974865, 0.47680326579848, -0.09350469740094, -0.13670658466433, -0.00269496688011, 0.01345670945912, 0),
        (0, 0, 0.03968708834741, -0.00794810863724, -0.05446378846824, -0.34560528195603, 0.73666018142821, -0.34560528195603, -0.05446378846824, -0.00794810863724, 0.03968708834741, 0),
    ),
    "sym5": (
        (0.027333068345077982, 0.029519490925774643, -0.039134249302383094, 0.1993975339773936, 0.72340769040242059, 0.63397896345821192, 0.016602105764522319, -0.17532808990845047, -0.021101834024758855, 0.019538882735286728),
        (-0.019538882735286728, -0.021101834024758855, 0.17532808990845047, 0.016602105764522319, -0.63397896345821192, 0.72340769040242059, -0.1993975339773936, -0.039134249302383094, -0.029519490925774643, 0.027333068345077982),
        (0.019538882735286728, -0.021101834024758855, -0.17532808990845047, 0.016602105764522319, 0.63397896345821192, 0.72340769040242059, 0.1993975339773936, -0.039134249302383094, 0.029519490925774643, 0.027333068345077982),
        (0.027333068345077982, -0.029519490925774643, -0.039134249302383094, -0.1993975339773936, 0.72340769040242059, -0.63397896345821192, 0.016602105764522319, 0.17532808990845047, -0.021101834024758855, -0.019538882735286728),
    ),
}
#: Limits below which coefficients are set to zero.
LIMITS = {"bior3.1": 1e-4, "bior3.1 fine": 1e-5, "bior5.5": 1e-7, "sym5": 1e-4}
MODES = ("zeropad", "symmetric", "asymmetric", "constant edge", "smooth", "periodic", "periodization")


def dwt_length(n: int, taps: int, mode: str = "zeropad") -> int:
    return math.ceil(n / 2) if mode == "periodization" else (n + taps - 1) // 2


def max_level(n: int, taps: int | None = None) -> int:
    """Of the stationary transform floor(log2 n); with taps, of the decimated one."""
    return int(math.log2(n)) if taps is None else max(0, int(math.log2(n / (taps - 1)))) if n >= taps - 1 > 0 else 0


def extended(v: Column, n: int, i: Column, mode: str) -> Column:
    """The value at position i of a signal of n values continued beyond its ends."""
    at = lambda k: F.get(v, k.cast("int"))
    inside = (i >= 0) & (i < n)
    if mode == "zeropad":
        return F.when(inside, at(i)).otherwise(0.0)
    if mode == "constant edge":
        return at(F.least(F.greatest(i, F.lit(0)), F.lit(n - 1)))
    if mode in ("periodic", "periodization"):
        return at(F.pmod(i, F.lit(n)))
    if mode in ("symmetric", "asymmetric"):
        k = F.pmod(i, F.lit(2 * n))
        value = at(F.when(k < n, k).otherwise(2 * n - 1 - k))
        odd = F.pmod(F.floor(i / n), F.lit(2)) == 1
        return F.when(odd & F.lit(mode == "asymmetric"), -value).otherwise(value)
    if mode == "smooth":
        first, last = at(F.lit(0)), at(F.lit(n - 1))
        down, up = first - at(F.lit(min(1, n - 1))), last - at(F.lit(max(0, n - 2)))
        return F.when(inside, at(i)).when(i < 0, first - i * down).otherwise(last + (i - n + 1) * up)
    raise ValueError(mode)


def analyse(v: Column, n: int, taps: tuple[float, ...], mode: str = "zeropad") -> Column:
    """One half of a DWT step: the convolution at every second position."""
    shift = len(taps) // 2 if mode == "periodization" else 1
    coeffs = F.array(*(F.lit(float(t)) for t in taps))
    one = lambda o, b: F.aggregate(F.transform(coeffs, lambda c, k: c * extended(b, n, 2 * o + shift - k, mode)), F.lit(0.0), lambda a, x: a + x)
    # The signal is bound once, so that nested steps don't multiply the expression.
    return F.transform(F.array(v), lambda b: F.transform(F.sequence(F.lit(0), F.lit(dwt_length(n, len(taps), mode) - 1)), lambda o: one(o, b)))[0]


def dwt(v: Column, n: int, bank: str, mode: str = "zeropad") -> tuple[Column, Column]:
    low, high, *_ = BANKS[bank]
    return analyse(v, n, low, mode), analyse(v, n, high, mode)


def synthesise(low: Column, high: Column, m: int, bank: str) -> Column:
    """The signal from the two halves of m values each, of any mode but periodization: 2 m - taps + 2 values."""
    taps_low, taps_high = (F.array(*(F.lit(float(t)) for t in b)) for b in BANKS[bank][2:])
    f = len(BANKS[bank][2])

    def one(o):
        # Values between the coefficients are zero: only every second tap meets one.
        def term(c, k, taps):
            i = o + f - 2 - k
            return F.when((F.pmod(i, F.lit(2)) == 0) & (i >= 0) & (i < 2 * m), F.get(taps, k) * F.get(c, F.floor(i / 2).cast("int"))).otherwise(0.0)

        ks = F.sequence(F.lit(0), F.lit(f - 1))
        return F.aggregate(F.transform(ks, lambda k: term(low, k, taps_low) + term(high, k, taps_high)), F.lit(0.0), lambda a, x: a + x)

    return F.transform(F.sequence(F.lit(0), F.lit(2 * m - f + 1)), one)


def dwt_2d(v: Column, w: int, h: int, bank: str, mode: str = "zeropad") -> dict[str, Column]:
    """Four bands of a 2-D step, row-major: rows first, then columns."""

    def step(p: Column, width: int, height: int, taps) -> tuple[Column, int]:
        n = dwt_length(width, len(taps), mode)
        rows = lambda b: F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda y: analyse(F.slice(b, y * width + 1, F.lit(width)), width, taps, mode))
        return F.transform(F.array(p), lambda b: F.flatten(rows(b)))[0], n

    def turned(p: Column, width: int, height: int) -> Column:
        at = lambda b: F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda k: F.get(b, ((k % height) * width + F.floor(k / height)).cast("int")))
        return F.transform(F.array(p), at)[0]

    out = {}
    for a, taps_x in zip("LH", BANKS[bank][:2], strict=True):
        rows, nw = step(v, w, h, taps_x)
        for b, taps_y in zip("LH", BANKS[bank][:2], strict=True):
            columns, nh = step(turned(rows, nw, h), h, nw, taps_y)
            out[a + b] = turned(columns, nh, nw)
    return out


def fft_2d(images: DataFrame, w: int, h: int) -> DataFrame:
    """(image_id, ky, kx, re, im) of each image, by numpy."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ky, kx = (a.ravel() for a in np.mgrid[0:h, 0:w])
        for f in frames:
            for i, p in zip(f["image_id"], f["pixels"], strict=True):
                z = np.fft.fft2(np.asarray(p, float).reshape(h, w)).ravel()
                yield pd.DataFrame({"image_id": i, "ky": ky, "kx": kx, "re": z.real, "im": z.imag})

    return images.select("image_id", "pixels").mapInPandas(run, "image_id long, ky int, kx int, re double, im double")


def fast_chebyshev(values: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Chebyshev coefficients from values at the Gauss-Lobatto points along the first axis, by a real FFT; and back."""
    n = len(values) - 1
    if inverse:
        c = values.astype(float).copy()
        c[1:n] /= 2
        return np.fft.fft(np.concatenate([c, c[n - 1 : 0 : -1]]), axis=0).real[: n + 1]
    c = np.fft.fft(np.concatenate([values, values[n - 1 : 0 : -1]]), axis=0).real[: n + 1] / n
    c[[0, n]] /= 2
    return c


def fast_chebyshev_2d(images: DataFrame, w: int, h: int, inverse: bool = False) -> DataFrame:
    """(image_id, pixels) transformed along both axes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [fast_chebyshev(fast_chebyshev(np.asarray(p, float).reshape(h, w), inverse).T, inverse).T.ravel().tolist() for p in f["pixels"]]
            yield pd.DataFrame({"image_id": f["image_id"], "pixels": out})

    return images.select("image_id", "pixels").mapInPandas(run, "image_id long, pixels array<double>")

"""Wavelet transforms of several levels in one, two or three dimensions, with thresholds and their inverse, in numpy.

A step filters along every axis and keeps every second value; the band that is low along all axes goes on to the next
level. `denoised` runs it over a table of planes: transform, zero the coefficients below the bank's limit, transform back.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame

from . import planes
from .transforms import BANKS, LIMITS, dwt_length, max_level

Bands = dict[str, np.ndarray]


def continued(n: int, i: np.ndarray, mode: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions within a signal of n values that stand for the positions i of its continuation, and their factors."""
    if mode == "constant edge":
        return np.clip(i, 0, n - 1), np.ones(len(i))
    if mode in ("periodic", "periodization"):
        return i % n, np.ones(len(i))
    if mode in ("symmetric", "asymmetric"):
        k = i % (2 * n)
        odd = (i // n) % 2 == 1
        return np.where(k < n, k, 2 * n - 1 - k), np.where(odd & (mode == "asymmetric"), -1.0, 1.0)
    return np.clip(i, 0, n - 1), ((i >= 0) & (i < n)).astype(float)


def analysed(v: np.ndarray, taps: tuple[float, ...], mode: str) -> np.ndarray:
    """One half of a step along the first axis."""
    n, shift = len(v), len(taps) // 2 if mode == "periodization" else 1
    places = 2 * np.arange(dwt_length(n, len(taps), mode)) + shift
    out = np.zeros((len(places), *v.shape[1:]))
    wide = (-1, *[1] * (v.ndim - 1))
    for k, tap in enumerate(taps):
        i = places - k
        at, factor = continued(n, i, mode)
        part = v[at] * factor.reshape(wide)
        if mode == "smooth":  # straight lines on at both ends
            first, last = v[0] - v[min(1, n - 1)], v[-1] - v[max(0, n - 2)]
            part = np.where((i < 0).reshape(wide), v[0] - i.reshape(wide) * first, part)
            part = np.where((i >= n).reshape(wide), v[-1] + (i - n + 1).reshape(wide) * last, part)
        out += tap * part
    return out


def synthesised(low: np.ndarray, high: np.ndarray, bank: str, mode: str = "zeropad") -> np.ndarray:
    """The signal along the first axis from the two halves of a step."""
    taps, m = BANKS[bank][2:], len(low)
    f = len(taps[0])
    whole = np.zeros((2 * m + f - 2 + f % 2, *low.shape[1:]))
    for half, t in ((low, taps[0]), (high, taps[1])):
        for k, tap in enumerate(t):
            whole[k : k + 2 * m : 2] += tap * half
    if mode != "periodization":
        return whole[f - 2 : 2 * m]
    # What stands beyond the ends wraps around.
    out, start = np.zeros((2 * m, *low.shape[1:])), f // 2 - 1
    np.add.at(out, (np.arange(len(whole)) - start) % (2 * m), whole)
    return out


def step(v: np.ndarray, bank: str, mode: str = "zeropad") -> Bands:
    """All bands of one step, named by L and H along each axis in turn."""
    bands = {"": v}
    for axis in range(v.ndim):
        bands = {name + half: np.moveaxis(analysed(np.moveaxis(b, axis, 0), taps, mode), 0, axis) for name, b in bands.items() for half, taps in zip("LH", BANKS[bank][:2], strict=True)}
    return bands


def unstep(bands: Bands, shape: tuple[int, ...], bank: str, mode: str = "zeropad") -> np.ndarray:
    """The array of a shape from its bands."""
    for axis in reversed(range(len(shape))):
        names = ["".join(x) for x in product("LH", repeat=axis)]
        pairs = {name: [np.moveaxis(bands[name + half], axis, 0) for half in "LH"] for name in names}
        bands = {name: np.moveaxis(synthesised(*pair, bank, mode)[: shape[axis]], 0, axis) for name, pair in pairs.items()}
    return bands[""]


def transform(v: np.ndarray, bank: str, levels: int | None = None, mode: str = "zeropad") -> tuple[np.ndarray, list[tuple[tuple[int, ...], Bands]]]:
    """The lowest band and, from the first level on, each level's shape and other bands. levels: as many as make sense by default."""
    levels = max(1, min(max_level(n, len(BANKS[bank][0])) for n in v.shape)) if levels is None else levels
    found = []
    for _ in range(levels):
        bands = step(v, bank, mode)
        found.append((v.shape, {k: b for k, b in bands.items() if "H" in k}))
        v = bands["L" * v.ndim]
    return v, found


def inverse(low: np.ndarray, levels: list[tuple[tuple[int, ...], Bands]], bank: str, mode: str = "zeropad") -> np.ndarray:
    for shape, bands in reversed(levels):
        low = unstep({"L" * len(shape): low, **bands}, shape, bank, mode)
    return low


def thresholded(levels: list[tuple[tuple[int, ...], Bands]], limit: float) -> list[tuple[tuple[int, ...], Bands]]:
    """The bands with what is below the limit in size set to zero."""
    return [(shape, {k: np.where(np.abs(b) < limit, 0.0, b) for k, b in bands.items()}) for shape, bands in levels]


def denoised(images: DataFrame, bank: str = "sym5", limit: float | None = None, levels: int | None = None, mode: str = "symmetric") -> DataFrame:
    """images (width, height, pixels, ...) with every plane transformed, thresholded (by the bank's own limit if none is given)
    and transformed back."""
    least = LIMITS[bank] if limit is None else limit

    def run(g: np.ndarray) -> np.ndarray:
        low, found = transform(g, bank, levels, mode)
        return inverse(low, thresholded(found, least), bank, mode)

    return planes.mapped(images, run)

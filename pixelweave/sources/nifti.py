"""NIfTI-1 and NIfTI-2 volumes in one file, gzipped or not, by the published definition: planes by (t, z) and channel, and the
affine map from voxels to the world by matrix, quaternion or spacing alone."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Container, Iterator
from typing import NamedTuple

import numpy as np

#: numpy's codes of the data types; colours are bytes side by side.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8", 128: "u1", 2304: "u1"}
COLOURS = {128: 3, 2304: 4}
#: Names of the intents and of the world's axes that are used most.
INTENTS = {0: "none", 2: "correlation", 3: "t-test", 4: "f-test", 5: "z-score", 1001: "estimate", 1002: "label", 1003: "neuroname", 1004: "matrix", 1005: "symmetric matrix", 1006: "displacement", 1007: "vector", 1008: "point set", 1009: "triangle", 1010: "quaternion"}
SPACES = {0: "unknown", 1: "scanner", 2: "aligned", 3: "talairach", 4: "mni 152"}
UNITS = {0: "", 1: "m", 2: "mm", 3: "um"}
TIMES = {0: "", 8: "s", 16: "ms", 24: "us", 32: "hz", 40: "ppm", 48: "rad/s"}


class Header(NamedTuple):
    order: str
    dims: tuple[int, ...]
    kind: int
    offset: int
    slope: float
    shift: float
    spacing: tuple[float, ...]
    qform: int
    sform: int
    quaternion: tuple[float, ...]
    rows: tuple[float, ...]
    intent: int
    units: int
    description: str


def is_nifti(head: bytes) -> bool:
    return head[344:348] == b"n+1\0" or head[4:8] == b"n+2\0"


def header(data: bytes) -> Header:
    if data[4:8] == b"n+2\0":
        order = "<" if struct.unpack_from("<i", data, 0)[0] == 540 else ">"
        (kind,) = struct.unpack_from(order + "h", data, 12)
        dims, (offset,) = struct.unpack_from(order + "8q", data, 16), struct.unpack_from(order + "q", data, 168)
        spacing, (slope, shift) = struct.unpack_from(order + "8d", data, 104), struct.unpack_from(order + "2d", data, 176)
        description, (qform, sform) = data[240:320], struct.unpack_from(order + "2i", data, 344)
        quaternion, rows = struct.unpack_from(order + "6d", data, 352), struct.unpack_from(order + "12d", data, 400)
        (units,), (intent,) = struct.unpack_from(order + "i", data, 500), struct.unpack_from(order + "i", data, 504)
    elif data[344:348] == b"n+1\0":
        order = "<" if struct.unpack_from("<i", data, 0)[0] == 348 else ">"
        dims, (intent, kind) = struct.unpack_from(order + "8h", data, 40), struct.unpack_from(order + "2h", data, 68)
        spacing, (offset, slope, shift) = struct.unpack_from(order + "8f", data, 76), struct.unpack_from(order + "3f", data, 108)
        units, description = data[123], data[148:228]
        qform, sform = struct.unpack_from(order + "2h", data, 252)
        quaternion, rows = struct.unpack_from(order + "6f", data, 256), struct.unpack_from(order + "12f", data, 280)
    else:
        raise ValueError("no NIfTI file")
    if not 1 <= dims[0] <= 7 or any(n < 1 for n in dims[1 : dims[0] + 1]):
        raise ValueError(f"dimensions {dims}")
    if kind not in TYPES:
        raise ValueError(f"data type {kind}")
    sizes = (*dims[1 : dims[0] + 1], *[1] * (7 - dims[0]))
    return Header(order, sizes, kind, int(offset), slope, shift, spacing, qform, sform, quaternion, rows, intent, units, description.split(b"\0")[0].decode("latin-1"))


def affine(h: Header) -> np.ndarray:
    """4 x 4, from (column, row, slice) to the world: the matrix if there is one, else the quaternion, else the spacing."""
    out = np.eye(4)
    if h.sform > 0:
        out[:3] = np.array(h.rows).reshape(3, 4)
        return out
    if h.qform > 0:
        b, c, d, *shift = h.quaternion
        a2 = 1 - (b * b + c * c + d * d)
        if a2 < 1e-7:  # half a turn: the axis alone counts
            n = (b * b + c * c + d * d) ** 0.5
            a, b, c, d = 0.0, b / n, c / n, d / n
        else:
            a = a2**0.5
        turn = np.array([
            [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
            [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
            [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
        ])
        flip = -1.0 if h.spacing[0] < 0 else 1.0
        out[:3, :3] = turn * np.array([h.spacing[1], h.spacing[2], h.spacing[3] * flip])
        out[:3, 3] = shift
        return out
    out[[0, 1, 2], [0, 1, 2]] = h.spacing[1:4]
    return out


def unzipped(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def tags(data: bytes) -> dict[str, str]:
    h = header(unzipped(data))
    m = affine(h)
    out = {"dims": ",".join(map(str, h.dims)), "spacing": ",".join(f"{x:g}" for x in h.spacing[1:8]), "units": UNITS.get(h.units & 7, ""), "time_units": TIMES.get(h.units & 56, "")}
    out |= {"intent": INTENTS.get(h.intent, str(h.intent)), "space": SPACES.get(h.sform or h.qform, ""), "description": h.description, "slope": f"{h.slope:g}", "intercept": f"{h.shift:g}"}
    return out | {"affine": ",".join(f"{x:.9g}" for x in m[:3].ravel())}


def read_nifti(data: bytes, pages: Container[int] | None = None, rescale: bool = True) -> Iterator:
    """Planes: page t * slices + z, channels the dimensions from the fifth on, or the colours. A slope of 0 means none."""
    from .codecs import Plane

    data = unzipped(data)
    h = header(data)
    (w, high, nz, nt, *rest), colours = h.dims, COLOURS.get(h.kind, 1)
    t = np.dtype(h.order + TYPES[h.kind])
    channels, size = int(np.prod(rest)), w * high * colours
    if h.offset + size * nz * nt * channels * t.itemsize > len(data):
        raise ValueError("voxels are cut off")
    scaled = rescale and np.isfinite(h.slope) and h.slope != 0 and (h.slope, h.shift) != (1, 0)
    name = "float" if scaled or t.kind == "f" else {"u": "unsigned", "i": "signed"}[t.kind]
    for page in range(nt * nz):
        if pages is not None and page not in pages:
            continue
        for c in range(channels):
            at = h.offset + (c * nt * nz + page) * size * t.itemsize
            v = np.frombuffer(data, t, size, at).reshape(high, w, colours).astype(float)
            v = v * h.slope + h.shift if scaled else v
            for k in range(colours):
                yield Plane(page, c * colours + k, w, high, t.itemsize * 8, name, np.ascontiguousarray(v[:, :, k]).ravel())

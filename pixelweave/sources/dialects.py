"""Private layouts of TIFF files that microscopes write: MetaMorph stacks (STK), Zeiss LSM, Olympus Fluoview, and PSIA atomic force
images. Their packed headers become dimensions, and pages become planes by time, depth and channel.

A STK has one directory for all its planes, which lie one after the other; an LSM has a thumbnail behind every page; Fluoview's pages
run through the dimensions that its header lists.
"""

from __future__ import annotations

import struct
from collections.abc import Container, Iterator
from typing import NamedTuple

import numpy as np

from . import tiff

#: The tags, and the beginnings of the headers.
STK_PLANES, STK_MORE, FLUOVIEW, LSM, PSIA_DATA, PSIA_HEADER = 33629, 33628, 34361, 34412, 50434, 50435
LSM_MAGIC = (0x00300494C, 0x00400494C)
#: Places in the PSIA header.
PSIA = {"source": (4, "64s"), "mode": (68, "16s"), "width": (100, "i"), "height": (104, "i"), "x_size": (140, "d"), "y_size": (148, "d"), "scan_rate": (172, "d"), "gain": (220, "d"), "z_scale": (228, "d"), "z_offset": (236, "d"), "unit": (244, "16s"), "least": (260, "i"), "most": (264, "i")}
THUMBNAIL = 1


class Layout(NamedTuple):
    kind: str
    nt: int
    nz: int
    nc: int
    #: x, y, z in micrometres and t in seconds; 0 where the file doesn't tell.
    resolution: tuple[float, float, float, float]
    #: Dimensions of the pages from the fastest to the slowest, of z, t and c.
    order: tuple[tuple[str, int], ...]
    more: dict[str, str]


def layout(data: bytes, pages: list[tiff.Page]) -> Layout:
    """The dialect of a file by its first page, and what its header says; plain files are pages of z."""
    first = pages[0]
    if STK_PLANES in first.tags:
        return _stk(data, first)
    if LSM in first.tags:
        return _lsm(data, first, sum(p.one(tiff.SUBFILE, 0) != THUMBNAIL and p.level == 0 for p in pages))
    if FLUOVIEW in first.tags:
        return _fluoview(data, first)
    if PSIA_HEADER in first.tags:
        return _psia(data, first)
    n = sum(p.level == 0 for p in pages)
    return Layout("tiff", 1, n, first.one(tiff.SAMPLES, 1), (0.0,) * 4, (("z", n),), {})


def _stk(data: bytes, page: tiff.Page) -> Layout:
    """Six numbers a plane: distance as a fraction, then days and milliseconds of making and of change."""
    n, at = len(page.tags[STK_PLANES]), page.places[STK_PLANES]
    if at + 24 * n > len(data):
        raise ValueError("the planes' table is cut off")
    rows = np.frombuffer(data, page.order + "u4", 6 * n, at).reshape(n, 6)
    steps = [int(a) / int(b) if b else 0.0 for a, b in rows[:, :2]]
    made = [int(d) * 86_400_000 + int(t) for d, t in rows[:, 2:4]]
    # planes at one height follow each other in time
    apart = len(set(steps[1:])) == 1 and steps[-1] != 0 if n > 1 else True
    seconds = (made[-1] - made[0]) / 1000 / (n - 1) if n > 1 else 0.0
    nz, nt = (n, 1) if apart else (1, n)
    return Layout("stk", nt, nz, 1, (0.0, 0.0, steps[-1] if apart and n > 1 else 0.0, 0.0 if apart else seconds), (("z", nz), ("t", nt)), {"planes": str(n)})


def _lsm(data: bytes, page: tiff.Page, pages: int) -> Layout:
    at, order = page.places[LSM], page.order
    magic, _, _, _, nz, nc, nt = struct.unpack_from(order + "Iiiiiii", data, at)
    if magic not in LSM_MAGIC:
        raise ValueError("no LSM header")
    x, y, z = struct.unpack_from(order + "3d", data, at + 40)
    nz, nt, nc = max(1, nz), max(1, nt), max(1, nc)
    if nz * nt != pages:
        raise ValueError(f"{pages} pages for {nz} slices at {nt} times")
    return Layout("lsm", nt, nz, nc, (x * 1e6, y * 1e6, z * 1e6, 0.0), (("z", nz), ("t", nt)), {})


def _fluoview(data: bytes, page: tiff.Page) -> Layout:
    """Ten dimensions of 100 bytes behind the image's name: name, size, origin, resolution, unit."""
    at, order = page.places[FLUOVIEW], page.order
    text = lambda raw: raw.split(b"\0")[0].decode("latin-1").strip()
    name = text(data[at + 3 : at + 259])
    size, steps, listed = {}, {}, []
    for k in range(10):
        d = at + 284 + 100 * k
        axis, (n, _, step) = text(data[d : d + 16]), struct.unpack_from(order + "Idd", data, d + 16)
        short = {"x": "x", "y": "y", "z": "z", "time": "t", "t": "t", "ch": "c", "channel": "c", "wavelength": "c"}.get(axis.lower())
        if short and n > 0 and short not in size:
            size[short], steps[short] = n, step
            if short in "ztc":
                listed.append((short, n))
    more = {"name": name} | {f"unit_{k}": "um" for k in "xyz" if k in steps}
    of = lambda k, usual=1: size.get(k, usual)
    return Layout("fluoview", of("t"), of("z"), of("c"), (steps.get("x", 0.0), steps.get("y", 0.0), steps.get("z", 0.0), steps.get("t", 0.0)), tuple(listed), more)


def _psia(data: bytes, page: tiff.Page) -> Layout:
    at, more = page.places[PSIA_HEADER], {}
    size = len(page.tags[PSIA_HEADER])
    for name, (offset, kind) in PSIA.items():
        if offset + struct.calcsize(kind) > size:
            raise ValueError("the header is cut off")
        (v,) = struct.unpack_from(page.order + kind, data, at + offset)
        more[name] = v.decode("utf-16-le", "replace").split("\0")[0] if isinstance(v, bytes) else f"{v:g}" if isinstance(v, float) else str(v)
    w, h = int(more["width"]), int(more["height"])
    per = lambda whole, n: float(whole) / n if n else 0.0
    return Layout("psia", 1, 1, 1, (per(more["x_size"], w), per(more["y_size"], h), 0.0, 0.0), (("z", 1),), more)


def tags(data: bytes) -> dict[str, str]:
    """Dimensions and resolutions of a file, and what else its header says."""
    lay = layout(data, _pages(data))
    out = {"dialect": lay.kind, "num_t": str(lay.nt), "num_z": str(lay.nz), "num_c": str(lay.nc), "order": "".join(k for k, _ in lay.order)}
    return out | {f"resolution_{k}": f"{v:.9g}" for k, v in zip("xyzt", lay.resolution, strict=True)} | lay.more


def _pages(data: bytes) -> list[tiff.Page]:
    pages = list(tiff.directories(data))
    if not pages:
        raise ValueError("no page")
    return pages


def _places(order: tuple[tuple[str, int], ...]) -> Iterator[dict[str, int]]:
    """Positions of the pages one after the other, the first dimension running fastest."""
    total = int(np.prod([n for _, n in order], dtype=np.int64)) if order else 1
    for k in range(total):
        out, rest = {}, k
        for name, n in order:
            rest, out[name] = divmod(rest, n)
        yield out


def read_microscope(data: bytes, pages: Container[int] | None = None) -> Iterator:
    """Planes with page = t * slices + z and the channel, in the file's order; only the pages asked for are decoded."""
    from .codecs import Plane, _planes

    listed = _pages(data)
    lay = layout(data, listed)
    if lay.kind == "stk":
        first = listed[0]
        w, h = first.one(tiff.WIDTH, 0), first.one(tiff.HEIGHT, 0)
        offsets, sizes = first.tags[tiff.STRIPS], first.tags[tiff.STRIP_BYTES]
        if first.one(tiff.COMPRESSION, tiff.NONE) != tiff.NONE:
            raise ValueError("coded planes of a stack have no place")
        step = offsets[-1] + sizes[-1] - offsets[0]
        for k, at in enumerate(_places(lay.order)):
            page = at["t"] * lay.nz + at["z"]
            if pages is None or page in pages:
                moved = tiff.Page(k, 0, first.order, first.tags | {tiff.STRIPS: tuple(x + k * step for x in offsets)})
                if offsets[0] + (k + 1) * step > len(data):
                    raise ValueError(f"plane {k} is cut off")
                values, bits, kind = tiff.pixels(data, moved)
                yield from (p._replace(width=w, height=h) for p in _planes(page, values, bits, kind))
        return
    if lay.kind == "psia":
        first = listed[0]
        w, h = int(lay.more["width"]), int(lay.more["height"])
        at, n = first.places[PSIA_DATA], len(first.tags[PSIA_DATA])
        if n < 2 * w * h:
            raise ValueError("the image is cut off")
        v = np.frombuffer(data, first.order + "i2", w * h, at).astype(float).reshape(h, w)[::-1]  # from the bottom up
        if pages is None or 0 in pages:
            gain, scale, shift = (float(lay.more[k]) for k in ("gain", "z_scale", "z_offset"))
            yield Plane(0, 0, w, h, 16, "float", np.ascontiguousarray(v * (gain or 1) * (scale or 1) + shift).ravel())
        return
    full = [p for p in listed if p.level == 0 and p.one(tiff.SUBFILE, 0) != THUMBNAIL]
    places = list(_places(lay.order))
    if len(places) > len(full):
        raise ValueError(f"{len(full)} pages for {len(places)} places")
    for p, at in zip(full, places, strict=False):
        page = at.get("t", 0) * lay.nz + at.get("z", 0)
        if pages is None or page in pages:
            values, bits, kind = tiff.pixels(data, p)
            for plane in _planes(page, values, bits, kind):
                yield plane._replace(channel=plane.channel + at.get("c", 0) * values.shape[2])

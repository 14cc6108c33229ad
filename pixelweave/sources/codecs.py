"""Decoders and encoders of the formats that need no library: planes in, planes out.

A decoded page is (page, channel, width, height, depth, pixel_format, pixels), pixels row-major from the top.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np


class Plane(NamedTuple):
    page: int
    channel: int
    width: int
    height: int
    depth: int
    pixel_format: str
    pixels: np.ndarray


def _planes(page: int, data: np.ndarray, depth: int, kind: str = "unsigned") -> Iterator[Plane]:
    """Planes of an array (height, width, channels)."""
    h, w, c = data.shape
    for i in range(c):
        yield Plane(page, i, w, h, depth, kind, data[:, :, i].astype(float).ravel())


def _rle(data: bytes, w: int, h: int, nibbles: bool) -> np.ndarray:
    """Run-length coded rows of a bitmap, from the bottom."""
    out, x, y, i = np.zeros((h, w), np.uint8), 0, 0, 0
    while i + 1 < len(data):
        n, v = data[i], data[i + 1]
        i += 2
        if n:
            run = np.array([v >> 4, v & 15] * ((n + 1) // 2) if nibbles else [v] * n, np.uint8)[:n]
        elif v == 0:
            x, y = 0, y + 1
            continue
        elif v == 1:
            break
        elif v == 2:
            x, y, i = x + data[i], y + data[i + 1], i + 2
            continue
        else:
            size = (v + 1) // 2 if nibbles else v
            raw = np.frombuffer(data[i : i + size], np.uint8)
            run = (np.stack([raw >> 4, raw & 15], 1).ravel() if nibbles else raw)[:v]
            i += size + size % 2
        if y < h:
            part = run[: max(0, w - x)]
            out[y, x : x + len(part)] = part
        x += len(run)
    return out[::-1]


def read_bmp(data: bytes) -> Iterator[Plane]:
    """Bitmaps of 1, 4, 8, 16, 24 and 32 bits with old and new headers; runs of 4 and 8 bits; bit fields."""
    if data[:2] != b"BM":
        raise ValueError("not a bitmap")
    offset, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    if size == 12:
        w, h, _, bits = struct.unpack_from("<HHHH", data, 18)
        coding, colours, entry = 0, 0, 3
    else:
        w, h, _, bits, coding = struct.unpack_from("<iiHHI", data, 18)
        colours, entry = struct.unpack_from("<I", data, 46)[0], 4
    top_down, h = h < 0, abs(h)
    masks = struct.unpack_from("<III", data, 54) if coding == 3 else (0x7C00, 0x3E0, 0x1F) if bits == 16 else (0xFF0000, 0xFF00, 0xFF)
    if coding in (1, 2):
        rows = _rle(data[offset:], w, h, coding == 2)
        top_down = False
    else:
        stride = (w * bits + 31) // 32 * 4
        raw = np.frombuffer(data, np.uint8, stride * h, offset).reshape(h, stride)
        if not top_down:
            raw = raw[::-1]
        if bits <= 8:
            rows = np.unpackbits(raw, axis=1).reshape(h, -1, bits)[:, :w] @ (1 << np.arange(bits)[::-1])
        elif bits == 24:
            yield from _planes(0, raw[:, : 3 * w].reshape(h, w, 3)[:, :, ::-1], 8)
            return
        else:
            words = raw[:, : w * bits // 8].copy().view("<u2" if bits == 16 else "<u4").astype(np.int64)
            parts = []
            for m in masks:
                shift = (m & -m).bit_length() - 1 if m else 0
                top = m >> shift
                parts.append((words & m) >> shift if top in (0, 255) else np.rint(((words & m) >> shift) * 255 / top).astype(int))
            yield from _planes(0, np.stack(parts, -1), 8)
            return
    colours = colours or 1 << bits
    table = np.zeros((1 << bits, 3), np.uint8)
    found = np.frombuffer(data, np.uint8, min(colours, 1 << bits) * entry, 14 + size).reshape(-1, entry)[:, 2::-1]
    table[: len(found)] = found
    image = table[np.minimum(rows, len(table) - 1).astype(int)]
    grey = (table[:, 0] == table[:, 1]).all() and (table[:, 1] == table[:, 2]).all()
    yield from _planes(0, image[:, :, :1] if grey else image, 8)


def write_bmp(planes: list[np.ndarray], w: int, h: int) -> bytes:
    """A 24-bit bitmap of one (grey), two or three planes of 0..255."""
    p = [np.clip(np.floor(np.asarray(x, float) + 0.5), 0, 255).astype(np.uint8).reshape(h, w) for x in planes[:3]]
    p = p * 3 if len(p) == 1 else [*p, np.zeros((h, w), np.uint8)] if len(p) == 2 else p
    stride = (3 * w + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : 3 * w] = np.stack(p[::-1], -1).reshape(h, 3 * w)
    return struct.pack("<2sIHHI", b"BM", 54 + stride * h, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, stride * h, 2835, 2835, 0, 0) + rows[::-1].tobytes()


#: Names of raw pixel types and numpy's.
RAW_TYPES = {"u8": "u1", "i8": "i1", "u16": "u2", "i16": "i2", "u32": "u4", "i32": "i4", "f32": "f4", "f64": "f8"}


def read_raw(data: bytes, width: int, height: int, channels: int = 1, pages: int = 1, kind: str = "u8", offset: int = 0, big_endian: bool = False, interleaved: bool = False) -> Iterator[Plane]:
    """Headerless pixels; what is missing at the end is zero."""
    t = np.dtype((">" if big_endian else "<") + RAW_TYPES[kind])
    size = width * height * channels
    body = data[offset : offset + size * pages * t.itemsize]
    body += bytes(size * pages * t.itemsize - len(body))
    values = np.frombuffer(body, t).reshape(pages, -1)
    name = {"u": "unsigned", "i": "signed", "f": "float"}[t.kind]
    for page in range(pages):
        v = values[page].reshape((height, width, channels) if interleaved else (channels, height, width))
        yield from _planes(page, v if interleaved else v.transpose(1, 2, 0), t.itemsize * 8, name)


def read_biorad(data: bytes) -> Iterator[Plane]:
    """PIC stacks: a 76-byte little-endian header, then pages of 8 or 16 bits."""
    w, h, pages, _, _, _, is_byte = struct.unpack_from("<HHHhhih", data, 0)
    if struct.unpack_from("<H", data, 54)[0] != 12345:
        raise ValueError("not a PIC file")
    yield from read_raw(data, w, h, 1, pages, "u8" if is_byte else "u16", 76)


def biorad_notes(data: bytes) -> list[tuple[int, str]]:
    """(type, text) of the 96-byte notes behind the pixels."""
    w, h, pages, _, _, _, is_byte = struct.unpack_from("<HHHhhih", data, 0)
    at, out = 76 + w * h * pages * (1 if is_byte else 2), []
    while at + 96 <= len(data):
        kind = struct.unpack_from("<h", data, at + 10)[0]
        out.append((kind, data[at + 16 : at + 96].split(b"\0")[0].decode("latin-1")))
        at += 96
    return out


def read_ibw(data: bytes) -> Iterator[Plane]:
    """Igor waves of version 5: types 2 (float 32), 4 (float 64), 8, 16, 32 (signed), + 64 unsigned; layers are channels;
    either byte order. All types are read; columns come first in the file."""
    order = "<" if struct.unpack_from("<h", data, 0)[0] == 5 else ">"
    if struct.unpack_from(order + "h", data, 0)[0] != 5:
        raise ValueError("not a wave of version 5")
    kind = struct.unpack_from(order + "h", data, 64 + 16)[0]
    dims = [max(1, n) for n in struct.unpack_from(order + "4i", data, 64 + 68)]
    code = {2: "f4", 4: "f8", 8: "i1", 16: "i2", 32: "i4", 72: "u1", 80: "u2", 96: "u4"}.get(kind)
    if code is None:
        raise ValueError("complex or text waves have no pixels")
    t = np.dtype(order + code)
    v = np.frombuffer(data, t, int(np.prod(dims)), 384).reshape(dims[3], dims[2], dims[1], dims[0])
    name = {"u": "unsigned", "i": "signed", "f": "float"}[t.kind]
    for page in range(dims[3]):
        yield from _planes(page, v[page].transpose(1, 2, 0), t.itemsize * 8, name)


def read_nanoscope(data: bytes) -> Iterator[Plane]:
    """AFM images: a text header gives each channel's offset and size; 16 bits, moved to unsigned, from the bottom up."""
    head, sections = data.split(b"\x1a")[0].decode("latin-1"), []
    for line in head.splitlines():
        line = line.lstrip("\\").strip()
        if line.startswith("*"):
            sections.append({"": line.strip("* ")})
        elif sections and ":" in line:
            k, v = line.split(":", 1)
            sections[-1].setdefault(k.strip(), v.strip())
    channel = 0
    for s in sections:
        if "image list" in s[""].lower() and "Data offset" in s:
            w, h, offset = int(s["Samps/line"].split()[0]), int(s["Number of lines"]), int(s["Data offset"])
            v = np.frombuffer(data, "<i2", w * h, offset).reshape(h, w)[::-1]
            yield Plane(0, channel, w, h, 16, "unsigned", ((v.astype(np.int64) + 32767) % 65536).astype(float).ravel())
            channel += 1


def _tiff(data: bytes, **options) -> Iterator[Plane]:
    from .tiff import read_tiff

    return read_tiff(data, **options)


def _microscope(data: bytes, **options) -> Iterator[Plane]:
    from .dialects import read_microscope

    return read_microscope(data, **options)


def _dicom(data: bytes, **options) -> Iterator[Plane]:
    from .dicom import read_dicom

    return read_dicom(data, **options)


def _nifti(data: bytes, **options) -> Iterator[Plane]:
    from .nifti import read_nifti

    return read_nifti(data, **options)


def _oib(data: bytes, **options) -> Iterator[Plane]:
    from .compound import read_oib

    return read_oib(data, **options)


#: Formats by name: decoder and file endings.
READERS = {"microscope": (_microscope, ("stk", "lsm", "tif")), "dicom": (_dicom, ("dcm", "dicom")), "nifti": (_nifti, ("nii", "gz")), "oib": (_oib, ("oib",)), "tiff": (_tiff, ("tif", "tiff", "stk", "lsm")), "bmp": (read_bmp, ("bmp",)), "raw": (read_raw, ("raw", "dat")), "pic": (read_biorad, ("pic",)), "ibw": (read_ibw, ("ibw",)), "nanoscope": (read_nanoscope, ("nan", "spm"))}
#: What each format can hold; the test before a write.
CAPABILITIES = {"dicom": {"write": False, "pages": True}, "nifti": {"write": False, "pages": True}, "oib": {"write": False, "pages": True}, "tiff": {"write": True, "pages": True}, "bmp": {"write": True, "pages": False}, "raw": {"write": True, "pages": True}, "pic": {"write": False, "pages": True}, "ibw": {"write": False, "pages": True}, "nanoscope": {"write": False, "pages": False}, "parquet": {"write": True, "pages": True}}


def sniff(head: bytes) -> str | None:
    """A format by its first 352 bytes or more. Gzipped files are taken for volumes, and compound files for image containers."""
    if head[128:132] == b"DICM":
        return "dicom"
    if head[344:348] == b"n+1\0" or head[4:8] == b"n+2\0" or head[:2] == b"\x1f\x8b":
        return "nifti"
    if head[:8] == bytes.fromhex("d0cf11e0a1b11ae1"):
        return "oib"
    if head[:2] == b"BM":
        return "bmp"
    if head[:4] in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
        return "tiff"
    if len(head) >= 56 and struct.unpack_from("<H", head, 54)[0] == 12345:
        return "pic"
    if len(head) >= 2 and 5 in (struct.unpack_from("<h", head)[0], struct.unpack_from(">h", head)[0]):
        return "ibw"
    if head.lstrip(b"\\").startswith(b"*File list"):
        return "nanoscope"
    return None

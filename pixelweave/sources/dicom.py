"""DICOM files by the published standard: data elements of either byte order with explicit or implicit value representations, nested
sequences of defined or undefined length, deflated data sets, and pixel data as it is or run-length coded.

Elements before the pixels are walked once; a frame or region is then read at its offset, so no other pixel is decoded.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Container, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np

#: Value representations with a long length field; those that hold numbers, with numpy's code; the transfer syntaxes.
LONG = {b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV"}
NUMBERS = {"US": "u2", "SS": "i2", "UL": "u4", "SL": "i4", "FL": "f4", "FD": "f8", "UV": "u8", "SV": "i8"}
BYTES = {"OB", "OD", "OF", "OL", "OV", "OW", "UN"}
IMPLICIT, EXPLICIT, BIG, DEFLATED, RUNS = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.5"
#: Representations of the elements that decoding needs, for files that leave them out.
KNOWN = {
    (0x0020, 0x0032): "DS", (0x0020, 0x0037): "DS", (0x0028, 0x0002): "US", (0x0028, 0x0004): "CS", (0x0028, 0x0006): "US", (0x0028, 0x0008): "IS", (0x0028, 0x0010): "US",
    (0x0028, 0x0011): "US", (0x0028, 0x0030): "DS", (0x0028, 0x0100): "US", (0x0028, 0x0101): "US", (0x0028, 0x0102): "US", (0x0028, 0x0103): "US", (0x0028, 0x1052): "DS",
    (0x0028, 0x1053): "DS", (0x0028, 0x1101): "US", (0x0028, 0x1102): "US", (0x0028, 0x1103): "US", (0x0028, 0x1201): "OW", (0x0028, 0x1202): "OW", (0x0028, 0x1203): "OW",
}
ITEM, ITEM_END, SEQUENCE_END, UNDEFINED = (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD), 0xFFFFFFFF
PIXELS, FLOATS, DOUBLES = (0x7FE0, 0x0010), (0x7FE0, 0x0008), (0x7FE0, 0x0009)
DEEPEST = 64


class Element(NamedTuple):
    kind: str
    at: int
    size: int


@dataclass
class DataSet:
    data: bytes
    order: str
    syntax: str
    elements: dict[tuple[int, int], Element] = field(default_factory=dict)
    #: Of nested elements, by path: (0008,1140)[0].(0008,1150).
    nested: dict[str, Element] = field(default_factory=dict)
    #: Parts of encapsulated pixels, the offset table first.
    fragments: list[tuple[int, int]] = field(default_factory=list)

    def values(self, tag: tuple[int, int]) -> list:
        e = self.elements.get(tag)
        return [] if e is None else self.of(e)

    def of(self, e: Element) -> list:
        raw = self.data[e.at : e.at + e.size]
        if e.kind in NUMBERS:
            t = np.dtype(self.order + NUMBERS[e.kind])
            return np.frombuffer(raw[: len(raw) // t.itemsize * t.itemsize], t).tolist()
        if e.kind == "AT":
            return [f"({g:04x},{x:04x})" for g, x in struct.iter_unpack(self.order + "HH", raw[: len(raw) // 4 * 4])]
        text = raw.decode("utf-8" if self.utf8 else "latin-1", "replace").rstrip("\0 ")
        return [text] if e.kind in ("LT", "ST", "UT", "UR") else [x.strip(" ") for x in text.split("\\")]

    @property
    def utf8(self) -> bool:
        e = self.elements.get((0x0008, 0x0005))
        return e is not None and b"192" in self.data[e.at : e.at + e.size]

    def one(self, tag: tuple[int, int], usual=None):
        v = self.values(tag)
        return v[0] if v and v[0] != "" else usual


def name(tag: tuple[int, int]) -> str:
    return f"({tag[0]:04x},{tag[1]:04x})"


def is_dicom(head: bytes) -> bool:
    return head[128:132] == b"DICM"


def parse(data: bytes) -> DataSet:
    """All elements but the pixels' values."""
    if not is_dicom(data):
        raise ValueError("no DICOM file")
    meta = DataSet(data, "<", EXPLICIT)
    at = 132
    while at + 8 <= len(data) and struct.unpack_from("<H", data, at)[0] == 2:
        at = _element(meta, at, len(data), True, "", 0)
    syntax = str(meta.one((0x0002, 0x0010), IMPLICIT))
    if syntax == DEFLATED:
        data, at = zlib.decompress(data[at:], -15), 0
    out = DataSet(data, ">" if syntax == BIG else "<", syntax)
    while at + 8 <= len(data):
        at = _element(out, at, len(data), syntax != IMPLICIT, "", 0)
    for k, e in meta.elements.items():
        if syntax != DEFLATED:
            out.elements.setdefault(k, e)
    return out


def _element(s: DataSet, at: int, end: int, explicit: bool, path: str, depth: int) -> int:
    """Takes in one element; where the next begins."""
    if at + 8 > end:
        raise ValueError(f"an element at {at} is cut off")
    tag = struct.unpack_from(s.order + "HH", s.data, at)
    if explicit and tag[0] != 0xFFFE:
        code = s.data[at + 4 : at + 6]
        kind = code.decode("latin-1")
        if not (code.isalpha() and code.isupper()):
            raise ValueError(f"{name(tag)} has no value representation")
        if code in LONG:
            (size,) = struct.unpack_from(s.order + "I", s.data, at + 8)
            at += 12
        else:
            (size,) = struct.unpack_from(s.order + "H", s.data, at + 6)
            at += 8
    else:
        kind = KNOWN.get(tag, "UL" if tag[1] == 0 else "")
        (size,) = struct.unpack_from(s.order + "I", s.data, at + 4)
        at += 8
    if size == UNDEFINED and tag == PIXELS and not path:
        s.elements[tag] = Element(kind or "OB", at, 0)
        return _fragments(s, at, end)
    if kind == "SQ" or size == UNDEFINED or (not kind and s.data[at : at + 4] == struct.pack(s.order + "HH", *ITEM)):
        if depth >= DEEPEST:
            raise ValueError("sequences are nested too deeply")
        # a sequence of unknown representation is written without representations
        return _sequence(s, at, end if size == UNDEFINED else at + size, size == UNDEFINED, explicit and kind != "UN", f"{path}{name(tag)}", depth)
    if at + size > end:
        raise ValueError(f"{name(tag)} is cut off")
    e = Element(kind or ("OW" if tag[0] == 0x7FE0 else "LO"), at, size)
    if path:
        s.nested[path + name(tag)] = e
    else:
        s.elements[tag] = e
    return at + size


def _sequence(s: DataSet, at: int, end: int, open_: bool, explicit: bool, path: str, depth: int) -> int:
    number = 0
    while at < end:
        if at + 8 > len(s.data):
            raise ValueError(f"{path} is cut off")
        tag = struct.unpack_from(s.order + "HH", s.data, at)
        (size,) = struct.unpack_from(s.order + "I", s.data, at + 4)
        at += 8
        if tag == SEQUENCE_END:
            return at
        if tag != ITEM:
            raise ValueError(f"{path} holds {name(tag)} where an item should begin")
        stop = end if size == UNDEFINED else at + size
        if stop > len(s.data):
            raise ValueError(f"{path} is cut off")
        while at < stop:
            if size == UNDEFINED and s.data[at : at + 4] == struct.pack(s.order + "HH", *ITEM_END):
                at += 8
                break
            at = _element(s, at, stop, explicit, f"{path}[{number}].", depth + 1)
        number += 1
    if open_:
        raise ValueError(f"{path} doesn't end")
    return at


def _fragments(s: DataSet, at: int, end: int) -> int:
    while at + 8 <= end:
        tag = struct.unpack_from(s.order + "HH", s.data, at)
        (size,) = struct.unpack_from(s.order + "I", s.data, at + 4)
        at += 8
        if tag == SEQUENCE_END:
            return at
        if tag != ITEM or at + size > end:
            break
        s.fragments.append((at, size))
        at += size
    raise ValueError("pixel data are cut off")


def tags(data: bytes) -> dict[str, str]:
    """All elements as text by tag, nested ones by path, several values with backslashes between; of binary ones the length."""
    s = parse(data)
    listed = [(name(t), e) for t, e in s.elements.items()] + list(s.nested.items())
    return {k: f"{e.size} bytes" if e.kind in BYTES or k.startswith("(7fe0") else "\\".join(f"{v:g}" if isinstance(v, float) else str(v) for v in s.of(e)) for k, e in listed}


def _runs(raw: bytes, size: int) -> bytes:
    """One run-length coded segment of so many bytes."""
    out, i = bytearray(), 0
    while i < len(raw) and len(out) < size:
        n = raw[i]
        if n < 128:
            out += raw[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += raw[i + 1 : i + 2] * (257 - n) if n > 128 else b""
            i += 2 if n > 128 else 1
    if len(out) < size:
        raise ValueError("a run-length segment is cut off")
    return bytes(out[:size])


def _rle_frame(raw: bytes, pixels: int, samples: int, width: int) -> np.ndarray:
    """(samples, pixels) of a frame: a segment for each byte of each sample, the highest first."""
    count, *offsets = struct.unpack_from("<16I", raw, 0)
    if count != samples * width or count > 15:
        raise ValueError(f"{count} run-length segments for {samples} samples of {width} bytes")
    ends = [*offsets[1:count], len(raw)]
    planes = np.stack([np.frombuffer(_runs(raw[a:b], pixels), np.uint8) for a, b in zip(offsets[:count], ends, strict=True)])
    return np.ascontiguousarray(planes.reshape(samples, width, pixels)[:, ::-1].transpose(0, 2, 1)).view(f"<u{width}")[:, :, 0]


def read_dicom(data: bytes, pages: Container[int] | None = None, region: tuple[int, int, int, int] | None = None, rescale: bool = True) -> Iterator:
    """Planes of the frames asked for; region: first and last column and row (x1, y1, x2, y2), inclusive, cut to the image. With rescale,
    values become slope * value + intercept where the file gives them. Palettes are looked up; a stored value's bits above the
    stored ones don't count."""
    from .codecs import Plane

    s = parse(data)
    h, w = int(s.one((0x0028, 0x0010), 0)), int(s.one((0x0028, 0x0011), 0))
    kind = next((t for t in (PIXELS, FLOATS, DOUBLES) if t in s.elements), None)
    if kind is None or h <= 0 or w <= 0:
        raise ValueError("no pixels")
    samples, frames = int(s.one((0x0028, 0x0002), 1)), int(s.one((0x0028, 0x0008), 1))
    allocated = {FLOATS: 32, DOUBLES: 64}.get(kind, int(s.one((0x0028, 0x0100), 8)))
    stored = int(s.one((0x0028, 0x0101), allocated)) if kind == PIXELS else allocated
    high = int(s.one((0x0028, 0x0102), stored - 1))
    signed = int(s.one((0x0028, 0x0103), 0)) == 1
    planar = int(s.one((0x0028, 0x0006), 0)) == 1
    photometric = str(s.one((0x0028, 0x0004), "MONOCHROME2"))
    slope, shift = (float(s.one((0x0028, 0x1053), 1)), float(s.one((0x0028, 0x1052), 0))) if rescale else (1.0, 0.0)
    if allocated not in (1, 8, 16, 32, 64) or not 0 < stored <= allocated:
        raise ValueError(f"{allocated} bits allocated, {stored} stored")
    if s.fragments and s.syntax != RUNS or not s.fragments and s.syntax not in (IMPLICIT, EXPLICIT, BIG, DEFLATED):
        raise ValueError(f"pixels coded by {s.syntax}")
    x1, y1, x2, y2 = region or (0, 0, w - 1, h - 1)
    x1, y1, x2, y2 = max(0, x1), max(0, y1), min(w - 1, x2), min(h - 1, y2)
    if x1 > x2 or y1 > y2:
        return
    e = s.elements[kind]
    code = np.dtype(s.order + ("f" if kind != PIXELS else "u") + str(max(1, allocated // 8)))
    size = h * w * samples * allocated // 8 if allocated > 1 else 0
    for page in range(frames):
        if pages is not None and page not in pages:
            continue
        if s.fragments:
            parts = s.fragments[1:]
            if len(parts) != frames:
                raise ValueError(f"{len(parts)} fragments for {frames} frames")
            at, n = parts[page]
            v = _rle_frame(s.data[at : at + n], h * w, samples, allocated // 8).reshape(samples, h, w)[:, y1 : y2 + 1, x1 : x2 + 1]
        elif allocated == 1:
            bits = np.unpackbits(np.frombuffer(s.data, np.uint8, e.size, e.at), bitorder="little")[page * h * w : (page + 1) * h * w]
            v = bits.reshape(1, h, w)[:, y1 : y2 + 1, x1 : x2 + 1]
        else:
            at = e.at + page * size
            if at + size > e.at + e.size:
                raise ValueError("pixel data are cut off")
            if planar and samples > 1:
                rows = [np.frombuffer(s.data, code, (y2 - y1 + 1) * w, at + (c * h + y1) * w * code.itemsize).reshape(-1, w) for c in range(samples)]
                v = np.stack(rows)[:, :, x1 : x2 + 1]
            else:
                rows = np.frombuffer(s.data, code, (y2 - y1 + 1) * w * samples, at + y1 * w * samples * code.itemsize)
                v = rows.reshape(-1, w, samples)[:, x1 : x2 + 1].transpose(2, 0, 1)
        if v.dtype.kind != "f":
            v = v.astype(np.uint64) >> np.uint64(max(0, high + 1 - stored)) & np.uint64((1 << stored) - 1)
            v = v.astype(np.int64)
            if signed:
                v = np.where(v >> (stored - 1) & 1, v - (1 << stored), v)
        if photometric == "PALETTE COLOR" and (0x0028, 0x1201) in s.elements:
            v = np.stack([_looked_up(s, v[0], c) for c in range(3)])
        out = v.astype(float) * slope + shift if (slope, shift) != (1.0, 0.0) else v.astype(float)
        form = "float" if kind != PIXELS or (slope, shift) != (1.0, 0.0) else "signed" if signed else "unsigned"
        for c in range(len(out)):
            yield Plane(page, c, x2 - x1 + 1, y2 - y1 + 1, stored, form, np.ascontiguousarray(out[c]).ravel())


def _looked_up(s: DataSet, v: np.ndarray, channel: int) -> np.ndarray:
    count, first, bits = s.values((0x0028, 0x1101 + channel))
    e = s.elements[(0x0028, 0x1201 + channel)]
    table = np.frombuffer(s.data[e.at : e.at + e.size], s.order + "u2" if e.size >= 2 * (count or 65536) else "u1")
    return table[np.clip(v - first, 0, min(count or 65536, len(table)) - 1)]

"""EXIF and GPS tags of JPEG files: read from the directories inside their segments, changed, and written back.

Values lie at offsets from the block's beginning, so a block that is written has all offsets anew; a text that grows moves what
follows it. What lies outside the directories (thumbnails, makers' notes at absolute offsets) isn't kept by write_exif."""

from __future__ import annotations

import struct
from typing import NamedTuple

from .tiff import CODES, SIZES

MAGIC = b"Exif\0\0"
#: Pointers to the inner directories; the tags that are known by name.
POINTERS = {"image": {0x8769: "photo", 0x8825: "gps"}, "photo": {0xA005: "interop"}}
NAMES = {
    "image": {0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x011A: "XResolution", 0x011B: "YResolution", 0x0128: "ResolutionUnit", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright"},
    "photo": {0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "ISOSpeedRatings", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x920A: "FocalLength", 0xA002: "PixelXDimension", 0xA003: "PixelYDimension"},
    "gps": {0: "GPSVersionID", 1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude", 7: "GPSTimeStamp", 29: "GPSDateStamp"},
    "interop": {1: "InteroperabilityIndex"},
}
ASCII, SHORT, LONG, RATIONAL, BYTE, UNKNOWN = 2, 3, 4, 5, 1, 7
FORMATS = CODES | {5: "I", 10: "i"}


class Tag(NamedTuple):
    """A value as stored: texts and unknown ones are bytes, rationals pairs of whole numbers."""

    group: str
    tag: int
    kind: int
    values: tuple


def segments(data: bytes) -> list[tuple[int, int, int]]:
    """(marker, first byte of the segment, its end) up to the coded image."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    out, at = [], 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError(f"no segment begins at {at}")
        marker = data[at + 1]
        if marker == 0xFF:  # padding
            at += 1
            continue
        if marker in (0xDA, 0xD9):
            break
        (size,) = struct.unpack_from(">H", data, at + 2)
        if size < 2 or at + 2 + size > len(data):
            raise ValueError(f"the segment at {at} is cut off")
        out.append((marker, at, at + 2 + size))
        at += 2 + size
    return out


def _block(data: bytes) -> tuple[int, int] | None:
    return next(((a, b) for m, a, b in segments(data) if m == 0xE1 and data[a + 4 : a + 10] == MAGIC), None)


def read_exif(data: bytes) -> list[Tag]:
    """The tags of all directories, without the pointers between them; none if the file has no block."""
    found = _block(data)
    if found is None:
        return []
    block = data[found[0] + 10 : found[1]]
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    if order is None or struct.unpack_from(order + "H", block, 2)[0] != 42:
        raise ValueError("no EXIF block")
    out: list[Tag] = []
    to_do, seen = [("image", struct.unpack_from(order + "I", block, 4)[0])], set()
    while to_do:
        group, at = to_do.pop(0)
        if at in seen or at + 2 > len(block):
            raise ValueError(f"the {group} directory is {'listed twice' if at in seen else 'beyond the block'}")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", block, at)
        for k in range(n):
            tag, kind, times = struct.unpack_from(order + "HHI", block, at + 2 + 12 * k)
            size, place = SIZES.get(kind, 0) * times, at + 10 + 12 * k
            if not size:
                continue
            if size > 4:
                (place,) = struct.unpack_from(order + "I", block, place)
            if place + size > len(block):
                raise ValueError(f"tag {tag} lies beyond the block")
            if kind in (ASCII, UNKNOWN):
                values: tuple = (block[place : place + size],)
            elif kind in (5, 10):
                flat = struct.unpack_from(f"{order}{2 * times}{FORMATS[kind]}", block, place)
                values = tuple(zip(flat[::2], flat[1::2], strict=True))
            else:
                values = struct.unpack_from(f"{order}{times}{CODES[kind]}", block, place)
            if tag in POINTERS.get(group, {}):
                to_do.append((POINTERS[group][tag], values[0]))
            else:
                out.append(Tag(group, tag, kind, values))
    return out


def _packed(t: Tag, order: str) -> tuple[int, bytes]:
    if t.kind in (ASCII, UNKNOWN):
        return len(t.values[0]), t.values[0]
    flat = [x for v in t.values for x in v] if t.kind in (5, 10) else t.values
    return len(t.values), struct.pack(f"{order}{len(flat)}{FORMATS[t.kind]}", *flat)


def exif_block(tags: list[Tag], order: str = "<") -> bytes:
    """A block with these tags in their directories."""
    groups = {g: sorted((t for t in tags if t.group == g), key=lambda t: t.tag) for g in NAMES}
    inner = {"photo": [g for g in ("interop",) if groups[g]], "image": [g for g in ("photo", "gps") if groups[g] or g == "photo" and groups["interop"]]}
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8))

    def write(group: str) -> int:
        """Writes a directory, then its values, then the directories that it points to."""
        pointer = {v: k for k, v in POINTERS.get(group, {}).items()}
        entries = sorted([(t.tag, t) for t in groups[group]] + [(pointer[g], g) for g in inner.get(group, ())], key=lambda e: e[0])
        at = len(out)
        out.extend(struct.pack(order + "H", len(entries)) + bytes(12 * len(entries) + 4))
        for k, (tag, t) in enumerate(entries):
            if isinstance(t, str):
                raw, kind, times = struct.pack(order + "I", write(t)), LONG, 1
            else:
                (times, raw), kind = _packed(t, order), t.kind
            if len(raw) > 4:
                out.extend(b"\0" * (len(out) % 2))
                place = len(out)
                out.extend(raw)
                raw = struct.pack(order + "I", place)
            out[at + 2 + 12 * k : at + 14 + 12 * k] = struct.pack(order + "HHI", tag, kind, times) + raw.ljust(4, b"\0")
        return at

    write("image")
    return bytes(out)


def write_exif(data: bytes, tags: list[Tag], order: str = "<") -> bytes:
    """The file with these tags instead of those it has; the coded image stays byte for byte."""
    body = MAGIC + exif_block(tags, order)
    if len(body) + 2 > 0xFFFF:
        raise ValueError("the tags don't fit a segment")
    segment = b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body
    found = _block(data)
    if found:
        return data[: found[0]] + segment + data[found[1] :]
    listed = segments(data)
    at = listed[0][2] if listed and listed[0][0] == 0xE0 else 2  # behind the first header
    return data[:at] + segment + data[at:]


def _text(t: Tag) -> str:
    if t.kind == ASCII:
        return t.values[0].split(b"\0")[0].decode("utf-8", "replace").strip()
    if t.kind == UNKNOWN:
        return f"{len(t.values[0])} bytes"
    return ",".join(f"{v[0] / v[1]:.9g}" if t.kind in (5, 10) and v[1] else "0" if t.kind in (5, 10) else str(v) for v in t.values)


def named(tags: list[Tag]) -> dict[str, str]:
    """Tags by name, such as photo/FNumber, or by number; with latitude and longitude as signed degrees and altitude in metres,
    below the sea negative."""
    out = {f"{t.group}/{NAMES[t.group].get(t.tag, hex(t.tag))}": _text(t) for t in tags}
    of = {t.tag: t for t in tags if t.group == "gps"}
    for ref, tag, name, minus in ((1, 2, "latitude", b"S"), (3, 4, "longitude", b"W")):
        if tag in of and len(of[tag].values) == 3 and all(v[1] for v in of[tag].values):
            degrees = sum(v[0] / v[1] / 60**k for k, v in enumerate(of[tag].values))
            out[name] = f"{-degrees if ref in of and of[ref].values[0][:1] == minus else degrees:.11g}"
    if 6 in of and of[6].values[0][1]:
        height = of[6].values[0][0] / of[6].values[0][1]
        out["altitude"] = f"{-height if 5 in of and of[5].values[0] == 1 else height:.9g}"
    return out


def gps_tags(lat: float, lon: float, altitude: float | None = None) -> list[Tag]:
    """Tags of a place in signed degrees, to a hundred-thousandth of a second."""

    def parts(x: float) -> tuple:
        whole = round(abs(x) * 3600 * 100_000)
        degrees, rest = divmod(whole, 3600 * 100_000)
        minutes, seconds = divmod(rest, 60 * 100_000)
        return ((degrees, 1), (minutes, 1), (seconds, 100_000))

    out = [Tag("gps", 0, BYTE, (2, 3, 0, 0)), Tag("gps", 1, ASCII, (b"S\0" if lat < 0 else b"N\0",)), Tag("gps", 2, RATIONAL, parts(lat)), Tag("gps", 3, ASCII, (b"W\0" if lon < 0 else b"E\0",)), Tag("gps", 4, RATIONAL, parts(lon))]
    if altitude is not None:
        out += [Tag("gps", 5, BYTE, (int(altitude < 0),)), Tag("gps", 6, RATIONAL, ((round(abs(altitude) * 1000), 1000),))]
    return out

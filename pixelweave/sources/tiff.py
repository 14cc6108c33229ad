"""TIFF and BigTIFF by the published specification: strips and tiles, several pages, both byte orders, samples of 1 to 64 bits,
uncompressed, PackBits, LZW and deflate, horizontal differences, planar or interleaved, and pages that are reduced levels.

A page's directory is read without its pixels, so a reader of one page decodes that page's strips or tiles only.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Container, Iterator
from dataclasses import dataclass, field

import numpy as np

#: Bytes of the field types; tags of the specification; compressions.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
CODES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
SUBFILE, WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR, PALETTE, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SUBDIRS, FORMAT = (
    254, 256, 257, 258, 259, 262, 270, 273, 277, 278, 279, 284, 317, 320, 322, 323, 324, 325, 330, 339,
)
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
KINDS = {1: "unsigned", 2: "signed", 3: "float"}


@dataclass
class Page:
    number: int
    level: int
    order: str
    tags: dict[int, tuple] = field(default_factory=dict)
    #: Where a tag's values begin in the file, for layouts that pack something else there.
    places: dict[int, int] = field(default_factory=dict)

    def one(self, tag: int, usual: int) -> int:
        return int(self.tags[tag][0]) if self.tags.get(tag) else usual

    @property
    def description(self) -> str | None:
        text = self.tags.get(DESCRIPTION)
        return bytes(text).split(b"\0")[0].decode("utf-8", "replace") if text else None


def is_tiff(head: bytes) -> bool:
    return head[:4] in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+")


def directories(data: bytes) -> Iterator[Page]:
    """The pages' directories: those of the chain, each followed by its sub-directories, its reduced levels."""
    if not is_tiff(data):
        raise ValueError("no TIFF")
    order = "<" if data[:2] == b"II" else ">"
    big = data[2:4] in (b"+\0", b"\0+")
    count, entry, word = ("Q", 20, "Q") if big else ("H", 12, "I")
    wide = struct.calcsize(word)

    def directory(at: int, number: int, level: int) -> tuple[Page, int]:
        (n,) = struct.unpack_from(order + count, data, at)
        at += struct.calcsize(count)
        page = Page(number, level, order)
        for k in range(n):
            tag, kind = struct.unpack_from(order + "HH", data, at + k * entry)
            (times,) = struct.unpack_from(order + word, data, at + k * entry + 4)
            size = SIZES.get(kind, 0) * times
            value = at + k * entry + 4 + wide
            if size > wide:
                (value,) = struct.unpack_from(order + word, data, value)
            if not size:
                continue  # of a type that the specification doesn't have
            if value + size > len(data):
                raise ValueError(f"tag {tag} of page {number} lies beyond the file")
            page.places[tag] = value
            if kind in (5, 10):
                pairs = struct.unpack_from(f"{order}{2 * times}{'I' if kind == 5 else 'i'}", data, value)
                page.tags[tag] = tuple(a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2], strict=True))
            else:
                page.tags[tag] = struct.unpack_from(f"{order}{times}{CODES[kind]}", data, value)
        (following,) = struct.unpack_from(order + word, data, at + n * entry)
        return page, following

    (at,) = struct.unpack_from(order + word, data, 8 if big else 4)
    seen, number = set(), 0
    while at and at not in seen:
        if at >= len(data):
            raise ValueError(f"the directory of page {number} lies beyond the file")
        seen.add(at)
        page, at = directory(at, number, 0)
        yield page
        for level, sub in enumerate(page.tags.get(SUBDIRS, ()), 1):
            if sub not in seen and 0 < sub < len(data):
                seen.add(sub)
                yield directory(sub, number, level)[0]
        number += 1


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, the highest bit first; widths grow one code early."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, last, width, held, bits = list(first), [], None, 9, 0, 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, last, width = list(first), None, 9
            continue
        if last is None:
            text = table[code]
        else:
            text = table[code] if code < len(table) else last + last[:1]
            table.append(last + text[:1])
        out.append(text)
        last = text
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    """The inverse of unpack_lzw: a new table begins before codes would need more than 12 bits."""
    table = {bytes([i]): i for i in range(256)}
    out, held, bits, width, following, text = bytearray(), 256, 9, 9, 258, b""
    for byte in data:
        longer = text + bytes([byte])
        if longer in table:
            text = longer
            continue
        held, bits = held << width | table[text], bits + width
        table[longer] = following
        following += 1
        if following == 4095:
            held, bits = held << width | 256, bits + width
            table, following, width = {bytes([i]): i for i in range(256)}, 258, 9
        elif following in (512, 1024, 2048):
            width += 1
        text = longer[-1:]
        if bits > 4096:
            keep = bits % 8
            out += (held >> keep).to_bytes(bits // 8, "big")
            held, bits = held & (1 << keep) - 1, keep
    if text:
        held, bits, following = held << width | table[text], bits + width, following + 1
        width += following in (512, 1024, 2048)
    held, bits = held << width | 257, bits + width
    return bytes(out) + (held << -bits % 8).to_bytes(-(-bits // 8), "big")


def _unpacked(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return unpack_bits(data)
    if compression == LZW:
        return unpack_lzw(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    raise ValueError(f"compression {compression}")


def _samples(raw: bytes, order: str, bits: int, kind: str, h: int, w: int, c: int) -> np.ndarray:
    """(h, w, c) from a strip's or tile's bytes, whose rows start at whole bytes; rows that are missing are zero."""
    if bits in (8, 16, 32, 64):
        letter = {"unsigned": "u", "signed": "i", "float": "f"}[kind]
        row = w * c * bits // 8
        raw = raw[: h * row].ljust(h * row, b"\0")
        return np.frombuffer(raw, f"{order}{letter}{bits // 8}").reshape(h, w, c)
    if bits > 16 or kind != "unsigned":
        raise ValueError(f"{bits} bits of {kind}")
    row = -(-w * c * bits // 8)
    each = np.unpackbits(np.frombuffer(raw[: h * row].ljust(h * row, b"\0"), np.uint8).reshape(h, row), axis=1)[:, : w * c * bits]
    return (each.reshape(h, w, c, bits) @ (1 << np.arange(bits - 1, -1, -1))).astype(np.uint16)


def pixels(data: bytes, page: Page) -> tuple[np.ndarray, int, str]:
    """(height, width, channels) of a page, its bits and the kind of its samples. Palettes are looked up."""
    w, h, c = page.one(WIDTH, 0), page.one(HEIGHT, 0), page.one(SAMPLES, 1)
    bits, kind, compression = page.one(BITS, 1), KINDS.get(page.one(FORMAT, 1), "unsigned"), page.one(COMPRESSION, NONE)
    planar, tiled = page.one(PLANAR, 1) == 2 and c > 1, TILES in page.tags
    tw, th = (page.one(TILE_WIDTH, w), page.one(TILE_HEIGHT, h)) if tiled else (w, min(h, page.one(ROWS, h)))
    if not (0 < w and 0 < h and 0 < tw and 0 < th) or w * h * c > 1 << 31:
        raise ValueError("bad size")
    offsets = page.tags.get(TILES if tiled else STRIPS, ())
    sizes = page.tags.get(TILE_BYTES if tiled else STRIP_BYTES) or (len(data),) * len(offsets)
    across, down, deep = -(-w // tw), -(-h // th), 1 if planar else c
    if len(offsets) < across * down * (c // deep):
        raise ValueError("parts are missing")
    out = None
    for k in range(across * down * (c // deep)):
        plane, rest = divmod(k, across * down)
        y, x = rest // across * th, rest % across * tw
        high = th if tiled else min(th, h - y)
        part = _samples(_unpacked(data[offsets[k] : offsets[k] + sizes[k]], compression), page.order, bits, kind, high, tw, deep)
        if page.one(PREDICTOR, 1) == 2:
            part = np.cumsum(part, axis=1, dtype=part.dtype.newbyteorder("="))
        if out is None:
            out = np.zeros((h, w, c), part.dtype.newbyteorder("="))
        low, right = min(h, y + high), min(w, x + tw)
        out[y:low, x:right, plane if planar else slice(None)] = part[: low - y, : right - x, 0] if planar else part[: low - y, : right - x]
    if page.one(PHOTOMETRIC, 1) == 3 and PALETTE in page.tags:
        table = np.array(page.tags[PALETTE]).reshape(3, -1)
        return table[:, out[:, :, 0]].transpose(1, 2, 0), 16, "unsigned"
    if page.one(PHOTOMETRIC, 1) == 0 and kind == "unsigned":
        out = ((1 << bits) - 1 - out.astype(np.int64)).astype(out.dtype)
    return out, bits, kind


def read_tiff(data: bytes, pages: Container[int] | None = None, level: int = 0):
    """Planes of the pages asked for (all by default) at a level: 0, or that of a page's sub-directories."""
    from .codecs import _planes

    for page in directories(data):
        if page.level == level and (pages is None or page.number in pages):
            values, bits, kind = pixels(data, page)
            yield from _planes(page.number, values, bits, kind)


PACKERS = {NONE: bytes, LZW: pack_lzw, DEFLATE: zlib.compress}


def write_tiff(
    pages: list[np.ndarray], tile: int | None = None, compressed: bool = True, order: str = "<", big: bool = False, compression: int | None = None, levels: list[list[np.ndarray]] | None = None,
    tags: list[list[tuple[int, int, tuple]]] | None = None,
) -> bytes:
    """Pages (height, width, channels) as a TIFF in strips of 64 rows or in tiles, deflated unless compressed is false or compression
    names another way. levels: of each page its reduced levels, which become sub-directories of it. tags: of each page further
    (tag, type, values)."""
    compression = compression if compression is not None else DEFLATE if compressed else NONE
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + ("HHHQ" if big else "HI"), *((43, 8, 0, 16) if big else (42, 8)))
    count, word, kind, wide = ("Q", "Q", 16, 8) if big else ("H", "I", 4, 4)
    out = bytearray(head)

    def directory(page: np.ndarray, more: list[tuple[int, int, tuple]]) -> tuple[int, int]:
        """Writes a page and its directory; where the directory begins, and where it names the next."""
        h, w, c = page.shape
        tw, th = (tile, tile) if tile else (w, min(h, 64))
        offsets, sizes = [], []
        for y in range(0, h, th):
            for x in range(0, w, tw):
                part = page[y : y + th, x : x + tw]
                if tile:
                    part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1]), (0, 0)))
                raw = PACKERS[compression](np.ascontiguousarray(part, page.dtype.newbyteorder(order)).tobytes())
                offsets.append(len(out))
                sizes.append(len(raw))
                out.extend(raw)
        fields = [(WIDTH, 4, (w,)), (HEIGHT, 4, (h,)), (BITS, 3, (page.dtype.itemsize * 8,) * c), (COMPRESSION, 3, (compression,)), (PHOTOMETRIC, 3, (2 if c == 3 else 1,))]
        fields += [(SAMPLES, 3, (c,)), (FORMAT, 3, ({"u": 1, "i": 2, "f": 3}[page.dtype.kind],) * c), *more]
        fields += [(TILE_WIDTH, 4, (tw,)), (TILE_HEIGHT, 4, (th,)), (TILES, kind, tuple(offsets)), (TILE_BYTES, kind, tuple(sizes))] if tile else [(STRIPS, kind, tuple(offsets)), (ROWS, 4, (th,)), (STRIP_BYTES, kind, tuple(sizes))]
        entries = []
        for tag, t, values in sorted(fields):
            raw = struct.pack(f"{order}{len(values)}{CODES[t]}", *values)
            if len(raw) > wide:
                out.extend(b"\0" * (len(out) % 2))
                raw, beyond = struct.pack(order + word, len(out)), raw
                out.extend(beyond)
            entries.append(struct.pack(f"{order}HH{word}", tag, t, len(values)) + raw.ljust(wide, b"\0"))
        out.extend(b"\0" * (len(out) % 2))
        at = len(out)
        out.extend(struct.pack(order + count, len(entries)) + b"".join(entries))
        link = len(out)
        out.extend(struct.pack(order + word, 0))
        return at, link

    link = 8 if big else 4
    for k, page in enumerate(pages):
        subs = tuple(directory(x, [(SUBFILE, 4, (1,))])[0] for x in (levels[k] if levels else ()))
        more = [*((tags[k]) if tags else ()), *([(SUBDIRS, kind, subs)] if subs else ())]
        at, following = directory(page, more)
        out[link : link + wide] = struct.pack(order + word, at)
        link = following
    return bytes(out)


def pyramid(page: np.ndarray, least: int) -> list[np.ndarray]:
    """Levels below a page (height, width, channels), each of half the size, down to the first that fits least x least."""
    from ..operators.planes import halve

    out, t = [], page.dtype
    while max(page.shape[:2]) > least:
        page = np.stack([halve(page[:, :, k].astype(float)) for k in range(page.shape[2])], -1)
        page = (np.floor(page + 0.5) if t.kind != "f" else page).astype(t)
        out.append(page)
    return out

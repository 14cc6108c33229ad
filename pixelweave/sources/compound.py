"""Compound files (structured storage) by the published specification: sector chains, small streams, the directory tree, and the
Olympus image containers (OIB) that are written in them.

A stream is read by its own chain, so one stream of a large file costs its own sectors. Chains and trees with cycles, and sectors
beyond the file, are errors that name the place.
"""

from __future__ import annotations

import configparser
import re
import struct
from collections.abc import Container, Iterator
from typing import NamedTuple

MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
#: Marks that stand in place of sector numbers, and kinds of directory entries.
LARGEST, END, FREE, NONE = 0xFFFFFFFA, 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFF
STORAGE, STREAM, ROOT = 1, 2, 5


class Entry(NamedTuple):
    path: str
    kind: int
    first: int
    size: int


class Compound:
    """The streams of a compound file by path, such as Storage00001/Stream00001."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("no compound file")
        self.data = data
        version, order, power, small_power = struct.unpack_from("<HHHH", data, 26)
        if order != 0xFFFE or power not in (9, 12) or small_power != 6:
            raise ValueError(f"sectors of 2^{power} and 2^{small_power} bytes")
        self.sector, self.small = 1 << power, 1 << small_power
        tables, directory = struct.unpack_from("<II", data, 44)
        self.cutoff, first_small, _, more, extra = struct.unpack_from("<IIIII", data, 56)
        listed = list(struct.unpack_from("<109I", data, 76))
        seen: set[int] = set()
        while more < LARGEST:  # the table of tables goes on in sectors of its own
            if more in seen:
                raise ValueError(f"sector {more} of the table of tables comes twice")
            seen.add(more)
            *part, more = struct.unpack(f"<{self.sector // 4}I", self._sector(more))
            listed += part
        listed = [x for x in listed if x < LARGEST]
        if len(listed) < tables:
            raise ValueError(f"{len(listed)} of {tables} tables of sectors")
        self.table: list[int] = []
        for x in listed[:tables]:
            self.table += struct.unpack(f"<{self.sector // 4}I", self._sector(x))
        self.wide = version >= 4
        self.entries = self._entries(b"".join(map(self._sector, self._chain(directory, self.table))))
        raw = b"".join(map(self._sector, self._chain(first_small, self.table))) if first_small < LARGEST else b""
        self.small_table = list(struct.unpack(f"<{len(raw) // 4}I", raw))
        root = self.entries[0]
        self.small_data = b"".join(map(self._sector, self._chain(root.first, self.table)))[: root.size] if root.size else b""

    def _sector(self, number: int) -> bytes:
        at = (number + 1) * self.sector
        part = self.data[at : at + self.sector]
        if not part:
            raise ValueError(f"sector {number} lies beyond the file")
        return part.ljust(self.sector, b"\0")  # the last may be cut

    @staticmethod
    def _chain(first: int, table: list[int]) -> Iterator[int]:
        seen: set[int] = set()
        while first != END:
            if first in seen:
                raise ValueError(f"sector {first} comes twice in a chain")
            if first >= len(table):
                raise ValueError(f"sector {first} isn't in the table")
            seen.add(first)
            yield first
            first = table[first]

    def _entries(self, raw: bytes) -> list[Entry]:
        """The root, then all that it holds by path; siblings are a binary tree."""
        found = []
        for at in range(0, len(raw) - 127, 128):
            n, kind = struct.unpack_from("<HB", raw, at + 64)
            left, right, child = struct.unpack_from("<III", raw, at + 68)
            first, size = struct.unpack_from("<IQ", raw, at + 116)
            found.append((raw[at : at + max(0, min(64, n) - 2)].decode("utf-16-le", "replace"), kind, left, right, child, first, size if self.wide else size & 0xFFFFFFFF))
        if not found or found[0][1] != ROOT:
            raise ValueError("no root entry")
        out, seen = [Entry("", ROOT, found[0][5], found[0][6])], {0}
        left_to_do = [(found[0][4], "")]
        while left_to_do:
            k, path = left_to_do.pop()
            if k == NONE:
                continue
            if k >= len(found) or k in seen:
                raise ValueError(f"directory entry {k} is out of range" if k >= len(found) else f"directory entry {k} comes twice")
            seen.add(k)
            name, kind, left, right, child, first, size = found[k]
            own = f"{path}/{name}" if path else name
            out.append(Entry(own, kind, first, size))
            left_to_do += [(left, path), (right, path)]
            if kind == STORAGE:
                left_to_do.append((child, own))
        return out

    def streams(self) -> list[tuple[str, int]]:
        """(path, size) of all streams, by path."""
        return sorted((e.path, e.size) for e in self.entries if e.kind == STREAM)

    def read(self, path: str) -> bytes:
        e = next((e for e in self.entries if e.kind == STREAM and e.path == path), None)
        if e is None:
            raise KeyError(path)
        if not e.size:
            return b""
        if e.size < self.cutoff:
            parts = (self.small_data[k * self.small : (k + 1) * self.small] for k in self._chain(e.first, self.small_table))
        else:
            parts = map(self._sector, self._chain(e.first, self.table))
        out = b"".join(parts)
        if len(out) < e.size:
            raise ValueError(f"{path} has {len(out)} of {e.size} bytes")
        return out[: e.size]


def _ini(raw: bytes) -> configparser.ConfigParser:
    """Sections of a text that Windows programs write: UTF-16 with a mark, or Latin-1."""
    text = raw.decode("utf-16" if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else "latin-1", "replace")
    out = configparser.ConfigParser(interpolation=None, strict=False, delimiters=("=",), comment_prefixes=(";",))
    out.optionxform = str
    out.read_string(text.replace("\0", ""))
    return out


def oib_names(c: Compound) -> dict[str, str]:
    """Paths of the streams by the file names that OibInfo.txt gives them."""
    paths = [p for p, _ in c.streams()]
    info = next((p for p in paths if p.rsplit("/", 1)[-1] == "OibInfo.txt"), None)
    if info is None:
        raise ValueError("no OibInfo.txt")
    listed = _ini(c.read(info))
    out = {}
    for section in listed.sections():
        for key, value in listed.items(section):
            found = [p for p in paths if p.rsplit("/", 1)[-1] == key]
            if found:
                out[value.strip('" ')] = found[0]
    return out


def oib_tags(data: bytes) -> dict[str, str]:
    """Settings of the container: section/key of OibInfo.txt and of the main (.oif) text, such as Axis 0 Parameters Common/MaxSize."""
    c, out = Compound(data), {}
    names = oib_names(c)
    texts = [p for p, _ in c.streams() if p.rsplit("/", 1)[-1] == "OibInfo.txt"] + [p for n, p in names.items() if n.lower().endswith(".oif")]
    for path in texts:
        parsed = _ini(c.read(path))
        out |= {f"{s}/{k}": v.strip('"') for s in parsed.sections() for k, v in parsed.items(s)}
    return out


#: Positions in a file name: s_C001Z003T002.tif.
POSITION = re.compile(r"(?:^|_)C(\d+)(?:Z(\d+))?(?:T(\d+))?\.tif$", re.I)


def read_oib(data: bytes, pages: Container[int] | None = None) -> Iterator:
    """Planes of the container: pages by time, then depth; channels by number."""
    from .tiff import read_tiff

    c, found = Compound(data), []
    for file, path in oib_names(c).items():
        if m := POSITION.search(file.replace("\\", "/").rsplit("/", 1)[-1]):
            found.append((int(m[3] or 1), int(m[2] or 1), int(m[1]), path))
    if not found:
        raise ValueError("no images in the container")
    page_of = {tz: k for k, tz in enumerate(sorted({f[:2] for f in found}))}
    for t, z, channel, path in sorted(found):
        page = page_of[t, z]
        if pages is None or page in pages:
            for plane in read_tiff(c.read(path), pages={0}):
                yield plane._replace(page=page, channel=channel - 1 + plane.channel)

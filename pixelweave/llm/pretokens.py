"""Pre-tokens of byte-level BPE: the pattern of the public vocabularies, run by the standard library's engine.

The pattern knows letters, numbers and white space by Unicode class. Here the classes are spelled out as ranges,
taken from the regex library at start-up, because sets of ranges match several times faster; texts with characters
outside the basic plane, for which sets aren't fast, go through the pattern itself. Both give the same pieces.
"""

from __future__ import annotations

import functools
import re

import regex

ASTRAL = re.compile("[\U00010000-\U0010ffff]")


@functools.cache
def _ranges(prop: str) -> str:
    """The basic plane's characters of a class as the inside of a set."""
    every = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    out = []
    for m in regex.finditer(f"{prop}+", every):
        start = prev = ord(m[0][0])
        for c in map(ord, m[0][1:]):
            if c != prev + 1:
                out.append((start, prev))
                start = c
            prev = c
        out.append((start, prev))
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out)


@functools.cache
def splitters(pattern: str) -> tuple[regex.Pattern, re.Pattern]:
    space = _ranges(r"\s")
    out, inside, i = [], False, 0
    while i < len(pattern):
        for prop in (r"\p{L}", r"\p{N}", r"\s"):
            if pattern.startswith(prop, i):
                body = _ranges(prop)
                out.append(body if inside else f"[{body}]")
                i += len(prop)
                break
        else:
            if pattern.startswith(r"\S", i):
                out.append(f"[^{space}]")
                i += 2
                continue
            inside = pattern[i] == "[" or inside and pattern[i] != "]"
            out.append(pattern[i])
            i += 1
    return regex.compile(pattern), re.compile("".join(out))


def findall(pattern: str, text: str) -> list[str]:
    slow, fast = splitters(pattern)
    return (fast if text.isascii() or not ASTRAL.search(text) else slow).findall(text)


def boundaries(pattern: str, text: str) -> list[int]:
    """Ends of the pre-tokens."""
    at, out = 0, []
    for p in findall(pattern, text):
        at += len(p)
        out.append(at)
    return out

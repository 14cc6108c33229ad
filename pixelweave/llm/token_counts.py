"""Token counts of every prefix of a text, by dynamic programming.

Within a pre-token, the encoding of each prefix ends in one token whose front is the encoding of a shorter prefix:
of the vocabulary's tokens that end there it is the one that the merges would leave standing beside that shorter
prefix's last token. So one pass over a pre-token's bytes finds the count at every prefix from counts before it.
Pre-tokens repeat, so their tables are remembered. Over a text, the counts at the ends of its pre-tokens are running
sums, and any prefix is a running sum plus one table entry; truncation ('the longest prefix of at most k tokens')
and budget questions read the tables and encode nothing again.

A prefix is counted as the text it is: one that ends in white space has that white space in one pre-token, and one
that ends within a contraction or within a special token's string has these as ordinary characters.

The vocabulary's special tokens count one each where their strings stand in a text, as the tokenizers library has
it by default.

Cases: null text is empty with 0 tokens; rows that repeat are counted each; an empty table gives an empty result;
columns of the input other than the named two are not read.
"""

from __future__ import annotations

import functools
import json
import math
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, small_batches
from .pretokens import findall

REMEMBERED = 350_000
#: Characters of a pre-token above which its table is kept for its own text alone.
LONG = 512
#: Fixed value: the pre-tokens of byte-level vocabularies in the tokenizers library's files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in such files: printable bytes for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = {i: bytes(letters[c] for c in s) for s, i in spec["model"]["vocab"].items() if all(c in letters for c in s)}
        self.ids = {b: i for i, b in raw.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks = {tuple(bytes(letters[c] for c in s) for s in p): i for i, p in enumerate(pairs)}
        self.splits: dict[bytes, tuple[bytes, bytes]] = {}
        for p in self.ranks:
            self.splits.setdefault(p[0] + p[1], p)
        self.longest = max(map(len, self.ids))
        kind = spec["pre_tokenizer"] or {}
        plain = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not spec["normalizer"]
        if not plain or any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("a byte-level file without normalizer, prefix space and stripping tokens is needed")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.tables: dict[str, bytes | array] = {}
        self.totals: dict[str, int] = {}
        self.stands: dict[tuple[bytes, bytes], bool] = {}

    def spine(self, token: bytes, side: int) -> list[tuple[bytes, float]]:
        """The parts that stand at a token's right (side 1) or left (0) edge while its merges run, each with the rank
        of the merge that consumes it."""
        out, until = [(token, math.inf)], math.inf
        while (pair := self.splits.get(token)) is not None:
            until = self.ranks[pair]
            token = pair[side]
            out.append((token, until))
        return out

    def stand(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens side by side stay two: no part at the one's edge merges with a part at the other's
        before either is consumed by its own token. Of equal ranks the leftmost merge comes first."""
        key = (left, right)
        if (out := self.stands.get(key)) is None:
            out = True
            for a, a_until in self.spine(left, 1):
                for b, b_until in self.spine(right, 0):
                    rank = self.ranks.get((a, b))
                    if rank is not None and rank < a_until and rank <= b_until:
                        out = False
            self.stands[key] = out
        return out

    def table(self, piece: bytes) -> bytes | array:
        """Counts of the prefixes of one pre-token, by bytes from 0 on. Of the last tokens only as many are held as a token can
        go back."""
        size = min(len(piece), self.longest) + 1
        counts, last, ids, stands = array("I", [0]), [b""] * size, self.ids, self.stands
        before = 0  # where the last token of the prefix before this one starts: it often goes on
        for end in range(1, len(piece) + 1):
            start, token = before, piece[before:end]
            ok = token in ids
            if ok and start and (ok := stands.get((last[start % size], token))) is None:
                ok = self.stand(last[start % size], token)
            if not ok:
                for start in range(end - 1, max(0, end - self.longest) - 1, -1):
                    token = piece[start:end]
                    if start != before and token in ids:
                        if not start:
                            break
                        if (ok := stands.get((last[start % size], token))) is None:
                            ok = self.stand(last[start % size], token)
                        if ok:
                            break
                else:
                    raise ValueError("a byte is not in the vocabulary")
            counts.append(counts[start] + 1)
            last[end % size] = token
            before = start
        return counts if len(counts) > 256 and max(counts) > 255 else bytes(counts.tolist())

    def learn(self, pieces: list[str], own: dict[str, bytes | array]) -> list[int]:
        """Counts of the pre-tokens, whose tables are kept: those of long ones in own, a text's, alone."""
        if len(self.totals) > REMEMBERED:
            self.tables.clear()
            self.totals.clear()
        if len(self.stands) > 2 * REMEMBERED:
            self.stands.clear()
        for p in set(pieces).difference(self.totals):
            if len(p) > LONG:
                if p not in own:
                    own[p] = self.table(p.encode())
                continue
            t = self.table(p.encode())
            self.tables[p] = t
            self.totals[p] = t[-1]
        if own:
            return [own[p][-1] if p in own else self.totals[p] for p in pieces]
        return list(map(self.totals.__getitem__, pieces))

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """Stretches between special tokens, and these."""
        if not self.special or not self.special.search(text):
            return [(text, False)]
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(text[at : m.start()], False), (m[0], True)]
            at = m.end()
        return [x for x in [*out, (text[at:], False)] if x[0]]

    def prefix_table(self, text: str) -> PrefixTable:
        return PrefixTable(self, text)

    def count(self, text: str) -> int:
        return self.prefix_table(text).total


class PrefixTable:
    """Counts at every prefix of one text: at the ends of pre-tokens here, within them in the pre-tokens' tables."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.text = counter, text
        self.own: dict[str, bytes | array] = {}
        parts = counter.parts(text)
        if len(parts) == 1 and not parts[0][1]:
            self.pieces = findall(PATTERN, text)
            self.specials: frozenset[int] = frozenset()
            self.counts = counter.learn(self.pieces, self.own)
        else:
            self.pieces, self.counts, specials = [], [], set()
            for part, special in parts:
                if special:
                    specials.add(len(self.pieces))
                    self.pieces.append(part)
                    self.counts.append(1)
                else:
                    found = findall(PATTERN, part)
                    self.counts += counter.learn(found, self.own)
                    self.pieces += found
            self.specials = frozenset(specials)
        self.total = sum(self.counts)

    def _ends(self) -> None:
        self.ends = list(accumulate(map(len, self.pieces), initial=0))
        self.sums = list(accumulate(self.counts, initial=0))

    def _table(self, piece: str) -> bytes | array:
        self.counter.learn([piece], self.own)
        return self.own[piece] if piece in self.own else self.counter.tables[piece]

    def _plain(self, start: int, stop: int) -> int:
        """Tokens of text[start:stop] from a pre-token's start on, pre-tokenised again without special tokens."""
        return sum(self.counter.learn(findall(PATTERN, self.text[start:stop]), self.own))

    def _space(self, k: int) -> int:
        """The pre-token where the white space starts that one which ends within pre-token k takes in: all of it is one then."""
        while k and k - 1 not in self.specials and self.pieces[k - 1].isspace():
            k -= 1
        return k

    def at(self, i: int) -> int:
        """Tokens of the prefix of i characters."""
        if not hasattr(self, "ends"):
            self._ends()
        if i <= 0:
            return 0
        k = bisect_right(self.ends, i - 1) - 1  # the pre-token that holds the last character
        start, piece = self.ends[k], self.pieces[k]
        if k in self.specials:
            if i == self.ends[k + 1]:
                return self.sums[k + 1]
            j = k - 1 if k and k - 1 not in self.specials else k  # its first characters may join what is before
            return self.sums[j] + self._plain(self.ends[j], i)
        if self.text[i - 1].isspace():
            j = self._space(k)
            return self.sums[j] + self._plain(self.ends[j], i)
        if piece[0] == "'" and i < self.ends[k + 1]:
            return self.sums[k] + self._plain(start, i)
        return self.sums[k] + self._table(piece)[len(piece[: i - start].encode())]

    def _fit_within(self, k: int, budget: int) -> int | None:
        """The longest prefix of at most budget tokens that ends within the long pre-token k, from its table at once."""
        white = self.pieces[k].isspace()
        j = self._space(k) if white else k
        start = self.ends[j]
        text = self.text[start : self.ends[k + 1]]
        counts = np.array(memoryview(self._table(text) if not white else self.counter.table(text.encode())))
        if not text.isascii():  # the bytes at which characters end
            raw = np.frombuffer(text.encode(), np.uint8)
            counts = counts[np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))]
        first = self.ends[k] - start + 1
        fits = np.flatnonzero(counts[first:] <= budget - self.sums[j])
        return start + first + int(fits[-1]) if len(fits) else None

    def fit(self, budget: int) -> int:
        """The longest prefix, in characters, of at most budget tokens."""
        if self.total <= budget:
            return len(self.text)
        if not hasattr(self, "ends"):
            self._ends()
        # A prefix has at most one token fewer than its whole pre-tokens before it (joined white space).
        for k in range(min(bisect_right(self.sums, budget + 1), len(self.pieces)) - 1, -1, -1):
            if len(self.pieces[k]) > LONG and k not in self.specials and self.pieces[k][0] != "'":
                if (i := self._fit_within(k, budget)) is not None:
                    return i
                continue
            for i in range(self.ends[k + 1], self.ends[k], -1):
                if self.at(i) <= budget:
                    return i
        return 0


@functools.cache
def counter(file: str) -> PrefixCounter:
    return PrefixCounter(file)


def token_counts(docs: DataFrame, file: str, budget: int, id_col: str = "doc_id", text_col: str = "text", prefixes: bool = False) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit and fit_chars (the longest prefix within the budget); with prefixes also
    prefix_counts: the count at every prefix of 0, 1, ... characters."""
    small_batches(docs.sparkSession, 128)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(file)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            tables = map(c.prefix_table, texts)  # one text's at a time
            got = [(t.total, t.fit(budget), [t.at(i) for i in range(len(t.text) + 1)] if prefixes else None) for t in tables]
            cols = [pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array([x[0] for x in got], pa.int64()), pa.array([x[0] > budget for x in got]), pa.array([x[1] for x in got], pa.int64())]
            cols += [pa.array([x[2] for x in got], pa.list_(pa.int32()))] if prefixes else []
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_bytes", "n_tokens", "over_limit", "fit_chars", *(["prefix_counts"] if prefixes else [])]
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + ", prefix_counts array<int>" * prefixes).withColumnRenamed("id", id_col)

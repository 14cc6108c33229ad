"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks that overlap. Each chunk is pre-tokenised on its own, and has ends of its
pre-tokens in the two overlaps. Because a pre-token depends only on the text from its start on, two chunks that have
an end in common agree from there on: the first common end of two neighbours, among the ends that the cut-off of the
earlier chunk can't have moved, is where they are stitched. The pieces between stitches are then encoded
and their ids joined in order. Where an overlap holds no common end (one pre-token longer than the overlap), the
chunks on its two sides stay one piece and their pre-tokens are found again over both.

Texts of up to LARGE characters are cut, stitched and encoded in the task that reads them, CHUNK characters at a time.
Larger ones are cut into chunks of WIDE characters that go to tasks of their own: only the ends in the overlaps
meet by document, and of the chunks each piece's own; no task holds the text but the one that reads it.

Decoding concatenates the raw bytes of the ids.

Cases: null text is empty and has no ids; special tokens' strings are ordinary text; rows that repeat are encoded
each; an empty table gives an empty result; columns of the input other than the named two are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, quoted, small_batches
from .pretokens import boundaries, findall

CHUNK, OVERLAP = 8192, 128
LARGE, WIDE, WIDE_OVERLAP = 1 << 22, 1 << 19, 2048
#: A match can depend on this many characters after its end; ends nearer to a chunk's end aren't trusted.
LOOKAHEAD = 4
#: Pre-tokens whose ids a worker remembers; beyond that it starts anew.
REMEMBERED = 200_000


class Codec:
    """Ids of single pre-tokens as little-endian bytes, remembered; bytes of single ids."""

    def __init__(self, rank_file: str, pattern: str):
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = pattern
        #: Ids of one pre-token: the library merges each match of its pattern separately, and here a match is all there is.
        self.merge = tiktoken.Encoding("ranks", pat_str=r"(?s:.)+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.raw = {i: b for b, i in ranks.items()}
        self.known: dict[str, bytes] = {}

    @functools.cached_property
    def words(self) -> Callable[[str], list[int]]:
        """Ids of a text whose pre-tokens the library finds itself, for many words in one call."""
        import tiktoken

        return tiktoken.Encoding("words", pat_str=self.pattern, mergeable_ranks={b: i for i, b in self.raw.items()}, special_tokens={}).encode_ordinary

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> bytes:
        return b"".join(map(self.ids, stitched(self.pattern, text, chunk, overlap)))

    def ids(self, pieces: list[str]) -> bytes:
        known = self.known
        for p in set(pieces).difference(known):
            known[p] = array("I", self.merge(p)).tobytes()
        out = b"".join(map(known.__getitem__, pieces))
        if len(known) > REMEMBERED:
            known.clear()
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.raw.__getitem__, memoryview(ids).cast("I")))


@functools.cache
def codec(rank_file: str, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


def stitched(pattern: str, text: str, chunk: int, overlap: int) -> Iterator[list[str]]:
    """Pre-tokens of a text, by chunks that each start at the stitch with the one before."""
    at, stop, width = 0, min(len(text), chunk), chunk
    pieces = findall(pattern, text[:stop])
    while stop < len(text):
        then = stop - overlap
        further = min(len(text), then + width)
        found = findall(pattern, text[then:further])
        tails = _ends(pieces, at)
        heads = _ends(found, then)
        both = set(tails[bisect_left(tails, then) : bisect_right(tails, stop - LOOKAHEAD)]).intersection(heads[: bisect_right(heads, stop)])
        if both:
            p = min(both)
            yield pieces[: tails.index(p) + 1]
            at, pieces, width = p, found[heads.index(p) + 1 :], chunk
        else:
            pieces, width = findall(pattern, text[at:further]), further - at  # twice as far each time
        stop = further
    yield pieces


def _ends(pieces: list[str], at: int) -> list[int]:
    return list(accumulate(map(len, pieces), initial=at))[1:]


def stitches(heads: list[list[int]], tails: list[list[int]]) -> list[int | None]:
    """For each chunk but the first the position where it takes over, or None where it can't: heads and tails hold
    positions in the whole text."""
    out: list[int | None] = []
    for i in range(1, len(heads)):
        both = set(tails[i - 1]).intersection(heads[i])
        out.append(min(both) if both else None)
    return out


def encode(
    docs: DataFrame, rank_file: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, large: int = LARGE, wide: int = WIDE, wide_overlap: int = WIDE_OVERLAP, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id and ids (binary, little-endian unsigned 32-bit) of every row."""
    spark = docs.sparkSession
    small_batches(spark, 128)
    step = wide - wide_overlap
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))

    def encode_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((c.encode(x, chunk, overlap) for x in b.column(1).to_pylist()), pa.binary())], names=["id", "ids"])

    def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of the texts, with whether they are the last, and the ends of their pre-tokens in the overlaps."""
        for b in batches:
            for i, row, text in zip(*(b.column(c).to_pylist() for c in ("id", "row", "text")), strict=True):
                for at in range(0, max(1, len(text) - wide_overlap), step):
                    yield pa.RecordBatch.from_arrays([pa.array([i], b.schema.field("id").type), pa.array([row], pa.int64()), pa.array([at], pa.int64()), pa.array([at + wide >= len(text)]), pa.array([text[at : at + wide]])], names=["id", "row", "at", "last", "text"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, tails = [], []
            for at, last, text in zip(*(b.column(c).to_pylist() for c in ("at", "last", "text")), strict=True):
                found = boundaries(pattern, text)
                sure = len(text) if last else len(text) - LOOKAHEAD
                heads.append([at + e for e in found if e <= min(wide_overlap, sure)])
                tails.append([] if last else [at + e for e in found if step <= e <= sure])
            lists = (pa.array(x, pa.list_(pa.int64())) for x in (heads, tails))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "at")), *lists], names=["row", "at", "head", "tail"])

    def shares(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """Of one document: to which piece (named by its start) each chunk's share belongs, and where the share starts and ends."""
        group = group.sort_values("at")
        at = group["at"].tolist()
        takes = [0, *stitches(group["head"].tolist(), group["tail"].tolist())]
        piece, out = 0, []
        for i, take in enumerate(takes):
            piece = piece if take is None else take
            following = None if i + 1 == len(takes) else takes[i + 1]
            out.append((key[0], at[i], piece, max(piece, at[i]), -1 if i + 1 == len(takes) else at[i + 1] if following is None else following))
        return pd.DataFrame(out, columns=["row", "at", "piece", "lo", "hi"])

    def encode_pieces(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """Of one piece: its chunks' shares, joined and encoded; mostly one chunk."""
        group = group.sort_values("at")
        text = "".join(t[lo - a : None if hi < 0 else hi - a] for t, a, lo, hi in zip(group["text"], group["at"], group["lo"], group["hi"], strict=True))
        return pd.DataFrame({"row": [key[0]], "piece": [key[1]], "ids": [codec(rank_file, pattern).encode(text, chunk, overlap)]})

    def join_ids(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": [key[0]], "ids": [b"".join(group.sort_values("piece")["ids"])]})

    size = F.length("text")
    here = rows.where(size <= large).mapInArrow(encode_here, f"id {kind}, ids binary")
    # Chunks are written once: rows get a number of their own, as ids may repeat or be null.
    chunks = cut(rows.where(size > large).withColumn("row", F.monotonically_increasing_id()).mapInArrow(chunks_of, f"id {kind}, row long, at long, last boolean, text string"), "chunks")
    found = chunks.repartition("row", "at").mapInArrow(ends, "row long, at long, head array<long>, tail array<long>")
    pieces = found.groupBy("row").applyInPandas(shares, "row long, at long, piece long, lo long, hi long")
    coded = chunks.select("row", "at", "text").join(pieces, ["row", "at"]).groupBy("row", "piece").applyInPandas(encode_pieces, "row long, piece long, ids binary")
    whole = coded.groupBy("row").applyInPandas(join_ids, "row long, ids binary").join(chunks.where("at = 0").select("row", "id"), "row").select("id", "ids")
    return here.unionByName(whole).select(F.col("id").alias(id_col), "ids")


def decode(coded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """id and bytes of every row of coded (id, ids): the concatenated bytes of its ids."""

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((c.decode(x or b"") for x in b.column(1).to_pylist()), pa.binary())], names=["id", "bytes"])

    return coded.select(F.col(quoted(id_col)).alias("id"), "ids").mapInArrow(to_bytes, f"id {coded.schema[id_col].dataType.simpleString()}, bytes binary").withColumnRenamed("id", id_col)


def digests(coded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens and the hashes of the ids and of what they decode to, for each row of coded (id, ids)."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        for b in batches:
            ids = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), *(pa.array([hashlib.sha256(f(x)).hexdigest() for x in ids], pa.string()) for f in (bytes, c.decode))],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return coded.select(F.col(quoted(id_col)).alias("id"), "ids").mapInArrow(hashes, f"id {coded.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)

"""Removal of repeated byte strings by suffix arrays, spread over the cluster by content.

A string of WINDOW bytes (a window) that also starts earlier is repeated: at a smaller document id, or earlier in the same
document. Every byte that a repeated window covers is removed; windows are judged on the input. Matches never cross documents.

1. A window's anchor is its ANCHOR-byte string of smallest hash (the leftmost of several), so equal windows have equal anchors
   at equal offsets. Neighbouring windows that share an anchor are one piece of text, keyed by the anchor's hash.
2. Anchors are counted by hash. Those that occur once can't lie in a repeated window. A Bloom filter of the others, of at most
   bloom.MOST_BITS bits, tells them apart where the texts are read; with more than it can hold, a join does.
3. Equal pieces under one key become one, with their first occurrence and number (a partial aggregation before the shuffle).
4. The pieces of a key form a text, and the texts of about BLOCK bytes are sorted at once by suffix_arrays; suffixes that share
   WINDOW bytes stand side by side, and all but the earliest of each such class are repeated.
5. Keys whose pieces exceed LARGE bytes are divided by longer anchors: a window reaches at least half of the bytes that its
   anchor lacks to the anchor's left or right, so that longer string takes the anchor's place and each window goes on under
   one of two such keys. An anchor of WINDOW bytes has a single piece, so this ends whatever the texts.
6. What is repeated returns to the documents by the pieces' occurrences, and each document's runs are cut out.

docs is read several times: a source that gives other rows each time has to be written first. Cases: null text is empty; empty
texts and those under WINDOW bytes lose nothing; an empty table gives an empty result; a null id is smaller than all others;
of rows with one id, the order is that of writing them once; columns other than the named ones are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import cut, small_batches
from .suffix_array import suffix_arrays

WINDOW, ANCHOR = 100, 20
#: Window starts that are hashed at once.
SPAN = 1 << 17
#: Bytes of pieces that are sorted at once, that a task sorts in all, about, and above which one key's are divided.
BLOCK, TASK, LARGE = 2 << 20, 2 << 20, 8 << 20

MULTIPLIER, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every string of width bytes, by doubling."""
    with np.errstate(over="ignore"):
        out, done, power, step, by = None, 0, codes.astype(np.uint64) + np.uint64(1), 1, MULTIPLIER
        places = len(codes) - width + 1
        while True:
            if width & step:
                part = power[done : done + places]
                out = part.copy() if out is None else out * by + part
                done += step
            if step * 2 > width:
                break
            power = power[:-step] * by + power[step:]
            by, step = by * by, step * 2
        out ^= out >> np.uint64(29)
        out *= MIX
        out ^= out >> np.uint64(32)
    return out


def _pieces(codes: np.ndarray, ends: np.ndarray, window: int, anchor: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, anchor's place, first window start, last window start) of the pieces of texts laid end to end."""
    n, reach = len(codes), window - anchor + 1
    end_of = np.repeat(ends, np.diff(ends, prepend=0))
    for lo in range(0, max(0, n - window + 1), SPAN):
        part = codes[lo : lo + SPAN + window - 1]
        if len(part) < window:
            return
        h = hashes(part, anchor)
        least = (h >> np.uint64(18) << np.uint64(18)) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while span * 2 <= reach:
            least, span = np.minimum(least[:-span], least[span:]), span * 2
        if span < reach:
            least = np.minimum(least[: len(least) - (reach - span)], least[reach - span :])
        at = (least & np.uint64((1 << 18) - 1)).astype(np.int64)
        starts = np.arange(len(at)) + lo
        inside = starts + window <= end_of[lo : lo + len(at)]
        edge = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])]))
        last = np.concatenate([edge[1:], [len(at)]]) - 1
        keep = inside[edge]
        edge, last = edge[keep], last[keep]
        yield h[at[edge]], at[edge] + lo, edge + lo, last + lo


def _laid(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    whole = b"".join(texts)
    return whole, np.frombuffer(whole, np.uint8), np.cumsum([len(t) for t in texts], dtype=np.int64)


def _texts(b: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return [x or b"" for x in b.column(name).to_pylist()]


def _counted(window: int, anchor: int):
    """Hashes of the anchors of pieces with their number in the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, codes, ends = _laid(_texts(b))
            for keys, *_ in _pieces(codes, ends, window, anchor):
                u, n = np.unique(keys.view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], names=["key", "n"])

    return run


PIECE = "key long, at int, piece binary, pid binary, id long, row long, pos long"


def _piece_rows(key, at, piece: list[bytes], id_, row, pos) -> Iterator[pa.RecordBatch]:
    """Rows of PIECE of columns; key and at are arrays."""
    told = np.rec.fromarrays([key, at], dtype=[("key", ">i8"), ("at", ">i4")]).tobytes()
    pid = [hashlib.blake2b(told[k : k + 12] + p, digest_size=16).digest() for k, p in zip(range(0, len(told), 12), piece, strict=True)]
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    cols = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip((key, at, piece, pid, id_, row, pos), kinds, strict=True)]
    whole = pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in PIECE.split(", ")])
    for k in range(0, whole.num_rows, 8192):
        yield whole.slice(k, 8192)


def _cut_pieces(window: int, anchor: int, words=None):
    """Pieces whose anchors the filter has (words), or stand in the column places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if words is None else words.value
        for b in batches:
            whole, codes, ends = _laid(_texts(b))
            begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            if bits is None:
                places = [np.array(x, np.int64) + s for x, s in zip(b.column("places").to_pylist(), begins.tolist(), strict=True)]
                places = np.concatenate(places) if places else np.empty(0, np.int64)
            for keys, at, first, last in _pieces(codes, ends, window, anchor):
                keep = bloom.contains(bits, keys) if bits is not None else np.isin(at, places)
                f, e = first[keep], last[keep]
                docs = np.searchsorted(ends, f, "right")
                pieces = [whole[x:y] for x, y in zip(f.tolist(), (e + window).tolist(), strict=True)]
                yield from _piece_rows(keys.view(np.int64)[keep], at[keep] - f, pieces, b.column("id").take(pa.array(docs)), b.column("row").take(pa.array(docs)), f - begins[docs])

    return run


def _places(window: int, anchor: int):
    """Every anchor with its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, codes, ends = _laid(_texts(b))
            rows = b.column("row").to_numpy(zero_copy_only=False)
            begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            for keys, at, first, _ in _pieces(codes, ends, window, anchor):
                d = np.searchsorted(ends, first, "right")
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(rows[d]), pa.array(at - begins[d])], names=["key", "row", "place"])

    return run


def _alike(text: bytes, order: np.ndarray, window: int) -> np.ndarray:
    """Whether each window of order equals the one after it."""
    same = np.ones(max(0, len(order) - 1), bool)
    if window < 8:
        wide, steps = np.frombuffer(text, np.uint8), range(window)
    else:  # eight bytes from every place
        wide = np.ascontiguousarray(np.ndarray(max(0, len(text) - 7), "<u8", text, strides=(1,)))
        steps = sorted({*range(0, window - 7, 8), window - 8})
    left = np.arange(len(same))
    for k in steps:  # columns of the windows, until all are told apart
        here = order.take(left)
        here += k
        there = order.take(left + 1)
        there += k
        equal = wide.take(here) == wide.take(there)
        same[left[~equal]] = False
        left = left[equal]
    return same


def _sorted_blocks(window: int, block: int):
    """Of pieces in order of their keys: (pid, row, pos, n, runs) of those that hold a repeated window or occur more than once;
    runs: (first, last) window starts that are repeated in the first occurrence."""

    def done(held: list[tuple]) -> pa.RecordBatch:
        # each piece ends with a byte that UTF-8 has nowhere, so no window runs on
        laid = [p[1] + b"\xff" for p in held]
        keys = [0, *(k for k in range(1, len(held)) if held[k][0] != held[k - 1][0]), len(held)]
        texts = [laid[a] if b - a == 1 else b"".join(laid[a:b]) for a, b in itertools.pairwise(keys)]
        order = suffix_arrays(texts)  # equal windows are under one key
        sizes = np.array([len(p[1]) for p in held], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        begins = ends - sizes
        of = np.repeat(np.arange(len(held)), sizes + 1)
        order = order[(np.arange(len(of)) + window <= ends.take(of)).take(order)]
        same = _alike(b"".join(laid), order, window)
        # classes of several windows, and the earliest of each
        member = np.append(same, False)
        member[1:] |= same
        order, first = order[member], np.append(True, ~same)[member]
        w = of.take(order)
        ids, rows = np.array([p[3] or 0 for p in held], np.int64), np.array([p[4] for p in held], np.int64)
        by = np.lexsort((rows, ids, [p[3] is not None for p in held]))
        turn = np.empty(len(held), np.int64)
        turn[by] = np.cumsum(np.append(0, np.diff(rows.take(by)) != 0))
        place = (turn << 40).take(w) | (np.array([p[5] for p in held], np.int64) - begins).take(w) + order
        starts = np.flatnonzero(first)
        earliest = np.minimum.reduceat(place, starts) if len(starts) else place
        # divided keys may hold one window of one document twice
        marks = order[place != np.repeat(earliest, np.diff(starts, append=len(place)))]
        marks.sort()
        edge = np.flatnonzero(np.diff(marks, prepend=-2) != 1)
        lo, hi = marks.take(edge), marks.take(np.append(edge[1:], len(marks))[: len(edge)] - 1)
        of_run = of.take(lo)
        runs: dict[int, list[int]] = {}
        for k, x, y in zip(of_run.tolist(), (lo - begins.take(of_run)).tolist(), (hi - begins.take(of_run)).tolist(), strict=True):
            runs.setdefault(k, []).extend((x, y))
        told = [k for k, p in enumerate(held) if p[6] > 1 or k in runs]
        cols = [[held[k][2] for k in told], [held[k][4] for k in told], [held[k][5] for k in told], [int(sizes[k]) - window for k in told], [runs.get(k, []) for k in told]]
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["pid", "first_row", "first_pos", "last", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, total, group, start = 0, 0, None, 0
        for b in batches:
            for p in zip(*(b.column(c).to_pylist() for c in ("key", "piece", "pid", "id", "row", "pos", "n")), strict=True):
                if p[0] != group:
                    if group is not None and total == 1:  # a key by itself, let through by the filter
                        size -= len(held.pop()[1])
                    if size >= block:
                        yield done(held)
                        held, size = [], 0
                    group, total = p[0], 0
                held.append(p)
                size += len(p[1])
                total += p[6]
        if group is not None and total == 1:
            held.pop()
        if held:
            yield done(held)

    return run


def _longer(window: int, anchor: int):
    """Pieces again, by anchors of longer(window, anchor) bytes, to the left and to the right of the former ones."""
    more = longer(window, anchor) - anchor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for at, piece, id_, row, pos in zip(*(b.column(c).to_pylist() for c in ("at", "piece", "id", "row", "pos")), strict=True):
                # windows that start at least more bytes before the anchor, and those that end as far behind it
                for a, lo, hi in ((at - more, 0, at - more), (at, at + anchor + more - window, len(piece) - window)):
                    lo, hi = max(0, lo), min(hi, at, len(piece) - window)
                    if a < 0 or lo > hi:
                        continue
                    key = int.from_bytes(hashlib.blake2b(piece[a : a + anchor + more], digest_size=8).digest(), "big", signed=True)
                    out.append((key, a - lo, piece[lo : hi + window], id_, row, pos + lo))
            if out:
                key, at, *others = zip(*out, strict=True)
                yield from _piece_rows(np.array(key), np.array(at), *others)

    return run


def longer(window: int, anchor: int) -> int:
    return anchor + (window - anchor + 1) // 2


def _marks(pieces: DataFrame, window: int, anchor: int, block: int, large: int) -> DataFrame:
    """(row, first, last) window starts that are repeated, of all occurrences of pieces."""
    where = F.struct(F.col("id").isNotNull().alias("known"), "id", "row", "pos")
    whole = pieces.groupBy("key", "at", "piece", "pid").agg(F.min(where).alias("w"), F.count("*").alias("n"))
    whole = cut(whole.select("key", "at", "piece", "pid", "w.id", "w.row", "w.pos", "n"), "pieces")
    sizes = whole.groupBy("key").agg(F.sum(F.octet_length("piece")).alias("bytes"), F.sum("n").alias("all"))
    sizes = cut(sizes.where("`all` > 1").select("key", "bytes"), "sizes")
    hot, total = sizes.where(F.col("bytes") > large).select("key"), sizes.agg(F.sum("bytes")).first()[0] or 0
    rest, divided = whole, None
    if anchor < window and not hot.isEmpty():
        rest = whole.join(hot, "key", "left_anti")
        again = whole.join(hot, "key", "left_semi").mapInArrow(_longer(window, anchor), PIECE)
        divided = _marks(cut(again, "divided"), window, longer(window, anchor), block, large)
        split = whole.join(hot, "key", "left_semi").where("n > 1")
        copied = split.select("pid", F.col("row").alias("first_row"), F.col("pos").alias("first_pos"), (F.octet_length("piece") - window).cast("long").alias("last"), F.lit(None).cast("array<long>").alias("runs"))
    tasks = max(pieces.sparkSession.sparkContext.defaultParallelism, -(-total // TASK))
    dealt = rest.select("key", "piece", "pid", "id", "row", "pos", "n").repartition(tasks, "key").sortWithinPartitions("key")
    found = dealt.mapInArrow(_sorted_blocks(window, block), "pid binary, first_row long, first_pos long, last long, runs array<long>")
    if divided is not None:
        found = found.unionByName(copied)
    found = cut(found, "repeated")
    first = pieces.select("pid", "row", "pos").join(found, "pid")
    own = (F.col("row") == F.col("first_row")) & (F.col("pos") == F.col("first_pos"))
    runs = F.when(own, F.coalesce("runs", F.array())).otherwise(F.array(F.lit(0), F.col("last")))
    out = first.select("row", F.transform(runs, lambda x: x + F.col("pos")).alias("runs")).where(F.size("runs") > 0)
    return out if divided is None else out.unionByName(divided)


def repeated_windows(rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, block: int = BLOCK, large: int = LARGE, filter_bits: int = bloom.MOST_BITS) -> DataFrame:
    """(row, runs: first and last start of repeated windows, in turn, several rows a row) of rows (id, row, text binary); row is unique."""
    spark = rows.sparkSession
    counted = rows.select("text").mapInArrow(_counted(window, anchor), "key long, n long")
    keys = cut(counted.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"), "anchors")
    n = keys.count()
    if n * bloom.BITS_PER_KEY <= filter_bits:
        words = spark.sparkContext.broadcast(bloom.build(keys, bloom.bits_for(n, filter_bits)))
        pieces = rows.mapInArrow(_cut_pieces(window, anchor, words), PIECE)
    else:
        places = rows.select("row", "text").mapInArrow(_places(window, anchor), "key long, row long, place long")
        wanted = places.join(keys, "key", "left_semi").groupBy("row").agg(F.collect_set("place").alias("places"))
        pieces = rows.join(wanted, "row").mapInArrow(_cut_pieces(window, anchor), PIECE)
    return _marks(cut(pieces, "occurrences"), window, anchor, block, large)


def _removed(window: int, with_text: bool):
    """n_bytes, n_removed, n_spans and kept_sha256 of a text and its runs; with_text also the text that remains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, runs = _texts(b), b.column("runs")
            sizes = np.array([len(t) for t in texts], np.int64)
            begins = np.cumsum(sizes + 1) - sizes - 1  # a place between texts, so that no runs of two touch
            inner = runs.flatten()
            doc = np.repeat(np.arange(len(texts)), runs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            doc = np.repeat(doc, inner.value_lengths().to_numpy(zero_copy_only=False) // 2)
            flat = inner.flatten().to_numpy(zero_copy_only=False)
            lo, hi = flat[::2] + begins[doc], flat[1::2] + window + begins[doc]
            by = np.argsort(lo, kind="stable")
            lo, reach = lo[by], np.maximum.accumulate(hi[by])
            edge = np.flatnonzero(np.append(True, lo[1:] > reach[:-1])[: len(lo)])
            lo, hi = lo[edge], reach[np.append(edge[1:], len(reach))[: len(edge)] - 1]
            of_doc = np.append(np.searchsorted(lo, begins), len(lo))
            so_far = np.append(0, np.cumsum(hi - lo))
            lows, highs, cuts = lo.tolist(), hi.tolist(), of_doc.tolist()
            kept = []
            for text, begin, x, y in zip(texts, begins.tolist(), cuts, cuts[1:], strict=False):
                parts, at = [], 0
                for k in range(x, y):
                    parts.append(text[at : lows[k] - begin])
                    at = highs[k] - begin
                parts.append(text[at:])
                kept.append(b"".join(parts) if x < y else text)
            out = [sizes, np.diff(so_far[of_doc]), np.diff(of_doc), [hashlib.sha256(t).hexdigest() for t in kept], kept if with_text else [None] * len(kept)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            cols = [b.column("id"), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays(cols if with_text else cols[:-1], names=names if with_text else names[:-1])

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, text) of docs: row is the id where ids are whole and none repeats, else a number from writing them once."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    unlike = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL")
    if unlike.isEmpty():
        return rows.withColumn("row", F.col("id"))
    return cut(rows.withColumn("row", F.monotonically_increasing_id()), "rows")


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, block: int = BLOCK, large: int = LARGE, filter_bits: int = bloom.MOST_BITS, with_text: bool = False
) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs; with_text adds kept, the bytes that remain."""
    if not 0 < anchor <= window <= SPAN:
        raise ValueError(f"anchor ({anchor}) must be from 1 to window ({window}), and window at most {SPAN}")
    small_batches(docs.sparkSession)
    rows = _keyed(docs, id_col, text_col)
    marks = repeated_windows(rows, window, anchor, block, large, filter_bits)
    by_row = cut(marks.groupBy("row").agg(F.collect_list("runs").alias("runs")), "runs")
    kinds = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    out = rows.join(by_row, "row", "left").select("id", "text", "runs").mapInArrow(_removed(window, with_text), kinds)
    return out.withColumnRenamed("id", id_col)

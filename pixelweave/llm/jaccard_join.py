"""N-gram Jaccard join: documents whose sets of word shingles link, exactly up to collisions of 64-bit hashes, as components.

Sets are of 64-bit hashes of shingles, of which the counts use 48 within a range of hashes, 54 or more in all: two
different shingles of one hash would count as one. All else is exact.

Jaccard distance is a metric, and the join is one in its space:

1. Pivots. In one common order of all shingles, rarest first, two documents that link share one of the first
   n - needed + 1 shingles of each. Shingles are counted over the whole corpus; one that no other document has can
   join nothing, so documents with enough of those are alone. Of the documents that have a rare shingle the one with the
   smallest key is its pivot, and the pivot's region are all documents that have such a shingle: two that link are in one
   region at least. (Sampled pivots would have nearly all documents at distance 1.)
2. Regions. Within a region every document's distance to the pivot is known. What is within the radius links to the pivot:
   that ball is one component, and pairs inside it need no look. The others are divided among the Voronoi cells of further
   pivots, and by the triangle inequality a document also goes, as a visitor, to every cell whose pivot is nearer than its
   own plus two radii: every partner of it that lives there is then met. Cells are divided again, recursively, until
   they are small or one component.
3. A region of at most REGION shingles is joined so within a task. In a larger one the same steps are joins: distances
   to the pivot, the ball, then the documents within two radii against the ball, in blocks, and all those outside of it by
   cells. A cell that hardly shrinks (all its distances alike) is joined in blocks, every pair of blocks in a task of its
   own; that costs the square of the cell's shingles over REGION, and only documents that share rare shingles, aren't
   near their pivot and are about equally far from all others come to it.

Copies of a set are one node throughout, with the smallest id of the class; no pair of copies is ever made. What a
task returns are the edges of a spanning forest, never pairs. A hot shingle's list of documents is never collected:
within a flush (a bounded stretch of documents) one that HOT documents have is one entry with its number, and pivots are
a minimum by shingle that is joined back.

The flushes are numbered by partition and position, so docs must be read in a fixed order (files are).

Cases: null or empty text has no shingles and is linked with nothing; fewer than five words are one shingle; a null
doc_id is a document, not a name for a component unless alone; repeated rows link with each other; an empty table
gives an empty result; columns of the input other than the named two are not read.
"""

from __future__ import annotations

import collections
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, small_batches
from .components import connected_components
from .shingles import WORDS, Shingler, prefix_length

PERCENT = 75
#: A flush holds so many shingles or documents at most (and one document at least).
FLUSH, FLUSH_DOCS = 1_500_000, 1 << 16
#: A shingle of so many documents of a flush is sent to be counted as one entry.
HOT = 8
#: Shingles of a region that one task joins (a document counts as ROW at least), and pivots of a region that is larger.
REGION, ROW, PIVOTS = 3_000_000, 64, 16
#: A cell of more than this share of its region is joined without being divided further.
DENSE = 0.75
#: Pivots of a region within a task, and documents that are compared each with each there.
FEW, SMALL = 4, 8
KEY = 6  # bytes of a hash that are shuffled, besides its range

PROFILE = "uid long, doc_id long, n long, digest binary, keys binary, prefix array<long>"
#: Of a flush: hashes and their documents by range; in one row what is known of each document, and the documents of its
#: hot shingles; hot: those shingles by range, with their numbers, later with the logarithms of their counts.
SORTED = "range int, flush long, hashes binary, docs binary, hot binary, counts binary, meta binary, ids binary, lists binary"
COLUMNS = [c.split()[0] for c in SORTED.split(", ")]
TYPES = [pa.int32(), pa.int64(), *[pa.binary()] * 7]


def _pack(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, KEY)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :KEY] = raw
    return out.reshape(-1).view("<u8")


def _flushes(bits: int, words: int):
    """Shingles of a stretch of documents by range of their hashes, and what is to be known of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, number = Shingler(words), TaskContext.get().partitionId() << 24
        sets: list[np.ndarray] = []
        of: list[int] = []
        first: dict[bytes, int] = {}
        ids: list[int | None] = []
        meta: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            d = np.repeat(np.array(of, np.uint16), [len(s) for s in sets]) if sets else np.empty(0, np.uint16)
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            begins = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
            times = np.diff(np.r_[begins, len(h)])
            many = times >= HOT
            cold = np.repeat(~many, times)
            lists = h[begins[many]].tobytes(), times[many].astype(np.uint32).tobytes(), d[~cold].tobytes()
            rows = [(a, number, _pack(k), x.tobytes(), *[None] * 5) for a, k, x in by_range(h[cold], d[cold])]
            rows += [(a, number, None, None, _pack(k), x.astype(np.uint32).tobytes(), *[None] * 3) for a, k, x in by_range(h[begins[many]], times[many])]
            known = np.array([(-(2**63) if i is None else i) for i in ids], np.int64).tobytes() + bytes(i is None for i in ids)
            rows.append((number % (1 << bits), number, *[None] * 4, b"".join(meta), known, int(many.sum()).to_bytes(8, "little") + b"".join(lists)))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(TYPES)], names=COLUMNS)

        def by_range(h: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            """Stretches of sorted hashes of one range: the range, the hashes' bits below it, what belongs to them."""
            r = (h >> np.uint64(64 - bits)).astype(np.int64)
            low = (h >> np.uint64(64 - bits - 8 * KEY)) & np.uint64((1 << 8 * KEY) - 1)
            cuts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.empty(0, np.int64)
            for a, b in zip(cuts, np.r_[cuts[1:], len(r)], strict=False):
                yield int(r[a]), low[a:b], x[a:b]

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingler(text)
                if ids and (held + len(s) > FLUSH or len(ids) >= FLUSH_DOCS):
                    yield flush()
                    number += 1
                    held = 0
                    for x in (sets, of, first, ids, meta):
                        x.clear()
                digest = xxhash.xxh3_128_digest(s.tobytes())
                at = first.setdefault(digest, len(ids))
                if at == len(ids) and len(s):  # copies in the flush give their shingles once
                    sets.append(s)
                    of.append(at)
                    held += len(s)
                meta.append(len(s).to_bytes(8, "little") + at.to_bytes(8, "little") + digest)
                ids.append(doc_id)
        if ids:
            yield flush()

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Of one range: to each flush the shingles that are in more than one document, with how many, as logarithms."""
    column = lambda *names: zip(*(table.column(c).to_pylist() for c in names), strict=True)
    rows = [(r, f, *[None] * 4, m, i, x) for r, f, m, i, x in column("range", "flush", "meta", "ids", "lists") if m is not None]
    cold = [(f, _unpack(h), np.frombuffer(d, np.uint16)) for f, h, d in column("flush", "hashes", "docs") if h]
    hot = [(f, _unpack(h), np.frombuffer(n, np.uint32)) for f, h, n in column("flush", "hot", "counts") if h]
    if cold or hot:
        number = table.column("range")[0].as_py()
        keys = np.concatenate([x[1] for x in (*cold, *hot)])
        times = np.concatenate([np.ones(sum(len(x[1]) for x in cold), np.int64), *(x[2] for x in hot)])
        order = np.argsort(keys, kind="stable")
        same = keys[order]
        begins = np.flatnonzero(np.r_[True, same[1:] != same[:-1]])
        many = np.empty(len(keys), np.int64)
        many[order] = np.repeat(np.add.reduceat(times[order], begins), np.diff(np.r_[begins, len(same)]))
        log = np.minimum(255, np.log2(many) * 8).astype(np.uint8)
        at = 0
        for f, k, d in cold:
            own = np.flatnonzero(many[at : at + len(k)] > 1)
            if len(own):  # the log's byte follows the document's two
                tail = np.empty((len(own), 3), np.uint8)
                tail[:, :2] = d[own].view(np.uint8).reshape(-1, 2)
                tail[:, 2] = log[at + own]
                rows.append((number, f, _pack(k[own]), tail.tobytes(), *[None] * 5))
            at += len(k)
        for f, k, _ in hot:
            rows.append((number, f, None, None, _pack(k), log[at : at + len(k)].tobytes(), *[None] * 3))
            at += len(k)
    return pa.table({c: pa.array([x[i] for x in rows], k) for i, (c, k) in enumerate(zip(COLUMNS, TYPES, strict=True))})


def _profiles(bits: int, percent: int):
    """Of one flush: each document's shared shingles, and of those that may link the rarest by which they meet others."""

    def run(table: pa.Table) -> pa.Table:
        flush = table.column("flush")[0].as_py()
        meta = ids = lists = b""
        keys, docs, logs, hot, hot_logs = [], [], [], [], []
        for r, h, d, k, n, m, i, x in zip(*(table.column(c).to_pylist() for c in ("range", "hashes", "docs", "hot", "counts", "meta", "ids", "lists")), strict=True):
            top = np.uint64(r) << np.uint64(8 * KEY)
            if m is not None:
                meta, ids, lists = m, i, x
            elif h is not None:
                keys.append(_unpack(h) | top)
                tail = np.frombuffer(d, np.uint8).reshape(-1, 3)
                docs.append(np.ascontiguousarray(tail[:, :2]).view(np.uint16).reshape(-1))
                logs.append(tail[:, 2])
            else:
                hot.append(_unpack(k) | top)
                hot_logs.append(np.frombuffer(n, np.uint8))
        if hot:  # by the documents' lists, which are in the order of the whole hashes, as the ranges and their hashes are
            n = int.from_bytes(lists[:8], "little")
            times = np.frombuffer(lists, np.uint32, n, 8 + 8 * n)
            whole, log = np.concatenate(hot), np.concatenate(hot_logs)
            order = np.argsort(whole, kind="stable")
            keys.append(np.repeat(whole[order], times))
            logs.append(np.repeat(log[order], times))
            docs.append(np.frombuffer(lists, np.uint16, -1, 8 + 12 * n))
        size = len(meta) // 32
        k = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        d = np.concatenate(docs).astype(np.int64) if docs else np.empty(0, np.int64)
        g = np.concatenate(logs) if logs else np.empty(0, np.uint8)
        order = np.lexsort((k, g, d))
        k, d = k[order], d[order]
        starts = np.searchsorted(d, np.arange(size + 1))
        numbers = np.frombuffer(ids[: 8 * size], np.int64)
        out: dict[str, list] = {c: [] for c in ("uid", "doc_id", "n", "digest", "keys", "prefix")}
        for j in range(size):
            n, at = (int.from_bytes(meta[32 * j + a : 32 * j + a + 8], "little") for a in (0, 8))
            own = k[starts[j] : starts[j + 1]] if at == j else k[:0]
            wanted = prefix_length(n, percent) - (n - len(own)) if n and at == j else 0
            out["uid"].append((flush << 16) + j)
            out["doc_id"].append(None if ids[8 * size + j] else int(numbers[j]))
            out["n"].append(n)
            out["digest"].append(meta[32 * j + 16 : 32 * j + 32])
            out["keys"].append(np.sort(own).tobytes() if wanted > 0 else None)
            out["prefix"].append(own[:wanted].view(np.int64).tolist() if wanted > 0 else None)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds, strict=True)})

    return run


class Region:
    """Documents of a region with an inverted index of their shingles."""

    def __init__(self, sizes: list[int], sets: list[np.ndarray]):
        self.sizes = np.array(sizes, np.int64)
        lengths = [len(s) for s in sets]
        keys = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), lengths)
        _, which = np.unique(keys, return_inverse=True)
        order = np.argsort(which, kind="stable")
        self.posts = owner[order]
        self.begins = np.r_[0, np.cumsum(np.bincount(which))] if len(keys) else np.zeros(1, np.int64)
        self.which = which
        self.at = np.r_[0, np.cumsum(lengths)]
        self.keys = keys

    def shared(self, j: int) -> np.ndarray:
        """Intersection sizes of document j with all."""
        own = self.which[self.at[j] : self.at[j + 1]]
        a, lens = self.begins[own], self.begins[own + 1] - self.begins[own]
        at = np.repeat(a - np.r_[0, np.cumsum(lens)[:-1]], lens) + np.arange(lens.sum())
        return np.bincount(self.posts[at], minlength=len(self.sizes))

    def links(self, j: int, percent: int) -> np.ndarray:
        both = self.shared(j)
        hit = 100 * both >= percent * (self.sizes + self.sizes[j] - both)
        hit[j] = False
        return np.flatnonzero(hit)

    def distances(self, j: int) -> np.ndarray:
        both = self.shared(j)
        return 1 - both / np.maximum(1, self.sizes + self.sizes[j] - both)

    def part(self, own: np.ndarray) -> Region:
        return Region(self.sizes[own].tolist(), [self.keys[self.at[j] : self.at[j + 1]] for j in own])

    def forest(self, percent: int) -> list[tuple[int, int]]:
        """Edges that join the documents exactly as their links do."""
        root, edges, near = list(range(len(self.sizes))), [], 2 * (1 - percent / 100) + 1e-9

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def merge(j: int, others: list[int]) -> None:
            for o in others:
                a, b = find(j), find(o)
                if a != b:
                    root[b] = a
                    edges.append((j, o))

        cells = [np.arange(len(self.sizes))]
        while cells:
            own = cells.pop()
            if len({find(j) for j in own.tolist()}) < 2:
                continue  # one component: pairs inside need no look
            region = self if len(own) == len(self.sizes) else self.part(own)
            compare: Iterable[int] = range(len(own))
            if len(own) > SMALL:
                # Pivots: the first document, then each time the one farthest from those so far.
                pivot, apart = 0, []
                for _ in range(FEW):
                    merge(int(own[pivot]), own[region.links(pivot, percent)].tolist())
                    apart.append(region.distances(pivot))
                    pivot = int(np.min(apart, axis=0).argmax())
                least = np.min(apart, axis=0)
                windows = [own[d - least <= near] for d in apart]
                if max(map(len, windows)) <= DENSE * len(own):
                    cells += [w for w in windows if len(w) > 1]
                    continue
                roots = [find(j) for j in own.tolist()]
                main = collections.Counter(roots).most_common(1)[0][0]
                compare = [j for j, r in enumerate(roots) if r != main]
            for j in compare:
                merge(int(own[j]), own[region.links(j, percent)].tolist())
        return edges


def _joined(percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")  # the region's own pivot comes first
        uids = table.column("uid").to_pylist()
        region = Region(table.column("n").to_pylist(), [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()])
        edges = region.forest(percent)
        return pa.table({"u": pa.array([uids[a] for a, _ in edges], pa.int64()), "v": pa.array([uids[b] for _, b in edges], pa.int64())})

    return run


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("n", "keys", "pn", "pkeys")]
        out = []
        for n, keys, pn, pkeys in zip(*cols, strict=True):
            both = len(np.intersect1d(np.frombuffer(keys, np.uint64), np.frombuffer(pkeys, np.uint64), assume_unique=True))
            out.append(1 - both / (n + pn - both))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("region", "uid", "pivot")), pa.array(out, pa.float64())], names=["region", "uid", "pivot", "d"])


def components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, region: int = REGION, pivots: int = PIVOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bits = max(6, math.ceil(math.log2(8 * max(1, rows.rdd.getNumPartitions()))))
    flushed = rows.mapInArrow(_flushes(bits, words), SORTED)
    shared = flushed.groupBy("range").applyInArrow(_shared, SORTED)
    profile = cut(shared.groupBy("flush").applyInArrow(_profiles(bits, percent), PROFILE), "profiles")
    classes = profile.where("n > 0").groupBy("n", "digest").agg(F.min("uid").alias("node"))
    # Documents that may link, one of each class, by the rare shingles they share.
    nodes = profile.where("keys is not null").join(classes.select(F.col("node").alias("uid")), "uid")
    meets = nodes.select("uid", F.explode("prefix").alias("key"))
    pivot = meets.groupBy("key").agg(F.min("uid").alias("pivot"), F.count("*").alias("k")).where("k > 1").select("key", "pivot")
    placed = cut(meets.join(pivot, "key").select("uid", "pivot").distinct(), "placed")
    sized = placed.join(nodes.select("uid", _weight("keys").alias("weight")), "uid")
    sizes = cut(sized.groupBy("pivot").agg(F.sum("weight").alias("size")), "sizes")
    members = placed.join(nodes.select("uid", "n", "keys"), "uid").join(sizes, "pivot")
    links = _region_links(members, percent, region, pivots)
    joined = connected_components(links).select(F.col("node"), "component")
    named = profile.join(classes, ["n", "digest"], "left").withColumn("node", F.coalesce("node", "uid")).select("doc_id", "n", "node")
    named = cut(named.join(joined, "node", "left").select("doc_id", "n", F.coalesce("component", "node").alias("component")), "named")
    names = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(names, "component").select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _weight(keys: str) -> Column:
    """Shingles of a row; a row counts as ROW at least."""
    return F.greatest(F.octet_length(keys) / 8, F.lit(ROW))


def _apart(rows: DataFrame, pivots: DataFrame, on: str) -> DataFrame:
    """(region, uid, pivot, d) of the rows (region, uid, n, keys) and each pivot (on, pivot, pn, pkeys) of their region."""
    return rows.join(pivots, on).select("region", "uid", "pivot", "n", "keys", "pn", "pkeys").mapInArrow(_distances, "region string, uid long, pivot long, d double")


def _in_blocks(rows: DataFrame, blocks: Column, percent: int) -> DataFrame:
    """Edges (u, v) of regions of rows (region, uid, n, keys): every two blocks of a region in a task of their own."""
    own = F.pmod(F.xxhash64("uid", F.lit(7)), blocks).cast("int")
    paired = rows.withColumn("b", own).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    name = F.concat_ws("+", "region", F.least("b", "o").cast("string"), F.greatest("b", "o").cast("string"))
    return paired.select(name.alias("region"), "uid", "n", "keys").groupBy("region").applyInArrow(_joined(percent), "u long, v long")


def _region_links(members: DataFrame, percent: int, limit: int, pivots: int) -> DataFrame:
    """Edges (u, v) of spanning forests of the pivots' regions, members (pivot, uid, n, keys, size)."""
    radius = 1 - percent / 100 + 1e-9  # distances are rounded
    found = members.where(F.col("size") <= limit).select("pivot", "uid", "n", "keys").groupBy("pivot").applyInArrow(_joined(percent), "u long, v long")
    large = members.where(F.col("size") > limit).select(F.col("pivot").cast("string").alias("region"), "pivot", "uid", "n", "keys")
    if large.isEmpty():
        return found
    own = large.where(F.col("uid") == F.col("pivot")).select("pivot", F.col("n").alias("pn"), F.col("keys").alias("pkeys"))
    known = cut(_apart(large, own, "pivot"), "distances").select("region", "uid", "d", "pivot")
    found = found.unionByName(known.where((F.col("d") <= radius) & (F.col("uid") != F.col("pivot"))).select(F.col("pivot").alias("u"), F.col("uid").alias("v")))
    placed = cut(large.join(known.select("region", "uid", "d"), ["region", "uid"]).select("region", "uid", "n", "keys", "d"), "rings")
    # The ring around the ball against it: blocks of the ring with blocks of those in the ball that its inner edge can reach.
    ring = placed.where((F.col("d") > radius) & (F.col("d") <= 2 * radius))
    edge = ring.groupBy("region").agg(F.sum(_weight("keys")).alias("ring"), F.min("d").alias("inner"))
    ball = placed.where(F.col("d") <= radius).join(edge, "region").where(F.col("d") >= F.col("inner") - radius)
    wide = ball.groupBy("region").agg(F.sum(_weight("keys")).alias("ball"))
    cuts = edge.join(wide, "region").select("region", *(F.ceil(2 * F.col(c) / limit).cast("int").alias(c) for c in ("ring", "ball")))
    part = lambda c: F.pmod(F.xxhash64("uid", F.lit(7)), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    sides = [
        ring.join(cuts, "region").select("region", "uid", "n", "keys", part("ring").alias("a"), each("ball").alias("b")),
        ball.drop("ring", "inner").join(cuts, "region").select("region", "uid", "n", "keys", each("ring").alias("a"), part("ball").alias("b")),
    ]
    met = sides[0].unionByName(sides[1]).groupBy("region", "a", "b").applyInArrow(_joined(percent), "u long, v long")
    outer = cut(placed.where(F.col("d") > radius).select("region", "uid", "n", "keys"), "outer")
    return found.unionByName(met).unionByName(_cell_links(outer, percent, limit, pivots))


def _cell_links(members: DataFrame, percent: int, limit: int, pivots: int) -> DataFrame:
    """Edges (u, v) of spanning forests of the regions of members (region, uid, n, keys), by Voronoi cells of sampled pivots."""
    radius = 1 - percent / 100
    found = None
    for _ in range(4):
        sizes = cut(members.groupBy("region").agg(F.sum(_weight("keys")).alias("size")), "sizes")
        small = members.join(sizes.where(F.col("size") <= limit).select("region"), "region")
        got = small.select("region", "uid", "n", "keys").groupBy("region").applyInArrow(_joined(percent), "u long, v long")
        found = got if found is None else found.unionByName(got)
        big = sizes.where(F.col("size") > limit)
        if big.isEmpty():
            return found
        large = members.join(big, "region")
        # Pivots: of each of a fixed number of slots of hashes the one with the smallest.
        slot = F.pmod(F.xxhash64("uid", F.lit(5)), F.lit(pivots))
        chosen = large.withColumn("slot", slot).groupBy("region", "slot").agg(F.min_by(F.struct("uid", "n", "keys"), F.xxhash64("uid")).alias("p"))
        chosen = chosen.select("region", F.col("p.uid").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.keys").alias("pkeys"))
        pairs = cut(_apart(large, chosen, "region"), "distances")
        nearest = pairs.groupBy("region", "uid").agg(F.min("d").alias("least"))
        # A little more than two radii: distances are rounded.
        cells = pairs.join(nearest, ["region", "uid"]).where(F.col("d") - F.col("least") <= 2 * radius + 1e-9).select("region", "uid", "pivot")
        placed = large.join(cells, ["region", "uid"]).withColumn("cell", F.concat_ws("/", "region", F.col("pivot").cast("string")))
        placed = cut(placed.select("region", "size", "cell", "uid", "n", "keys"), "cells")
        cell_sizes = placed.groupBy("region", "cell").agg((F.sum(_weight("keys")) / F.first("size")).alias("part"), F.sum(_weight("keys")).alias("in_cell"))
        # Regions of which a cell hardly shrank go in blocks instead.
        dense = cut(cell_sizes.where((F.col("part") > DENSE) & (F.col("in_cell") > limit)).select("region").distinct(), "dense")
        found = found.unionByName(_in_blocks(large.join(dense, "region"), F.greatest(F.ceil(2 * F.col("size") / limit).cast("int"), F.lit(2)), percent))
        members = cut(placed.join(dense, "region", "left_anti").select(F.col("cell").alias("region"), "uid", "n", "keys"), "regions")
    # Deeper than that: in blocks, whatever their size.
    sizes = members.groupBy("region").agg(F.sum(_weight("keys")).alias("size"))
    return found.unionByName(_in_blocks(members.join(sizes, "region"), F.greatest(F.ceil(2 * F.col("size") / limit).cast("int"), F.lit(2)), percent))


def first_of_each(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each group: the one with the smallest doc_id, null last; of equal ids any one. Rows
    are told apart by a key of their own, so null and repeated ids are rows like others."""
    keyed, row = numbered(docs, "keyed")
    found = components(keyed, id_col=row).select(F.col(row).alias("found"), "component_id")
    ids = keyed.select(F.col(row).alias("found"), F.col("doc_id").alias("id"))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "found")
    first = found.join(ids, "found").groupBy("component_id").agg(F.min(order).alias("m")).select(F.col("m.found").alias("first"))
    return keyed.join(first, keyed[row] == first["first"], "left_semi").select(*docs.columns)

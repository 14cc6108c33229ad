"""A small causal self-attention model in numpy over subword ids (one head, residual, learned relative positions).

Ids are named by their rank, by falling corpus count, and make a tree: classes of about equal weight, and leaves of at
most LEAF ids of consecutive ranks within a class. The next id is predicted from the ids before it in up to three
factors, each a softmax over the context's products with vectors: its class, its leaf where the class has several, and
itself within the leaf. The two inner factors start from the smoothed corpus shares. Every id has an input and an output
vector of its own, each the sum of two hashed ones (remainder and quotient of the rank by HASHED). An end mark, which is
also the begin mark, is a class of its own.

A text is cut into blocks of STRIDE tokens. A block's window is LENGTH tokens, its own and those before it: windows
overlap, every token is scored exactly once, in the window of its own block, and the blocks of many texts go through
masked attention together. Keys and values are those of the tokens, so windows share them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np

STRIDE, LENGTH, WIDTH, CLASSES = 16, 32, 16, 16
#: Rows of the hashed tables of id vectors; ids of a leaf.
HASHED, LEAF = 1024, 256
#: Blocks that go through the model together.
BATCH = 512
#: Largest norm of a step's mean gradient, and steps over which the rate rises to its full size.
NORM, WARM = 1.0, 20
NEVER = np.float32(-1e9)


class Tree:
    """Ids by rank, their classes and leaves, and the log shares within the nodes. The end mark has rank size."""

    def __init__(self, counts: np.ndarray):
        self.size = size = len(counts)
        self.mark = zlib.crc32(np.ascontiguousarray(counts).tobytes())
        order = np.lexsort((np.arange(size), -counts))
        self.rank = np.empty(size, np.uint32)
        self.rank[order] = np.arange(size)
        weight = counts[order] + 0.1
        middle = (np.cumsum(weight) - weight / 2) / weight.sum()
        of = np.unique(np.minimum(CLASSES - 1, (middle * CLASSES).astype(np.int64)), return_inverse=True)[1]  # no class is empty
        self.classes = int(of[-1]) + 1
        edge = np.flatnonzero(np.diff(of)) + 1  # a class's first rank, but for the first
        wide = np.bincount(of)[of] > LEAF
        ranks = np.arange(size)
        begin = np.unique(np.concatenate([[0], edge, ranks[(ranks % HASHED == 0) | (wide & (ranks % LEAF == 0))]]))
        #: First ranks of the leaves, then size (the end mark's leaf), then its end.
        self.begin = np.append(begin, [size, size + 1])
        self.leaves = len(begin)
        leaf_class = np.append(of[begin], self.classes)
        self.class_of_leaf = leaf_class
        self.leaf_of = np.append(np.searchsorted(begin, ranks, "right") - 1, self.leaves).astype(np.uint16)
        self.ends = list(zip(self.begin.tolist(), self.begin[1:].tolist(), strict=False))
        by = np.searchsorted(leaf_class, np.arange(self.classes + 1)).tolist()
        #: First leaf and end of the classes that have several.
        self.split = [(a, b) for a, b in zip(by, by[1:], strict=False) if b - a > 1]
        by_leaf, by_class = np.add.reduceat(weight, begin), np.bincount(of, weight)
        self.id_share = np.log(weight / by_leaf[self.leaf_of[:size]]).astype(np.float32)
        self.leaf_share = np.log(by_leaf / by_class[leaf_class[:-1]]).astype(np.float32)


def shapes(tree: Tree) -> dict[str, tuple[int, ...]]:
    high = (tree.size // HASHED + 1, WIDTH)
    return {
        "low": (HASHED, WIDTH), "high": high, "qkv": (WIDTH, 3 * WIDTH), "near": (LENGTH,), "classes": (tree.classes + 1, WIDTH), "bias": (tree.classes + 1,),
        "leaves": (tree.leaves, WIDTH), "low_out": (HASHED, WIDTH), "high_out": high,
    }


def count(tree: Tree) -> int:
    return sum(int(np.prod(s)) for s in shapes(tree).values())


def views(flat: np.ndarray, tree: Tree) -> dict[str, np.ndarray]:
    """The model's arrays as parts of one."""
    out, at = {}, 0
    for k, s in shapes(tree).items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s)
        at += n
    return out


def start(tree: Tree, seed: int = 11) -> np.ndarray:
    """First weights, as one array."""
    rng = np.random.default_rng(seed)
    flat = (0.2 * rng.standard_normal(count(tree))).astype(np.float32)
    m = views(flat, tree)
    for k in ("near", "bias", "leaves", "low_out", "high_out"):
        m[k][:] = 0
    return flat


def blocks(tree: Tree, texts: Iterable[tuple[int, np.ndarray]], most: int = BATCH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
    """Batches of blocks of the texts (name, ranks): inputs and targets (blocks x STRIDE), which blocks have nothing before
    them, and (name, first block, end) of the texts' parts. A target that isn't to be scored is -1. A text of any length
    passes in parts; a part that goes on has the block before it once more, as context alone."""
    x, y, alone, parts, n = np.full((most, STRIDE), tree.size, np.int64), np.full((most, STRIDE), -1, np.int64), np.zeros(most, bool), [], 0
    for name, ranks in texts:
        whole = len(ranks) + 1
        own = np.empty(-(-whole // STRIDE) * STRIDE + 1, np.int64)
        own[0] = tree.size
        own[1:whole] = ranks
        own[whole:] = tree.size
        a, end = 0, len(own) // STRIDE
        while a < end:
            back = int(a > 0)
            if n + back + 1 > most:
                yield x[:n], y[:n], alone[:n], parts
                x, y, alone, parts, n = np.full((most, STRIDE), tree.size, np.int64), np.full((most, STRIDE), -1, np.int64), np.zeros(most, bool), [], 0
            b = min(end, a + most - n - back)
            lo, hi = (a - back) * STRIDE, b * STRIDE
            x[n : n + b - a + back].reshape(-1)[:] = own[lo:hi]
            goal = y[n : n + b - a + back].reshape(-1)
            goal[:] = own[lo + 1 : hi + 1]
            goal[: back * STRIDE] = -1
            goal[max(0, whole - lo) :] = -1
            alone[n] = True
            parts.append((name, n, n + b - a + back))
            n += b - a + back
            a = b
    if n:
        yield x[:n], y[:n], alone[:n], parts


def inputs(m: dict[str, np.ndarray], ranks: np.ndarray) -> np.ndarray:
    """Input vectors of ranks."""
    e = m["low"].take(ranks % HASHED, 0)
    e += m["high"].take(ranks // HASHED, 0)
    return e


def _windows(t: np.ndarray) -> np.ndarray:
    """Of rows of blocks, one block of zeros before them, the rows of each block's window."""
    a, b = t.strides
    return np.lib.stride_tricks.as_strided(t, (len(t) // STRIDE - LENGTH // STRIDE + 1, LENGTH, t.shape[1]), (a * STRIDE, a, b))


#: How far before its query each key of a window is; later ones are masked.
DISTANCE = np.arange(LENGTH - STRIDE, LENGTH)[:, None] - np.arange(LENGTH)
LATER = DISTANCE < 0


#: Sums of exponentials that are taken as they are; a batch with others has its logits shifted by their largest.
SAFE = (1e-12, 1e12)


def _safe(total: np.ndarray) -> bool:
    return bool(SAFE[0] < total.min() and total.max() < SAFE[1])


def attend(m: dict[str, np.ndarray], e: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, tuple]:
    """What the tokens with input vectors e take in from their windows, with a column of ones, and what the gradient needs.
    Values have a column of ones, so the weights' sums come with the sums of weighted values."""
    n = len(alone)
    wide = np.empty((STRIDE + len(e), 3 * WIDTH + 1), np.float32)
    wide[:STRIDE] = 0
    np.matmul(e, m["qkv"], out=wide[STRIDE:, :-1])
    wide[:, -1] = 1
    q = wide[STRIDE:, :WIDTH].reshape(n, STRIDE, WIDTH)
    k, v = _windows(wide[:, WIDTH : 2 * WIDTH]), _windows(wide[:, 2 * WIDTH :])
    near = np.where(LATER, NEVER, m["near"][np.maximum(DISTANCE, 0)])
    a = _logits(q, k, near, alone)
    np.exp(a, out=a)
    mixed = (a @ v).reshape(-1, WIDTH + 1)
    if not _safe(mixed[:, -1]):
        a = _logits(q, k, near, alone)
        a -= a.max(2, keepdims=True)  # the key at the query's own place is never masked
        np.exp(a, out=a)
        mixed = (a @ v).reshape(-1, WIDTH + 1)
    part = np.float32(1) / mixed[:, -1:]
    mixed *= part
    return mixed, (q, k, v, a, part)


def _logits(q: np.ndarray, k: np.ndarray, near: np.ndarray, alone: np.ndarray) -> np.ndarray:
    a = q @ k.transpose(0, 2, 1)
    a += near
    a[alone, :, : LENGTH - STRIDE] = NEVER
    return a


def _softmax(vectors: np.ndarray, own: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log-probabilities at one place of each of own's products with the vectors; exponentials of the products (vectors x own),
    their sums, and the places in them."""
    z = vectors @ own.T
    places = at * z.shape[1]
    places += np.arange(z.shape[1])
    got = z.reshape(-1).take(places)
    np.exp(z, out=z)
    total = z.sum(0)
    if not _safe(total):
        z = vectors @ own.T
        z -= z.max(0)
        got = z.reshape(-1).take(places)
        np.exp(z, out=z)
        total = z.sum(0)
    got -= np.log(total)
    return got, z, total, places


def _errors(vectors: np.ndarray, own: np.ndarray, at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The summed loss of a factor, its gradient by the vectors and by own, and its errors times the sums in part."""
    got, z, total, places = _softmax(vectors, own, at)
    z.reshape(-1)[places] -= total
    part = (np.float32(1) / total)[:, None]
    back = z.T @ vectors[:, :WIDTH]
    back *= part
    return -float(got.sum(dtype=np.float64)), z @ (own[:, :WIDTH] * part), back, z, part


def _with(vectors: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Vectors with a column of shares, which the contexts' column of ones adds to the products."""
    out = np.empty((len(shares), WIDTH + 1), np.float32)
    out[:, :WIDTH] = vectors
    out[:, WIDTH] = shares
    return out


def outputs(m: dict[str, np.ndarray], tree: Tree, a: int, b: int) -> np.ndarray:
    """Output vectors and log shares of a leaf's ranks."""
    out = np.empty((b - a, WIDTH + 1), np.float32)
    top = a % HASHED
    np.add(m["low_out"][top : top + b - a], m["high_out"][a // HASHED], out=out[:, :WIDTH])
    out[:, WIDTH] = tree.id_share[a:b]
    return out


def _factors(m: dict[str, np.ndarray], tree: Tree, goal: np.ndarray) -> Iterator[tuple[slice, str, int, int, np.ndarray, np.ndarray]]:
    """Inner factors of sorted targets: the rows, which factor, its children from first to last, their vectors with shares,
    and the child found."""
    at = np.searchsorted(goal, tree.begin)
    for a, b in tree.split:
        rows = slice(int(at[a]), int(at[b]))
        if rows.start < rows.stop:
            yield rows, "leaf", a, b, _with(m["leaves"][a:b], tree.leaf_share[a:b]), tree.leaf_of.take(goal[rows]).astype(np.int64) - a
    for j in np.flatnonzero(np.diff(at)).tolist():
        a, b = tree.ends[j]
        if b - a > 1:
            rows = slice(int(at[j]), int(at[j + 1]))
            yield rows, "id", a, b, outputs(m, tree, a, b), goal[rows] - a


def _contexts(m: dict[str, np.ndarray], e: np.ndarray, mixed: np.ndarray, y: np.ndarray, tree: Tree) -> tuple[np.ndarray, ...]:
    """Places of the targets, these sorted, their contexts with a column of ones, and their classes."""
    h = mixed.copy()
    h[:, :WIDTH] += e
    order = _order(y, tree)
    goal = y.take(order)
    return order, goal, h.take(order, 0), tree.class_of_leaf.take(tree.leaf_of.take(goal))


@np.errstate(over="ignore", invalid="ignore", divide="ignore")  # such sums aren't safe: their logits are shifted
def token_scores(m: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, alone: np.ndarray, tree: Tree, table: np.ndarray | None = None) -> np.ndarray:
    """Natural log-probability of each target, 0 where it is -1. table: the input vectors of all ranks, if at hand."""
    flat = x.reshape(-1)
    e = inputs(m, flat) if table is None else table.take(flat, 0)
    y = y.reshape(-1)
    order, goal, hs, cls = _contexts(m, e, attend(m, e, alone)[0], y, tree)
    got = _softmax(_with(m["classes"], m["bias"]), hs, cls)[0]
    for rows, _, _, _, vectors, found in _factors(m, tree, goal):
        got[rows] += _softmax(vectors, hs[rows], found)[0]
    out = np.zeros(len(y), np.float32)
    out[order] = got
    return out.reshape(x.shape)


def _order(y: np.ndarray, tree: Tree) -> np.ndarray:
    """Places of the targets that are scored, by rank. Narrow integers are sorted by radix."""
    kind = np.uint16 if tree.size < 65535 else np.uint32
    return np.argsort(y.astype(kind), kind="stable")[: int((y >= 0).sum())]


@np.errstate(over="ignore", invalid="ignore", divide="ignore")
def gradient(m: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, alone: np.ndarray, tree: Tree, out: dict[str, np.ndarray]) -> float:
    """The gradient of the summed loss into out, whose arrays are zero; returns that loss."""
    n, flat, y = len(alone), x.reshape(-1), y.reshape(-1)
    e = inputs(m, flat)
    mixed, (q, k, v, a, part) = attend(m, e, alone)
    order, goal, hs, cls = _contexts(m, e, mixed, y, tree)
    loss, d, ds, z, part_of = _errors(_with(m["classes"], m["bias"]), hs, cls)
    out["classes"] += d
    out["bias"] += (z @ part_of)[:, 0]
    for rows, kind, first, last, vectors, found in _factors(m, tree, goal):
        more, d, back, _, _ = _errors(vectors, hs[rows], found)
        loss += more
        ds[rows] += back
        if kind == "leaf":
            out["leaves"][first:last] += d
        else:
            out["low_out"][first % HASHED : (last - 1) % HASHED + 1] += d
            out["high_out"][first // HASHED] += d.sum(0)
    wide = np.zeros((len(flat), WIDTH + 1), np.float32)
    dh = wide[:, :WIDTH]
    dh[order] = ds
    # Attention: the rows' normalisation is kept out of the wide arrays, and the values' ones take off its part of the gradient.
    np.negative(np.einsum("ij,ij->i", dh, mixed[:, :WIDTH]), out=wide[:, WIDTH])
    da = wide.reshape(n, STRIDE, WIDTH + 1) @ v.transpose(0, 2, 1)
    da *= a
    near = np.einsum("nij,ni->ij", da, part.reshape(n, STRIDE))
    np.add.at(out["near"], DISTANCE[~LATER], near[~LATER])
    dqkv = np.zeros((STRIDE + len(e), 3 * WIDTH), np.float32)
    np.multiply((da @ k).reshape(-1, WIDTH), part, out=dqkv[STRIDE:, :WIDTH])
    for lo, d in ((WIDTH, da.transpose(0, 2, 1) @ (q * part.reshape(n, STRIDE, 1))), (2 * WIDTH, a.transpose(0, 2, 1) @ (dh * part).reshape(n, STRIDE, WIDTH))):
        dqkv[STRIDE:, lo : lo + WIDTH].reshape(n, STRIDE, WIDTH)[:] = d[:, LENGTH - STRIDE :]
        dqkv[:-STRIDE, lo : lo + WIDTH].reshape(n, STRIDE, WIDTH)[:] += d[:, : LENGTH - STRIDE]
    dqkv = dqkv[STRIDE:]
    out["qkv"] += e.T @ dqkv
    de = dqkv @ m["qkv"].T
    de += dh
    # Input vectors: the input after a target is that target, so the targets' order serves again; the rest are end marks.
    rest = flat == tree.size
    after = order[: np.searchsorted(goal, tree.size)] + 1
    inside = after < len(flat)
    after, ranks = after[inside], goal[: len(inside)][inside]
    counted = flat[after] == ranks
    after, ranks = after[counted], ranks[counted]
    seen = np.zeros(len(flat), bool)
    seen[after] = True
    more = np.flatnonzero(~seen & ~rest)  # context that goes before a part
    if len(more):
        at = np.argsort(np.concatenate([ranks, flat[more]]), kind="stable")
        after, ranks = np.concatenate([after, more])[at], np.concatenate([ranks, flat[more]])[at]
    firsts = np.flatnonzero(np.diff(ranks, prepend=-1))
    if len(firsts):
        sums, of = np.add.reduceat(de.take(after, 0), firsts), ranks[firsts]
        _add(out["high"], of // HASHED, sums)
        by = np.argsort(of % HASHED, kind="stable")
        _add(out["low"], (of % HASHED)[by], sums[by])
    ends = de[rest].sum(0)
    out["low"][tree.size % HASHED] += ends
    out["high"][tree.size // HASHED] += ends
    return loss


def _add(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds rows to the rows of out at sorted places, which may repeat."""
    firsts = np.flatnonzero(np.diff(at, prepend=-1))
    out[at[firsts]] += np.add.reduceat(rows, firsts)


def keep_memory() -> None:
    """An array that is given back at once: the C library then keeps freed arrays of up to this size for the next batch."""
    np.empty(31 << 20, np.uint8)


class Trainer:
    """Adam steps over batches of blocks; the weights are one array. Long gradients are cut to NORM, and the first WARM steps are shorter."""

    def __init__(self, flat: np.ndarray, tree: Tree, rate: float = 0.02):
        self.flat, self.tree, self.rate = flat.copy(), tree, rate
        self.model = views(self.flat, tree)
        self.first, self.second, self.grad = (np.zeros_like(flat) for _ in range(3))
        self.parts = views(self.grad, tree)
        self.steps = self.tokens = 0
        keep_memory()
        self.loss = 0.0

    def step(self, x: np.ndarray, y: np.ndarray, alone: np.ndarray) -> None:
        self.grad[:] = 0
        self.loss += gradient(self.model, x, y, alone, self.tree, self.parts)
        self.steps += 1
        tokens = int((y >= 0).sum())
        self.tokens += tokens
        g = self.grad
        g *= np.float32(1 / max(1, tokens))
        norm = math.sqrt(float(g @ g))
        if norm > NORM:
            g *= np.float32(NORM / norm)
        self.first += np.float32(0.1) * (g - self.first)
        g *= g
        self.second += np.float32(0.02) * (g - self.second)
        np.sqrt(self.second, out=g)
        g *= np.float32((1 - 0.98**self.steps) ** -0.5)
        g += np.float32(1e-8)
        np.divide(self.first, g, out=g)
        g *= np.float32(self.rate * min(1.0, self.steps / WARM) / (1 - 0.9**self.steps))
        self.flat -= g

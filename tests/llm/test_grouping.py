"""Spelling variants, centroid clusters and suffix-array dedup against brute force, with nulls, empties, repeats and ties."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pixelweave.llm import centroids, spelling, suffix_dedup
from pixelweave.llm.suffix_array import suffix_array, suffix_arrays

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# 11 ----------------------------------------------------------------------------------------------------------------


def spelled(docs, ratio=10):
    counts = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    v = {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out, form = [], {}
    found = {w: [(-v[x], x) for x in v if near(w, x)] for w in v}
    for w, some in found.items():
        form[w] = min(some)[1] if some and -min(some)[0] >= ratio * v[w] else None
    for w in v:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, v[w], len(found[w]), v[form[w]] if form[w] else None))
    return sorted(out, key=str)


def test_spelling_variants(spark, documents):
    rng = random.Random(3)
    stems = ["international", "Äquivalenz", "straßenbahn", "aaaaaaaa", "bookkeeper", "équipage"]
    docs = [(1, None), (2, ""), (None, "International! " * 45), (4, "aaaaaaaa aaaaaaa aaaaaaaaa aaaaaaab " * 4), (4, "aaaaaaaa aaaaaaa aaaaaaaaa aaaaaaab " * 4)]
    docs += [(5, "internationalx " * 3 + "internationalxy " * 2 + "internationa1"), (6, "stillsmall " * 2000 + "stillsmalls " * 150 + "stillsmallsx " * 12 + "stillsmallsxy")]
    for i in range(60):
        text = []
        for _ in range(rng.randrange(40)):
            w = rng.choice(stems)
            if rng.random() < 0.4:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "x", "é", w[k] * 2]) + w[k + 1 :]
            text.append(w)
        docs.append((100 + i, rng.choice([" ", "\n", "-", "1", "中"]).join(text)))
    want = spelled(docs)
    assert rows_of(spelling.variants(documents(*docs))) == want
    assert any(r[1] and r[1] != r[2] for r in want) and any(r[1] is None for r in want)
    assert rows_of(spelling.variants(documents(*docs), filter_bits=64)) == want  # a filter that lets all pass


def test_spelling_variants_of_nothing(spark, documents):
    for docs in ([], [(1, None), (2, "")], [(1, "lonelyword")]):
        df = documents(*docs) if docs else documents((1, "x")).limit(0)
        out = spelling.variants(df)
        assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() == 0


def test_neighbours_are_all_and_distinct():
    alphabet = np.frombuffer(b"abc", np.uint8)
    for word in (b"aab", b"abcab", b"cccc"):
        want = {word[:k] + word[k + 1 :] for k in range(len(word))}
        want |= {word[:k] + bytes([x]) + word[k + 1 :] for k in range(len(word)) for x in alphabet}
        want |= {word[:k] + bytes([x]) + word[k:] for k in range(len(word) + 1) for x in alphabet}
        got = [h[wanted] for _, h, wanted in spelling.neighbours(np.frombuffer(word, np.uint8)[None], alphabet)]
        got = np.concatenate(got)
        assert len(set(got.tolist())) == len(got)
        assert set(got.tolist()) == set(spelling.word_hashes(sorted(want - {word})).tolist())


# 12 ----------------------------------------------------------------------------------------------------------------


def clustered(rows, k=8):
    q = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and not any(x is None or not np.isfinite(x) for x in v)]
    q = [(i, [max(-(1 << 26), min(1 << 26, x)) for x in v]) for i, v in q]
    c = [v for _, v in sorted(q, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in enumerate(c)) for _, v in q]

    for _ in range(10):
        near = assigned()
        for j in range(len(c)):
            mine = [v for (_, m), (_, v) in zip(near, q, strict=True) if m == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    near, inertia = assigned(), collections.Counter()
    for d, j in near:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    return sorted([(i, j, d, inertia[j], sum(inertia.values()), digest[j]) for (d, j), (i, _) in zip(near, q, strict=True)], key=str)


def test_centroid_clusters(spark):
    rng = np.random.default_rng(1)
    base = [[float(x) for x in rng.normal(0, 0.3, 64)] for _ in range(90)]
    rows = [(i, base[i % 90] if i % 3 else base[0]) for i in range(200)]
    rows += [(1000, None), (1001, [1.0] * 63), (1002, [float("nan")] + [0.0] * 63), (1003, [None] + [0.0] * 63), (1004, [float("inf")] * 64)]
    rows += [(None, [30.0] * 64), (5, [-0.0001] * 64), (5, [-0.0001] * 64)]
    make = lambda r: spark.createDataFrame([(*x, 1, b"p") for x in r], "vec_id long, embedding array<float>, n int, packed binary")
    assert rows_of(centroids.clusters(make(rows))) == clustered(rows)
    large = [(i, [float(x) for x in rng.normal(0, 30000, 64)]) for i in range(30)] + [(99, [3e38] * 64)]
    assert rows_of(centroids.clusters(make(large))) == clustered(large)
    assert rows_of(centroids.clusters(make(rows[:3]))) == clustered(rows[:3])
    assert centroids.clusters(make([(1, None)])).count() == 0


def test_weighted_sums_stay_exact(spark):
    """Multiplicities beyond 32 bits: sums in whole numbers beyond 64 bits."""
    packed = np.full(64, 1 << 26, "<i4").tobytes()
    distinct = spark.createDataFrame([(packed, 1 << 45), (np.full(64, -3, "<i2").tobytes(), 5)], "packed binary, n long")
    totals = centroids._totals(distinct, np.zeros((1, 64), np.int64), 64)
    assert totals == [[(1 << 71) - 15] * 64 + [(1 << 45) + 5, (1 << 45) * 64 * (1 << 52) + 5 * 64 * 9]]


# 13 ----------------------------------------------------------------------------------------------------------------


def removed(docs, width=100):
    seen, out = set(), []
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        b = (text or "").encode()
        marked = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if b[s : s + width] in seen:
                marked[s : s + width] = b"\1" * width
            seen.add(b[s : s + width])
        spans = sum(1 for k in range(len(b)) if marked[k] and not (k and marked[k - 1]))
        out.append((i, len(b), sum(marked), spans, hashlib.sha256(bytes(x for x, y in zip(b, marked, strict=True) if not y)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("many", [1, 2, 5, 48])
def test_suffix_array(many, monkeypatch):
    """With groups of every size through numpy, and through views."""
    monkeypatch.setattr("pixelweave.llm.suffix_array.MANY", many)
    rng = random.Random(1)
    for t in range(400):
        x = bytes(rng.randrange(rng.choice([1, 2, 3, 200])) for _ in range(rng.randrange(60))) * (t % 3 + 1)
        assert suffix_array(x).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


@pytest.mark.parametrize("together", [1, 5, 24])
def test_suffix_arrays(together, monkeypatch):
    """Texts of all lengths, with runs and repeats, sorted side by side and one by one."""
    monkeypatch.setattr("pixelweave.llm.suffix_array.TOGETHER", together)
    rng = random.Random(together)
    for _ in range(40):
        texts = []
        for _ in range(rng.randrange(60)):
            x = bytes(rng.randrange(rng.choice([1, 2, 4, 256])) for _ in range(rng.randrange(40)))
            texts.append(x * rng.randint(1, 3) + b"\xff" * rng.randrange(2))
        want, begin = [], 0
        for x in texts:
            want += [begin + i for i in sorted(range(len(x)), key=lambda i, x=x: x[i:])]
            begin += len(x)
        assert suffix_arrays(texts).tolist() == want


def test_pieces_of_many_keys_are_sorted_side_by_side(monkeypatch):
    """Of a block of many short pieces, only the few longer than the rest go through the sorting of a single text."""
    alone = []
    monkeypatch.setattr("pixelweave.llm.suffix_array.suffix_array", lambda t: alone.append(len(t)) or suffix_array(t))
    rng = random.Random(7)
    words = [bytes(rng.choice(b"abcdefgh ") for _ in range(100 + k % 60)) for k in range(400)]
    names = ["key", "piece", "pid", "id", "row", "pos", "n"]
    rows = [(k, w, b"%d" % (2 * k + j), k, k, 7 * j, 1) for k, w in enumerate(words) for j in range(2)]  # each piece twice in its document
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])
    got = pa.Table.from_batches(suffix_dedup._sorted_blocks(100, 1 << 20)(iter([batch]))).to_pylist()
    assert [(r["pid"], r["runs"]) for r in got] == [(b"%d" % (2 * k + 1), [0, k % 60]) for k in range(400)]
    assert len(alone) < 24


def repeating(seed):
    rng = random.Random(seed)
    words = ["alpha", "be", "gam", "été", "d", "epsilon", "\0"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [make(60) for _ in range(6)]
    docs = [(70, "a" * 300), (71, "a" * 150), (72, "ab" * 120), (73, None), (74, ""), (75, "x" * 99), (76, "x" * 100), (77, "x" * 101), (-5, base[0]), (78, "中" * 70), (79, "b" + "中" * 70)]
    for i in range(50):
        text = make(rng.randrange(80))
        if rng.random() < 0.6:
            b, a = rng.choice(base), rng.randrange(100)
            text = text[:50] + b[a : a + rng.randint(50, 250)] + text[50:]
        docs.append((i, text))
    return docs


@pytest.mark.parametrize(
    "settings",
    [{}, {"large": 0}, {"window": 20, "anchor": 5, "block": 500, "large": 200}, {"window": 30, "anchor": 4, "filter_bits": 0, "large": 3000}, {"window": 7, "anchor": 7}],
    ids=["as in production", "all keys divided", "short windows", "without a filter", "the window is the anchor"],
)
def test_suffix_dedup(spark, documents, settings):
    docs = repeating(5)
    assert rows_of(suffix_dedup.without_repeats(documents(*docs), **settings)) == removed(docs, settings.get("window", 100))


def test_suffix_dedup_of_repeated_and_null_ids(spark, documents):
    text = "It is the same long sentence in all of these, and it goes on for well over a hundred bytes, so that it is removed. "
    got = rows_of(suffix_dedup.without_repeats(documents((3, text), (3, text), (None, text), (4, None), (4, "")), with_text=True).select("doc_id", "n_bytes", "n_removed", "kept"))
    n = len(text)
    assert sorted((r[0] is None, r[0], r[1], r[2], len(r[3])) for r in got) == [(False, 3, n, n, 0), (False, 3, n, n, 0), (False, 4, 0, 0, 0), (False, 4, 0, 0, 0), (True, None, n, 0, n)]
    assert suffix_dedup.without_repeats(documents((1, "x")).limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.without_repeats(documents((1, "x")), window=10, anchor=20)


def test_suffix_dedup_across_spans(spark, documents):
    """Texts longer than what is hashed at once."""
    rng = random.Random(2)
    body = "".join(rng.choice("abcdefghij ") for _ in range(1000))
    filler = lambda n: "".join(rng.choice("klmnopqrst ") for _ in range(n))
    docs = [(1, filler(130_600) + body + filler(5000)), (2, filler(300) + body + filler(140_000)), (3, body[100:900])]
    assert rows_of(suffix_dedup.without_repeats(documents(*docs))) == removed(docs)

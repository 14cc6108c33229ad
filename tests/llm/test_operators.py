"""Each operator against a brute-force version, on small tables with nulls, empty and long texts, ties and repeats."""

import base64
import collections
import hashlib
import json
import math
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from pixelweave.llm import byte_bpe, chat_format, components, exact_dedup, jaccard_join, license_scan, mixing, quality, queries, token_counts, url_filter  # noqa: E402
from pixelweave.llm.common import n_words  # noqa: E402

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
WORDS = ["alpha", "beta", "Gamma", "delta", "the", "of", "Ünï", "x1", "#", "don't", "  ", "\n", "\t"]


def texts(n, seed, most=40):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(most))) for _ in range(n)]


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()), key=str)


# 1 -----------------------------------------------------------------------------------------------------------------


def test_mixing(spark, documents):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice(["hot"] * 5 + ["b", "c", None])) for i in range(600)] + [(700, None, "b"), (None, "a b", "c"), (1, "w " * 3, "b"), (1, "w " * 3, "b")]
    weight = F.element_at(F.array(F.lit(3), F.lit(1), F.lit(2)), (F.col("rank") % 3 + 1).cast("int"))
    out = mixing.mix(documents(*rows), weight)
    got = out.collect()
    assert len(got) == len(rows) and sorted(map(str, ((r.doc_id, r["taken"]) for r in got))) == sorted(map(str, ((r.doc_id, r["taken"]) for r in mixing.mix(documents(*rows), weight).collect())))
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert r["size"] == len((r.text or "").split()) and r["taken"] in (0, r["size"], 2 * r["size"])
        size[r.source] += r["size"]
        taken[r.source] += r["taken"]
        target[r.source] = r["target"]
    names = sorted((s for s in size if s is not None)) + [None]
    weights, free, left, want = dict(zip(names, (3, 1, 2, 3), strict=False)), set(names), 1.5 * sum(size.values()), {}
    while True:
        level = left / sum(weights[s] for s in free)
        over = [s for s in free if level * weights[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            want[s], left = 2.0 * size[s], left - 2 * size[s]
            free.remove(s)
    want |= {s: level * weights[s] for s in free}
    for s in names:
        assert math.isclose(target[s], want[s]) and abs(taken[s] - want[s]) <= 60, s
    assert mixing.mix(documents(*rows).limit(0), weight).count() == 0
    assert mixing.repeated(out, ["doc_id", "text"]).count() == sum(r["copies"] for r in got)


def test_mixing_of_repeated_ids(spark):
    """Null and repeated ids, thousands of one id, and one row many times: each source within one document of its target."""
    rows = [(None, "a", 3 + i % 9) for i in range(5000)] + [(i % 3, "b", 20) for i in range(3000)] + [(7, "c", 11)] * 2500 + [(None, "d", 90_000)] + [(None, None, 0)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    weight = F.element_at(F.array(*map(F.lit, (3, 1, 2))), (F.col("rank") % 3 + 1).cast("int"))
    for share in (1.5, 0.77):
        got = mixing.mix(docs, weight, share=share).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most"), F.count("*").alias("n")).collect()
        assert sum(r.n for r in got) == len(rows)
        for r in got:
            assert abs(r.taken - r.target) <= r.most / 2 + 1e-6, r


def test_word_count(spark):
    cases = [None, "", " \n\t", "a", " a b ", "a\x0bb\x0cc\rd", "a b", "é ü\n\nß"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r.n or 0 for r in df.select(n_words(F.col("t")).alias("n")).collect()] == [len((c or "").encode().split()) for c in cases]


# 2 -----------------------------------------------------------------------------------------------------------------


def test_chat_layouts(spark):
    nasty = "a<|user|>b</s>\\0\\1[INST]|\\"
    records = [
        {"messages": [{"role": "user", "content": nasty}, {"role": "assistant", "content": "y"}]},
        {"prompt": nasty, "completion": "y"},
        {"instruction": nasty, "input": "", "output": "y"},
        {"conversations": [{"from": "human", "value": nasty}, {"from": "gpt", "value": "y"}]},
        {"messages": [{"role": "user", "content": None}, {"role": None, "content": "z"}]},
        {"messages": []},
        {"other": 1},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(7, "not json"), (8, None)]
    df = chat_format.canonical_turns(spark.createDataFrame(rows, "id int, record string"))
    df = df.withColumn("f", chat_format.formatted(F.col("turns"))).withColumn("back", chat_format.read_back(F.col("f"))).withColumn("spans", chat_format.spans(F.col("f")))
    got = {r.id: r for r in df.collect()}
    pair = [("user", nasty), ("assistant", "y")]
    for i, want in enumerate([pair, pair, [("user", nasty), ("user", ""), ("assistant", "y")], pair, [("user", ""), ("", "z")], []]):
        assert [tuple(t) for t in got[i].back] == want == [tuple(t) for t in got[i].turns], i
        assert [got[i].f[s.start : s.start + s.length] for s in got[i].spans] == [t for r, t in want if r == "assistant"]
    assert [got[i].layout for i in (6, 7, 8)] == [None] * 3 and [got[i].f for i in (6, 7, 8)] == [None] * 3
    for r in df.withColumn("loss", chat_format.masked(F.col("f"))).collect():
        assert r.loss == (None if r.turns is None else "".join(t for role, t in r.turns if role == "assistant"))
    assert got[0].f.count("</s>") == 2 and "[INST]" not in got[0].f
    assert df.select(F.count_distinct("fingerprint")).first()[0] >= 6


def test_chat_query_layouts_and_sizes(spark, tmp_path):
    """Conversations of all layouts, a very long one, empty and null turns, repeated rows: read back whole."""
    nasty = 'q"\\n\n</s><|x|>\u00e9'
    rows = [(i, 1, "assistant", f"a{i}{nasty}") for i in range(40)] + [(i, 0, "user", nasty) for i in range(40)]
    rows += [(50, 0, "human", "h"), (50, 1, "gpt", "g"), (51, 0, None, None), (52, 0, "assistant", None), (53, 0, "user", "x"), (53, 0, "user", "x"), (60, 0, "user", "u"), (60, 1, "assistant", "long <| " * 500_000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op2_chat_format(spark, str(tmp_path)).collect()}
    by = collections.defaultdict(list)
    for i, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1], str(r[2]))):
        by[i].append((role or "", text or ""))
    assert set(got) == {*by, -1}
    for i, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[i].n_turns, got[i].turns_sha256, got[i].loss_chars, got[i].loss_sha256) == want, i
    layouts = chat_format.canonical_turns(queries.chat_records(queries.conversations(spark.read.parquet(f"{tmp_path}/conversations.parquet"))).where("conv_id < 50"))
    assert layouts.select(F.count_distinct("layout")).first()[0] >= 5
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert [r.conv_id for r in queries.op2_chat_format(spark, f"{tmp_path}/none").collect()] == [-1]


def test_chat_keeps_other_columns(spark):
    row = spark.createDataFrame([('{"prompt":"a","completion":"b"}', 1, "x", 2, 3)], "record string, _0 int, _v string, _paths int, layout int")
    got = chat_format.canonical_turns(row).first()
    assert (got._0, got._v, got._paths, got.layout) == (1, "x", 2, "prompt and completion")


# 3 -----------------------------------------------------------------------------------------------------------------


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randrange(3, 60))] for _ in range(12)]
    passage = [rng.choice(vocabulary) for _ in range(50)]
    out = []
    for i in range(260):
        w = list(bases[0] if i % 3 == 0 else rng.choice(bases))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(" ".join(w + passage if i % 5 == 0 else w))
    return out


def linked(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    name = collections.defaultdict(lambda: math.inf)
    for i, r in enumerate(rows):
        name[find(i)] = min(name[find(i)], math.inf if r[0] is None else r[0])
    return sorted(((r[0], len(sets[i]), None if name[find(i)] == math.inf else name[find(i)]) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize(("seed", "region"), [(1, jaccard_join.REGION), (2, 400), (3, 60)])
def test_jaccard_join(documents, seed, region):
    rows = list(enumerate(near_copies(seed))) + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One two"), (5, "one two"), (None, "lone text with no other like it")]
    rows += [(7, rows[7][1]), (905, " ".join(f"long{i}" for i in range(30000)))]
    random.Random(seed).shuffle(rows)
    got = jaccard_join.components(documents(*rows).repartition(3), region=region)
    assert by_id(got, "n_shingles", "component_id") == linked(rows)


def test_jaccard_join_with_a_hot_shingle(documents):
    """A passage that all documents hold, so its shingles are hot in every flush, and near copies among them."""
    rng = random.Random(8)
    passage = "one passage of seven words in all"
    rows = [(i, f"{passage} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(12))) for i in range(150)]
    rows += [(1000 + i, rows[i % 7][1] + f" tail{i % 5}") for i in range(60)]
    got = jaccard_join.components(documents(*rows).repartition(3))
    assert by_id(got, "n_shingles", "component_id") == linked(rows)


def test_region_forest_divides_and_joins():
    """Region.forest alone, on sets of many sizes: the same components as all pairs, by pivots, windows and parts."""
    for seed in range(4):
        rng = np.random.default_rng(seed)
        families = [rng.integers(0, 1 << 40, 120).astype(np.uint64) for _ in range(6)]
        sets = [np.unique(np.concatenate([rng.choice(families[i % 6], 100 - i % 31, replace=False), rng.integers(0, 1 << 40, i % 25).astype(np.uint64)])) for i in range(160)]
        region = jaccard_join.Region([len(x) for x in sets], sets)
        root = list(range(len(sets)))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for i, a in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(a, sets[j]))
                if 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                    root[find(i)] = find(j)
        want = {frozenset(j for j in range(len(sets)) if find(j) == r) for r in map(find, range(len(sets)))}
        groups = {i: {i} for i in range(len(sets))}
        for a, b in region.forest(75):
            both = groups[a] | groups[b]
            for x in both:
                groups[x] = both
        assert {frozenset(g) for g in groups.values()} == want


def test_jaccard_join_empty(documents):
    docs = documents((1, None), (2, ""))
    assert by_id(jaccard_join.components(docs), "n_shingles", "component_id") == [(1, 0, 1), (2, 0, 2)]
    assert jaccard_join.components(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (4, 1), (None, 3)] + [(100, 100 + i) for i in range(50)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, 5: 5} | {100 + i: 100 for i in range(50)}


# 4 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("sizes", [(byte_bpe.CHUNK, byte_bpe.OVERLAP), (64, 16), (64, 16, 500, 256, 32)])
def test_byte_bpe(documents, sizes):
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("lib", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    cases = [None, "", "a", "x" * 700, " " * 300 + "a", "it's we'll " * 40, "<|endoftext|>" * 20, "日本語😀é" * 50, "\n \n\t " * 90, "ab " * 9000, *texts(30, 4, 200)]
    rows = [*enumerate(cases), (3, "x" * 700), (None, "null id " * 30)]
    coded = byte_bpe.encode(documents(*rows), RANKS, P.PATTERN, *sizes)
    got = by_id(coded.withColumn("ids", F.hex("ids")), "ids")
    assert got == sorted(((i, np.array(lib.encode_ordinary(t or ""), "<u4").tobytes().hex().upper()) for i, t in rows), key=str)
    assert by_id(byte_bpe.decode(coded, RANKS, P.PATTERN), "bytes") == sorted(((i, bytearray((t or "").encode())) for i, t in rows), key=str)
    assert byte_bpe.encode(documents(*rows).limit(0), RANKS, P.PATTERN).count() == 0


def test_byte_bpe_stitches_within_a_task():
    """The texts of the smallest table are cut, at several widths, and give the pre-tokens of the whole."""
    texts = [x or "" for x in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()]
    assert sum(len(x) > byte_bpe.CHUNK for x in texts) > 20
    for chunk, overlap in ((byte_bpe.CHUNK, byte_bpe.OVERLAP), (200, 20), (50, 8)):
        for x in texts[:300]:
            parts = list(byte_bpe.stitched(P.PATTERN, x, chunk, overlap))
            assert [p for part in parts for p in part] == byte_bpe.findall(P.PATTERN, x)
            assert len(parts) > 1 or len(x) <= 4 * chunk


# 5 -----------------------------------------------------------------------------------------------------------------


def test_quality_measures(documents):
    cases = [None, "", "a a a a", "x y z x y z\nx y z\n\nx y z", "# $% & |<> *", "Ünï CAPS\n \nÜnï CAPS", *texts(60, 5)]
    got = {r.doc_id: r for r in quality.measured(documents(*enumerate(cases))).collect()}
    for i, t in enumerate(cases):
        t = t or ""
        w = t.encode().split()
        windows = list(zip(w, w[1:], w[2:], strict=False))
        many = collections.Counter(windows)
        again = {k + d for k, x in enumerate(windows) if many[x] > 1 for d in range(3)}
        lines = [x for x in t.encode().split(b"\n") if x.split()]
        want = (len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), sum(x in lines[:k] for k, x in enumerate(lines)), len(again))
        assert tuple(got[i][c] for c in quality.COUNTS[:5]) == want, t


def test_quality_risk(spark, documents):
    assert math.isclose(quality.binomial_cdf(2, 10, 0.3), sum(math.comb(10, k) * 0.3**k * 0.7 ** (10 - k) for k in range(3)))
    rng = random.Random(6)
    good = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(1500)]
    bad = [" ".join(f"w{rng.randrange(10**6)}#" for _ in range(60)) for _ in range(300)]
    rows = list(enumerate(good + bad))
    labels = spark.createDataFrame([(i, int(i < 1500)) for i, _ in rows] + [(0, 1), (5000, 0), (3, None)], "doc_id long, quality int")
    docs = documents(*rows).repartition(4)
    kept = {r.doc_id for r in quality.accepted(docs, labels).collect()}
    assert kept == set(range(1500))
    few = labels.where("doc_id % 20 = 0")  # too few to certify anything
    assert quality.accepted(docs, few).count() == 1800
    assert quality.accepted(docs, labels.limit(0)).count() == 1800
    assert quality.accepted(docs.limit(0), labels).count() == 0


def test_quality_equals_brute_force(spark, documents):
    """Cutoffs and verdicts against counts in Python: strata null, empty and by language, a very long text, repeated rows."""
    rng = random.Random(16)
    rows, marks = [], {}
    for i in range(5200):
        bad = i % 5 == 0
        words = [f"w{rng.randrange(10**6)}" + ("#" if rng.random() < (0.5 if bad else 0.004) else "") for _ in range(rng.choice([40, 60, 60, 60]))]
        rows.append((i, " ".join(words), ("en", None, "")[i % 7 % 3], "s", 0, "h", 7, 9))
        if i % 9:
            marks[i] = int(not bad)
    rows += [(9000, "long w1# " * 200_000, "en", "s", 0, "h", 7, 9), (9001, None, "zz", "s", 0, "h", 7, 9), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, documents((1, "x")).schema).repartition(4)
    labels = spark.createDataFrame(sorted(marks.items()), "doc_id long, quality int")
    ratio = lambda a, b: a / b if b else 0.0

    def shares(t):
        n, chars, symbols, dup, again, lines, capitals = quality.measure(t or "")
        return {"symbol_share": ratio(symbols, n), "dup_line_share": ratio(dup, lines), "repeat_share": ratio(again, n), "chars_per_word": ratio(chars, n), "capital_share": ratio(capitals, chars)}

    of = [(r[2], shares(r[1]), marks.get(r[0])) for r in rows]
    strata = {lang for lang, _, mark in of if mark is not None}
    level = quality.DELTA / (len(strata) * sum(map(len, quality.GRID.values())))
    cut = {}
    for lang in strata:
        for m, grid in quality.GRID.items():
            values = {q: [s[m] for x, s, mark in of if x == lang and mark == q] for q in (0, 1)}
            best = 0.0
            for g in reversed(grid):
                lost, caught = (sum(v > g for v in values[q]) for q in (1, 0))
                n = len(values[1])
                if n and lost <= quality.ALPHA / 5 * n and quality.binomial_cdf(lost, n, quality.ALPHA / 5) <= level and caught - quality.COST * lost > best:
                    best, cut[lang, m] = caught - quality.COST * lost, g
    assert cut and (None, "symbol_share") in cut and ("", "symbol_share") in cut
    want = []
    for r, (lang, s, _) in zip(rows, of, strict=True):
        n, _, _, _, again, *_ = quality.measure(r[1] or "")
        failed = n < 50 or 100 * again > 50 * n
        want.append((r[0], failed, not failed and not any(v > cut.get((lang, m), math.inf) for m, v in s.items())))
    measures = quality.measured(docs, keep=["doc_id", "lang"])
    got = quality.judged(measures, quality.calibrate(measures, labels)).collect()
    assert sorted((r.doc_id, r.base_failed, r.kept) for r in got) == sorted(want)
    left = quality.accepted(docs, labels)
    assert left.columns == docs.columns and sorted(map(str, left.collect())) == sorted(str(r) for r, w in zip(docs.orderBy("doc_id").collect(), sorted(want), strict=True) if w[2])


def test_quality_bound_holds():
    """Where the true rate of a cutoff is above alpha, it is certified no more often than delta."""
    rng = np.random.default_rng(7)
    grid = quality.GRID["symbol_share"]
    wrong = 0
    for _ in range(200):
        lost = rng.binomial(1000, 0.03)
        good = [1000 - lost, *[0] * (len(grid) - 1), lost]
        wrong += quality.choose(good, [0] * len(grid) + [900], grid, 0.02, 0.05, 0) is not None
    assert wrong <= 20


# 6 -----------------------------------------------------------------------------------------------------------------


def test_license_scan(documents):
    cases = {
        0: None, 1: "", 2: "under CC-BY 4.0, or cc by", 3: "the GNU General Public License. All rights reserved", 4: "Licensed under the Apache Licence, Version 2.0!",
        5: "xcc by generalpublic license allé rights reserved", 6: "Permission is herby granted, free of charge, to any persn obtaining a copy", 7: "cc cc by by", 8: "clean text about apples",
    }
    got = {r.doc_id: r for r in license_scan.scan(documents(*cases.items(), (2, cases[2]))).collect()}
    for i, t in cases.items():
        words = bytes((t or "").encode()).translate(license_scan.LETTERS).split()
        places = [(k, label) for phrase, label in license_scan.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.encode().split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert got[4].labels == "apache-2.0" and got[4].spans[0].first_word == 0 and got[4].spans[0].last_word == 7 and got[4].spans[0].errors == 1
    assert got[6].labels == "mit" and got[8].labels == "" and got[8].score == 0


def nearest(notice, body):
    """The least edits between the notice and any stretch of the body, by dynamic programming."""
    row = [0] * (len(body) + 1)
    for i, x in enumerate(notice, 1):
        left, row = row, [i]
        for j, y in enumerate(body, 1):
            row.append(min(left[j - 1] + (x != y), left[j] + 1, row[j - 1] + 1))
    return min(row)


def test_license_labels_and_score_equal_all_alignments(documents):
    rng, cases = random.Random(5), []
    for notice in license_scan.NOTICES:
        for edits in (0, 1, 3, 9):
            t = list(notice)
            for _ in range(edits):
                k = rng.randrange(len(t))
                t[k : k + 1] = rng.choice([["q"], [], [t[k], "z"]])
            cases.append(" ".join(rng.choice(["apple", "pear", "cc"]) for _ in range(6)) + " " + "".join(t) + " tail")
    for r in license_scan.scan(documents(*enumerate(cases))).collect():
        body = b" " + b" ".join(cases[r.doc_id].encode().translate(license_scan.LETTERS).split()) + b" "
        near = {n: nearest(n, body.decode()) for n in license_scan.NOTICES}
        bound = {n: max(1, len(n) // license_scan.CHARS_PER_ERROR) for n in near}
        found = {license_scan.NOTICES[n] for n in near if near[n] <= bound[n]} | set(filter(None, r.base_labels.split(",")))
        assert set(filter(None, r.labels.split(","))) == found, cases[r.doc_id]
        best = 1.0 if r.n_base else max((1 - near[n] / len(n) for n in near if near[n] <= bound[n]), default=0.0)
        assert r.score <= best + 1e-9 and r.score >= (best > 0) * (1 - 1 / license_scan.CHARS_PER_ERROR - 1e-9), (r.score, best)


def test_license_long_text_and_empty_table(documents):
    import time

    took = []
    for n in (20_000, 80_000):  # four times the places: about four times as long
        text, began = "all rights reserved under cc by ok " * n, time.time()
        places = license_scan.Scanner(license_scan.PHRASES, license_scan.NOTICES).scan(text)[1]
        took.append(time.time() - began)
        assert len(places) == 2 * n and places[-1][:2] == (7 * n - 3, 7 * n - 2)
    assert took[1] < 9 * took[0]
    notice = "licensed under the mit license "
    assert len(license_scan.Scanner(license_scan.PHRASES, license_scan.NOTICES).fuzzy(f" {notice * 2000}")) >= 2000
    assert license_scan.scan(documents((1, "x")).limit(0)).count() == 0
    assert license_scan.merged([(5, 9), (0, 3), (9, 12), (2, 4)]) == [(0, 4), (5, 12)]


def test_license_pigeonhole():
    """Every notice is found with any edits within its bound."""
    scanner, rng = license_scan.Scanner(license_scan.PHRASES, license_scan.NOTICES), random.Random(8)
    for notice, label, errors, _ in scanner.notices:
        for _ in range(20):
            t = list(notice)
            for _ in range(rng.randrange(errors + 1)):
                k = rng.randrange(len(t))
                t[k : k + 1] = rng.choice([["q"], [], [t[k], "q"]])
            assert label in {x[2] for x in scanner.fuzzy(f" noise before {''.join(t)} and after ")}, "".join(t)


# 7 -----------------------------------------------------------------------------------------------------------------


def test_url_filter(spark):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/")]
    rows = [
        (1, "http://a.Example.com/en/7?x", None), (2, "https://b.com/en/1#f", ""), (3, "ftp://xcom/en/", "<p>"), (4, None, None), (5, "no scheme/en/", "x"), (6, "http://q.org", "<link rel=canonical href='//b.com/en/9'>"),
        (7, "http://r.org/a/b", '<LINK REL="canonical" HREF="../c">'), (8, "http://r.org/c", '<meta http-equiv="refresh" content="0; url=http://n.net/de/1">'), (9, "http://r.org/a/b", None),
        (10, "http://m.org/1", "<link rel=canonical href=http://b.com/en/1>"), (11, "http://m.org/2", "<link rel=canonical href=http://m.org/1><link rel='canonical' href='http://example.com/en/7'>"), (12, "http://solo.org/x?y#z", "<link rel=stylesheet href=//b.com/en/>"),
    ]
    out = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules, variants=False)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got == {
        1: ("a.example.com", "/en/7", "example.com/en/7", "allow"), 2: ("b.com", "/en/1", "com/en/", "block"), 3: ("xcom", "/en/", None, "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"),
        6: ("q.org", "", None, "block"), 7: ("r.org", "/a/b", None, "block"), 8: ("r.org", "/c", None, "block"), 9: ("r.org", "/a/b", None, "block"),
        10: ("m.org", "/1", None, "allow"), 11: ("m.org", "/2", None, "allow"), 12: ("solo.org", "/x", None, "allow"),
    }
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string"), rules).count() == 0


def test_url_variants():
    same = ["http://A.com/x/", "https://a.com/x?utm_source=f", "http://a.com:80/x.html#top", "https://a.com:443/x/index.html?fbclid=1&utm_medium=e", "https://a.com/x?ref=q"]
    assert {url_filter.usual(u) for u in same} == {"https://a.com/x"}
    assert url_filter.usual("http://a.com") == url_filter.usual("https://a.com/index.html") == "https://a.com/"
    assert url_filter.usual("https://a.com/x?page=2&utm_id=3") == "https://a.com/x?page=2" != url_filter.usual("https://a.com/x")
    assert url_filter.usual(None) is url_filter.usual("nothing") is None


def test_url_filter_equals_brute_force(spark):
    """Variants, links, chains, one hot component with a third of all pages, repeated urls, clashing columns: every verdict."""
    rng = random.Random(9)
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "org", "/es/")]
    rows = []
    for i in range(600):
        host = rng.choice(["a.com", "b.com", "x.example.com", "q.org", "r.net", "s.net"])
        url = f"{rng.choice(['http', 'https'])}://{host}/{rng.choice(['en', 'es', 'fr'])}/{rng.randrange(60)}{rng.choice(['', '/', '.html', '?utm_source=x', '?page=1', '#t'])}"
        html = rng.choice([None, "<p>", "<link " * 50, f"<link rel=canonical href='http://r.net/fr/{rng.randrange(60)}'>", f"<meta http-equiv=refresh content='0;url=http://q.org/fr/{rng.randrange(60)}'>"])
        if i % 3 == 0:
            url, html = f"http://hot.net/{i}", f"<link rel=canonical href='http://hot.net/{i // 2 * 3 // 3 if i % 2 else 0}'>"
        rows.append((i % 590, url, html, "h", 1))
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string, host string, component int"), rules, variants=True).collect()
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for _, url, html, *_ in rows:
        node = url_filter.parts(url)[2]
        for other in [*url_filter.targets(url, html), url_filter.usual(url)]:
            root[find(node)] = find(other)
    own = {x: url_filter.rule_of(*url_filter.parts(x)[:2], rules)[1] for x in list(root)}
    spread = collections.defaultdict(set)
    for x, verdict in own.items():
        spread[find(x)].add(verdict)
    want = []
    for i, url, *_ in rows:
        host, path, node = url_filter.parts(url)
        rule, verdict = url_filter.rule_of(host, path, rules)
        said = spread[find(node)]
        want.append((i, host, path, str(rule), verdict or ("allow" if "allow" in said else "block" if "block" in said else "allow")))
    assert sorted((r.page_id, r.host, r.path, str(r.rule), r.verdict) for r in got) == sorted(want)
    assert sum(rule == "None" and verdict == "block" for *_, rule, verdict in want) > 5


# 8 -----------------------------------------------------------------------------------------------------------------


def test_first_of_each_keeps_one_row_a_group(documents):
    rng = random.Random(15)
    prose = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(4)]
    near = prose[0] + " end"
    rows = [(None, near), (None, prose[0]), (None, prose[0]), (3, prose[1]), (2, prose[1]), (2, prose[1] + " end"), (3, prose[2]), (None, prose[2]), (None, prose[3]), (9, None), (9, "")]
    got = [(r.doc_id, r.text) for r in jaccard_join.first_of_each(documents(*rows)).collect()]
    for ids, group in (({None}, {prose[0], near}), ({2}, {prose[1], prose[1] + " end"}), ({3}, {prose[2]}), ({None}, {prose[3]})):
        kept = [i for i, t in got if t in group]
        assert len(kept) == 1 and set(kept) == ids
    assert len([t for _, t in got if not t]) == len(jaccard_join.components(documents((8, None), (9, ""))).select("component_id").distinct().collect())


# 9 -----------------------------------------------------------------------------------------------------------------


def test_exact_dedup(documents):
    long = "long " * 30000
    rows = [(1, "A b"), (2, "a B"), (9, "a b"), (9, "a b"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, long + "x"), (8, long + "y"), (10, long.upper() + "x"), (None, "n"), (None, "N"), (None, "m" * 50), (11, "a b ")]
    rows += [(100 + i, "hot") for i in range(200)]
    got = exact_dedup.exact_groups(documents(*rows)).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").encode().lower()].append(i)
    assert len(got) == len(rows)
    want = sorted((str(i), str(max((x for x in g if x is not None), default=None)), len(g), hashlib.sha256(t).hexdigest()) for t, g in groups.items() for i in g)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.drop_copies(documents(*rows))
    assert kept.columns == documents(*rows).columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(documents(*rows).limit(0)).count() == 0


def test_exact_dedup_of_repeated_ids(documents):
    """One id on unequal texts, whole rows twice, and texts that part late: groups by text alone, one kept in each."""
    late = "x" * 70000
    rows = [(5, "abc"), (5, "abc"), (5, "abd"), (5, "abd"), (None, late + "1"), (None, late + "1"), (None, late + "2"), (None, late + "2"), (5, late + "1")]
    size = collections.Counter(t for _, t in rows)
    got = exact_dedup.exact_groups(documents(*rows)).collect()
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for _, t in rows}
    assert all(r.group_size == size[sha[r.text_sha256]] for r in got) and len(got) == len(rows)
    assert {r.keep_id for r in got if sha[r.text_sha256] == late + "1"} == {5}
    assert collections.Counter(sha[r.text_sha256] for r in got if r.kept) == dict.fromkeys(size, 1)
    assert sorted((r.doc_id or 0, r.text) for r in exact_dedup.drop_copies(documents(*rows)).collect()) == sorted([(5, "abc"), (5, "abd"), (5, late + "1"), (0, late + "2")])


def test_shared_folder(spark):
    from types import SimpleNamespace

    from pixelweave.llm.common import shared_folder

    conf = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(cluster)
    assert shared_folder(spark)


# 10 ----------------------------------------------------------------------------------------------------------------


def test_token_counts_of_every_prefix(documents):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(JSON)
    n = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    cases = [None, "", "it's  we'll\n\n x", "<|endoftext|>a <|endoftext|", "!!<|endoftext|>", "日本語😀é", "x" * 300, *texts(15, 11, 12)]
    rows = [*enumerate(cases), (2, cases[2]), (None, "null")]
    got = token_counts.token_counts(documents(*rows), JSON, 5, prefixes=True).collect()
    for r, (i, t) in zip(sorted(got, key=lambda r: (str(r.doc_id), r.n_bytes)), sorted(rows, key=lambda r: (str(r[0]), len((r[1] or "").encode()))), strict=True):
        t = t or ""
        counts = [n(t[:k]) for k in range(len(t) + 1)]
        assert (r.doc_id, r.n_bytes, r.n_tokens, r.over_limit, r.prefix_counts) == (i, len(t.encode()), counts[-1], counts[-1] > 5, counts)
        assert r.fit_chars == max(k for k, c in enumerate(counts) if c <= 5)
    assert token_counts.token_counts(documents(*rows).limit(0), JSON, 5).count() == 0


def test_token_counts_of_long_pieces():
    """Long words, long white space and long words of other scripts: totals and fits as the library has them, whatever the length."""
    from tokenizers import Tokenizer

    lib, c = Tokenizer.from_file(JSON), token_counts.counter(JSON)
    n = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    rng = random.Random(3)
    for t in ("a b  " + "x" * 900 + " end", "z " + " " * 700 + "\n" * 300 + "z", "".join(rng.choice("abcdefgh") for _ in range(1500)), "\u6f22\u5b57" * 400, "!" * 800 + "'s", "'" * 700 + "a"):
        table, counts = c.prefix_table(t), [n(t[:i]) for i in range(len(t) + 1)]
        assert table.total == counts[-1]
        for budget in (0, 1, 3, 20, 50, 90):
            assert table.fit(budget) == max(i for i, x in enumerate(counts) if x <= budget), (t[:9], budget)
    import tracemalloc

    tracemalloc.start()
    table = c.prefix_table("x" * 1_000_000)
    assert table.total == n("x" * 1_000_000) and table.fit(1024) > 1024
    assert tracemalloc.get_traced_memory()[1] < 30 << 20  # not an object for each byte
    tracemalloc.stop()

"""LM scoring: the base against counts, the model against a direct forward pass, its gradient against differences."""

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from pixelweave.llm import attention_lm as lm
from pixelweave.llm import byte_bpe, lm_scoring

RANKS = P.path("byte_bpe_50k.tiktoken")


def texts(n, seed, most=40):
    r = random.Random(seed)
    words = ["Alpha", "beta,", "gamma.", "delta", "the", "of", "x1y2", "\u00e9t\u00e9", "omega" * 4]
    return [" ".join(r.choice(words) for _ in range(r.randint(1, most))) for _ in range(n)]


@pytest.mark.parametrize("hot", [0, lm_scoring.HOT_WORDS])
def test_lm_base(documents, hot, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HOT_WORDS", hot)
    rows = [*enumerate(texts(60, 9)), (100, None), (101, ""), (5, "Alpha unseen"), (None, "the of")]
    got = lm_scoring.score(documents(*rows), RANKS, P.PATTERN).collect()
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    c = collections.Counter()
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    for i, t in rows:
        if not out(i):
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), out(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm_scoring.score(documents(*rows).limit(0), RANKS, P.PATTERN).count() == 0


def direct(m, tree, ranks):
    """The log-probability of a text, one token after the other, with sums over all ids written out."""
    vec = lambda low, high, r: m[low][r % lm.HASHED].astype(float) + m[high][r // lm.HASHED]
    x = [tree.size, *ranks]
    e = [vec("low", "high", r) for r in x]
    q, k, v = (np.array(e) @ m["qkv"][:, a : a + lm.WIDTH].astype(float) for a in (0, lm.WIDTH, 2 * lm.WIDTH))
    leaf = tree.leaf_of.astype(int)
    total = 0.0
    for i, goal in enumerate([*ranks, tree.size]):
        first = max(0, (i // lm.STRIDE) * lm.STRIDE - (lm.LENGTH - lm.STRIDE))
        w = np.array([math.exp(q[i] @ k[j] + m["near"][i - j]) for j in range(first, i + 1)])
        h = e[i] + (w / w.sum()) @ v[first : i + 1]
        logit = lambda z, at: z[at] - math.log(np.exp(z).sum())
        cls = tree.class_of_leaf[leaf[goal]]
        total += logit(m["classes"].astype(float) @ h + m["bias"], cls)
        of_class = np.flatnonzero(tree.class_of_leaf == cls)
        if len(of_class) > 1:
            total += logit(m["leaves"][of_class].astype(float) @ h + tree.leaf_share[of_class], leaf[goal] - of_class[0])
        ids = np.flatnonzero(leaf == leaf[goal])
        if len(ids) > 1:
            total += logit(np.array([vec("low_out", "high_out", r) for r in ids]) @ h + tree.id_share[ids], goal - ids[0])
    return total


def some_tree(seed=13, n=1500):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 40, n) * (rng.random(n) < 0.6)
    counts[:3] = 9000
    return rng, lm.Tree(counts)


def some_model(tree, seed=3):
    flat = (0.3 * np.random.default_rng(seed).standard_normal(lm.count(tree))).astype(np.float32)
    return flat, lm.views(flat, tree)


def test_tree_covers_every_id():
    _, tree = some_tree()
    assert tree.split and max(b - a for a, b in tree.ends) <= lm.HASHED
    assert tree.leaf_of[tree.size] == tree.leaves and tree.class_of_leaf[-1] == tree.classes
    spread = [math.fsum(np.exp(tree.id_share[a:b].astype(float))) for a, b in tree.ends[:-1]]
    assert np.allclose(spread, 1, atol=1e-4)
    assert np.allclose([math.fsum(np.exp(tree.leaf_share[a:b].astype(float))) for a, b in tree.split], 1, atol=1e-4)


@pytest.mark.parametrize("most", [3, 7, lm.BATCH])
def test_scores_equal_a_direct_pass(most):
    """Texts of no token to many windows, in batches so small that texts pass in parts: every token is scored once."""
    rng, tree = some_tree()
    _, m = some_model(tree)
    made = [rng.integers(0, tree.size, n) for n in (0, 1, 15, 16, 17, 31, 33, 200)]
    got, seen = collections.Counter(), collections.Counter()
    for x, y, alone, parts in lm.blocks(tree, enumerate(made), most):
        assert len(x) <= most
        scores = lm.token_scores(m, x, y, alone, tree)
        assert np.allclose(scores, lm.token_scores(m, x, y, alone, tree, lm.inputs(m, np.arange(tree.size + 1))), atol=1e-5)
        for name, a, b in parts:
            got[name] += float(scores[a:b].sum(dtype=float))
            seen[name] += int((y[a:b] >= 0).sum())
    for name, ranks in enumerate(made):
        assert seen[name] == len(ranks) + 1
        assert abs(got[name] - direct(m, tree, ranks.tolist())) < 1e-3 * (len(ranks) + 1)


def test_logits_beyond_the_exponentials_range():
    """Weights whose exponentials overflow or vanish as they are: the logits are shifted, and scores and gradient stay right."""
    rng, tree = some_tree()
    flat = np.random.default_rng(3).standard_normal(lm.count(tree)).astype(np.float32)
    m = lm.views(flat, tree)
    made = [rng.integers(0, tree.size, n) for n in (5, 40)]
    for x, y, alone, parts in lm.blocks(tree, enumerate(made)):
        scores = lm.token_scores(m, x, y, alone, tree)
        for name, a, b in parts:
            want = direct(m, tree, made[name].tolist())
            assert abs(float(scores[a:b].sum(dtype=float)) - want) < 1e-3 * abs(want)
        grad = np.zeros_like(flat)
        assert abs(lm.gradient(m, x, y, alone, tree, lm.views(grad, tree)) + float(scores.sum(dtype=float))) < 1e-3 * abs(float(scores.sum()))
        assert np.isfinite(grad).all()


def test_distribution_over_ids_and_order():
    _, tree = some_tree()
    _, m = some_model(tree)
    one = lambda ids: direct(m, tree, ids)
    rng = np.random.default_rng(1)
    x = rng.integers(0, tree.size, (1, lm.STRIDE))
    every = [lm.token_scores(m, x, np.where(np.arange(lm.STRIDE) == 9, i, -1)[None], np.ones(1, bool), tree)[0, 9] for i in range(tree.size + 1)]
    assert abs(np.exp(np.array(every, float)).sum() - 1) < 1e-3
    a, b = tree.ends[-2][0], tree.ends[-2][0] + 1  # two ids of one leaf: their order counts
    assert abs(one([5, a, b, 6]) - one([5, b, a, 6])) > 1e-3


def test_gradient():
    rng, tree = some_tree()
    flat, m = some_model(tree)
    made = [(i, rng.integers(0, tree.size, n)) for i, n in enumerate((40, 3, 70, 0))]
    for x, y, alone, _ in lm.blocks(tree, made, 6):
        grad = np.zeros_like(flat)
        loss = lambda w: -float(lm.token_scores(lm.views(w, tree), x, y, alone, tree).sum(dtype=float))  # noqa: B023, E731
        assert abs(lm.gradient(m, x, y, alone, tree, lm.views(grad, tree)) - loss(flat)) < 1e-2
        for k, g in lm.views(grad, tree).items():
            at = lm.views(np.arange(len(flat)), tree)[k].ravel()[np.abs(g).argmax()]
            near = []
            for step in (0.01, -0.01):
                w = flat.copy()
                w[at] += step
                near.append(loss(w))
            assert abs((near[0] - near[1]) / 0.02 - grad[at]) < 0.03 * abs(grad[at]) + 1e-2, k


def test_learns_what_follows():
    rng = np.random.default_rng(10)
    n = 60
    follow = rng.permutation(n)  # each id is followed by one other, nine times in ten
    made = []
    for _ in range(150):
        s = [int(rng.integers(n))]
        while len(s) < 150:
            s.append(int(follow[s[-1]]) if rng.random() < 0.9 else int(rng.integers(n)))
        made.append(s)
    tree = lm.Tree(np.bincount(np.concatenate(made), minlength=n))
    ranks = [(0, tree.rank[s].astype(int)) for s in made]
    trainer = lm.Trainer(lm.start(tree), tree)
    for _ in range(6):
        for x, y, alone, _ in lm.blocks(tree, ranks[:120], 64):
            trainer.step(x, y, alone)
    held = [(lm.token_scores(trainer.model, x, y, alone, tree).sum(), (y >= 0).sum()) for x, y, alone, _ in lm.blocks(tree, ranks[120:])]
    assert -sum(a for a, _ in held) / sum(b for _, b in held) < 0.5 * math.log(n)


def test_trains_on_every_id(spark, monkeypatch):
    rows = [*enumerate(texts(40, 12, 200)), (100, None), (101, "short"), (102, "\u6f22\u5b57" * 300), (103, "x1y2" * 200), (None, "the of")]
    of = lm_scoring.WordIds(byte_bpe.codec(RANKS, P.PATTERN))
    want = sum(sum(len(of(w)) for w in lm_scoring._lower(t).split()) + 1 for i, t in rows if not lm_scoring.held_out(i))
    tree = lm.Tree(np.zeros(lm_scoring.vocabulary_size(RANKS, P.PATTERN), np.int64))
    frame, seen = spark.createDataFrame(rows, "doc_id long, text string"), []
    monkeypatch.setattr(lm.Trainer, "step", lambda self, x, y, alone: seen.append(int((y >= 0).sum())))
    for turn in range(lm_scoring.ROUNDS):
        kept = lm_scoring.learnt(frame, turn).collect()
        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in kept], pa.int64()), pa.array([r[1] for r in kept], pa.string())], names=["doc_id", "text"])
        list(lm_scoring._train(RANKS, P.PATTERN, tree, lm.start(tree))(iter([batch])))
    assert sum(seen) == want


def test_word_ids_are_the_librarys():
    import tiktoken

    c = byte_bpe.codec(RANKS, P.PATTERN)
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={b: i for i, b in c.raw.items()}, special_tokens={})
    of = lm_scoring.WordIds(c)
    for w in ("the", "tionnten.", "a,", "x1.", "don't", "...", ",", "\u00e9t\u00e9.", "ab.,", "7,"):
        assert of(w.encode()) == e.encode_ordinary(" " + w)


def test_new_words_of_a_text_take_one_call():
    """Words that aren't known yet go to the library together, with the ids that each has alone; white space of other kinds within
    a word doesn't join what is between words."""
    c = byte_bpe.Codec(RANKS, P.PATTERN)
    of, tree, calls = lm_scoring.WordIds(c), lm.Tree(np.zeros(lm_scoring.vocabulary_size(RANKS, P.PATTERN), np.int64)), []
    for name in ("merge", "words"):
        setattr(c, name, lambda text, f=getattr(c, name): calls.append(text) or f(text))
    words = ["the", "tionnten.", "don't", "...", ",", "x1.", "\u00e9t\u00e9.", "\u6f22\u5b57", "q" * 3000, "'s", "\x00", "the", "\U0001f600a"]
    odd = ["end\u00a0", "\u2003", "a\u0085b", "x\x1c", "\u3000y"]
    known = lm_scoring.WordRanks(of, tree, {})
    got = known.ranks(known.numbers([w.encode() for w in words]))
    assert len(calls) == 1
    assert got.tolist() == [int(tree.rank[i]) for w in words for i in of(w.encode())]
    both = [w.encode() for w in [*words, *odd, *words]]
    flat, sizes = of.many(both)
    assert (flat.tolist(), sizes.tolist()) == ([i for w in both for i in of(w)], [len(of(w)) for w in both])
    assert [x.tolist() for x in of.many([])] == [[], []]


def test_score_end_to_end(documents):
    """score against a direct pass with the weights that training left, on texts of many windows, and the same twice."""
    rows = [*enumerate(texts(30, 4, 400)), (90, None), (91, "q" * 3000)]
    got = {r.doc_id: r.score for r in lm_scoring.score(documents(*rows), RANKS, P.PATTERN).collect()}
    docs = documents(*rows).select("doc_id", "text")
    counts = lm_scoring.word_counts(docs)
    tree, weights = lm_scoring.trained(docs, counts, RANKS, P.PATTERN)
    of = lm_scoring.WordIds(byte_bpe.codec(RANKS, P.PATTERN))
    m = lm.views(weights, tree)
    for i in (0, 7, 90, 91):
        ranks = [int(tree.rank[j]) for w in lm_scoring._lower(dict(rows)[i]).split() for j in of(w)]
        assert abs(got[i] - direct(m, tree, ranks) / math.log(10)) < 1e-3 * (len(ranks) + 1)
    again = {r.doc_id: r.score for r in lm_scoring.score(documents(*rows), RANKS, P.PATTERN).collect()}
    assert again == got

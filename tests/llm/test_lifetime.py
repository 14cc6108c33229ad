"""How long written tables last, filters of keys, and what leaves a map that a filter prunes."""

import glob
import os
import threading

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pixelweave.llm import attention_lm as lm
from pixelweave.llm import bloom, exact_dedup, lm_scoring
from pixelweave.llm.common import cut, discard, shared_folder, stage, sweep

SF = "/root/testdata/sf0.001"


def folders(spark, tag):
    return {os.path.basename(x) for x in glob.glob(f"{shared_folder(spark).removeprefix('file://')}/{tag}-*")}


def test_a_table_lasts_as_long_as_anything_reads_it(spark):
    made = cut(spark.range(10), "lasting")
    derived = made.select((F.col("id") * 2).alias("x")).where("x > 3")
    del made
    sweep(spark, collect=True)
    cut(spark.range(3), "other")
    assert derived.count() == 8 and len(folders(spark, "lasting")) == 1
    del derived
    sweep(spark, collect=True)
    assert not folders(spark, "lasting")
    again = cut(spark.range(5), "lasting")
    discard(again)
    assert not folders(spark, "lasting")


def test_stages_called_before_others_are_read(spark):
    """Lazy results of stages stay whole whatever stages are called before they are read."""

    @stage
    def doubled(spark, docs, sf_dir):
        return cut(docs.select((F.col("id") * 2).alias("id")), "staged").where("id >= 0")

    first = doubled(spark, spark.range(4), SF)
    second = doubled(spark, first, SF)
    third = doubled(spark, spark.range(7), SF)
    assert [second.count(), first.count(), third.count()] == [4, 4, 7] and len(folders(spark, "staged")) == 3
    del first, third
    sweep(spark, collect=True)
    assert sorted(r.id for r in second.collect()) == [0, 4, 8, 12]


def told(df):
    return sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in df.collect())


def test_two_pipelines_built_before_either_is_read(spark):
    one, two = corpus_pipeline.run(spark, SF), corpus_pipeline.run(spark, SF)
    want = told(two)
    assert want and told(one) == want and told(two) == want


def test_pipelines_of_two_threads(spark):
    found = {}

    def build(k):
        found[k] = told(corpus_pipeline.run(spark, SF))

    threads = [threading.Thread(target=build, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert found[0] and found[0] == found[1]


@pytest.mark.parametrize("bits", [64, 1 << 12, 1 << 18])
def test_bloom_has_all_its_keys(spark, bits):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 3000)
    words = bloom.build(spark.createDataFrame([(int(k),) for k in keys], "h long"), bits)
    assert bloom.contains(words, keys.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 20000).view(np.uint64)
    assert bits < 1 << 18 or bloom.contains(words, others).mean() < 0.01
    assert not bloom.build(spark.createDataFrame([], "h long"), bits).any() and bloom.bits_for(10**12) == bloom.MOST_BITS


def test_exact_dedup_moves_only_texts_that_share_a_head(spark, monkeypatch):
    """Bytes of digits that the map lets through, with joins that don't broadcast, against those of texts in groups."""
    seen = []
    monkeypatch.setattr(exact_dedup, "cut", lambda df, tag: seen.append((tag, out := cut(df, tag))) or out)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        groups = {r.doc_id: r.group_size for r in exact_dedup.exact_groups(docs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    sizes = {r.doc_id: r.n for r in docs.select("doc_id", F.octet_length("text").alias("n")).collect()}
    repeated = next(df for tag, df in seen if tag == "repeated")
    words = spark.sparkContext.broadcast(bloom.build(repeated.select("h"), bloom.bits_for(repeated.count())))
    rows = docs.select(F.col("text").cast("binary").alias("text"), F.col("doc_id").alias("id"))
    moved = rows.mapInArrow(exact_dedup._whole(["id"], words), "head binary, text_sha256 string, digits binary, id long").select("id", F.octet_length("digits").alias("n")).collect()
    assert {r.id for r in moved} >= {i for i, n in groups.items() if n > 1}
    in_groups, whole = sum(sizes[i] for i, n in groups.items() if n > 1), sum(sizes.values())
    assert sum(r.n for r in moved) < 1.5 * in_groups + 0.02 * whole < 0.5 * whole


def test_softmaxes_of_extreme_rows():
    z = np.array([[-1e4, -2e4, -3e4], [5e3, 0, -5e3]], np.float32)
    got = lm._softmax(z, np.array([0, 1]))
    assert got.tolist() == [0.0, -5000.0] and np.isfinite(z).all() and np.allclose(z.sum(1), 1)
    tree = lm.Tree(np.arange(300))
    flat = (30 * np.random.default_rng(1).standard_normal(lm.count(tree))).astype(np.float32)
    for x, y, alone, _ in lm.blocks(tree, [(0, np.arange(200))]):
        grad = np.zeros_like(flat)
        assert np.isfinite(lm.token_scores(lm.views(flat, tree), x, y, alone, tree)).all()
        assert np.isfinite(lm.gradient(lm.views(flat, tree), x, y, alone, tree, lm.views(grad, tree))) and np.isfinite(grad).all()


def test_long_training_stays_finite():
    """Every text of 10,000 documents through one model: nothing leaves the finite numbers, and the loss falls below the ids' own shares."""
    table = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rank_file, size = P.path("byte_bpe_50k.tiktoken"), lm_scoring.vocabulary_size(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    of = lm_scoring.WordIds(lm_scoring.codec(rank_file, P.PATTERN))
    known: dict = {}
    texts = [np.array([i for w in lm_scoring._lower(r["text"]).split() for i in (known.get(w) or known.setdefault(w, of(w)))], np.int64) for r in table[:6000]]
    counts = np.bincount(np.concatenate(texts), minlength=size)
    tree = lm.Tree(counts)
    trainer = lm.Trainer(lm.start(tree), tree)
    ranks = [tree.rank[t].astype(np.int64) for t in texts]
    for x, y, alone, _ in lm.blocks(tree, enumerate(ranks[:5500])):
        trainer.step(x, y, alone)
    assert trainer.steps > 300 and np.isfinite(trainer.loss) and np.isfinite(trainer.flat).all()
    held = [(lm.token_scores(trainer.model, x, y, alone, tree), y >= 0) for x, y, alone, _ in lm.blocks(tree, enumerate(ranks[5500:]))]
    assert all(np.isfinite(s).all() for s, _ in held)
    loss = -sum(float(s.sum(dtype=float)) for s, _ in held) / sum(int(m.sum()) for _, m in held)
    share = np.log((counts + 0.1) / (counts.sum() + 0.1 * size))
    alone_loss = -sum(float(share[t].sum()) for t in texts[5500:]) / sum(len(t) for t in texts[5500:])
    assert loss < alone_loss


def test_training_that_fails_is_loud(monkeypatch):
    import pyarrow as pa

    tree = lm.Tree(np.zeros(lm_scoring.vocabulary_size(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), np.int64))
    monkeypatch.setattr(lm.Trainer, "step", lambda self, x, y, alone: self.flat.fill(np.nan))
    monkeypatch.setattr(lm_scoring.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 7})()))
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array(["some words"])], names=["doc_id", "text"])
    with pytest.raises(FloatingPointError, match="task 7"):
        list(lm_scoring._train(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, tree, lm.start(tree))(iter([batch])))


def test_ids_of_any_name(spark):
    """Columns whose names hold spaces, dots and quotes."""
    from pixelweave.llm import byte_bpe, license_scan, token_counts

    for name in ("doc id", "doc.id", "select", "a`b"):
        docs = spark.createDataFrame([(7, "cc by and more"), (8, None)], "x long, text string").withColumnRenamed("x", name)
        counted = token_counts.token_counts(docs, P.path("byte_bpe_50k.json"), 10, id_col=name)
        assert counted.columns[0] == name and sorted(r[0] for r in counted.collect()) == [7, 8]
        coded = byte_bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, id_col=name)
        assert sorted(r[0] for r in byte_bpe.digests(coded, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, id_col=name).collect()) == [7, 8]
        scanned = license_scan.scan(docs, id_col=name)
        assert sorted((r[0], r.base_labels) for r in scanned.collect()) == [(7, "cc-by"), (8, "")]

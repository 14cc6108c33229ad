"""Every query of the package over the smallest tables: whole, with the stated columns, equal to its SQL where it has one."""

import os

import duckdb
import pytest

import corpus_pipeline
from pixelweave.llm import queries

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id size source_size target taken", "op2": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op3": "doc_id n_shingles component_id",
    "op4": "doc_id n_tokens ids_sha256 decoded_sha256", "op5": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6": "doc_id n_words n_base first_word last_word base_labels labels score", "op7": "page_id host path rule verdict", "op8": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op9": "doc_id keep_id group_size kept text_sha256", "op10": "doc_id n_bytes n_tokens over_limit",
    "op11": "word form root n n_near form_n", "op12": "vec_id cluster distance cluster_inertia inertia centroid_sha256", "op13": "doc_id n_bytes n_removed n_spans kept_sha256",
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(got.columns)
    rows = got.collect()
    if queries.ORACLES.get(name):
        con = duckdb.connect()
        for f in os.listdir(DATA):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
        columns = sorted(got.columns)
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
        text = lambda r: tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r)
        assert sorted(text(r[c] for c in columns) for r in rows) == sorted(map(text, want))
    elif name.split("_")[0] not in ("op7", "op2"):
        assert len(rows) == 200


def test_url_rules(spark, tmp_path):
    """The five rules of the contract, each by pages that no shorter or other rule decides; an allowed page clears what links to it."""
    rows = [
        ("http://a.com/en/1", None, "com/en/", "block"), ("http://www.example.com/en/70", None, "example.com/en/7", "allow"), ("http://example.com/en/6", None, "com/en/", "block"),
        ("http://a.net/de/1", None, "net/de/", "allow"), ("http://x.example.net/de/81", None, "example.net/de/8", "block"), ("http://example.net/de/7", None, "net/de/", "allow"),
        ("http://a.org/es/1", None, "org/es/", "block"), ("http://a.org/de/8", None, None, "allow"),
        ("http://m.org/1", "<link rel=canonical href=http://a.com/en/1><link rel=canonical href=http://m.org/2>", None, "block"),
        ("http://n.org/1", "<link rel=canonical href=http://a.net/de/5><link rel=canonical href=http://x.org/es/9>", None, "allow"),
    ]
    spark.createDataFrame([(i, u, h) for i, (u, h, *_) in enumerate(rows)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in queries.op7_url_filter(spark, str(tmp_path)).collect()}
    assert got == {i: r[2:] for i, r in enumerate(rows)}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "n-gram Jaccard join", "mixing", "byte-level BPE"]
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append(docs.count())
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= ids
    assert sizes[0] >= sizes[1] >= sizes[2] > 0
    kept = docs.select("doc_id").collect()
    final = corpus_pipeline.run(spark, DATA)
    assert sorted(r.doc_id for r in final.collect()) == sorted(r.doc_id for r in kept)

"""The queries of this package with the production parameters, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, jaccard_join, lm_scoring, quality
from .centroids import clusters
from .chat_format import canonical_turns, formatted, masked, read_back
from .common import cut, n_words, read
from .exact_dedup import exact_groups
from .license_scan import scan
from .mixing import mix
from .spelling import variants
from .suffix_dedup import without_repeats
from .token_counts import token_counts
from .url_filter import judge

#: Weights of the sources by rank, repeating.
WEIGHTS = (3, 1, 2)
URL_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def rank_weight():
    return F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    sizes = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    mixed = mix(sizes, rank_weight(), share=1.5, max_epochs=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


#: Bytes of a JSON record up to which it becomes a variant, which end at 16 MiB.
JSON_BYTES = 15 << 20


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, t) of conversations by turn; t: their turns in order."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))


def chat_records(table: DataFrame) -> DataFrame:
    """conversations with record: JSON in the layouts that chat data come in, another by conversation. Layouts
    that can't hold a conversation (other roles, or not two turns) give way to one that can."""
    listed = lambda role, text, names=(): F.transform("t", lambda t: F.struct(_named(t["role"], names).alias(role), t["text"].alias(text)))
    pair = (F.size("t") == 2) & (F.col("t")[0]["role"] == "user") & (F.get("t", F.lit(1))["role"] == "assistant")
    one, two = F.col("t")[0]["text"], F.get("t", F.lit(1))["text"]
    layout = F.pmod(F.xxhash64("conv_id"), F.lit(8))
    record = (
        F.when((layout == 0) & pair, F.to_json(F.struct(one.alias("prompt"), two.alias("response"))))
        .when((layout == 1) & pair, F.to_json(F.struct(one.alias("prompt"), two.alias("completion"))))
        .when((layout == 2) & pair, F.to_json(F.struct(one.alias("instruction"), two.alias("output"))))
        .when((layout % 3 == 0) & ~F.exists("t", lambda t: t["role"].isin("human", "gpt")), F.to_json(F.struct(listed("from", "value", (("user", "human"), ("assistant", "gpt"))).alias("conversations"))))
        .when(layout % 3 == 1, F.to_json(F.struct(listed("role", "content").alias("messages"))))
        .otherwise(F.to_json(F.struct(listed("role", "text").alias("turns"))))
    )
    return table.withColumn("record", record)


def _named(role: Column, names: tuple[tuple[str, str], ...]) -> Column:
    out = role
    for own, other in names:
        out = F.when(role == own, F.lit(other)).otherwise(out)
    return out


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.to_json(F.struct(said.alias("prompt"), said.alias("response"))).alias("record"))
    table = conversations(read(spark, sf_dir, "conversations"))
    told, short = chat_records(table), F.octet_length("record") <= JSON_BYTES
    records = told.where(short).select("conv_id", "record").unionByName(extra)
    listed = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    large = told.where(~short).select("conv_id", F.struct(listed.alias("turns")).alias("record"))
    turns = canonical_turns(records).select("conv_id", "turns").unionByName(canonical_turns(large).select("conv_id", "turns"))
    out = turns.select("conv_id", formatted(F.col("turns")).alias("formatted"))
    out = out.select("conv_id", "formatted", read_back(F.col("formatted")).alias("back"), masked(F.col("formatted")).alias("loss"))
    hashed = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(hashed.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(read(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_bpe.digests(byte_bpe.encode(read(spark, sf_dir, "documents"), *vocabulary), *vocabulary)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(quality.measured(read(spark, sf_dir, "documents"), keep=["doc_id", "lang"]), "measures")
    cutoffs = quality.calibrate(rows, read(spark, sf_dir, "labels"))
    return quality.judged(rows, cutoffs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents")).drop("spans")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lm_scoring.score(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), budget=1024)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read(spark, sf_dir, "documents"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(read(spark, sf_dir, "embeddings"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_chat_format": op2_chat_format,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_quality_rules": op5_quality_rules,
    "op6_license_scan": op6_license_scan,
    "op7_url_filter": op7_url_filter,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_suffix_dedup": op13_suffix_dedup,
}



def _lloyd_sql(rounds: int) -> str:
    """Clustering written out round by round, in whole numbers."""
    near = """
a{n} AS MATERIALIZED (
  SELECT rid, c, d FROM (
    SELECT x.rid, y.c, sum((x.x - y.y) * (x.x - y.y))::BIGINT AS d, row_number() OVER (PARTITION BY x.rid ORDER BY sum((x.x - y.y) * (x.x - y.y)), y.c) AS best
    FROM x JOIN c{n} y ON x.i = y.i GROUP BY x.rid, y.c) WHERE best = 1)"""
    move = """,
c{m} AS MATERIALIZED (
  SELECT y.c, y.i, coalesce(s.mean, y.y) AS y FROM c{n} y LEFT JOIN (
    SELECT a.c, x.i, ((sum(x.x) - ((sum(x.x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS mean FROM x JOIN a{n} a ON a.rid = x.rid GROUP BY a.c, x.i) s
  ON s.c = y.c AND s.i = y.i),"""
    steps = "".join(near.format(n=k) + (move.format(n=k, m=k + 1) if k < rounds else "") for k in range(rounds + 1))
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS rid, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
x AS MATERIALIZED (SELECT rid, i, floor(1024 * embedding[i]::DOUBLE)::BIGINT AS x FROM v, range(1, 65) r(i)),
f AS MATERIALIZED (SELECT rid, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM v ORDER BY c LIMIT 8),
c0 AS MATERIALIZED (SELECT f.c, x.i, x.x AS y FROM f JOIN x ON x.rid = f.rid),{steps},
h AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT v.vec_id, a.c::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, h.centroid_sha256
FROM a{rounds} a JOIN v ON v.rid = a.rid JOIN h ON h.c = a.c
"""


ORACLES: dict[str, str | None] = {
    "op11_spelling_variants": """
WITH RECURSIVE bits(i, k, v) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
grouped AS (SELECT run, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS code, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_transform(range(0, length(code) // 2), lambda i: ('0x' || substr(code, (2 * i + 1)::BIGINT, 2))::BIGINT),
    lambda s, b: xor(t[(xor(s, b) & 255) + 1], s >> 8), 4294967295)) AS h
  FROM grouped, crc),
kept AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word, n FROM hashed),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM kept WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
places AS MATERIALIZED (SELECT word, substr(word, 1, k - 1) AS head, substr(word, k + 1) AS tail FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM v)),
pairs AS (
  SELECT a.word, b.word AS near FROM places a JOIN places b ON a.head = b.head AND a.tail = b.tail WHERE a.word <> b.word
  UNION SELECT p.word, v.word FROM places p JOIN v ON v.word = p.head || p.tail
  UNION SELECT v.word, p.word FROM places p JOIN v ON v.word = p.head || p.tail),
ranked AS (
  SELECT p.word, p.near, v.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near,
    row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, p.near) AS best FROM pairs p JOIN v ON v.word = p.near),
formed AS MATERIALIZED (
  SELECT v.word, v.n, CASE WHEN near_n >= 10 * v.n THEN near END AS form, CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n, coalesce(n_near, 0)::BIGINT AS n_near
  FROM v LEFT JOIN ranked r ON r.word = v.word AND r.best = 1),
roots(word, leaf) AS (
  SELECT word, word FROM formed UNION ALL SELECT r.word, f.form FROM roots r JOIN formed f ON f.word = r.leaf WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.leaf AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN roots r ON r.word = f.word JOIN formed e ON e.word = r.leaf AND e.form IS NULL
""",
    "op12_centroid_clusters": _lloyd_sql(10),
    "op13_suffix_dedup": """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS code, strlen(coalesce(text, '')) AS n FROM documents),
w AS MATERIALIZED (SELECT doc_id, s, substr(code, 2 * s + 1, 200) AS body FROM (SELECT doc_id, code, unnest(range(0, n - 99)) AS s FROM d WHERE n >= 100)),
m AS MATERIALIZED (SELECT hash(body) AS h FROM w GROUP BY h HAVING count(*) > 1),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS k FROM w WHERE hash(body) IN (SELECT h FROM m)) WHERE k > 1),
e AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER o + 100 THEN 0 ELSE 1 END AS opens FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
g AS (SELECT doc_id, s, sum(opens) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS span FROM e),
p AS (SELECT doc_id, span, min(s) AS lo, max(s) + 100 AS hi FROM g GROUP BY doc_id, span),
q AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS before FROM p),
k AS (
  SELECT q.doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, max(hi) AS last,
    string_agg(substr(d.code, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS kept
  FROM q JOIN d ON d.doc_id = q.doc_id GROUP BY q.doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept || substr(d.code, 2 * last + 1), d.code))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
""",
    "op1_mixing": """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
t AS (SELECT sum(source_size) AS total, sum(weight) AS weights FROM w),
c AS (
  SELECT cap / weight AS ratio, sum(cap) OVER o - cap AS gone, sum(weight) OVER o - weight AS used
  FROM w WINDOW o AS (ORDER BY cap / weight, rank ROWS UNBOUNDED PRECEDING)),
l AS (
  SELECT coalesce(min_by((1.5::DOUBLE * total - gone) / (weights - used), ratio), 0) AS level
  FROM c, t WHERE (1.5::DOUBLE * total - gone) / (weights - used) <= ratio),
p AS (SELECT w.*, least(cap, level * weight) AS target FROM w, l),
q AS (
  SELECT p.*, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::BIGINT AS whole FROM p),
m AS (
  SELECT d.*, q.source_size, q.target, q.whole, q.target - q.whole * q.source_size AS quota,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('17:' || coalesce(d.doc_id::VARCHAR, '')), d.doc_id ROWS UNBOUNDED PRECEDING) - d.size / 2.0::DOUBLE AS middle
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, (size * least(whole + CASE WHEN middle < quota THEN 1 ELSE 0 END, 2))::BIGINT AS taken FROM m
""",
    "op2_chat_format": """
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(8 + 2 * length(role) - length(translate(role, '\\<[|', '')) + 2 * length(text) - length(translate(text, '\\<[|', '')))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
""",
    "op9_exact_dedup": """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
g AS (SELECT *, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM d)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
""",
}

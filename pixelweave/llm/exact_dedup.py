"""Exact dedup by distributed MSD radix partitioning.

A text becomes a string of digits: its length in eight bytes, then its bytes (A-Z lower-cased). Each round
splits the groups of the round before by their next bytes. A document leaves when its group has one row
(singleton) or when the digits have ended; equal digits, not digests, decide equality. The first round works on
heads alone. A Bloom filter of the heads that repeat (bloom.MOST_BITS bits at most) then drops texts where they are read, and a join
the few that pass it by chance, so only texts that share length and first bytes with another are ever moved. The width of a round
grows geometrically up to LAST_WIDTH, the most bytes of a text that are ever a key: copies of ordinary texts end
within a few rounds, and a text of any length within one round for each LAST_WIDTH of it.

Every row has a key of its own, and a group is named by the smallest key in it, so groups stay apart whatever the
ids. A group is pre-aggregated before its count is joined back, and the join back is one that adaptive execution can
split, so a group with a third of all rows doesn't meet in one task.

Cases: null text counts as empty; empty texts are equal to each other; an empty table gives an empty result; a
null doc_id ranks below all others; an id may repeat, with equal or with other texts: of equal texts exactly one row has
kept true, of those with the largest id any one. Columns of the input other than the named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import cut, discard, numbered, small_batches

HEAD, FIRST_WIDTH, GROWTH, LAST_WIDTH = 40, 512, 8, 1 << 20


def _digits(text: bytes) -> bytes:
    return len(text).to_bytes(8, "big") + text


def _hash(head: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(head, digest_size=8).digest(), "big", signed=True)


def _heads(names: list[str]):
    """Of each row (text first) the head of its digits with a hash, and its digest, before the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(x or b"").lower() for x in b.column(0).to_pylist()]
            heads = [_digits(x)[:HEAD] for x in texts]
            cols = [pa.array(map(_hash, heads), pa.int64()), pa.array(heads, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *b.columns[1:]], names=["h", "head", "text_sha256", *names])

    return run


def _whole(names: list[str], words):
    """The rows whose heads the filter has: head, digest and all digits, before the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(x or b"").lower() for x in b.column(0).to_pylist()]
            heads = [_digits(x)[:HEAD] for x in texts]
            keep = bloom.contains(words.value, np.fromiter(map(_hash, heads), np.int64, len(heads)).view(np.uint64))
            at = np.flatnonzero(keep).tolist()
            cols = [pa.array([heads[i] for i in at], pa.binary()), pa.array([hashlib.sha256(texts[i]).hexdigest() for i in at], pa.string()), pa.array([_digits(texts[i]) for i in at], pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, *(c.filter(pa.array(keep)) for c in b.columns[1:])], names=["head", "text_sha256", "digits", *names])

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256 of every row of docs; row_col, a column without nulls or repeats, is passed through."""
    small_batches(docs.sparkSession)
    more = [] if row_col is None else [F.col(row_col).cast("long").alias("passed")]
    rows = docs.select(F.col(text_col).cast("binary").alias("text"), F.col(id_col).cast("long").alias("id"), *more)
    names = rows.columns[1:]
    kept_columns, kinds = ["id", *names[1:], "text_sha256"], ", ".join(f"{c} long" for c in names)
    heads = cut(rows.mapInArrow(_heads(names), f"h long, head binary, text_sha256 string, {kinds}"), "heads")
    repeated = heads.groupBy("head").agg(F.count("*").alias("n"), F.min("h").alias("h")).where("n > 1")
    repeated = cut(repeated.select("h", "head"), "repeated")
    alone = heads.join(repeated.select("head"), "head", "left_anti")
    found = [alone.select(*kept_columns, F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))]
    words = docs.sparkSession.sparkContext.broadcast(bloom.build(repeated.select("h"), bloom.bits_for(repeated.count())))
    whole = rows.mapInArrow(_whole(names, words), f"head binary, text_sha256 string, digits binary, {kinds}")
    active = cut(
        whole.join(repeated.select("head"), "head").select(*kept_columns, "digits", F.col("head").alias("group")).withColumn("row", F.monotonically_increasing_id()),
        "radix",
    )
    at, width = HEAD, FIRST_WIDTH
    while not active.isEmpty():
        keyed = active.withColumn("chunk", F.substring("digits", at + 1, width))
        best = F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", "row"))
        counts = keyed.groupBy("group", "chunk").agg(F.count("*").alias("n"), best.alias("top"), F.min("row").cast("string").cast("binary").alias("next"))
        over = (F.col("n") == 1) | (F.octet_length("digits") <= at + width)
        split = cut(
            keyed.join(counts, ["group", "chunk"]).select(*kept_columns, F.when(~over, F.col("digits")).alias("digits"), F.col("next").alias("group"), "row", "n", "top", over.alias("over")),
            "radix",
        )
        discard(active)
        found.append(split.where("over").select(*kept_columns, F.col("top.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("top.row")).alias("kept")))
        active = split.where("not over").select(*kept_columns, "digits", "group", "row")
        at, width = at + width, min(width * GROWTH, LAST_WIDTH)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    passed = [] if row_col is None else [F.col("passed").alias(row_col)]
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256", *passed)


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs, all columns, without the rows whose text an equal row with a larger doc_id has."""
    keyed, row = numbered(docs, "keyed")
    kept = exact_groups(keyed, row_col=row).where("kept").select(F.col(row).alias("kept_row"))
    return keyed.join(kept, keyed[row] == kept["kept_row"], "left_semi").select(*docs.columns)

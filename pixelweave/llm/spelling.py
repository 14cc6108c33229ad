"""Spelling variants: words that differ by one code point, found by generating each word's whole neighbourhood.

1. Each task counts the words of its texts and sums them before the shuffle.
2. A neighbour of a word is what one deletion, replacement or insertion over the alphabet makes of it. The alphabet is that of the
   vocabulary (at most ALPHABET_SIZE code points, which the pattern bounds). Each is made once: a deletion at the first of equal neighbours
   alone, an insertion never behind an equal code point, so no distance is ever verified.
3. Neighbours are held against a Bloom filter of the vocabulary (bloom.MOST_BITS bits at most) by hashes put together from those of
   the word's parts; only those that pass are spelled out, and the join with the vocabulary is exact. With a vocabulary beyond the filter
   more neighbours pass and the join drops them.
4. A word's form is its most frequent neighbour, where that is RATIO times as frequent; roots follow the forms by doubling.

Cases: null text has no words; a null id counts as an empty one; an id may repeat, each row counts; an empty table, or one without
repeated words, gives an empty result; of neighbours of equal count the smallest in code-point order is the form; columns other than the
named ones are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import cut, discard, small_batches

#: In Latin-1 a run's code points are bytes, and bytes.lower() lowers A-Z alone; all other code points become "?".
RUN = rb"[A-Za-z\xc0-\xff]{%d,}"
ALPHABET_SIZE = 26 + 64
LEAST_LENGTH, LEAST_COUNT, RATIO, CHANGED_OF = 7, 2, 10, 31
#: Words that a task counts before it passes them on.
HELD = 200_000
#: Words whose neighbourhoods a task makes, and of words of 16 letters those made at once.
WORDS_A_TASK, AT_ONCE = 20_000, 512
MULTIPLIER, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _words(least: int, changed_of: int):
    """Words of texts with their number; of changed_of occurrences one loses a code point, by the hash of id and run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, counts = re.compile(RUN % least), Counter()
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                start = zlib.crc32(b"%s:" % (b"" if doc is None else str(doc).encode()))
                found = Counter(runs.findall((text or b"").decode("utf-8", "replace").encode("latin-1", "replace").lower()))
                for word, n in found.items():
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                    if h % changed_of == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    counts[word] += n
            if len(counts) >= HELD:
                yield _counted(counts)
                counts.clear()
        if counts:
            yield _counted(counts)

    return run


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, changed_of: int = CHANGED_OF) -> DataFrame:
    """(word, n) of the words of at least so many code points and occurrences."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"))
    counted = rows.mapInArrow(_words(least, changed_of), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, MULTIPLIER)]))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


def _prefixes(codes: np.ndarray) -> np.ndarray:
    """Polynomials of all prefixes of words of one length, one row a word."""
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    for k in range(codes.shape[1]):
        out[:, k + 1] = out[:, k] * MULTIPLIER + codes[:, k]
    return out


def neighbours(codes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(kind, hash, wanted) of all neighbours of m words of length n: by word and place, for replacements and insertions also by
    letter; wanted leaves each neighbour once."""
    m, n = codes.shape
    with np.errstate(over="ignore"):
        power, before = _powers(n + 1), _prefixes(codes.astype(np.uint64) + np.uint64(1))
        letter = alphabet.astype(np.uint64) + np.uint64(1)
        tail = before[:, n, None] - before * power[n - np.arange(n + 1)][None, :]  # what follows each place
        whole = lambda head, k: head * power[n - k]
        k = np.arange(n)
        first = np.concatenate([np.ones((m, 1), bool), codes[:, 1:] != codes[:, :-1]], 1)
        yield "delete", _mixed(whole(before[:, :n], k + 1) + tail[:, 1:]), first
        put = before[:, :n, None] * MULTIPLIER + letter
        yield "replace", _mixed(put * power[n - k - 1][None, :, None] + tail[:, 1:, None]), alphabet != codes[:, :, None]
        k = np.arange(n + 1)
        put = before[:, :, None] * MULTIPLIER + letter
        other = np.concatenate([np.ones((m, 1, len(alphabet)), bool), alphabet != codes[:, :, None]], 1)
        yield "insert", _mixed(put * power[n - k][None, :, None] + tail[:, :, None]), other


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The hashes that neighbours() gives to these words."""
    out = np.zeros(len(words), np.uint64)
    lengths = np.array([len(w) for w in words])
    with np.errstate(over="ignore"):
        for n in np.unique(lengths):
            of = np.flatnonzero(lengths == n)
            codes = np.frombuffer(b"".join(words[i] for i in of), np.uint8).reshape(len(of), n)
            out[of] = _mixed(_prefixes(codes.astype(np.uint64) + np.uint64(1))[:, -1])
    return out


def _latin(column: pa.Array) -> list[bytes]:
    return [w.encode("latin-1") for w in column.to_pylist()]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(word_hashes(_latin(b.column("word"))).view(np.int64))], names=["h"])


def _candidates(filter_, alphabet: bytes):
    """(near, word, n) of the neighbours that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_held, letters = filter_.value, np.frombuffer(alphabet, np.uint8)
        for b in batches:
            words, counts = _latin(b.column("word")), b.column("n").to_pylist()
            by_length: dict[int, list[int]] = {}
            for i, w in enumerate(words):
                by_length.setdefault(len(w), []).append(i)
            for n, all_of in by_length.items():
                step = max(1, AT_ONCE * 16 // n)
                for lo in range(0, len(all_of), step):
                    of = all_of[lo : lo + step]
                    codes = np.frombuffer(b"".join(words[i] for i in of), np.uint8).reshape(len(of), n)
                    out: list[tuple[bytes, int]] = []
                    for kind, h, wanted in neighbours(codes, letters):
                        for place in np.argwhere(wanted & bloom.contains(words_held, h)).tolist():
                            w, k = words[of[place[0]]], place[1]
                            put = b"" if kind == "delete" else alphabet[place[2] : place[2] + 1]
                            out.append((w[:k] + put + w[k + (kind != "insert") :], of[place[0]]))
                    if out:
                        near = pa.array([x.decode("latin-1") for x, _ in out], pa.string())
                        own = pa.array([words[i].decode("latin-1") for _, i in out], pa.string())
                        yield pa.RecordBatch.from_arrays([near, own, pa.array([counts[i] for _, i in out], pa.int64())], names=["near", "word", "n"])

    return run


def near_words(words: DataFrame, filter_bits: int = bloom.MOST_BITS) -> DataFrame:
    """(word, n, near, near_n) of all pairs of words that differ by one code point, both ways; words: (word, n), each once,
    of the code points that RUN names."""
    spark = words.sparkSession
    letters = words.select(F.explode(F.split("word", "")).alias("x")).where("x <> ''").distinct()
    alphabet = "".join(sorted(r.x for r in letters.collect())).encode("latin-1")
    n = words.count()
    held = bloom.build(words.select("word").mapInArrow(_hashed, "h long"), bloom.bits_for(n, filter_bits))
    spread = words.repartition(max(spark.sparkContext.defaultParallelism, -(-n // WORDS_A_TASK)), "word")
    found = spread.mapInArrow(_candidates(spark.sparkContext.broadcast(held), alphabet), "near string, word string, n long")
    return found.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, changed_of: int = CHANGED_OF, filter_bits: int = bloom.MOST_BITS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = cut(vocabulary(docs, id_col, text_col, least, least_count, changed_of), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    by_word = near_words(words, filter_bits).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    formed = words.join(by_word, "word", "left")
    is_form = -F.col("best.less") >= ratio * F.col("n")
    table = formed.select(
        "word",
        F.when(is_form, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, -F.col("best.less")).alias("form_n"),
    )
    table = cut(table, "forms")
    return table.join(_roots(table), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(table: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: every round follows twice as many steps, and a form is ratio times as frequent."""
    step = table.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    step = cut(step, "roots")
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = cut(step.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(step)
        if longer.where("moved").isEmpty():
            return longer.select("word", "root")
        step = longer.select("word", "root")

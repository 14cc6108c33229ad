"""LM scoring: a unigram base over words, and a causal self-attention model over subword ids.

Documents whose crc32 of the id, mod HELD_OUT, isn't 0 are learnt from. Three things are gathered from all of them:
counts of words (by pre-aggregated shuffle, so they grow with the corpus and stay distributed), counts of subword
ids (one number an id of the fixed vocabulary), and the attention model's weights. The weights are trained in
numpy by data-parallel rounds: each task starts from the round's weights and steps through all of its documents of
that round, and the tasks' weights are averaged by tokens, as sums of whole numbers, so their order doesn't matter.
A document belongs to one round, by the crc of its id: the rounds together take every id of every text once. A text is
the sequence of its words' subword ids, each word encoded with a space before it, so a word's ids are found once and
the ids' counts follow exactly from the words' counts.

Scoring sends every text through batched masked attention in overlapping windows that score each token once. For the
base, the most frequent words' counts go to the tasks (at most HOT_WORDS words of at most HOT_BYTES bytes, whatever
the corpus); all other words of a document leave as (document, word, times) and are joined with the counts.

The text is lower-cased (A-Z only). score is the model's log10 probability of the lower-cased words and the end: the
model is a distribution over subword sequences, of which the words' own encoding is one.

Cases: null text is empty and consists of its end alone; a null id counts as an empty string for the crc; without any
training document all counts are 0; rows that repeat are scored each; an empty table gives an empty result; columns
of the input other than the named two are not read.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention_lm as lm
from .byte_bpe import Codec, codec
from .common import cut, small_batches
from .pretokens import findall

HELD_OUT = 10
HOT_WORDS, HOT_BYTES = 200_000, 40
#: Distinct words a task counts before it sends them on.
COUNTED = 400_000
#: Words whose ids' ranks a task remembers.
REMEMBERED = 600_000
#: Blocks that are scored together; their number doesn't change the scores.
SCORED = 2048
ROUNDS = 2
SMOOTH = 0.1
#: Weights are averaged in steps of one part in FIXED.
FIXED = 1 << 24


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT == 0


def _crc() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def learnt(rows: DataFrame, turn: int | None = None) -> DataFrame:
    """The rows that are learnt from; of one round alone if turn is given."""
    rows = rows.where(_crc() % HELD_OUT != 0)
    return rows if turn is None else rows.where(F.floor(_crc() / HELD_OUT) % ROUNDS == turn)


def _lower(text: str | None) -> bytes:
    return (text or "").encode().lower()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of training texts; the end of a text is the null word."""
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    for b in batches:
        for text in b.column(1).to_pylist():
            seen.update(_lower(text).split())
            seen[None] += 1
        if len(seen) > COUNTED:
            yield out()
            seen.clear()
    yield out()


#: White space other than the space and the line end that many() puts between words.
OTHER_SPACE = re.compile(r"[^\S\n ]")


class WordIds:
    """Ids of a word with a space before it."""

    def __init__(self, c: Codec):
        self.codec = c
        # Whether ASCII letters are one pre-token with the space before them, and a sign after them another.
        self.plain = findall(c.pattern, " ab.") == [" ab", "."]
        # Whether a line end before the space is a pre-token of its own and changes nothing in the words on both sides.
        self.lines = findall(c.pattern, "\n ab\n 1.\n .\n ab") == ["\n", " ab", "\n", " 1", ".", "\n", " .", "\n", " ab"]
        self.end = c.merge("\n")

    def __call__(self, word: bytes) -> list[int]:
        if self.plain and word.isalpha():
            return self.codec.merge(" " + word.decode())
        if self.plain and word[-1:] in (b".", b",") and word[:-1].isalpha():
            return self.codec.merge(" " + word[:-1].decode()) + self.codec.merge(word[-1:].decode())
        return [i for p in findall(self.codec.pattern, " " + word.decode()) for i in self.codec.merge(p)]


    def many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and how many each has. The library takes the words in one call, a line each; words
        with white space of their own, which could join the line end, go one by one."""
        text = "\n ".join(map(bytes.decode, [b"", *words]))
        if not self.lines or len(self.end) > 1 or OTHER_SPACE.search(text):
            ids = list(map(self, words))
            return np.fromiter(itertools.chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.array(self.codec.words(text), np.int64)
        ends = flat == self.end[0]  # no word has a line end
        return flat[~ends], np.diff(np.flatnonzero(ends), append=len(flat)) - 1


def _count_ids(rank_file: str, pattern: str, size: int):
    """Counts of ids from counts of words, a task's as one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = WordIds(codec(rank_file, pattern)), np.zeros(size)
        for b in batches:
            if b.num_rows:
                flat, sizes = of.many(b.column(0).to_pylist())
                total += np.bincount(flat, np.repeat(b.column(1).to_numpy(), sizes), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at].astype(np.int64))], names=["id", "n"])

    return run


class WordRanks:
    """Words by number, remembered: the ranks of their ids one after the other, and the log share of the frequent ones."""

    def __init__(self, ids: WordIds, tree: lm.Tree, logs: dict[bytes, float]):
        self.ids, self.logs, self.rank = ids, logs, tree.rank
        self.forget()

    def forget(self) -> None:
        self.of: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.flat, self.ends, self.shares = array("I"), array("Q", [0]), array("d")

    def numbers(self, words: list[bytes]) -> np.ndarray:
        of = self.of
        if len(of) > REMEMBERED:
            self.forget()
            of = self.of
        out = np.fromiter(map(of.get, words, itertools.repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(out < 0)
        if len(at):
            missing = [words[i] for i in at.tolist()]
            new = list(dict.fromkeys(missing))
            of.update(zip(new, itertools.count(len(of))))
            self.words += new
            ids, sizes = self.ids.many(new)
            ends = len(self.flat) + np.cumsum(sizes)
            self.flat.frombytes(self.rank.take(ids).tobytes())
            self.ends.frombytes(ends.astype(np.uint64).tobytes())
            self.shares.extend(map(self.logs.get, new, itertools.repeat(math.nan)))
            out[at] = np.fromiter(map(of.__getitem__, missing), np.int64, len(missing))
        return out

    def ranks(self, numbers: np.ndarray) -> np.ndarray:
        """Ranks of the ids of the words."""
        flat, ends = np.frombuffer(self.flat, np.uint32), np.frombuffer(self.ends, np.int64)
        begin = ends.take(numbers)
        size = ends.take(numbers + 1) - begin
        stop = np.cumsum(size)
        at = np.repeat(begin - stop + size, size)
        at += np.arange(len(at))
        return flat.take(at)

    def share(self, numbers: np.ndarray) -> np.ndarray:
        """Log shares of the words, nan for those that aren't frequent."""
        return np.frombuffer(self.shares, np.float64).take(numbers)


#: What a worker remembers of words, of one tree at a time.
_words: dict[tuple, WordRanks] = {}


def word_ranks(rank_file: str, pattern: str, tree: lm.Tree, logs: dict[bytes, float] | None = None) -> WordRanks:
    key = (rank_file, pattern, tree.mark, logs is None)
    if key not in _words:
        _words.clear()
        _words[key] = WordRanks(WordIds(codec(rank_file, pattern)), tree, logs or {})
    return _words[key]


def _train(rank_file: str, pattern: str, tree: lm.Tree, weights: np.ndarray):
    """Weights of a task after all its texts, with the number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, trainer = word_ranks(rank_file, pattern, tree), lm.Trainer(weights, tree)
        texts = ((0, known.ranks(known.numbers(_lower(text).split()))) for b in batches for text in b.column(1).to_pylist())
        for x, y, alone, _ in lm.blocks(tree, texts):
            trainer.step(x, y, alone)
        if not (math.isfinite(trainer.loss) and np.isfinite(trainer.flat).all()):
            raise FloatingPointError(f"training in task {TaskContext.get().partitionId()} has left the finite numbers after {trainer.steps} steps")
        fixed = np.rint(trainer.flat.astype(np.float64) * FIXED).astype(np.int64) * trainer.tokens
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(fixed)), pa.int32()), pa.array(fixed), pa.array(np.full(len(fixed), trainer.tokens))], names=["at", "value", "tokens"])

    return run


def _score(rank_file: str, pattern: str, tree: lm.Tree, weights: np.ndarray, hot: dict[bytes, int], total: int, kinds: int, ends: int):
    """Rows of documents (word null) with the model's score and the base over hot words, and of their other words."""
    model, least = lm.views(weights, tree), total + SMOOTH * (kinds + 1)
    table = lm.inputs(model, np.arange(tree.size + 1))
    logs = {w: math.log10((n + SMOOTH) / least) for w, n in hot.items()}
    end = math.log10((ends + SMOOTH) / least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = word_ranks(rank_file, pattern, tree, logs), TaskContext.get().partitionId() << 40
        lm.keep_memory()
        for b in batches:
            docs: list[tuple] = []
            rest: list[list] = [[], [], []]

            def texts() -> Iterator[tuple[int, np.ndarray]]:
                for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):  # noqa: B023
                    uid, words = number + len(docs), _lower(text).split()  # noqa: B023
                    numbers = known.numbers(words)
                    share = known.share(numbers)
                    rare = np.isnan(share)
                    which, times = np.unique(numbers[rare], return_counts=True)
                    for column, values in zip(rest, ([uid] * len(which), [known.words[j] for j in which.tolist()], times.tolist()), strict=True):  # noqa: B023
                        column += values
                    docs.append((uid, i, held_out(i), len(words) + 1, int(len(words) - rare.sum()) + (ends > 0), float(share[~rare].sum()) + end))  # noqa: B023
                    yield len(docs) - 1, known.ranks(numbers)  # noqa: B023

            scores = [0.0] * b.num_rows
            for x, y, alone, parts in lm.blocks(tree, texts(), SCORED):
                by_block = lm.token_scores(model, x, y, alone, tree, table).sum(1, dtype=np.float64)
                for at, first, stop in parts:
                    scores[at] += float(by_block[first:stop].sum()) / math.log(10)
            number += len(docs)
            kinds_of = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64())
            of_docs = [pa.array([d[k] for d in docs], kind) for k, kind in enumerate(kinds_of)]
            n, m = len(docs), len(rest[0])
            both = [(of_docs[0], pa.array(rest[0], pa.int64())), (pa.nulls(n, pa.binary()), pa.array(rest[1], pa.binary())), (pa.nulls(n, pa.int64()), pa.array(rest[2], pa.int64()))]
            both += [(c, pa.nulls(m, c.type)) for c in (*of_docs[1:], pa.array(scores, pa.float64()))]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in both], names=["uid", "word", "times", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    return run


def _trained(rank_file: str, pattern: str, now: Broadcast):
    return lambda batches: _train(rank_file, pattern, *now.value)(batches)


@functools.cache
def vocabulary_size(rank_file: str, pattern: str) -> int:
    return max(codec(rank_file, pattern).raw) + 1


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n) over all texts that are learnt from; the end of a text is the null word."""
    return cut(learnt(rows).mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def trained(rows: DataFrame, counts: DataFrame, rank_file: str, pattern: str) -> tuple[lm.Tree, np.ndarray]:
    """The tree over the ids' counts, one of each id of a fixed vocabulary, and the model's weights, averaged over tasks."""
    size = vocabulary_size(rank_file, pattern)
    ids = counts.where("word is not null").mapInArrow(_count_ids(rank_file, pattern, size), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    of_id = np.zeros(size, np.int64)
    of_id[ids["id"].to_numpy()] = ids["n"].to_numpy()
    tree = lm.Tree(of_id)
    weights = lm.start(tree)
    for turn in range(ROUNDS):
        now = rows.sparkSession.sparkContext.broadcast((tree, weights))
        tasks = learnt(rows, turn).mapInArrow(_trained(rank_file, pattern, now), "at int, value long, tokens long")
        mean = tasks.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("double").alias("value"), F.sum("tokens").alias("tokens")).toPandas().sort_values("at")
        if len(mean) and mean["tokens"].iloc[0]:
            weights = (mean["value"] / mean["tokens"] / FIXED).to_numpy(np.float32)
    return tree, weights


def score(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    small_batches(spark, 128)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Words: distributed, with the totals and the most frequent.
    counts = word_counts(rows)
    total, kinds, ends = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("word").isNull(), F.col("n")))).first()
    total, ends = total or 0, ends or 0
    steps = counts.where("word is not null").groupBy(F.floor(F.log2("n") * 8).alias("step")).count().orderBy(F.desc("step")).collect()
    floor, room = math.inf, HOT_WORDS
    for step in steps:  # by eighths of a doubling, as many steps as there is room for
        room -= step["count"]
        if room < 0:
            break
        floor = step["step"]
    hot_rows = counts.where(F.col("word").isNotNull() & (F.octet_length("word") <= HOT_BYTES) & (F.floor(F.log2("n") * 8) >= (floor if floor < math.inf else 10**6)))
    hot = {bytes(w): n for w, n in hot_rows.toLocalIterator(prefetchPartitions=False)}
    tree, weights = trained(rows, counts, rank_file, pattern)
    shared = spark.sparkContext.broadcast((tree, weights, hot))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _score(rank_file, pattern, *shared.value, total, kinds, ends)(batches)

    kind = "uid long, word binary, times long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
    all_rows = cut(rows.mapInArrow(scored, kind), "scored")
    least = total + SMOOTH * (kinds + 1)
    rest = all_rows.where("word is not null").select("uid", "word", "times").join(counts, "word", "left")
    n = F.coalesce("n", F.lit(0))
    rest = rest.groupBy("uid").agg(F.sum(F.col("times") * F.log10((n + SMOOTH) / least)).alias("more"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"))
    out = all_rows.where("word is null").drop("word", "times").join(rest, "uid", "left")
    return out.select(
        F.col("doc_id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )

"""Quality rules with risk-controlled thresholds.

Base rules look at a document alone. The method adds cutoffs on shares (symbols, repeated lines, repeated words,
characters a word, capitals), one set a stratum (language). A cutoff is used only if labelled holdout documents show
that it rejects few good ones: for each stratum, measure and grid value the number of good documents above the value
is compared with the exact binomial distribution under the allowed rate, and the hypothesis 'it rejects more than
its share of the good' must fall at level delta divided by the number of all such tests (Bonferroni). alpha is the rate that a
stratum may lose in all; each measure may lose alpha divided by the number of measures. So with probability
1 - delta the cutoffs in use reject, in every stratum, at most alpha of the good documents together. Among the certified cutoffs the one that rejects most bad documents is taken, a
good one counting COST times; where none is certified, as in a stratum with few labels, nothing is rejected.

All labelled rows are counted, natively and by bins of the fixed grid; what is looked at together is one row for each
stratum, measure and bin.

Cases: null text has no words and fails the base rules; a null stratum is one of its own; documents without a label
don't count in the holdout, a repeated label counts by its worst; an empty table or no labels give no cutoffs;
columns whose names clash with the measures are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, cut, small_batches

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
#: Fixed grids of the cutoffs; a document above the cutoff is rejected.
GRID = {
    "symbol_share": [0.02 * i for i in range(1, 51)],
    "dup_line_share": [0.02 * i for i in range(1, 50)],
    "repeat_share": [0.02 * i for i in range(1, 50)],
    "chars_per_word": [4 + 0.25 * i for i in range(1, 50)],
    "capital_share": [0.02 * i for i in range(1, 50)],
}
ALPHA, DELTA, COST = 0.05, 0.05, 50
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
CAPITALS = bytes(range(65, 91))


def measure(text: str) -> tuple[int, ...]:
    """COUNTS of one text."""
    raw = text.encode()
    words = raw.split()
    joined = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(seen := set(windows)) < len(windows):
        many = {w for w, n in Counter(windows).items() if n > 1}
        at = -1  # last word counted
        for i, w in enumerate(windows):
            if w in many:
                repeated += i + 2 - max(at, i - 1)
                at = i + 2
    del seen
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return len(words), joined, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), capitals


def measured(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all by default) with COUNTS."""
    small_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in COUNTS]
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    names = [*keep, *COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [measure(x or "") for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array([g[i] for g in got], pa.int64()) for i in range(len(COUNTS)))], names=names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *(T.StructField(c, T.LongType()) for c in COUNTS)]))


def shares() -> dict[str, Column]:
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {
        "symbol_share": ratio("n_symbols", "n_words"),
        "dup_line_share": ratio("n_dup_lines", "n_lines"),
        "repeat_share": ratio("n_repeat_words", "n_words"),
        "chars_per_word": ratio("word_chars", "n_words"),
        "capital_share": ratio("n_capitals", "word_chars"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(at most k of n), exactly, by the terms' logarithms."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def choose(good: list[int], bad: list[int], grid: list[float], alpha: float, level: float, cost: float) -> float | None:
    """The certified cutoff of most use. good and bad: documents by bin, bin i having values above i grid values."""
    n, best, gain = sum(good), None, 0.0
    for j in range(len(grid) - 1, -1, -1):
        lost, caught = sum(good[j + 1 :]), sum(bad[j + 1 :])
        if not n or lost > alpha * n or binomial_cdf(lost, n, alpha) > level:
            continue
        if (now := caught - cost * lost) > gain:
            best, gain = grid[j], now
    return best


def calibrate(rows: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", alpha: float = ALPHA, delta: float = DELTA, cost: float = COST) -> DataFrame:
    """(stratum, measure names...): the cutoffs, null where none is certified. rows: measured documents; labels: id, quality.

    alpha is the allowed rate of a stratum, all measures together.
    """
    marks = labels.groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").alias("quality")).where("quality is not null")
    of = shares()
    above = lambda m: F.size(F.filter(F.array(*map(F.lit, GRID[m])), lambda x: of[m] > x))
    bins = F.array(*(F.struct(F.lit(m).alias("measure"), above(m).alias("bin")) for m in GRID))
    binned = rows.join(marks, F.col(id_col) == F.col("_id")).select(F.col(stratum).cast("string").alias("stratum"), "quality", F.explode(bins).alias("b"))
    counts = binned.groupBy("stratum", "b.measure", "b.bin").agg(F.count_if(F.col("quality") > 0).alias("good"), F.count_if(F.col("quality") <= 0).alias("bad"))
    counts = cut(counts, "bins")
    tests = max(1, counts.select("stratum").distinct().count() * sum(map(len, GRID.values())))

    def certify(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out = {"stratum": None if pd.isna(key[0]) else key[0]}
        for m, grid in GRID.items():
            own = group[group["measure"] == m]
            good, bad = ([0] * (len(grid) + 1) for _ in range(2))
            for i, g, b in zip(own["bin"], own["good"], own["bad"], strict=True):
                good[i], bad[i] = int(g), int(b)
            out[m] = choose(good, bad, grid, alpha / len(GRID), delta / tests, cost)
        return pd.DataFrame([out]).astype({m: "float64" for m in GRID})

    return cut(counts.groupBy("stratum").applyInPandas(certify, "stratum string, " + ", ".join(f"{m} double" for m in GRID)), "cutoffs")


def judged(rows: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Measured rows with base_failed, rejected_by (the measures above their cutoffs) and kept."""
    table = cutoffs.select(F.col("stratum").alias("_stratum"), *(F.col(m).alias(f"_{m}") for m in GRID))
    over = F.filter(F.array(*(F.when(c > F.col(f"_{m}"), F.lit(m)) for m, c in shares().items())), lambda x: x.isNotNull())
    out = rows.join(table, F.col(stratum).cast("string").eqNullSafe(F.col("_stratum")), "left")
    out = out.withColumn("base_failed", base_failed()).withColumn("rejected_by", over)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("_stratum", *(f"_{m}" for m in GRID))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, without what the rules reject. Texts are measured once: rows and measures are written together."""
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}  # the measures' names are free then
    known = docs.select(F.col("text"), F.col("doc_id"), F.col("lang"), *(F.col(c).alias(n) for c, n in names.items()))
    rows = cut(measured(known, keep=["doc_id", "lang", *names.values()]), "measured")
    kept = judged(rows, calibrate(rows, labels)).where("kept")
    return kept.select(*(F.col(n).alias(c) for c, n in names.items()))

"""Bloom filters of 64-bit hashes, built by the cluster and small enough for every task.

A filter has at most the bits that its caller allows, whatever the number of keys: with more keys more others pass, and the join that
follows drops them. A key sets three bits of one 64-bit word; keys have to be well mixed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 32 MB.
MOST_BITS, BITS_PER_KEY = 1 << 28, 16


def bits_for(n: int, most: int = MOST_BITS) -> int:
    """Bits of a filter of n keys."""
    return min(most, 1 << max(12, (n * BITS_PER_KEY - 1).bit_length()))


def _bit_of(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of each key, and its three bits in it."""
    one, low = np.uint64(1), np.uint64(63)
    word = (h >> np.uint64(40)) & np.uint64(bits // 64 - 1)
    return word.astype(np.int64), (one << (h & low)) | (one << (h >> np.uint64(6) & low)) | (one << (h >> np.uint64(12) & low))


def contains(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter has these keys: true for all that it was built of, and seldom for others."""
    at, mask = _bit_of(h, len(words) * 64)
    return words[at] & mask == mask


def _words_of(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, mask = _bit_of(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(mask.view(np.int64))], names=["at", "mask"])

    return run


def build(keys: DataFrame, bits: int) -> np.ndarray:
    """The words of a filter of keys, a table of one long column without nulls; at most bits / 64 rows come to the driver."""
    if bits & (bits - 1) or bits < 64:
        raise ValueError("bits must be a power of two, 64 or more")
    made = keys.mapInArrow(_words_of(bits), "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[made["at"].to_numpy()] = made["mask"].to_numpy().view(np.uint64)
    return words

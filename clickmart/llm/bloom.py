"""Bloom filters of bounded size, for semi-joins that are checked exactly later on.

What a filter lets through by mistake costs work and nothing else, so its size may be bounded whatever it holds: with more
numbers than fit it lets more through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickmart.llm.substring_dedup import ODD, mix

FILTER_MB = 16
PROBES = 3


class Filter:
    """A Bloom filter of 64-bit numbers."""

    def __init__(self, words: np.ndarray):
        self.words = words  # 64 bits each, a power of two of them

    @staticmethod
    def positions(numbers: np.ndarray, size: int) -> np.ndarray:
        shift = np.uint64(64 - (size * 64).bit_length() + 1)
        salts = (np.arange(1, 2 * PROBES, 2, dtype=np.uint64) * ODD)[:, None]
        return mix(numbers.view(np.uint64) * salts) >> shift

    def holds(self, numbers: np.ndarray) -> np.ndarray:
        at = self.positions(numbers, len(self.words))
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)


def filter_of(frequent: DataFrame, filter_mb: int = FILTER_MB) -> Filter:
    """A filter of the column id: 16 bits for each and no more than ``filter_mb``; its bits are put together on executors."""
    size = 1 << min(max(frequent.count() // 4, 1).bit_length(), (filter_mb << 17).bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(Filter.positions(batch.column(0).to_numpy(), size))
            words, first = np.unique(at >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            columns = [pa.array(words.astype(np.int32)), pa.array(bits.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "bits"])

    found = frequent.select("id").mapInArrow(run, "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = found.toArrow()
    words = np.zeros(size, np.uint64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return Filter(words)

"""Benchmark decontamination by greedy string tiling.

Words are parted by ASCII white space and compared with A-Z lower-cased and punctuation at their ends ignored. A
document that shares a seed, a run of ``least`` words, with a benchmark item is tiled against it: the longest run that
both have and no tile covers becomes a tile in both, again and again, down to runs of ``least`` words. The longest length
is found by Karp-Rabin hashes over the uncovered words, run for halves of the possible lengths. The share of the item's
words that tiles cover does not depend on the order of its passages; from ``threshold`` on the document is contaminated.

The benchmark is the query set. It goes to the tasks in blocks of bounded size, each of which meets all documents, so no
row of the documents is shuffled. A document's words meet a table of the block's seeds; only documents with seeds are
tiled.

Edge cases: NULL and empty texts share nothing; an item of fewer words than a seed can't be tiled: with ``short``
it is one seed of its whole length and matches only a text that holds it whole, without, it matches nothing; equal items are each reported; equally long tiles are laid from the item's start; rows that repeat a doc_id or item_id
are each looked at; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from clickmart.llm.common import flat_schema, map_rows, text_at, texts_of, utf8

LEAST = 5
THRESHOLD = 0.8
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words(text: bytes) -> list[bytes]:
    """Lower-cased words without punctuation at their ends; words of nothing else are left out."""
    return [w for word in text.lower().split() if (w := word.strip(EDGES))]


def powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[:1] = 1
    return np.multiply.accumulate(factors)


class Rolling:
    """Karp-Rabin hashes of all windows of any length, modulo 2^64."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * powers(BASE, n), out=self.sums[1:])
        self.back = powers(pow(BASE, -1, 1 << 64), n)

    def windows(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:-length]) * self.back[:n]


def open_windows(covered: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows in which nothing is covered."""
    if len(covered) < length:
        return np.zeros(0, np.int64)
    sums = np.concatenate([[0], np.cumsum(covered)])
    return np.flatnonzero(sums[length:] == sums[:-length])


def tiles(item: np.ndarray, text: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start in the item, start in the text, length) of the tiles of two arrays of word codes; code 0 matches nothing."""
    rolling = Rolling(item), Rolling(text)
    covered = np.zeros(len(item), bool), text == 0
    found, longest = [], min(len(item), len(text))

    def common(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of open windows that both sides have, and their hashes."""
        a, b = (open_windows(c, length) for c in covered)
        ha, hb = rolling[0].windows(length)[a], rolling[1].windows(length)[b]
        ina, inb = np.isin(ha, hb), np.isin(hb, ha)
        return a[ina], ha[ina], b[inb], hb[inb]

    while longest >= least:
        low, high = least - 1, longest  # the longest length that both still have; runs of a common run are common
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(common(middle)[0]) else (low, middle - 1)
        longest = low
        if longest < least:
            break
        a, ha, b, hb = common(longest)
        places: dict[int, list[int]] = defaultdict(list)
        for start, h in zip(b[::-1].tolist(), hb[::-1].tolist(), strict=True):
            places[h].append(start)  # the first is popped first
        before = len(found)
        for start, h in zip(a.tolist(), ha.tolist(), strict=True):
            if covered[0][start : start + longest].any():
                continue
            while places[h]:
                at = places[h].pop()
                same = (item[start : start + longest] == text[at : at + longest]).all()
                if same and not covered[1][at : at + longest].any():
                    covered[0][start : start + longest] = True
                    covered[1][at : at + longest] = True
                    found.append((start, at, longest))
                    break
        if len(found) == before:
            longest -= 1  # only hashes were equal
    return sorted(found)


class Block:
    """Items of the benchmark made ready for the tasks."""

    def __init__(self, items: list[tuple[int | None, bytes]], least: int, short: bool = False):
        self.least = least
        split = [(item_id, words(text)) for item_id, text in items]
        self.codes = {w: xxhash.xxh64_intdigest(w) or 1 for _, ws in split for w in ws}
        self.items = [(item_id, np.array([self.codes[w] for w in ws], np.uint64)) for item_id, ws in split]
        seeds = [Rolling(codes).windows(least) if len(codes) >= least else np.zeros(0, np.uint64) for _, codes in self.items]
        hashes = np.concatenate([np.zeros(0, np.uint64), *seeds])
        of = np.repeat(np.arange(len(seeds)), list(map(len, seeds)))
        order = np.argsort(hashes, kind="stable")
        self.seeds, self.of = hashes[order], of[order]
        self.short: dict[int, dict[int, list[int]]] = {}
        for i, (_, codes) in enumerate(self.items):
            if short and 0 < len(codes) < least:
                whole = int(Rolling(codes).windows(len(codes))[0])
                self.short.setdefault(len(codes), {}).setdefault(whole, []).append(i)

    def matches(self, text: bytes) -> Iterator[tuple[int | None, float, list[tuple[int, int, int]]]]:
        """(item, share of its words covered, tiles) for each item with a seed in the text."""
        codes = np.array([self.codes.get(w, 0) for w in words(text)], np.uint64)
        for n, wholes in self.short.items():
            starts = open_windows(codes == 0, n)
            if len(starts):
                hashes = Rolling(codes).windows(n)[starts]
                held = np.isin(hashes, np.array(list(wholes), np.uint64))
                first = dict(zip(hashes[held][::-1].tolist(), starts[held][::-1].tolist(), strict=True))
                for i, at in sorted((i, at) for h, at in first.items() for i in wholes[h]):
                    if (codes[at : at + n] == self.items[i][1]).all():
                        yield self.items[i][0], 1.0, [(0, at, n)]
        # Only runs of known words can hold a seed.
        starts = open_windows(codes == 0, self.least)
        if not len(starts) or not len(self.seeds):
            return
        hashes = Rolling(codes).windows(self.least)[starts]
        left, right = np.searchsorted(self.seeds, hashes, "left"), np.searchsorted(self.seeds, hashes, "right")
        near = np.zeros(len(codes) + 1, np.int64)
        hit = starts[right > left]
        np.add.at(near, hit, 1)
        np.add.at(near, hit + self.least, -1)
        runs = np.unique(np.stack([left, right], axis=1)[right > left], axis=0)
        owners = sorted({int(i) for a, b in runs for i in self.of[a:b]})
        # Words outside all seeds are in no tile: they shrink to one gap each.
        inside = np.cumsum(near)[:-1] > 0
        held = inside | np.concatenate([[False], inside[:-1]])
        places = np.flatnonzero(held)
        part = np.where(inside, codes, np.uint64(0))[held]
        for i in owners:
            item_id, item = self.items[i]
            found = [(a, int(places[b]), n) for a, b, n in tiles(item, part, self.least)]
            yield item_id, sum(n for _, _, n in found) / len(item), found


def blocks(benchmark: DataFrame, least: int, block_bytes: int, short: bool = False) -> Iterator[Block]:
    """The benchmark's items in blocks of about ``block_bytes`` of text; the driver holds one at a time."""
    items, size = [], 0
    both = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    for row in both.toLocalIterator():
        items.append((row["item_id"], (row["text"] or "").encode()))
        size += len(items[-1][1])
        if size >= block_bytes:
            yield Block(items, least, short)
            items, size = [], 0
    if items:
        yield Block(items, least, short)


TILE = flat_schema("item_start integer, doc_start integer, length integer")
SCHEMA = flat_schema("doc_id long, item_id long, coverage double").add("tiles", ArrayType(TILE))


def contamination(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: int = LEAST, block_bytes: int = 16 << 20,
    short: bool = False,
) -> DataFrame:
    """One row for each document and item of which it covers ``threshold`` or more: coverage and the tiles, in words."""
    spark, found = docs.sparkSession, None
    for block in blocks(benchmark, least, block_bytes, short):
        shared = spark.sparkContext.broadcast(block)

        def run(ids: pa.Array, texts: pa.Array, shared=shared) -> Iterator[tuple]:
            for doc_id, text in zip(ids.to_pylist(), utf8(texts), strict=True):
                for item_id, coverage, laid in shared.value.matches(text):
                    if coverage >= threshold:
                        yield doc_id, item_id, coverage, laid

        rows = map_rows(texts_of(docs), run, SCHEMA)
        found = rows if found is None else found.unionByName(rows)
    return spark.createDataFrame([], SCHEMA) if found is None else found


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: int = LEAST, block_bytes: int = 16 << 20,
    short: bool = False,
) -> DataFrame:
    """The rows of ``docs`` that cover less than ``threshold`` of every item, with all their columns."""
    at = text_at(docs)
    for block in blocks(benchmark, least, block_bytes, short):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [all(c < threshold for _, c, _ in shared.value.matches(text)) for text in utf8(batch.column(at))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

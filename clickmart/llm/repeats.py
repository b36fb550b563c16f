"""Repeated text: similar lines by MinHash banding, and every exact run of words that two documents share.

Two things are repeated. Whole lines whose class (``substring_dedup``: tuned bands, exact Jaccard similarity of five-word
shingles, components) two documents hold, alone or in a sequence, from ``min_words`` on: the whole line, edited words
included. And every run of ``min_words`` words or more that two documents share, wherever it stands in a line and however
it is broken into lines.

Runs are found without borders. Of each window of ``min_words`` words the least hash of its ``SEED``-word grams is a seed,
so the same window has the same seed in every document. Windows are hashed only where a seed is in two documents, and those
that two documents hold are repeated: a run is as long as it really is. The seeds go to the tasks as a Bloom filter of
bounded size; the hashes of windows are joined with those that two documents really hold, so a filter that is too full
costs work only. Only equal hashes are trusted (64 bits).

Repeated text stays in the smallest doc_id that holds it and goes elsewhere. A span is as many repeated words side by side.

Edge cases: as in ``substring_dedup``; white space and lines do not matter to runs; a run repeated within one document only
is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickmart.llm import substring_dedup as sub
from clickmart.llm.bloom import filter_of
from clickmart.llm.common import discard, settle, texts_of
from clickmart.llm.graph import components
from clickmart.llm.words import Words

SEED = 8
FILTER_MB = 32


class Windows:
    """The windows of ``n`` words of some texts: whose they are, their start, seed and hash."""

    def __init__(self, texts: list[bytes], n: int):
        words = Words(texts)
        hashes, sizes = words.hashes, words.sizes
        begins = np.cumsum(sizes) - sizes
        count = np.maximum(sizes - n + 1, 0)
        self.of = np.repeat(np.arange(len(texts)), count)
        self.start = np.arange(len(self.of)) - np.repeat(np.cumsum(count) - count, count)
        self.at = self.start + np.repeat(begins, count)
        width = min(SEED, n)
        if not len(self.of):
            self.seeds = np.zeros(0, np.int64)
        else:
            self.seeds = least_of(grams_of(hashes, width), n - width + 1)[self.at].view(np.int64)
        self.words, self.n = hashes, n

    def keys(self, chosen: np.ndarray) -> np.ndarray:
        return grams_of(self.words, self.n)[self.at[chosen]].view(np.int64)


def least_of(values: np.ndarray, n: int) -> np.ndarray:
    """The least of the ``n`` values from each place on, by spans that double."""
    span = 1
    while 2 * span <= n:
        values, span = np.minimum(values[:-span], values[span:]), 2 * span
    return np.minimum(values[: len(values) - (n - span)], values[n - span :])


def grams_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the ``n`` words from each place on."""
    size = max(len(hashes) - n + 1, 0)
    found = np.zeros(size, np.uint64)
    for k in range(n):
        found = found * sub.ODD + hashes[k : k + size]
    return sub.mix(found)


def seeds(docs: DataFrame, n: int) -> DataFrame:
    """doc_id and seed, once for each group of texts that a task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in sub.in_groups(batches):
            w = Windows(texts, n)
            change = (w.seeds[1:] != w.seeds[:-1]) | (w.of[1:] != w.of[:-1])
            first = np.flatnonzero(np.append(np.ones(min(1, len(w.of)), bool), change))
            of = np.array(ids, np.int64)[w.of[first]]
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(w.seeds[first])], names=["doc_id", "seed"])

    return texts_of(docs).where("doc_id is not null").mapInArrow(run, "doc_id bigint, seed bigint")


def windows(docs: DataFrame, n: int, seeds: Broadcast) -> DataFrame:
    """doc_id, start and key of the windows whose seed the filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in sub.in_groups(batches):
            w = Windows(texts, n)
            chosen = np.flatnonzero(seeds.value.holds(w.seeds))
            found = w.keys(chosen)
            for a in range(0, len(chosen), 65_536):
                some = chosen[a : a + 65_536]
                columns = [np.array(ids, np.int64)[w.of[some]], w.start[some], found[a : a + 65_536]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "start", "key"])

    known = texts_of(docs).where("doc_id is not null")
    return known.mapInArrow(run, "doc_id bigint, start bigint, key bigint")


def shared(rows: DataFrame, key: str) -> DataFrame:
    """The keys that two documents hold, as id, and the smallest doc_id that does."""
    ends = rows.groupBy(F.col(key).alias("id")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return ends.where("first < last").select("id", "first")


def runs(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, start, n_words and first of the windows of ``n`` words that two documents share."""
    context = docs.sparkSession.sparkContext
    found = settle(shared(seeds(docs, n), "seed").select("id"))
    by_seed = context.broadcast(filter_of(found, FILTER_MB))
    discard(found)
    held = windows(docs, n, by_seed)  # nearly all whose seed two documents hold are in two themselves
    keys = settle(shared(held, "key"))
    whole = held.join(keys, held["key"] == keys["id"])
    return whole.select("doc_id", "start", F.lit(n).cast("bigint").alias("n_words"), "first")


def repeats(
    docs: DataFrame, similar: float = sub.SIMILAR, min_words: int = sub.MIN_WORDS, recall: float = 0.98
) -> DataFrame:
    """doc_id, start, n_words and first (the smallest doc_id) of all repeated text; places may overlap."""
    cut = sub.passages(docs, similar, min_words, recall, lines=True)
    return cut.select("doc_id", "start", "n_words", "first").unionByName(runs(docs, min_words))


def spans(found: DataFrame) -> DataFrame:
    """doc_id, all (repeated) and gone, both arrays of (start, n_words): places that touch or overlap are one; firsts: the
    smaller documents that hold any of it."""
    span = "array<struct<start:bigint,n_words:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # of the last document, which may go on
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(rows[0]):
                continue
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if last or (held and held[0][0][0] != rows[0][0]):
                yield spans_of(*map(np.concatenate, zip(*held, [r[:last] for r in rows], strict=True)))
                held = []
            held.append([r[last:] for r in rows])
        if held:
            yield spans_of(*map(np.concatenate, zip(*held, strict=True)))

    each = found.select("doc_id", "start", "n_words", "first").repartition("doc_id").sortWithinPartitions("doc_id")
    return each.mapInArrow(run, f"doc_id bigint, all {span}, gone {span}, firsts array<bigint>")


def spans_of(doc_id: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    """The spans of whole documents."""
    ids, of = np.unique(doc_id, return_inverse=True)
    goes = first < doc_id
    pairs = np.unique(np.stack([of[goes], first[goes]], axis=1), axis=0) if goes.any() else np.zeros((0, 2), np.int64)
    firsts = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs[:, 0], np.arange(len(ids) + 1)), pa.int32()), pa.array(pairs[:, 1]))
    columns = [pa.array(ids), joined(of, start, size, len(ids)), joined(of[goes], start[goes], size[goes], len(ids)), firsts]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "all", "gone", "firsts"])


def joined(of: np.ndarray, start: np.ndarray, size: np.ndarray, n: int) -> pa.ListArray:
    """Places that touch or overlap, as one, for each of ``n`` documents."""
    apart = int((start + size).max(initial=0)) + 1  # documents follow each other, none touches the next
    order = np.argsort(of * apart + start, kind="stable")
    of, begins = of[order], start[order]
    base = of * apart
    ends = np.maximum.accumulate(base + begins + size[order])
    new = np.flatnonzero(np.append(True, (base + begins)[1:] > ends[:-1])[: len(of)])
    last = np.append(new[1:], len(of))[: len(new)] - 1
    found = [pa.array(begins[new]), pa.array(ends[last] - base[last] - begins[new])]
    offsets = np.searchsorted(of[new], np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(found, names=["start", "n_words"]))


def report(docs: DataFrame, **options: float) -> DataFrame:
    """For each row of ``docs`` its class_id, the smallest doc_id that repeated text leads to, its spans, and what goes."""
    found = settle(spans(repeats(docs, **options)))
    words = F.aggregate("gone", F.lit(0).cast("bigint"), lambda total, span: total + span["n_words"])
    counts = found.select(
        "doc_id", F.size("all").alias("n_repeated"), F.size("gone").alias("n_removed"), words.alias("words_removed")
    )
    edges = found.select(F.col("doc_id").alias("u"), F.explode("firsts").alias("v"))
    reached = components(edges)
    whole = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).join(counts, "doc_id", "left")
    whole = whole.join(reached, whole["doc_id"] == reached["node"], "left")
    numbers = (F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in ("n_repeated", "n_removed", "words_removed"))
    return whole.select("doc_id", F.coalesce("component", "doc_id").alias("class_id"), *numbers)


def drop_repeats(docs: DataFrame, **options: float) -> DataFrame:
    """``docs`` without the words that go; the words of a line that stay are joined by a space where one is cut."""
    gone = spans(repeats(docs, **options)).select("doc_id", F.explode("gone").alias("g"))
    return sub.cut_out(docs, gone.select("doc_id", "g.start", "g.n_words"))

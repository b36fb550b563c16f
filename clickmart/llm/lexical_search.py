"""Ranked lexical search by hashed max-sketches.

Terms are runs of ASCII letters and digits and of characters beyond ASCII; A-Z is lower-cased. A term's impact in a
document follows from its count there and the document's length, and a document's score for a query is the sum of weight
times impact over the query's terms, repeats included; weights fall with the number of documents that hold the term. All
numbers but the logarithm are whole.

A document's sketch has one place for each hash of a term, with the largest impact of the terms that fall there. A query
looks its terms' places up in the sketches of a batch of documents, all queries at once: the sum is never less than the
score. Documents are scored exactly in the order of that bound until it can't beat the last of the best found so far.
Terms whose hashes collide only raise a bound.

The queries go to the tasks in blocks of bounded size, each of which meets all documents: once to count documents, terms
and the documents that hold each query term, once to search. Texts are read where they lie. A task keeps the best ``top``
of each query, so few rows are shuffled; they are ranked within parts of a query first.

Edge cases: NULL and empty texts have no terms, are not counted and are never found; a query without terms, or whose
terms are nowhere, finds nothing; repeated terms of a query count each time; rows that repeat a doc_id or item_id are
each a document or query; of equal scores the smaller doc_id comes first, a missing one last; very long texts are a batch
of their own; no other columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickmart.llm.common import flat_schema, texts_of, utf8

TOP = 10
COORDINATE_BITS = 12
BATCH_TERMS = 300_000
BLOCK_ITEMS = 512
CELLS = 4 << 20  # numbers held at once when bounds are added up
HASH_BITS = 44  # of a term in the sort key; the rest numbers the documents of a batch
UNIT = 10**9
#: Every byte that is in no term, as a space; letters in lower case.
TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


class Hashes(dict):
    """Hashes of terms; forgets all when it has grown."""

    def __missing__(self, term: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[term] = found = xxhash.xxh64_intdigest(term) >> (64 - HASH_BITS)
        return found


class Block:
    """Some queries: their ids and how often each has which term."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        self.ids = [item_id for item_id, _ in items]
        self.terms = [Counter(terms(text)) for _, text in items]
        self.vocabulary = {t: i for i, t in enumerate(sorted(set().union(*self.terms)))}


def blocks(queries: DataFrame, block_items: int, block_bytes: int) -> Iterator[Block]:
    """The queries in blocks of bounded number and text; the driver holds one at a time."""
    items, size = [], 0
    both = queries.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    for row in both.toLocalIterator():
        items.append((row["item_id"], (row["text"] or "").encode()))
        size += len(items[-1][1])
        if len(items) >= block_items or size >= block_bytes:
            yield Block(items)
            items, size = [], 0
    if items:
        yield Block(items)


class Statistics:
    """What all documents say: how many have terms, all their terms, and how many hold each term of a block."""

    def __init__(self, docs: DataFrame, block: Block):
        shared = docs.sparkSession.sparkContext.broadcast(block.vocabulary)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, held, counted, length = shared.value.get, Counter(), 0, 0
            for batch in batches:
                for text in utf8(batch.column(0)):
                    if found := terms(text):
                        counted += 1
                        length += len(found)
                        held.update(set(map(number, set(found))))
            del held[None]
            rows = {-1: counted, -2: length, **held}
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(rows), pa.int32()), pa.array(list(rows.values()), pa.int64())], names=["term", "n"]
            )

        counts = texts_of(docs).select("text").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n"))
        found = dict(map(tuple, counts.collect()))  # no more than the block has terms
        shared.unpersist()
        self.documents, self.length = found.get(-1, 0), found.get(-2, 0)
        self.weights = {
            t: math.floor(1000 * math.log((2 * self.documents + 2) / (2 * found[i] + 1)))
            for t, i in block.vocabulary.items()
            if i in found
        }


class Searcher:
    """A block's queries ready for the tasks, and the best documents that a task has found for each."""

    def __init__(self, block: Block, stats: Statistics, top: int, bits: int):
        self.documents, self.length, self.top, self.bits = stats.documents, stats.length, top, bits
        self.queries = [
            [(t, times * stats.weights[t]) for t, times in query.items() if stats.weights.get(t)] for query in block.terms
        ]

    def start(self) -> None:
        self.hashes = Hashes()
        weights = np.zeros((1 << self.bits, len(self.queries)), np.int64)
        for i, query in enumerate(self.queries):
            for t, weight in query:
                weights[self.hashes[t] >> (HASH_BITS - self.bits), i] += weight
        self.places = np.flatnonzero(weights.any(axis=1))  # no query looks anywhere else
        self.place_of = np.full(1 << self.bits, -1, np.int64)
        self.place_of[self.places] = np.arange(len(self.places))
        self.weights = weights[self.places]
        # (-score, whether it has no doc_id, doc_id), best first
        self.best: list[list[tuple[int, bool, int]]] = [[] for _ in self.queries]

    def sketches(self, sizes: np.ndarray, hashes: np.ndarray, loads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, place and largest impact for every place of a document that a query looks at."""
        owner = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes) << np.uint64(HASH_BITS)
        keys = np.sort(owner | hashes)
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        counts = np.diff(np.append(starts, len(keys)))
        of = (keys[starts] >> np.uint64(HASH_BITS)).astype(np.int64)
        impacts = UNIT * counts // (1000 * counts + 8 * loads[of])
        cells = keys[starts] >> np.uint64(HASH_BITS - self.bits)  # document and place, in order
        first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
        place = self.place_of[(cells[first] & np.uint64((1 << self.bits) - 1)).astype(np.int64)]
        seen = place >= 0
        return of[first][seen], place[seen], np.maximum.reduceat(impacts, first)[seen]

    def bounds(self, n: int, of: np.ndarray, place: np.ndarray, impact: np.ndarray) -> np.ndarray:
        """For each document and query the sum of weight times impact over the places."""
        found = np.zeros((n, len(self.queries)), np.int64)
        step = max(1, CELLS // max(1, len(self.queries)))
        for a in range(0, len(of), step):
            some = of[a : a + step]
            first = np.flatnonzero(np.append(True, some[1:] != some[:-1]))
            parts = self.weights[place[a : a + step]] * impact[a : a + step, None]
            found[some[first]] += np.add.reduceat(parts, first, axis=0)
        return found

    def take(self, ids: list[int | None], found: list[list[bytes]]) -> None:
        """Look through a batch of documents that all have terms."""
        sizes = np.array([len(words) for words in found], np.int64)
        loads = 25 + 75 * sizes * self.documents // self.length
        hashes = np.fromiter((self.hashes[t] for words in found for t in words), np.uint64, int(sizes.sum()))
        bounds = self.bounds(len(found), *self.sketches(sizes, hashes, loads))
        missing = np.array([i is None for i in ids])
        numbers = np.array([i or 0 for i in ids], np.int64)
        counts: dict[int, Counter] = {}
        least = np.array([-b[-1][0] if len(b) == self.top else 1 for b in self.best], np.int64)
        for q in np.flatnonzero((bounds >= least).any(axis=0)).tolist():
            best, query = self.best[q], self.queries[q]
            near = np.flatnonzero(bounds[:, q] >= least[q])
            for d in near[np.lexsort((numbers[near], missing[near], -bounds[near, q]))].tolist():
                place = bool(missing[d]), int(numbers[d])
                if len(best) == self.top and (-int(bounds[d, q]), *place) >= best[-1]:
                    break
                if d not in counts:
                    counts[d] = Counter(found[d])
                held, load = counts[d], int(loads[d])
                score = sum(w * (UNIT * n // (1000 * n + 8 * load)) for t, w in query if (n := held.get(t)))
                if score > 0:
                    best.append((-score, *place))
                    best.sort()
                    del best[self.top :]

    def run(self, batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[tuple[int, int | None, int]]:
        """(number of the query, doc_id, score) of the best of all batches."""
        self.start()
        ids, found, size = [], [], 0
        for of, texts in batches:
            for doc_id, text in zip(of.to_pylist(), utf8(texts), strict=True):
                if words := terms(text):
                    ids.append(doc_id)
                    found.append(words)
                    size += len(words)
                    if size >= BATCH_TERMS or len(found) * len(self.queries) >= CELLS:
                        self.take(ids, found)
                        ids, found, size = [], [], 0
        if found:
            self.take(ids, found)
        for q, best in enumerate(self.best):
            for score, missing, doc_id in best:
                yield q, None if missing else doc_id, -score


FOUND = flat_schema("query integer, doc_id long, score long")
RANKED = flat_schema("item_id long, rank integer, doc_id long, score long")


def search(
    docs: DataFrame, queries: DataFrame, top: int = TOP, bits: int = COORDINATE_BITS,
    block_items: int = BLOCK_ITEMS, block_bytes: int = 4 << 20,
) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``top`` documents of each row of ``queries`` (item_id and text).

    ``bits`` is the logarithm of a sketch's places: more of them give closer bounds and never another result.
    """
    spark, results = docs.sparkSession, []
    for block in blocks(queries, block_items, block_bytes):
        stats = Statistics(docs, block)
        shared = spark.sparkContext.broadcast(Searcher(block, stats, top, bits))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            rows = list(shared.value.run((b.column(0), b.column(1)) for b in batches))
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            kinds = (pa.int32(), pa.int64(), pa.int64())
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["query", "doc_id", "score"])

        found = texts_of(docs).mapInArrow(run, FOUND).withColumn("part", F.pmod("doc_id", F.lit(64)))
        best_first = [F.desc("score"), F.asc_nulls_last("doc_id")]
        for keys in (["query", "part"], ["query"]):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best_first)))
            found = found.where(F.col("rank") <= top)
        ids = spark.createDataFrame(list(enumerate(block.ids)), "number int, item_id bigint")
        ranked = found.join(ids, found["query"] == ids["number"])
        results.append(ranked.select("item_id", "rank", "doc_id", "score"))
    if not results:
        return spark.createDataFrame([], RANKED)
    whole = results[0]
    for more in results[1:]:
        whole = whole.unionByName(more)
    return whole

"""Language-model scores by deleted interpolation.

The probability of a token mixes maximum-likelihood estimates of its n-grams, from the longest down to the single token,
and a uniform share for the unknown. How they are mixed depends on how often the context was seen: contexts whose counts
have the same number of binary digits share weights, as do those never seen. A bucket's weights are learned by
expectation-maximisation on a fold of the training texts that is deleted from the counts for it; scores then use the
counts of all training texts.

Counting shuffles one number for each distinct n-gram of a chunk of texts, not one for each token. Tasks write chunks of
bounded size once, as numbers into the chunk's own vocabulary. Each chunk sends its distinct n-grams with their counts to
the ranges of hashes they lie in; a range adds up what all chunks sent and answers each with the totals of what it asked
for; the chunk meets its answers. Nothing is cut into more than ``2 ** STEP_BITS`` ranges at a time: where the input
needs more, groups of chunks are added up in a coarse range first, and what they hold together asks the finer ranges as
if it were a chunk. So rows follow the input, and not chunks times ranges. An n-gram that makes up a third of all tokens is
one number for each chunk, and the number of ranges follows the input, so nothing is hot. EM passes over the counts of the deleted fold, and only sums for
each bucket reach the driver.

An n-gram is stood for by a 64-bit hash.

Edge cases: a NULL or empty text is its end token alone; documents without doc_id are training texts; rows that repeat a
doc_id count and are scored one by one; without training texts every token gets the uniform share; where a bucket has no
deleted tokens its estimates weigh alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from clickmart.llm.common import discard, flat_schema, packed, settle, texts_of, utf8

FOLDS = 7
HELD_OUT, DELETED = 2, 3
CHUNK_TOKENS = 1 << 20
RANGE_TOKENS = 1 << 21
STEP_BITS = 10
BUCKETS = 65  # binary digits of a count, 0 for none
START, END = 1, 2  # stand for the marks among the words' hashes
ODD = np.uint64(0x9E3779B97F4A7C15)


def fold(doc_id: Column) -> Column:
    """The fold of a document: the checksum of its id as text, modulo the number of folds."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0)).cast("int")


def squeeze(values: np.ndarray) -> bytes:
    """Compressed numbers: all their first bytes, then all their second bytes, and so on."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def stretch(data: bytes, dtype: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def squeeze_sorted(values: np.ndarray) -> bytes:
    return squeeze(np.diff(values, prepend=np.zeros(1, values.dtype)))


def stretch_sorted(data: bytes, dtype: str = "<u8") -> np.ndarray:
    return np.cumsum(stretch(data, dtype), dtype=dtype)


def lengthen(gram: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams ``gram`` followed by ``token``."""
    mixed = (gram ^ (gram >> np.uint64(31))) * ODD + token
    mixed = (mixed ^ (mixed >> np.uint64(29))) * ODD
    return mixed ^ (mixed >> np.uint64(32))


@dataclass
class Chunk:
    """Texts as places in the sorted hashes of their words, one after another, each closed by its end."""

    words: np.ndarray
    tokens: np.ndarray
    ids: list[int | None]
    folds: np.ndarray
    lengths: np.ndarray

    @staticmethod
    def of(ids: list, folds: list, texts: list[np.ndarray]) -> Chunk:
        """From the hashes of each text's tokens."""
        words, tokens = np.unique(np.concatenate(texts), return_inverse=True)
        lengths = np.array([len(t) for t in texts], np.int64)
        return Chunk(words, tokens.astype(np.int32), ids, np.array(folds, np.int32), lengths)

    def first(self) -> np.ndarray:
        """Where each token's text starts."""
        return np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)

    def in_fold(self, chosen: np.ndarray) -> np.ndarray:
        return np.repeat(chosen, self.lengths)

    def grams(self, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length up to ``order``: the distinct n-grams' sorted hashes, and the place of each token's n-gram.

        An n-gram reaches back over start marks, never into the text before.
        """
        yield self.words, self.tokens
        hashes, first = self.words[self.tokens], self.first()
        at = np.arange(len(hashes))
        for n in range(2, order + 1):
            gram = np.full(len(at), n, np.uint64)
            for back in range(n - 1, 0, -1):
                gram = lengthen(gram, np.where(at - back >= first, hashes[np.maximum(at - back, 0)], np.uint64(START)))
            yield np.unique(lengthen(gram, hashes), return_inverse=True)


CHUNKS = flat_schema(
    "chunk long, n_tokens long, n_deleted long, n_train_texts long, n_deleted_texts long, "
    "words binary, tokens binary, ids binary, nulls binary, folds binary, lengths binary"
)


def _packed_chunk(number: int, c: Chunk) -> tuple:
    ids = squeeze(np.array([i or 0 for i in c.ids], "<i8"))
    nulls = squeeze(np.array([i is None for i in c.ids], np.uint8))
    deleted = c.folds == DELETED
    sizes = len(c.tokens), int(c.lengths[deleted].sum()), int((c.folds != HELD_OUT).sum()), int(deleted.sum())
    return number, *sizes, squeeze_sorted(c.words), squeeze(c.tokens), ids, nulls, squeeze(c.folds), squeeze(c.lengths)


def _chunk(row: dict) -> Chunk:
    nulls = stretch(row["nulls"], "u1")
    ids = [None if none else i for i, none in zip(stretch(row["ids"], "<i8").tolist(), nulls.tolist(), strict=True)]
    words, tokens = stretch_sorted(row["words"]), stretch(row["tokens"], "<i4")
    return Chunk(words, tokens, ids, stretch(row["folds"], "<i4"), stretch(row["lengths"], "<i8"))


def chunked(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    digest = xxhash.xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, ([], [], []), 0
        for batch in batches:
            ids, texts, folds = batch.columns
            for doc_id, text, part in zip(ids.to_pylist(), utf8(texts), folds.to_pylist(), strict=True):
                hashes = [*map(digest, text.lower().split()), END]
                for column, value in zip(held, (doc_id, part, np.array(hashes, np.uint64)), strict=True):
                    column.append(value)
                size += len(hashes)
                if size >= chunk_tokens:
                    yield packed([_packed_chunk(number, Chunk.of(*held))], to_arrow_schema(CHUNKS))
                    number, held, size = number + 1, ([], [], []), 0
        if size:
            yield packed([_packed_chunk(number, Chunk.of(*held))], to_arrow_schema(CHUNKS))

    return texts_of(docs, fold(F.col("doc_id").cast("bigint")).alias("fold")).mapInArrow(run, CHUNKS)


ASKED = flat_schema("chunk long, order integer, range long, keys binary, train binary, deleted binary")
ANSWERS = flat_schema(
    "chunk long, order integer, range long, train binary, deleted binary, n_known long, n_train long"
)


def in_ranges(keys: np.ndarray, counts: list[np.ndarray], bits: int) -> Iterator[tuple]:
    """Sorted hashes with their counts, cut by their first ``bits`` bits: the range, and what lies there."""
    ranges = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = np.flatnonzero(np.diff(ranges, prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
        yield int(ranges[a]), squeeze_sorted(keys[a:b]), *(squeeze(c[a:b]) for c in counts)


def asked(chunks: DataFrame, order: int, bits: int) -> DataFrame:
    """The distinct n-grams of each chunk with their counts in training texts and in the deleted fold, cut into ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _chunk(row)
                train = chunk.in_fold(chunk.folds != HELD_OUT).astype(np.float64)
                deleted = chunk.in_fold(chunk.folds == DELETED).astype(np.float64)
                for n, (keys, places) in enumerate(chunk.grams(order), 1):
                    counts = [np.bincount(places, w, len(keys)).astype("<u8") for w in (train, deleted)]
                    for sent in in_ranges(keys, counts, bits):
                        yield packed([(row["chunk"], n, *sent)], to_arrow_schema(ASKED))

    return chunks.mapInArrow(run, ASKED)


def answered(asks: DataFrame) -> DataFrame:
    """The totals of what each chunk asked for; the first row of a range also says how many n-grams and tokens it holds."""

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [stretch_sorted(k) for k in rows["keys"]]
        known, places = np.unique(np.concatenate(keys), return_inverse=True)
        ends = np.cumsum([len(k) for k in keys])[:-1]
        out = rows[["chunk", "order", "range"]].copy()
        for name in ("train", "deleted"):
            counts = np.concatenate([stretch(c, "<u8") for c in rows[name]])
            sums = np.bincount(places, counts, len(known)).astype("<u8")
            out[name] = [squeeze(part) for part in np.split(sums[places], ends)]
            if name == "train":
                out["n_known"] = [int(np.count_nonzero(sums)), *[0] * (len(rows) - 1)]
                out["n_train"] = [int(sums.sum()), *[0] * (len(rows) - 1)]
        return out

    return asks.groupBy("order", "range").applyInPandas(total, ANSWERS)


NODES = flat_schema("chunk long, order integer, keys binary, train binary, deleted binary")


def nodes_of(asks: DataFrame) -> DataFrame:
    """What the asks of each ``node`` hold together, as one chunk named after it."""

    def add_up(rows: pd.DataFrame) -> pd.DataFrame:
        known, places = np.unique(np.concatenate([stretch_sorted(k) for k in rows["keys"]]), return_inverse=True)
        out = {"chunk": rows["node"].iloc[0], "order": rows["order"].iloc[0], "keys": squeeze_sorted(known)}
        for name in ("train", "deleted"):
            counts = np.concatenate([stretch(c, "<u8") for c in rows[name]])
            out[name] = squeeze(np.bincount(places, counts, len(known)).astype("<u8"))
        return pd.DataFrame([out])

    return asks.groupBy("order", "node").applyInPandas(add_up, NODES)


def finer(nodes: DataFrame, bits: int) -> DataFrame:
    """The asks of nodes, cut into more ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = [stretch(row[name], "<u8") for name in ("train", "deleted")]
                for sent in in_ranges(stretch_sorted(row["keys"]), counts, bits):
                    yield packed([(row["chunk"], row["order"], *sent)], to_arrow_schema(ASKED))

    return nodes.mapInArrow(run, ASKED)


def handed_down(asks: DataFrame, answers: DataFrame) -> DataFrame:
    """The answers to the asks of each node from those to the node; the first has the node's own numbers."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        keys, right = [stretch_sorted(k) for k in left["keys"]], right.sort_values("range")
        places = np.unique(np.concatenate(keys), return_inverse=True)[1]
        ends = np.cumsum([len(k) for k in keys])[:-1]
        out = left[["chunk", "order", "range"]].copy()
        for name in ("train", "deleted"):
            totals = np.concatenate([stretch(c, "<u8") for c in right[name]])
            out[name] = [squeeze(part) for part in np.split(totals[places], ends)]
        for name in ("n_known", "n_train"):
            out[name] = [int(right[name].sum()), *[0] * (len(left) - 1)]
        return out

    below = answers.withColumnRenamed("chunk", "node")
    children = asks.select("chunk", "order", "range", "node", "keys")
    return children.groupBy("order", "node").cogroup(below.groupBy("order", "node")).applyInPandas(run, ANSWERS)


def answers_to(asks: DataFrame, bits: int, range_bits: int) -> DataFrame:
    """Answers, settled, to asks that are cut by ``bits`` bits, from ranges of ``range_bits`` bits."""
    if bits == range_bits:
        return settle(answered(asks))
    # As many groups of chunks in a coarse range as it has finer ranges, so that a node is as large as one of these.
    groups, more = 1 << (range_bits - bits), min(range_bits, bits + STEP_BITS)
    node = F.col("range") * groups + F.pmod(F.xxhash64("chunk"), F.lit(groups))
    written = settle(asks.withColumn("node", node))
    nodes = settle(nodes_of(written))
    below = answers_to(finer(nodes, more), more, range_bits)
    found = settle(handed_down(written, below))
    discard(written, nodes, below)
    return found


MET = flat_schema(
    "chunk long, ids binary, nulls binary, folds binary, lengths binary, counts binary, deleted binary"
)


def met(chunks: DataFrame, answers: DataFrame, order: int) -> DataFrame:
    """Each chunk's texts as the counts of its tokens' n-grams; ``deleted`` has the deleted fold's, without its own."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0].to_dict()
        chunk, by_order = _chunk(row), []
        right = right.sort_values(["order", "range"])
        inside = chunk.in_fold(chunk.folds == DELETED)
        without = []
        for n, (_, places) in enumerate(chunk.grams(order), 1):
            mine = right[right["order"] == n]
            train, deleted = (np.concatenate([stretch(c, "<u8") for c in mine[name]]) for name in ("train", "deleted"))
            by_order.append(squeeze(train[places].astype("<u8")))
            without.append(squeeze((train - deleted)[places[inside]].astype("<u8")))
        same = {name: row[name] for name in ("chunk", "ids", "nulls", "folds", "lengths")}
        return pd.DataFrame([same | {"counts": _bind(by_order), "deleted": _bind(without)}])

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(run, MET)


def _bind(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _unbind(data: bytes) -> list[np.ndarray]:
    found, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        found.append(stretch(data[at + 8 : at + 8 + size], "<u8"))
        at += 8 + size
    return found


def estimates(
    counts: list[np.ndarray], lengths: np.ndarray, tokens: int, texts: int, known: int
) -> tuple[np.ndarray, np.ndarray]:
    """For each token the uniform share and the estimate of each n-gram; and the bucket of its longest context.

    The count of a context is that of the n-gram before the token; before a first token it is the number of texts.
    """
    n = len(counts[0])
    shares = np.zeros((len(counts) + 1, n))
    shares[0] = 1 / (known + 1)
    shares[1] = counts[0] / max(1, tokens)
    starts = np.cumsum(lengths) - lengths
    context = np.zeros(n, np.uint64)
    for k in range(1, len(counts)):
        context = np.concatenate([np.zeros(1, np.uint64), counts[k - 1][:-1]])[:n]
        context[starts] = texts
        np.divide(counts[k], context, out=shares[k + 1], where=context > 0)
    buckets = np.where(context > 0, np.frexp(context.astype(np.float64))[1], 0)
    return shares, buckets


def learn(counted: DataFrame, order: int, tokens: int, texts: int, known: int, rounds: int) -> np.ndarray:
    """Weights of the uniform share and the n-grams for each bucket, by expectation-maximisation on the deleted fold."""
    width = order + 1
    weights = np.full((BUCKETS, width), 1 / width)
    weights[0, order:] = 0 if order > 1 else weights[0, order:]
    weights /= weights.sum(axis=1, keepdims=True)
    folds = counted.select("folds", "lengths", "deleted")
    for _ in range(rounds):
        now = weights

        def expect(frames: Iterator[pd.DataFrame], now: np.ndarray = now) -> Iterator[pd.DataFrame]:
            sums = np.zeros((BUCKETS, width))
            for frame in frames:
                for row in frame.itertuples(index=False):
                    counts = _unbind(row.deleted)
                    lengths = stretch(row.lengths, "<i8")[stretch(row.folds, "<i4") == DELETED]
                    if len(lengths):
                        shares, buckets = estimates(counts, lengths, tokens, texts, known)
                        mixed = now[buckets].T * shares
                        mixed /= mixed.sum(axis=0)
                        for k in range(width):
                            sums[:, k] += np.bincount(buckets, mixed[k], BUCKETS)
            at = np.argwhere(sums > 0)
            yield pd.DataFrame({"bucket": at[:, 0], "k": at[:, 1], "n": sums[sums > 0]})

        found = np.zeros((BUCKETS, width))
        sums = folds.mapInPandas(expect, "bucket int, k int, n double").groupBy("bucket", "k").agg(F.sum("n").alias("n"))
        for row in sums.collect():
            found[row["bucket"], row["k"]] = row["n"]  # a sum for each bucket and weight
        seen = found.sum(axis=1) > 0
        weights = now.copy()
        weights[seen] = found[seen] / found[seen].sum(axis=1, keepdims=True)
        if np.abs(weights - now).max() < 1e-4:
            break
    return weights


SCORES = flat_schema(
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def interpolated_scores(
    docs: DataFrame,
    order: int = 2,
    rounds: int = 12,
    chunk_tokens: int = CHUNK_TOKENS,
    range_tokens: int = RANGE_TOKENS,
) -> DataFrame:
    """log10 probabilities of all texts by the interpolated model (``score``) and by add-one counts (``base_score``)."""
    chunks = settle(chunked(docs, chunk_tokens))
    sizes = ("n_tokens", "n_deleted", "n_train_texts", "n_deleted_texts")
    sums = chunks.agg(*(F.coalesce(F.sum(size), F.lit(0)) for size in sizes))
    size, deleted_tokens, texts, deleted_texts = sums.first()
    range_bits = max(0, (-(-size // range_tokens) - 1).bit_length())
    bits = min(range_bits, STEP_BITS)
    answers = answers_to(asked(chunks, order, bits), bits, range_bits)
    totals = answers.where(F.col("order") == 1).agg(F.sum("n_known"), F.sum("n_train")).first()
    known, tokens = totals[0] or 0, totals[1] or 0
    counted = settle(met(chunks, answers.drop("n_known", "n_train"), order))
    weights = learn(counted, order, tokens - deleted_tokens, texts - deleted_texts, known, rounds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, folds = stretch(row["lengths"], "<i8"), stretch(row["folds"], "<i4")
                counts = _unbind(row["counts"])
                shares, buckets = estimates(counts, lengths, tokens, texts, known)
                mixed = np.log10((weights[buckets].T * shares).sum(axis=0))
                base = np.log10((counts[0].astype(np.float64) + 1) / (tokens + known + 1))
                starts = np.cumsum(lengths) - lengths
                n_known = np.add.reduceat((counts[0] > 0).astype(np.int64), starts)
                nulls = stretch(row["nulls"], "u1").astype(bool)
                columns = [
                    pa.array(stretch(row["ids"], "<i8"), pa.int64(), mask=nulls),
                    pa.array(folds == HELD_OUT),
                    pa.array(lengths),
                    pa.array(n_known),
                    pa.array(np.full(len(lengths), tokens, np.int64)),
                    pa.array(np.add.reduceat(base, starts)),
                    pa.array(np.add.reduceat(mixed, starts)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=to_arrow_schema(SCORES))

    return counted.mapInArrow(score, SCORES)


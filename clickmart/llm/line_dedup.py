"""Line deduplication with two Bloom filters.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least ten code points that two
documents hold stay only in the smallest doc_id of them.

Only keys that may repeat are shuffled. Each task adds the keys of its documents to a filter of what it has seen once
and, where a document meets a key again, to one of what it has seen twice; merged, a bit that two tasks have seen once is
seen twice. A key that two documents hold is never missing from the merged second filter. What that filter lets pass is
grouped by key, which confirms the repeat exactly and gives the first document. Filters have a fixed size: if the keys
need more, they are dealt out once into slices by hash. A slice then gets filters of its own, reads its own keys only, and
writes its suspects before its filters are given up, so one filter is alive at a time.

A key is stood for by its 128-bit hash. The hashes are written once, so the texts are read twice in all.

Edge cases: a NULL or empty text is one empty line; documents without doc_id keep all lines and count for nobody; rows
that repeat a doc_id are one document, each row keeping its own text; ties cannot occur, as the smallest doc_id wins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from clickmart.llm.common import discard, flat_schema, fresh, map_rows, packed, settle, settle_each, text_at, texts_of, utf8

MIN_CHARS = 10
SEGMENT = 1 << 18  # bytes of a filter that travel as one row
SLICE_PARTS = 16  # parts that a slice's documents are dealt to
KEYS = flat_schema("doc_id long, keys binary, n long")
SLICED = flat_schema("doc_id long, keys binary, slice integer")
SEGMENTS = flat_schema("segment integer, part integer, once binary, twice binary")


def line_key(line: bytes) -> bytes | None:
    """The 128-bit hash of a line's key, None if the key is too short to count."""
    key = line.strip().lower()
    if len(key) < MIN_CHARS or not key.isascii() and len(key.decode()) < MIN_CHARS:
        return None
    return xxhash.xxh3_128_digest(key)


def _keys_of(ids: pa.Array, texts: pa.Array) -> Iterator[tuple]:
    for doc_id, text in zip(ids.to_pylist(), utf8(texts), strict=True):
        found = {key for line in text.split(b"\n") if (key := line_key(line))}
        if found:
            yield doc_id, b"".join(sorted(found)), len(found)


def _hashes(blobs: Iterator[bytes]) -> np.ndarray:
    """Two 64-bit numbers for each key."""
    return np.frombuffer(b"".join(blobs), dtype="<u8").reshape(-1, 2)


def positions(hashes: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """The filter's bits for each key, by double hashing; ``bits`` is a power of two."""
    steps = np.arange(probes, dtype=np.uint64)
    return ((hashes[:, :1] + steps * (hashes[:, 1:] | np.uint64(1))) & np.uint64(bits - 1)).astype(np.int64)


def contains(filter_bytes: np.ndarray, hashes: np.ndarray, probes: int) -> np.ndarray:
    at = positions(hashes, 8 * len(filter_bytes), probes)
    return ((filter_bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def _slice_of(hashes: np.ndarray, slices: int) -> np.ndarray:
    return (hashes[:, 1] >> np.uint64(32)) % np.uint64(slices)


def _merge(rows: pd.DataFrame, size: int) -> tuple[bytes, bytes]:
    """One pair of filters from several: twice is what one had twice or two had once."""
    once, twice = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
    for a, b in zip(rows["once"], rows["twice"], strict=True):
        a = np.frombuffer(zlib.decompress(a), np.uint8)
        twice |= np.frombuffer(zlib.decompress(b), np.uint8) | (once & a)
        once |= a
    return zlib.compress(once.tobytes(), 1), zlib.compress(twice.tobytes(), 1)


def in_slices(keys: DataFrame, slices: int) -> DataFrame:
    """The keys in a folder for each slice, with a row for each document that has any there."""

    def cut(ids: pa.Array, blobs: pa.Array) -> Iterator[tuple]:
        for doc_id, blob in zip(ids.to_pylist(), blobs.to_pylist(), strict=True):
            hashes = _hashes([blob])
            of = _slice_of(hashes, slices)
            for part in np.unique(of).tolist():
                yield doc_id, hashes[of == part].tobytes(), part

    rows = map_rows(keys.select("doc_id", "keys"), cut, SLICED)
    return settle(rows.repartition("slice", F.pmod(F.xxhash64("doc_id"), F.lit(SLICE_PARTS))), "slice")


def twice_filter(keys: DataFrame, bits: int, probes: int) -> np.ndarray:
    """The bytes of the filter of ``keys`` that two documents may hold."""
    size = min(SEGMENT, bits // 8)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            hashes = _hashes(batch.column(0).to_pylist())
            hashes, counts = np.unique(hashes, axis=0, return_counts=True) if len(hashes) else (hashes, np.zeros(0, int))
            again = contains(once, hashes, probes) | (counts > 1)
            for target, chosen in ((twice, hashes[again]), (once, hashes)):
                at = positions(chosen, bits, probes).ravel()
                np.bitwise_or.at(target, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        of = TaskContext.get().partitionId() % 64
        for k in range(bits // 8 // size):
            cut = slice(k * size, (k + 1) * size)
            if once[cut].any():
                row = (k, of, zlib.compress(once[cut].tobytes(), 1), zlib.compress(twice[cut].tobytes(), 1))
                yield packed([row], to_arrow_schema(SEGMENTS))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        once, twice = _merge(rows, size)
        return pd.DataFrame({"segment": rows["segment"][:1], "part": rows["part"][:1], "once": [once], "twice": [twice]})

    parts = keys.select("keys").mapInArrow(build, SEGMENTS)
    # Few rows meet in one task: groups of tasks first, then the groups.
    some = parts.groupBy("segment", "part").applyInPandas(merge, SEGMENTS)
    merged = some.groupBy("segment").applyInPandas(merge, SEGMENTS).select("segment", "twice")
    found = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():  # as long as the filter, whatever the input
        found[row["segment"] * size : (row["segment"] + 1) * size] = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
    return found


def suspects(keys: DataFrame, bits_per_key: int = 10, probes: int = 4, filter_mb: int = 64) -> DataFrame:
    """doc_id and key, settled, of what may be held by two documents: every true repeat and a few others."""
    total = keys.agg(F.sum("n")).first()[0] or 0
    bits = 1 << max(16, min(int(total * bits_per_key).bit_length(), (filter_mb << 23).bit_length() - 1))
    slices = max(1, -(-int(total * bits_per_key) // bits))
    schema = flat_schema("doc_id long, key binary")
    sliced = in_slices(keys, slices) if slices > 1 else keys

    def each_slice() -> Iterator[DataFrame]:
        for part in range(slices):
            own = sliced.where(F.col("slice") == part) if slices > 1 else keys
            shared = keys.sparkSession.sparkContext.broadcast(twice_filter(own, bits, probes))

            def probe(ids: pa.Array, blobs: pa.Array, shared=shared) -> Iterator[tuple]:
                for doc_id, blob in zip(ids.to_pylist(), blobs.to_pylist(), strict=True):
                    for i in np.flatnonzero(contains(shared.value, _hashes([blob]), probes)):
                        yield doc_id, blob[16 * i : 16 * i + 16]

            yield map_rows(own.select("doc_id", "keys"), probe, schema).distinct()
            shared.destroy()

    found = settle_each(each_slice())
    if slices > 1:
        discard(sliced)
    return found


def repeats(docs: DataFrame, **filter_options: int) -> DataFrame:
    """doc_id and ``keys``: the keys whose lines the document loses."""
    keys = settle(map_rows(texts_of(docs).where("doc_id is not null"), _keys_of, KEYS))
    suspected = suspects(keys, **filter_options)
    discard(keys)
    first = suspected.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    first = settle(first.select("key", "first"))  # a join of two tables, in which a key of many documents can be split
    lost = suspected.join(first, "key").where("doc_id > first").select("doc_id", "key")
    return settle(lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys")))  # no longer than the document


def dedup_lines(docs: DataFrame, counts: str | None = None, **filter_options: int) -> DataFrame:
    """``docs`` with the lines of each text that stay. ``counts`` names a struct column of n_lines and n_dropped to add."""
    lost = repeats(docs, **filter_options)
    drop = fresh("_drop", docs)
    of = fresh("_of", docs)
    lost = lost.select(F.col("doc_id").alias(of), F.col("keys").alias(drop))
    joined = docs.join(lost, docs["doc_id"] == lost[of], "left").drop(of)
    at, width = text_at(docs), len(docs.columns)
    n_lines, n_dropped = pa.field("n_lines", pa.int64()), pa.field("n_dropped", pa.int64())

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines_of, dropped_of = [], [], []
            read = zip(utf8(batch.column(at)), batch.column(drop), batch.column(at).is_valid(), strict=True)
            for text, keys, known in read:
                lines = text.split(b"\n")
                gone = set(keys.as_py() or ())
                kept = [line for line in lines if line_key(line) not in gone] if gone else lines
                texts.append((b"\n".join(kept) if gone else text).decode() if known.as_py() else None)
                lines_of.append(len(lines))
                dropped_of.append(len(lines) - len(kept))
            columns = [batch.column(i) for i in range(width)]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            fields = [batch.schema.field(i) for i in range(width)]
            if counts:
                numbers = [pa.array(lines_of, pa.int64()), pa.array(dropped_of, pa.int64())]
                columns.append(pa.StructArray.from_arrays(numbers, fields=[n_lines, n_dropped]))
                fields.append(pa.field(counts, columns[-1].type))
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    schema = StructType(list(docs.schema.fields))
    if counts:
        schema = schema.add(counts, flat_schema("n_lines long, n_dropped long"))
    return joined.mapInArrow(rebuild, schema)

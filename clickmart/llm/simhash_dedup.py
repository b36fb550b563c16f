"""Near duplicates by SimHash, found with the generalised pigeonhole principle.

The 64 bits are grouped into partitions, correlated bits together, so that partitions differ little from independent
ones. A pair at distance t or less differs by at most t_i bits in some partition i whenever the t_i add up to
t - partitions + 1, and a partition with t_i = -1 need not be probed at all. Each fingerprint gets thresholds of its
own: a dynamic program picks those with the fewest estimated candidates, so a fingerprint avoids the partitions in which
its bits are common. It probes a table of all (partition, value) with every value within t_i bits, and candidates are
verified on all 64 bits.

Buckets larger than a fingerprint has single-bit neighbours (64, and itself) are not paired up. Fingerprints in such a
bucket, or probing one, are linked exactly in another way: each names itself and its 64 neighbours as keys. Two
fingerprints within two bits share such a key, and two that share one are within two bits, so all holders of a key hang
on the least of them. That is 65 rows for each, however large the group. For other even limits
the keys are the fingerprint with up to half the limit of its bits flipped.

Fingerprints are compared once each; documents with equal ones belong together from the start.

Edge cases: NULL and empty texts have fingerprint zero and belong together; a text of fewer words than a shingle is one
shingle; rows that repeat a doc_id link all their fingerprints; a NULL doc_id keeps its fingerprint and gets the
component of its group, NULL if nobody in it has a doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickmart.llm.common import flat_schema, fresh, map_rows, settle, texts_of, utf8
from clickmart.llm.graph import components

BITS = 64
SEED = 42


def shingles(text: bytes, length: int) -> list[bytes]:
    """Runs of ``length`` words, A-Z lower-cased, joined by a space; all words if there are fewer."""
    words = text.lower().split()
    if not words:
        return []
    joined, ends, at = b" ".join(words), [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    last = min(length, len(words)) - 1
    return [joined[s:e] for s, e in zip(starts, ends[last:], strict=False)]


def fingerprint(text: bytes, length: int = 3) -> int:
    """Bit i is set if it is set in more than half of the shingles' hashes."""
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles(text, length)], dtype="<u8")
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for block in range(0, len(hashes), 65_536):
        some = hashes[block : block + 65_536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def fingerprints(docs: DataFrame, length: int = 3, digest: Column | None = None) -> DataFrame:
    """doc_id and fingerprint, a bigint of the same 64 bits; and digest, a text of the row, if one is given."""
    more = [] if digest is None else [digest.alias("digest")]

    def run(ids: pa.Array, texts: pa.Array, *others: pa.Array) -> Iterator[tuple]:
        for doc_id, text, *other in zip(ids.to_pylist(), utf8(texts), *(o.to_pylist() for o in others), strict=True):
            yield doc_id, signed(fingerprint(text, length)), *other

    return map_rows(texts_of(docs, *more), run, flat_schema("doc_id long, fingerprint long" + ", digest string" * len(more)))


def group_bits(prints: DataFrame, partitions: int) -> list[list[int]]:
    """The bits in groups of nearly equal size, each bit with those it is most correlated with."""

    def co_occurrence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS))
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8)
            for block in range(0, len(values), 65_536):
                bits = np.unpackbits(values[block : block + 65_536], axis=1, bitorder="little").astype(np.float32)
                both += bits.T @ bits
        columns = [pa.array(range(BITS * BITS), pa.int32()), pa.array(both.ravel(), pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=["cell", "n"])

    partial = prints.select("fingerprint").mapInArrow(co_occurrence, "cell int, n double")
    cells = partial.groupBy("cell").agg(F.sum("n").alias("n"))
    both = np.zeros(BITS * BITS)
    for row in cells.collect():  # 64 x 64 sums
        both[row["cell"]] = row["n"]
    both = both.reshape(BITS, BITS) / max(1, prints.count())
    p = both.diagonal()
    deviation = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    correlation = np.abs((both - np.outer(p, p)) / np.outer(deviation, deviation))
    np.fill_diagonal(correlation, 0)
    left, groups = set(range(BITS)), []
    for k in range(partitions):
        size = len(left) // (partitions - k)
        seed = max(left, key=lambda i: (correlation[i, list(left)].max(initial=0), -i))
        group = [seed]
        left.remove(seed)
        while len(group) < size:
            best = max(left, key=lambda i: (correlation[i, group].mean(), -i))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def projections(values: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """The bits of each group gathered into one number; a column for each group."""
    out = np.zeros((len(values), len(groups)), np.uint64)
    for g, bits in enumerate(groups):
        for to, bit in enumerate(bits):
            out[:, g] |= ((values >> np.uint64(bit)) & np.uint64(1)) << np.uint64(to)
    return out


def masks(width: int, most: int) -> list[int]:
    """All numbers of ``width`` bits with at most ``most`` bits set."""
    return [sum(1 << b for b in chosen) for n in range(most + 1) for chosen in combinations(range(width), n)]


def allocate(cost: np.ndarray, limit: int) -> np.ndarray:
    """Thresholds from -1 to ``limit`` for each row and partition, adding up to limit - partitions + 1, of least cost.

    ``cost[row, partition, threshold]`` is the estimated work of a threshold from 0 on; -1 costs nothing. The program
    runs over partitions and what is spent so far, counted from -1 each, for all rows at once.
    """
    rows, partitions, _ = cost.shape
    spend = limit + 1
    best = np.full((rows, spend + 1), np.inf)
    best[:, 0] = 0
    chosen = np.zeros((partitions, rows, spend + 1), np.int8)
    for p in range(partitions):
        then = np.full_like(best, np.inf)
        for total in range(spend + 1):
            for own in range(total + 1):  # threshold own - 1
                value = best[:, total - own] + (cost[:, p, own - 1] if own else 0)
                better = value < then[:, total]
                then[better, total] = value[better]
                chosen[p, better, total] = own
        best = then
    result, left = np.zeros((rows, partitions), np.int64), np.full(rows, spend)
    for p in reversed(range(partitions)):
        own = chosen[p, np.arange(rows), left]
        result[:, p] = own - 1
        left = left - own
    return result


def partitions_for(n: int, limit: int) -> int:
    """How many partitions cost least where ``n`` fingerprints are spread evenly: more of them have larger buckets, fewer
    are probed with more values. Among as many as ``allocate`` may use, by what it estimates for one fingerprint."""

    def rows(partitions: int) -> float:
        width = BITS // partitions
        probed = np.array([len(masks(width, t)) for t in range(limit + 1)], float)
        cost = np.broadcast_to(probed * (1 + n / 2.0**width), (1, partitions, limit + 1))
        thresholds = allocate(cost, limit)[0]
        return partitions + sum(cost[0, p, t] for p, t in enumerate(thresholds) if t >= 0)

    return min(range(limit + 1, 1, -1), key=rows, default=2)


def links(prints: DataFrame, limit: int = 2, partitions: int | None = None, sample_rows: int = 2000) -> DataFrame:
    """Edges ``(u, v)`` between distinct fingerprints that join all within ``limit`` bits of each other.

    Every edge is within the limit. Inside large buckets not every pair is listed, but each is connected. The number of
    partitions follows that of the fingerprints unless it is given.
    """
    partitions = partitions or partitions_for(prints.count(), limit)
    groups = group_bits(prints, partitions)
    crowd = 1 + BITS  # rows that the other way takes for a fingerprint

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints_ = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            own = projections(prints_.view(np.uint64), groups).view(np.int64)
            for p in range(partitions):
                columns = [pa.array(np.full(len(prints_), p, np.int32)), pa.array(own[:, p]), pa.array(prints_)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "value", "fingerprint"])

    index = prints.select("fingerprint").mapInArrow(keyed, "part int, value bigint, fingerprint bigint")
    sizes = settle(index.groupBy("part", "value").agg(F.count("*").alias("size")))

    # What a probe of another value finds, by partition and bits flipped, on a bounded sample of fingerprints.
    total = sum(row["n"] for row in sizes.groupBy("part").agg(F.sum("size").alias("n")).collect()) / partitions
    share = F.lit(int(min(1, sample_rows / max(1, total)) * (1 << 30)) + 1)
    sample = index.where(F.pmod(F.xxhash64("fingerprint"), F.lit(1 << 30)) < share).select("part", "value")
    flipped = [
        F.struct(F.lit(b).alias("bit"), F.col("value").bitwiseXOR(F.lit(1 << b).cast("bigint")).alias("value"))
        for b in range(max(map(len, groups)))
    ]
    neighbours = sample.select("part", F.explode(F.array(*flipped)).alias("n")).select("part", "n.bit", "n.value")
    seen = neighbours.where(" or ".join(f"part = {p} and bit < {len(g)}" for p, g in enumerate(groups)))
    mean = dict(seen.join(sizes, ["part", "value"], "left").groupBy("part").agg(F.avg(F.coalesce("size", F.lit(0)))).collect())

    # Sizes of the own buckets, where they are not ordinary.
    large = sizes.where("size > 1").select("part", "value", "size")
    own = index.join(large, ["part", "value"], "left").groupBy("fingerprint").agg(
        *[F.max(F.when(F.col("part") == p, F.coalesce("size", F.lit(1)))).alias(f"size_{p}") for p in range(partitions)]
    )
    flips = [[masks(len(g), t) for t in range(limit + 1)] for g in groups]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in range(0, batch.num_rows, 4096):
                some = batch.slice(block, 4096)
                prints_ = some.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                values = projections(prints_.view(np.uint64), groups)
                cost = np.zeros((len(prints_), partitions, limit + 1))
                for p in range(partitions):
                    size = some.column(1 + p).to_numpy(zero_copy_only=False).astype(float)
                    for t in range(limit + 1):
                        more = len(flips[p][t]) - 1
                        cost[:, p, t] = size + more * (1 + mean.get(p, 0.0))
                thresholds = allocate(cost, limit)
                for p in range(partitions):
                    for t in range(limit + 1):
                        chosen = thresholds[:, p] == t
                        if chosen.any():
                            probed = (values[chosen, p, None] ^ np.array(flips[p][t], np.uint64)).view(np.int64)
                            who = np.repeat(prints_[chosen], probed.shape[1])
                            columns = [pa.array(np.full(len(who), p, np.int32)), pa.array(probed.ravel()), pa.array(who)]
                            yield pa.RecordBatch.from_arrays(columns, names=["part", "value", "probe"])

    probes = settle(own.mapInArrow(probe, "part int, value bigint, probe bigint"))
    crowded = settle(sizes.where(F.col("size") > crowd).select("part", "value"))
    at = ["part", "value"]
    pairs = (
        probes.join(index.join(crowded, at, "left_anti"), at)
        .where("probe <> fingerprint")
        .where(F.bit_count(F.col("probe").bitwiseXOR(F.col("fingerprint"))) <= limit)
        .select(F.greatest("probe", "fingerprint").alias("u"), F.least("probe", "fingerprint").alias("v"))
    )
    crowd_members = index.join(crowded, at, "left_semi").select("fingerprint")
    crowd_members = crowd_members.union(probes.join(crowded, at, "left_semi").select("probe")).distinct()
    return pairs.union(crowd_links(crowd_members, limit)).distinct()


def crowd_links(prints: DataFrame, limit: int) -> DataFrame:
    """Edges that connect all fingerprints within ``limit`` (an even number) by keys within half of it."""
    if limit % 2:
        raise ValueError("the bit limit must be even")
    keys = F.array(*[F.col("fingerprint").bitwiseXOR(F.lit(signed(m)).cast("bigint")) for m in masks(BITS, limit // 2)])
    held = prints.select("fingerprint", F.explode(keys).alias("key"))
    least = held.groupBy("key").agg(F.min("fingerprint").alias("v"), F.max("fingerprint").alias("u")).where("v < u")
    return held.join(least.select("key", "v"), "key").where("fingerprint <> v").select(F.col("fingerprint").alias("u"), "v")


def near_duplicates(docs: DataFrame, length: int = 3, limit: int = 2) -> DataFrame:
    """doc_id, fingerprint as 16 hexadecimal digits, and component_id: the smallest doc_id that can be reached."""
    of_docs = settle(fingerprints(docs, length))
    prints = settle(of_docs.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    found = links(prints, limit)
    # A doc_id on several rows ties their fingerprints together.
    by_id = of_docs.where("doc_id is not null").groupBy("doc_id")
    rows = by_id.agg(F.min("fingerprint").alias("v"), F.max("fingerprint").alias("w"))
    repeated = rows.where("v < w").select("doc_id", "v")
    ties = of_docs.join(repeated, "doc_id").where("fingerprint <> v").select(F.col("fingerprint").alias("u"), "v")
    reached = components(found.union(ties))
    whole = prints.join(reached, prints["fingerprint"] == reached["node"], "left").select(
        "fingerprint", "first", F.coalesce("component", "fingerprint").alias("component")
    )
    names = whole.groupBy("component").agg(F.min("first").alias("component_id"))
    named = settle(whole.join(names, "component").select("fingerprint", "component_id"))
    result = of_docs.join(named, "fingerprint")
    return result.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, length: int = 3, limit: int = 2) -> DataFrame:
    """``docs`` with one document from each group of texts that fingerprints link, whatever their doc_id.

    The smallest doc_id stays, a missing one only if nobody in the group has any; of texts on the same doc_id the one with
    the least MD5. So every text that goes leaves one of its group behind, also where rows repeat a doc_id.
    """
    key, of, same = (fresh(name, docs) for name in ("_digest", "_of", "_same"))
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    of_docs = settle(fingerprints(docs, length, digest))
    reached = components(links(settle(of_docs.select("fingerprint").distinct()), limit))
    grouped = of_docs.join(reached, of_docs["fingerprint"] == reached["node"], "left")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("best")
    kept = grouped.groupBy(F.coalesce("component", "fingerprint").alias("group")).agg(best)
    kept = settle(kept.select(F.col("best.doc_id").alias(of), F.col("best.digest").alias(same)))
    marked = docs.withColumn(key, digest)
    one = marked.join(kept, marked["doc_id"].cast("bigint").eqNullSafe(kept[of]) & (marked[key] == kept[same]), "left_semi")
    return one.dropDuplicates(["doc_id", key]).drop(key)

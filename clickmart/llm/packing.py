"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm.

A document's ids are cut into pieces of the sequence length; whole pieces are sequences of their own. The others are
dealt by hash into groups of some thousand pieces with nearly the same mix of lengths. A group is solved on several
islands, rows of a table that carry a population each. A child takes over one parent's well-filled sequences whole, loses
the other parent's sequences that hold any of their pieces, and the displaced pieces are put back, longest first, where
they fit best. Between epochs each island's best solution moves on to the next island of its group, by a window over
the few islands. A population that has reached the least number of sequences that could hold its pieces rests.

Every group leaves a few sequences half empty. Their pieces go to a next round with as many times fewer groups, and so
on until one group is left, so that what stays unfilled is about one sequence in all.

Edge cases: a NULL or empty text is its end id alone; rows that repeat a doc_id, and rows without one, are packed one by
one; an empty table gives no rows; among equally good solutions the first found stays.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickmart.llm.common import flat_schema, map_rows, settle, texts_of, utf8

LENGTH = 4096
END = (1).to_bytes(4, "little")
CACHED_WORDS = 800_000
PUNCTUATION = b".,;:!?"
LAST_LETTER, DOTTED_I = "\u017f", "\u0130"  # letters up to here are composed and lower-case to one other, but for one


def _byte_letters() -> dict[int, int]:
    """How byte-level vocabularies write bytes: the printable ones of Latin-1 as they are, the others from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in printable)
    return {b: 256 + k for k, b in enumerate(others)}


class Encoder:
    """Token ids of a text as little-endian 32-bit numbers, words remembered up to a bound.

    No token spans white space, so the ids of a text are those of its words. Words of Latin letters, with punctuation
    after them or not, go straight to the tokenizer's merges; any others to the whole tokenizer. Texts with a special
    token's opening are encoded whole, as A-Z must not be lower-cased in them.
    """

    LETTERS = _byte_letters()

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.known: dict[bytes, bytes] = {}
        self.ends: dict[bytes, bytes] = {}

    def _whole(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _plain(self, word: bytes) -> bytes | None:
        """Ids of a word of Latin letters and what punctuation ends it; None for other words."""
        stem = word.rstrip(PUNCTUATION)
        if stem.isalpha():
            spelt = stem.decode()
        else:
            letters = stem.decode()
            if not letters.isalpha() or max(letters) > LAST_LETTER or DOTTED_I in letters:
                return None
            spelt = letters.lower().encode().decode("latin-1").translate(self.LETTERS)
        ids = array("I", [t.id for t in self.merges(spelt)]).tobytes()
        if len(stem) < len(word):
            end = word[len(stem) :]
            if end not in self.ends:
                if len(self.ends) > CACHED_WORDS:
                    self.ends.clear()
                self.ends[end] = self._whole([end])[0]
            ids += self.ends[end]
        return ids

    def ids(self, text: bytes) -> bytes:
        if b"<|" in text:
            return self._whole([text])[0]
        words = text.lower().split()
        found = list(map(self.known.get, words))
        if None in found:
            fresh, rest = {}, []
            for word in {w for w, ids in zip(words, found, strict=True) if ids is None}:
                ids = self._plain(word)
                if ids is None:
                    rest.append(word)
                else:
                    fresh[word] = ids
            fresh.update(zip(rest, self._whole(rest), strict=True))
            found = [fresh[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
            if len(self.known) + len(fresh) > CACHED_WORDS:
                self.known.clear()
            self.known.update(fresh)
        return b"".join(found)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


PIECES = flat_schema("doc_id long, piece integer, start long, length long, ids_crc32 long")


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """A row for each piece of each document: its place in the document's ids and their checksum."""

    def run(ids: pa.Array, texts: pa.Array) -> Iterator[tuple]:
        for doc_id, text in zip(ids.to_pylist(), utf8(texts), strict=True):
            encoded = encoder(tokenizer).ids(text) + END
            for piece, start in enumerate(range(0, len(encoded), 4 * length)):
                part = encoded[start : start + 4 * length]
                yield doc_id, piece, start // 4, len(part) // 4, zlib.crc32(part)

    return map_rows(texts_of(docs), run, PIECES)


class Packing:
    """Which bin each piece is in, and how full the bins are. Bins may be empty until ``compact``."""

    def __init__(self, sizes: np.ndarray, capacity: int, bin_of: np.ndarray | None = None):
        self.sizes, self.capacity = sizes, capacity
        self.bin_of = np.full(len(sizes), -1, np.int32) if bin_of is None else bin_of

    def fills(self) -> np.ndarray:
        return np.bincount(self.bin_of[self.bin_of >= 0], self.sizes[self.bin_of >= 0]).astype(np.int64)

    def best_fit(self, order: np.ndarray) -> Packing:
        """Put the pieces ``order``, which are in no bin, where the least room is left, in that order."""
        fills = self.fills()
        free = sorted((self.capacity - f, b) for b, f in enumerate(fills.tolist()) if f)
        bins = len(fills)
        for i in order.tolist():
            size = int(self.sizes[i])
            at = bisect_left(free, (size, -1))
            if at == len(free):
                room, b, bins = self.capacity, bins, bins + 1
            else:
                room, b = free.pop(at)
            self.bin_of[i] = b
            insort(free, (room - size, b))
        return self

    def compact(self) -> Packing:
        self.bin_of = np.unique(self.bin_of, return_inverse=True)[1].astype(np.int32)
        return self

    def score(self) -> tuple[int, float]:
        """Fewer bins are better, then bins that are either full or empty."""
        fills = self.fills()
        return -len(fills), float(((fills / self.capacity) ** 2).sum())


def longest_first(sizes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    return chosen[np.argsort(-sizes[chosen], kind="stable")]


def offspring(one: Packing, other: Packing, random: np.random.Generator) -> Packing:
    """``one`` with whole well-filled bins of ``other``; then a few of its emptiest bins are dealt anew."""
    sizes, capacity = one.sizes, one.capacity
    fills = other.fills()
    good = np.flatnonzero(fills >= np.quantile(fills, 0.5))
    injected = random.choice(good, max(1, len(good) // 3), replace=False)
    taken = np.isin(other.bin_of, injected)
    child = one.bin_of.copy()
    broken = np.isin(child, child[taken])  # bins that hold a piece twice now
    child[broken] = -1
    child[taken] = other.bin_of[taken] + len(sizes)
    child = np.where(child >= 0, child, -1)
    _, renamed = np.unique(child[child >= 0], return_inverse=True)
    child[child >= 0] = renamed
    packing = Packing(sizes, capacity, child.astype(np.int32))
    fills = packing.fills()
    worst = np.argsort(fills, kind="stable")[: 1 + len(fills) // 50]
    packing.bin_of[np.isin(packing.bin_of, worst)] = -1
    return packing.best_fit(longest_first(sizes, np.flatnonzero(packing.bin_of < 0))).compact()


def first_population(sizes: np.ndarray, capacity: int, count: int, random: np.random.Generator) -> list[Packing]:
    """Best fit by falling length, and by lengths disturbed more and more."""
    found = []
    for k in range(count):
        order = np.argsort(-sizes * (1 + 0.1 * k * random.random(len(sizes))), kind="stable")
        found.append(Packing(sizes, capacity).best_fit(order).compact())
        if -found[0].score()[0] == fewest(sizes, capacity):
            break
    return sorted(found, key=Packing.score, reverse=True)


def fewest(sizes: np.ndarray, capacity: int) -> int:
    return -(-int(sizes.sum()) // capacity)


def evolve(population: list[Packing], generations: int, random: np.random.Generator) -> list[Packing]:
    """A child of two parents replaces the worst if it is better; stops where no fewer bins could do."""
    sizes, capacity = population[0].sizes, population[0].capacity
    least = fewest(sizes, capacity)
    for _ in range(generations * len(population)):
        if len(population) < 2 or -population[0].score()[0] <= least:
            break
        a, b = random.choice(len(population), 2, replace=False)
        child = offspring(population[a], population[b], random)
        if child.score() > population[-1].score():
            population = sorted([*population[:-1], child], key=Packing.score, reverse=True)
    return population


ISLANDS = flat_schema(
    "group long, island integer, ids binary, sizes binary, population binary, bins long, elite binary"
)


def _row(group: int, island: int, ids: bytes, population: list[Packing]) -> dict:
    best = population[0]
    return {
        "group": group,
        "island": island,
        "ids": ids,
        "sizes": best.sizes.astype("<i4").tobytes(),
        "population": np.concatenate([p.bin_of for p in population]).astype("<i4").tobytes(),
        "bins": -best.score()[0],
        "elite": best.bin_of.astype("<i4").tobytes(),
    }


def solve(
    items: DataFrame, groups: int, capacity: int, islands: int, population: int, generations: int, epochs: int
) -> DataFrame:
    """uid, group, bin, offset and room left of the bin, for items ``uid, length`` dealt into groups."""

    def settle_on(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("uid")
        group, island = (int(k) for k in key)
        random = np.random.default_rng([group, island])
        found = first_population(rows["length"].to_numpy(), capacity, population, random)
        return pd.DataFrame([_row(group, island, rows["uid"].to_numpy("<i8").tobytes(), evolve(found, generations, random))])

    def epoch(number: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.itertuples(index=False):
                    sizes = np.frombuffer(row.sizes, "<i4").astype(np.int64)
                    bins = np.frombuffer(row.population, "<i4").reshape(-1, len(sizes))
                    members = [Packing(sizes, capacity, b.astype(np.int32)) for b in bins]
                    guest = Packing(sizes, capacity, np.frombuffer(row.guest, "<i4").astype(np.int32))
                    members = sorted([*members[: max(1, population - 1)], guest], key=Packing.score, reverse=True)
                    random = np.random.default_rng([row.group, row.island, number])
                    yield pd.DataFrame([_row(row.group, row.island, row.ids, evolve(members, generations, random))])

        return run

    def lay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                sizes, bin_of = np.frombuffer(row.sizes, "<i4").astype(np.int64), np.frombuffer(row.elite, "<i4")
                order = np.argsort(bin_of, kind="stable")
                before = np.cumsum(sizes[order]) - sizes[order]
                heads = np.concatenate([[True], np.diff(bin_of[order]) > 0])
                offset = before - np.maximum.accumulate(np.where(heads, before, 0))
                room = capacity - np.bincount(bin_of, sizes).astype(np.int64)[bin_of[order]]
                uid, bins = np.frombuffer(row.ids, "<i8")[order], bin_of[order].astype(np.int64)
                yield pd.DataFrame({"uid": uid, "group": row.group, "bin": bins, "offset": offset, "room": room})

    dealt = items.withColumn("group", F.pmod(F.xxhash64("uid"), F.lit(groups)))
    dealt = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    state = settle(dealt.groupBy("group", "island").applyInPandas(settle_on, ISLANDS))
    ring = Window.partitionBy("group").orderBy("island")
    all_ring = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for number in range(epochs - 1):
        guest = F.coalesce(F.lag("elite").over(ring), F.last("elite").over(all_ring)).alias("guest")
        state = settle(state.select("*", guest).mapInPandas(epoch(number), ISLANDS))
    best = Window.partitionBy("group").orderBy("bins", "island")
    chosen = state.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")
    return chosen.mapInPandas(lay, "uid bigint, group bigint, bin bigint, offset bigint, room bigint")


def pack(
    cut: DataFrame,
    length: int = LENGTH,
    group_size: int = 4096,
    islands: int = 2,
    population: int = 4,
    generations: int = 4,
    epochs: int = 2,
    loose_share: float = 1 / 64,
) -> DataFrame:
    """``cut`` (rows of ``pieces``) with sequence_id and offset."""
    cut = settle(cut.withColumn("uid", F.monotonically_increasing_id()))
    left = cut.where(F.col("length") < length).select("uid", F.col("length").cast("bigint").alias("length"))
    alone = (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    placed = cut.where(F.col("length") >= length).select("uid", *alone)
    number, count = 0, left.count()
    while count:
        groups = -(-count // group_size)
        found = settle(solve(left, groups, length, islands, population, generations, epochs))
        loose = found.where(F.col("room") > int(length * loose_share))
        again = loose.count() if groups > 1 else 0
        done = again == 0 or 2 * again > count  # a next round must be much smaller
        fixed = found if done else found.where(F.col("room") <= int(length * loose_share))
        sequence = F.lit(number << 57).bitwiseOR(F.shiftleft(F.col("group"), 24)).bitwiseOR(F.col("bin"))
        placed = placed.unionByName(fixed.select("uid", sequence.alias("sequence_id"), "offset"))
        if done:
            break
        left = loose.select("uid").join(left, "uid")
        number, count = number + 1, again
    return cut.join(placed, "uid").drop("uid")

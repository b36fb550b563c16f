"""Phrase collocations by set-oriented mining of relations (SETM).

Texts are parted into pieces at punctuation and line ends and pieces into words; A-Z is lower-cased. A phrase is up to
``longest`` words that follow each other in a piece; everything is counted for each language on its own.

R1 is the relation of all places of frequent words. R(k+1) comes from R(k): two phrases of k words at adjacent places of
a piece are a phrase of k+1 words; they are counted in groups, and only places of groups of ``least`` or more stay. So a
longer phrase is only looked for where both its parts are frequent.

A relation is written to the shared folder as one row for each chunk of up to ``CHUNK_WORDS`` words of a language: places
in ascending order, and the phrase at each. Pieces are whole within a chunk and apart by an unused place, so the join by
piece and adjacent place is a merge of sorted arrays in the chunk, and nothing is shuffled but the counts of a chunk's
different groups: parted by a hash of the group, and each part as one compressed row. There are as many parts as the number of
words asks for, so that a part fits a task, and a group that is everywhere is one entry of each chunk. The semi-join with the frequent groups is a Bloom filter of bounded size (``bloom``):
what it lets through by mistake is counted at the next length and is not frequent there either, so a fuller filter costs
work and never changes a result. Phrases go by 64-bit names, a hash of language and word and then of the two parts;
frequent words are counted by their text, and frequent phrases that share a name raise an error.

A cut parts a phrase in two; 1000 * f(phrase) * n / (f(first) * f(rest)) rounded down, n being all words of the language,
is its score, and the lowest cut counts, of equal ones the first. A phrase is dropped if a longer one that holds it is at
least ``within`` percent as frequent; the longer by one word tell, as those beyond are never more frequent.

Edge cases: NULL and empty texts have no words; a missing language is ``und``; equal scores are ordered by frequency, then
by the phrase's UTF-8 bytes; repeated rows count each; a very long text is a chunk of its own; an empty table has no phrases;
doc_id and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickmart.llm.bloom import Filter, filter_of
from clickmart.llm.common import discard, settle, utf8
from clickmart.llm.substring_dedup import ODD, mix

LEAST = 100
LONGEST = 5
CHUNK_WORDS = 4 << 20  # also what a task holds of all languages together
MARK = b"."
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
#: Every end of a piece as the mark, letters in lower case.
SPLIT = bytes(MARK[0] if b in PIECE_ENDS else b for b in bytes(range(256)).lower())


class Numbers(dict):
    """A number for each word of a chunk, in the order in which they come; the mark is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Buffer:
    """The words of one language that a task has read and not yet sent."""

    def __init__(self):
        self.numbers, self.places, self.size = Numbers({MARK: 0}), [], 0

    def add(self, text: bytes) -> int:
        words = text.translate(SPLIT).replace(MARK, b" . ").split()
        words.append(MARK)
        self.places.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.size += len(words)
        return len(words)


CHUNKS = "lang string, words array<string>, names array<bigint>, counts array<bigint>, places binary"
RELATION = "names array<bigint>, gaps binary, at binary"
GROUPS = "part int, counts binary"
PARTS, PART_WORDS = 64, 4 << 20  # parts at least, and the words of the whole table for each


def one(values: np.ndarray | pa.Array) -> pa.ListArray:
    """A column of one row, which is a list of all values."""
    values = pa.array(values, pa.int64()) if isinstance(values, np.ndarray) else values
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def chunks(docs: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """The words of the texts: a row for each chunk with its different words, how often it has each, and which is where."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffers: dict[str, Buffer] = {}
        held = 0

        def sent(lang: str) -> pa.RecordBatch:
            nonlocal held
            done = buffers.pop(lang)
            held -= done.size
            places = np.concatenate(done.places)
            counts = np.bincount(places, minlength=len(done.numbers))[1:]
            words = list(done.numbers)[1:]
            prefix = lang.encode() + b" "
            names = np.fromiter((xxhash.xxh64_intdigest(prefix + w) for w in words), np.uint64, len(words))
            texts = pa.array(words, pa.binary()).cast(pa.string())
            columns = [pa.array([lang]), one(texts), one(names.view(np.int64)), one(counts), pa.array([places.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "words", "names", "counts", "places"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                if text:
                    held += buffers.setdefault(lang, Buffer()).add(text)
                    while held >= chunk_words:
                        yield sent(max(buffers, key=lambda x: buffers[x].size))
        for lang in list(buffers):
            yield sent(lang)

    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, CHUNKS)


def named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The names of the phrases made of two."""
    return mix(left.view(np.uint64) * ODD + right.view(np.uint64)).view(np.int64)


class Relation:
    """A chunk's phrases of one length: their names, the places in ascending order, and which phrase is at each."""

    def __init__(self, names: np.ndarray, places: np.ndarray, at: np.ndarray):
        self.names, self.places, self.at = names, places, at

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Left, right and number of the different pairs at adjacent places; the places, and which pair is at each."""
        first = np.flatnonzero(np.diff(self.places) == 1)
        size = max(len(self.names), 1)
        keys = self.at[first].astype(np.int64) * size + self.at[first + 1]
        keys, which, n = np.unique(keys, return_inverse=True, return_counts=True)
        return self.names[keys // size], self.names[keys % size], n, self.places[first], which

    def row(self) -> pa.RecordBatch:
        """Places as the gaps between them, which are mostly alike and small."""
        blobs = [np.diff(self.places, prepend=0).astype(np.int32), self.at.astype(np.int32)]
        columns = [one(self.names), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)]
        return pa.RecordBatch.from_arrays(columns, names=["names", "gaps", "at"])


def ints(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.int32)


def words_in(batch: pa.RecordBatch, frequent: Filter) -> Iterator[Relation]:
    """R1 of each chunk (names and places): the places of words that the filter holds."""
    for names, places in zip(batch.column(0), batch.column(1), strict=True):
        names, places = names.values.to_numpy(), ints(places)
        held = np.append(False, frequent.holds(names))[places]  # 0 is the mark
        yield Relation(names, np.flatnonzero(held), places[held] - 1)


def phrases_in(batch: pa.RecordBatch, frequent: Filter) -> Iterator[Relation]:
    """R(k) as it was written, of places that the filter holds already."""
    for names, gaps, at in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
        yield Relation(names.values.to_numpy(), np.cumsum(ints(gaps), dtype=np.int64), ints(at))


def squeezed(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> bytes:
    """Groups by ascending left and their numbers: different names once, and all values by place of their bytes, compressed."""
    names, codes = np.unique(np.concatenate([left, right]), return_inverse=True)
    order = np.argsort(codes[: len(left)], kind="stable")
    columns = [np.diff(names, prepend=0), np.diff(codes[: len(left)][order], prepend=0), codes[len(left) :][order], n[order]]
    planes = b"".join(c.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    sizes = np.array([len(names), len(left), len(planes)], "<i8").tobytes()
    return sizes + pa.compress(planes, codec="zstd", asbytes=True)


def loosened(counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """left, right and n of ``squeezed``."""
    n_names, n_groups, size = np.frombuffer(counts, "<i8", 3).tolist()
    planes = np.frombuffer(pa.decompress(counts[24:], size, codec="zstd"), np.uint8)
    ends = 8 * np.cumsum([n_names, n_groups, n_groups])
    names, left, right, n = (np.ascontiguousarray(c.reshape(8, -1).T).view("<i8").ravel() for c in np.split(planes, ends))
    names = np.cumsum(names)
    return names[np.cumsum(left)], names[right], n


def groups(rel: DataFrame, read: Callable, frequent: Broadcast, parts: int) -> DataFrame:
    """part and counts: how often a chunk has the phrase right one place after left, for all pairs of the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for relation in read(batch, frequent.value):
                left, right, n = relation.pairs()[:3]
                part = ((named(left, right).view(np.uint64) >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                for some in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                    if len(some):
                        columns = [pa.array(part[some[:1]]), pa.array([squeezed(left[some], right[some], n[some])], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names=["part", "counts"])

    return rel.mapInArrow(run, GROUPS)


def added_up(parted: DataFrame, least: int) -> DataFrame:
    """left, right and a, the sum of all chunks, where that is ``least`` or more."""

    def run(table: pa.Table) -> pa.Table:
        left, right, n = map(np.concatenate, zip(*map(loosened, table["counts"].to_pylist()), strict=True))
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        first = np.flatnonzero(np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])))
        a = np.add.reduceat(n[order], first)
        columns = [left[first], right[first], a]
        return pa.table([c[a >= least] for c in columns], names=["left", "right", "a"])

    return parted.groupBy("part").applyInArrow(run, "left bigint, right bigint, a bigint")


def with_names(counted: DataFrame) -> DataFrame:
    """left, right and a, and id: the name of the phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = named(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids)], names=["left", "right", "a", "id"])

    return counted.mapInArrow(run, "left bigint, right bigint, a bigint, id bigint")


def next_relation(rel: DataFrame, read: Callable, frequent: Broadcast, longer: Broadcast) -> DataFrame:
    """R(k+1) from R(k): the places of pairs that the filter ``longer`` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for relation in read(batch, frequent.value):
                left, right, _, places, which = relation.pairs()
                names = named(left, right)
                held = longer.value.holds(names)
                number = np.cumsum(held) - 1
                here = held[which]
                yield Relation(names[held], places[here], number[which[here]]).row()

    return rel.mapInArrow(run, RELATION)


def unique_names(frequent: DataFrame) -> DataFrame:
    """``frequent``, settled, after a look whether two share a name."""
    found = settle(frequent)
    if shared := found.groupBy("id").count().where("count > 1").head(1):
        raise ValueError(f"two frequent phrases have the same 64-bit name {shared[0]['id']}")
    return found


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, list[DataFrame]]:
    """All words of each language (lang, n), and for each length the frequent phrases.

    A phrase has id, left and right (the phrases without its last and first word), lang, words, a (how often it occurs),
    heads and tails (how often its first and last 1, 2, ... words do).
    """
    words, context = settle(chunks(docs)), docs.sparkSession.sparkContext
    each = words.select("lang", F.explode(F.arrays_zip("words", "names", "counts")).alias("w"))
    counts = each.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("a"), F.first("w.names").alias("id"))
    of_chunk = F.aggregate("counts", F.lit(0).cast("bigint"), lambda total, n: total + n)
    totals = settle(words.groupBy("lang").agg(F.sum(of_chunk).alias("n")))
    parts = max(PARTS, -(-(totals.agg(F.sum("n")).first()[0] or 0) // PART_WORDS))
    none, missing = F.array().cast("array<bigint>"), F.lit(None).cast("bigint")
    frequent = unique_names(counts.where(F.col("a") >= least))
    own = [missing.alias("left"), missing.alias("right"), "lang", F.array("word").alias("words"), "a", none.alias("heads"), none.alias("tails")]
    levels = [frequent.select("id", *own)]
    rel, read, held = words.select("names", "places"), words_in, context.broadcast(filter_of(frequent))
    written = words
    for length in range(2, longest + 1):
        frequent = unique_names(with_names(added_up(groups(rel, read, held, parts), least)))
        levels.append(settle(described(frequent, levels[-1])))
        if length < longest:
            longer = context.broadcast(filter_of(frequent))
            rel = settle(next_relation(rel, read, held, longer))
            discard(written)
            held.unpersist()
            written, read, held = rel, phrases_in, longer
        discard(frequent)
    discard(written)
    return totals, levels


def described(frequent: DataFrame, shorter: DataFrame) -> DataFrame:
    """What is known of the two phrases that each of ``frequent`` (left, right, id, a) consists of, put together."""
    left = shorter.select(
        F.col("id").alias("left"), "lang", F.col("words").alias("_words"), F.concat("heads", F.array("a")).alias("heads")
    )
    right = shorter.select(
        F.col("id").alias("right"), F.element_at("words", -1).alias("_last"), F.concat("tails", F.array("a")).alias("tails")
    )
    joined = frequent.join(left, "left").join(right, "right")
    words = F.concat("_words", F.array("_last"))
    return joined.select("id", "left", "right", "lang", words.alias("words"), "a", "heads", "tails")


def kept(phrases: DataFrame, longer: DataFrame | None, within: int) -> DataFrame:
    """``phrases`` that no phrase of ``longer``, of one word more, holds nearly always."""
    if longer is None:
        return phrases
    held = longer.select(F.explode(F.array("left", "right")).alias("of"), F.col("a").alias("most"))
    held = held.groupBy("of").agg(F.max("most").alias("most"))
    joined = phrases.join(held, phrases["id"] == held["of"], "left")
    return joined.where(F.coalesce(100 * F.col("most") < within * F.col("a"), F.lit(True))).drop("of", "most")


def scored(phrases: DataFrame, length: int, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n and score of phrases of ``length`` words; products have 38 digits."""
    cuts = []
    for k in range(1, length):
        first, rest = f"element_at(heads, {k})", f"element_at(tails, {length - k})"
        score = F.expr(f"(1000 * CAST(a AS DECIMAL(38,0)) * n) div (CAST({first} AS DECIMAL(38,0)) * {rest})")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.expr(first).alias("l"), F.expr(rest).alias("r")))
    found = phrases.join(totals, "lang").withColumn("cut", F.array_min(F.array(*cuts)))
    return found.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score", "id")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, within: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``top`` phrases of each language of ``docs`` (lang and text)."""
    totals, levels = frequent_phrases(docs, least, longest)
    longer = [*levels[2:], None]
    parts = [scored(kept(p, up, within), i, totals) for i, (p, up) in enumerate(zip(levels[1:], longer, strict=True), 2)]
    found = reduce(DataFrame.unionByName, parts)
    best_first = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = found.withColumn("part", F.pmod("id", F.lit(64)))
    for keys in (["lang", "part"], ["lang"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best_first)))
        found = found.where(F.col("rank") <= top)
    return found.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")

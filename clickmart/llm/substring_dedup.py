"""Repeated passages: paragraphs with MinHash banding, exact Jaccard, and components.

A line is a paragraph; longer ones are parted where the hash of a word is the least among its neighbours. Both depend on
nearby words alone, so a passage that documents share falls into the same paragraphs in each of them, wherever it
stands. Paragraphs are compared as sets of five-word shingles.

Bands are tuned: among the numbers of rows a band may have, each with the fewest bands that reach the recall, the one
with the least work is taken. Paragraphs that meet in a band are candidates. Equal ones are one text from there on; of
the others, all are checked against the least of their bucket. Where a bucket is not of one component then, its texts meet
by prefixes of their rarest shingles (two sets of the wanted similarity always share a shingle of such prefixes): first all
against the least with the shingle, then, component against component, each against the rest. So no candidate that could
join two components is lost and nothing is paired up where a bucket is a group of copies. Links have exact Jaccard
similarity. Their components are classes of paragraphs.

Paragraphs of a class that two documents hold are repeated. A passage is a sequence of them, with small gaps, of
``min_words`` or a few more; it counts if two documents hold the same sequence of classes. So a short line that many
documents have links none of them, whatever stands beside it. A passage's paragraphs stay in the smallest doc_id that
holds it and go elsewhere.

Edge cases: NULL and empty texts have no paragraphs; paragraphs shorter than a shingle are never compared; a paragraph
repeated within one document only is none; rows without doc_id are left as they are; rows that repeat a doc_id are one
document for all decisions; of equal texts the smallest doc_id wins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickmart.llm.common import discard, fresh, settle, text_at, texts_of, utf8
from clickmart.llm.graph import components
from clickmart.llm.words import Words

SHINGLE = 5
SIMILAR = 0.8
RADIUS = 5
GAP = 8
MIN_WORDS = 16
BATCH_WORDS = 200_000
MARKS = 4  # of 64 bits each
ODD = np.uint64(0x9E3779B97F4A7C15)
LAST = np.uint64(2**64 - 1)


def mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def tuned(similar: float = SIMILAR, recall: float = 0.98, false_cost: float = 20.0) -> tuple[int, int]:
    """Bands and rows of each: a band costs one row to shuffle, a false candidate the work of a check."""
    found = []
    for rows in range(1, 9):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similar**rows))
        false = sum(1 - (1 - (k / 100) ** rows) ** bands for k in range(int(100 * similar))) / 100
        found.append((bands + false_cost * false, bands, rows))
    return min(found)[1:]


class Paragraphs:
    """The paragraphs of some texts: where they start and end among all words, and whose they are.

    With ``lines`` every line is one paragraph, whole.
    """

    def __init__(self, texts: list[bytes], lines: bool = False):
        words, n = Words(texts), len(texts)
        at = np.arange(len(words.of)) + RADIUS * words.of  # neighbours behind each text
        total = len(words.of) + RADIUS * n
        self.hashes = np.full(total, LAST)
        self.hashes[at] = words.hashes
        behind = np.cumsum(words.sizes + RADIUS) - RADIUS  # what follows is no text
        edges = np.append(at[words.new_line], behind)
        whose = np.append(words.of[words.new_line], np.full(n, -1))
        order = np.argsort(edges, kind="stable")
        edges, whose = edges[order], whose[order]
        cuts = edges if lines else np.union1d(edges, self.minima())
        owner = whose if lines else whose[np.searchsorted(edges, cuts, "right") - 1]
        ends = np.append(cuts[1:], total)
        long = (owner >= 0) & (ends - cuts >= SHINGLE)
        self.start, self.end, self.of = cuts[long], ends[long], owner[long]
        self.first_word = (behind - words.sizes)[self.of]

    def minima(self) -> np.ndarray:
        """Places whose hash is less than that of all neighbours within the radius."""
        h, n = self.hashes, len(self.hashes)
        least = np.ones(n, bool)
        for k in range(1, RADIUS + 1):
            least[k:] &= h[k:] < h[:-k]
            least[:-k] &= h[:-k] < h[k:]
        return np.flatnonzero(least & (h != LAST))

    def shingles(self) -> np.ndarray:
        """The hash of the shingle that starts at each word."""
        found = np.zeros(len(self.hashes), np.uint64)
        for k in range(SHINGLE):
            found = found * ODD + np.roll(self.hashes, -k)
        return mix(found)

    def texts(self) -> np.ndarray:
        """A hash of each paragraph's whole text."""
        n = len(self.hashes)
        powers = np.full(n, ODD, np.uint64)
        powers[:1] = 1
        powers = np.multiply.accumulate(powers)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(self.hashes) * powers, out=sums[1:])
        back = np.full(n, pow(int(ODD), -1, 1 << 64), np.uint64)
        back[:1] = 1
        back = np.multiply.accumulate(back)
        return mix((sums[self.end] - sums[self.start]) * back[self.start] + (self.end - self.start).astype(np.uint64))

    def bands(self, bands: int, rows: int) -> list[np.ndarray]:
        """A key of each paragraph for each band."""
        shingles, found = self.shingles(), []
        edges = np.stack([self.start, self.end - SHINGLE + 1], axis=1).ravel()
        padded = np.append(shingles, LAST)
        for band in range(bands):
            key = np.full(len(self.start), band, np.uint64)
            for row in range(rows):
                salted = mix(padded ^ np.uint64((band * rows + row + 1) * int(ODD) % 2**64))
                key = mix(key * ODD + np.minimum.reduceat(salted, edges)[::2])
            found.append(key)
        return found


def in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes]]]:
    """doc_ids and texts, some at a time, whatever their lengths."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            ids.append(doc_id)
            texts.append(text)
            size += 1 + len(text) // 6
            if size >= BATCH_WORDS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if texts:
        yield ids, texts


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def paragraphs(docs: DataFrame, lines: bool = False) -> DataFrame:
    """doc_id, start (in words), n_words and text (a hash) of each paragraph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, some in in_groups(batches):
            p = Paragraphs(some, lines)
            if len(p.start):
                of, texts = np.array(ids, np.int64)[p.of], p.texts().view(np.int64)
                yield _batch(doc_id=of, start=p.start - p.first_word, n_words=p.end - p.start, text=texts)

    known = texts_of(docs).where("doc_id is not null")
    return known.mapInArrow(run, "doc_id bigint, start bigint, n_words bigint, text bigint")


def banded(docs: DataFrame, bands: int, rows: int, lines: bool = False, similar: float = SIMILAR) -> DataFrame:
    """band (a key), text and n: how often, as far as one task has seen."""
    least_unequal = math.ceil(similar / (1 - similar) - 1e-9) if similar < 1 else 1  # shingles of a set with an unequal similar one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, some in in_groups(batches):
            p = Paragraphs(some, lines)
            if len(p.start):
                texts, first, counts = np.unique(p.texts(), return_index=True, return_counts=True)
                # Sets of up to three shingles are similar only where they are equal, and equal ones meet in any band.
                few = (p.end - p.start)[first] < SHINGLE + least_unequal - 1
                for band, key in enumerate(p.bands(bands, rows)):
                    on = slice(None) if band == 0 else ~few
                    key, text, n = key[first][on], texts[on], counts[on].astype(np.int32)
                    yield _batch(band=key.view(np.int64), text=text.view(np.int64), n=n)

    return texts_of(docs).where("doc_id is not null").mapInArrow(run, "band bigint, text bigint, n int")


def buckets(docs: DataFrame, bands: int, rows: int, lines: bool = False, similar: float = SIMILAR) -> DataFrame:
    """band, text and least (of the bucket's texts) where a band holds more than one paragraph."""
    # A bucket has a row for each different text; what it holds is told by an aggregate, so that a hot one can be split.
    texts = settle(banded(docs, bands, rows, lines, similar).groupBy("band", "text").agg(F.sum("n").alias("n")))
    known = texts.groupBy("band").agg(F.min("text").alias("least"), F.max("text").alias("most"), F.sum("n").alias("all"))
    known = settle(known.where("all > 1").select("band", "least", (F.col("least") < F.col("most")).alias("mixed")))
    found = settle(texts.join(known, "band").where("n > 1 or mixed").select("band", "text", "least", "mixed"))
    discard(texts, known)
    return found


def shingles_of(docs: DataFrame, places: DataFrame, lines: bool = False) -> DataFrame:
    """text, its set of shingles and their marks, for ``places`` (doc_id and starts: (start, n_words, text) of paragraphs)."""
    own = texts_of(docs).where("doc_id is not null")
    wanted = places.select(F.col("doc_id").alias("_of"), "starts")
    joined = own.join(wanted, own["doc_id"] == wanted["_of"]).select("doc_id", "text", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[int, np.ndarray] = {}
            for text, starts in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                p = Paragraphs([text], lines)
                shingles, hashes = p.shingles().view(np.int64), p.texts().view(np.int64).tolist()
                at = {(s, h): k for k, (s, h) in enumerate(zip((p.start - p.first_word).tolist(), hashes, strict=True))}
                for s, h in ((x["start"], x["text"]) for x in starts):
                    if (k := at.get((s, h))) is not None:  # another row of the same doc_id has it otherwise
                        out[h] = np.unique(shingles[p.start[k] : p.end[k] - SHINGLE + 1])
            lists = pa.list_(pa.int64())
            columns = [pa.array(list(out), pa.int64()), pa.array([s.tolist() for s in out.values()], lists)]
            columns.append(pa.array([marks(s).tolist() for s in out.values()], lists))
            yield pa.RecordBatch.from_arrays(columns, names=["text", "shingles", "marks"])

    return joined.mapInArrow(run, "text bigint, shingles array<bigint>, marks array<bigint>").dropDuplicates(["text"])


def marks(shingles: np.ndarray) -> np.ndarray:
    """Bits by which two sets are told apart: each shingle turns one over, so sets differ by at least as many shingles as bits."""
    odd = np.bincount(shingles & (64 * MARKS - 1), minlength=64 * MARKS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def similar_pairs(pairs: DataFrame, shingles: DataFrame, similar: float) -> DataFrame:
    """The pairs ``u, v`` whose sets have Jaccard similarity ``similar`` or more."""
    of_u = shingles.select(F.col("text").alias("u"), F.col("shingles").alias("_u"))
    of_v = shingles.select(F.col("text").alias("v"), F.col("shingles").alias("_v"))
    both = F.size(F.array_intersect("_u", "_v"))
    checked = pairs.distinct().join(of_u, "u").join(of_v, "v")
    return checked.where(both >= similar * (F.size("_u") + F.size("_v") - both) - 1e-9).select("u", "v")


def links(mixed: DataFrame, shingles: DataFrame, similar: float) -> DataFrame:
    """Similar pairs of texts that connect, in every bucket of ``mixed``, all that are similar there."""
    to_least = mixed.where("text > least").select(F.col("text").alias("u"), F.col("least").alias("v"))
    led = settle(similar_pairs(to_least, shingles, similar))
    reached = components(led)
    members = mixed.select("band", "text").join(reached, F.col("text") == reached["node"], "left")
    members = settle(members.select("band", "text", F.coalesce("component", "text").alias("component")))
    # Where a bucket is of one component already, nothing is left to be found in it.
    several = members.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b")
    met = settle(members.join(settle(several.select("band")), "band", "left_semi"))
    sets = settle(shingles.join(met.select("text").distinct(), "text", "left_semi"))
    counts = sets.select("text", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    held = counts.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1")
    # Rarest first. A shingle of one text stands in front of all others and meets nothing, so it is only counted.
    own = Window.partitionBy("text")  # no more than a paragraph has
    at = F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("held", "shingle")) - 1
    ordered = counts.join(held, "shingle").select("text", "size", "shingle", at.alias("at"))
    prefix = settle(ordered.where(F.col("at") <= F.col("size") - F.ceil(F.lit(similar) * F.col("size") - 1e-9)))
    # Within a shingle of a bucket first all against the least; what is of one component then is not compared again.
    probes = settle(met.join(prefix.select("text", "shingle"), "text"))
    leading = probes.groupBy("band", "shingle").agg(F.min("text").alias("v"), F.min("component").alias("a"), F.max("component").alias("b"))
    leading = leading.where("a < b").select("band", "shingle", "v")
    to_leading = probes.join(leading, ["band", "shingle"]).where("text > v").select(F.col("text").alias("u"), "v")
    led = settle(led.union(similar_pairs(to_leading, shingles, similar)))
    texts = met.groupBy("text").agg(F.collect_set("band").alias("bands")).join(sets.select("text", "marks"), "text")
    reached = components(led)
    texts = texts.join(reached, F.col("text") == reached["node"], "left")
    texts = settle(texts.select("text", "bands", "marks", F.coalesce("component", "text").alias("component")))
    return led.union(similar_pairs(between(settle(prefix.join(texts, "text")), similar), shingles, similar))


def between(probes: DataFrame, similar: float) -> DataFrame:
    """Pairs ``u, v`` of texts of different components with a band and a shingle in common that may be similar.

    ``probes`` has text, size, bands, marks and component, and a shingle of the prefix: ``at`` is its place in the order.
    What is left out can't be similar. Two sets have to share ``need`` shingles, so the first one they share stands in
    front of that many in both, which a smaller set has near its front; and their marks differ by no more bits than the
    sets may differ by.
    """
    several = probes.groupBy("shingle").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b")
    probes = settle(probes.join(settle(several.select("shingle")), "shingle", "left_semi"))
    share = similar / (1 + similar)
    smaller = probes.select("shingle", *(F.col(c).alias(f"_{c}") for c in ("text", "size", "at", "bands", "marks", "component")))
    smaller = smaller.where(F.col("_at") <= F.col("_size") - 2 * share * F.col("_size") + 1e-6)
    both = F.col("size") + F.col("_size")
    need = F.ceil(share * both - 1e-6)
    turned = sum((F.bit_count(F.col("marks")[k].bitwiseXOR(F.col("_marks")[k])) for k in range(MARKS)), F.lit(0))
    may = (
        (F.col("component") != F.col("_component"))
        & (F.struct("_size", "_text") < F.struct("size", "text"))
        & (F.least(F.col("size") - F.col("at"), F.col("_size") - F.col("_at")) >= need)
        & (turned <= both - 2 * need)
        & F.arrays_overlap("bands", "_bands")
    )
    met = probes.join(smaller, "shingle").where(may)
    return met.select(F.greatest("text", "_text").alias("u"), F.least("text", "_text").alias("v"))


def repeated_paragraphs(docs: DataFrame, similar: float, recall: float, lines: bool = False) -> DataFrame:
    """doc_id, start, n_words and class of the paragraphs whose class two documents hold."""
    found = buckets(docs, *tuned(similar, recall), lines, similar)
    repeated = found.select("text").distinct()
    held = settle(paragraphs(docs, lines).join(repeated, "text", "left_semi"))
    mixed = found.where("mixed").select("band", "text", "least").distinct()
    # One place for each text first: a passage of many documents is a row for each task then.
    one = held.groupBy("text").agg(F.min(F.struct("doc_id", "start", "n_words")).alias("at"))
    one = one.join(mixed.select("text").distinct(), "text", "left_semi")
    places = one.groupBy("at.doc_id").agg(F.collect_list(F.struct("at.start", "at.n_words", "text")).alias("starts"))
    shingles = settle(shingles_of(docs, settle(places), lines))
    reached = components(links(mixed, shingles, similar))
    classes = held.join(reached, held["text"] == reached["node"], "left")
    classes = classes.select("doc_id", "start", "n_words", F.coalesce("component", "text").alias("class"))
    classes = settle(classes.distinct())
    across = classes.groupBy("class").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    across = across.where("first < last")
    repeated = classes.join(settle(across.select("class")), "class").select("doc_id", "start", "n_words", "class")
    discard(found, held, shingles)
    return repeated


def sequences(shared: DataFrame, min_words: int) -> DataFrame:
    """doc_id, key and members (start, n_words) of the shortest sequence of ``min_words`` from each paragraph on."""
    most = -(-min_words // SHINGLE)  # no paragraph is shorter than a shingle
    following = Window.partitionBy("doc_id").orderBy("start", "n_words", "class").rowsBetween(0, most - 1)
    ahead = shared.withColumn("ahead", F.collect_list(F.struct("start", "n_words", "class")).over(following))

    def longer(so_far: Column, one: Column) -> Column:
        goes_on = (so_far["words"] < min_words) & so_far["whole"]
        near = one["start"] <= so_far["end"] + GAP
        return F.when(
            goes_on & near,
            F.struct(
                (so_far["words"] + one["n_words"]).alias("words"),
                F.greatest(so_far["end"], one["start"] + one["n_words"]).alias("end"),
                (so_far["members"] + 1).alias("members"),
                F.xxhash64(so_far["key"], one["class"]).alias("key"),
                F.lit(True).alias("whole"),
            ),
        ).otherwise(so_far.withField("whole", so_far["whole"] & ~(goes_on & ~near)))

    none = F.struct(
        F.lit(0).cast("bigint").alias("words"),
        F.col("start").alias("end"),
        F.lit(0).alias("members"),
        F.lit(0).cast("bigint").alias("key"),
        F.lit(True).alias("whole"),
    )
    found = ahead.withColumn("s", F.aggregate("ahead", none, longer)).where(F.col("s.words") >= min_words)
    members = F.slice("ahead", F.lit(1), F.col("s.members"))
    return found.select("doc_id", F.col("s.key").alias("key"), members.alias("members"))


def passages(
    docs: DataFrame, similar: float = SIMILAR, min_words: int = MIN_WORDS, recall: float = 0.98, lines: bool = False
) -> DataFrame:
    """doc_id, start and n_words of the paragraphs of passages that two documents hold; first: the smallest doc_id."""
    held = settle(sequences(repeated_paragraphs(docs, similar, recall, lines), min_words))
    keys = held.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    shared = held.join(settle(keys.select("key", "first")), "key")
    members = shared.select("doc_id", F.explode("members").alias("m"), "first")
    return members.select("doc_id", "m.start", "m.n_words", "first").distinct()


def report(docs: DataFrame, **options: float) -> DataFrame:
    """For each row of ``docs`` its class_id, the smallest doc_id that shared passages lead to, and its repeats."""
    found = settle(passages(docs, **options))
    each = found.groupBy("doc_id", "start", "n_words").agg(F.min("first").alias("first"))
    goes = F.col("doc_id") > F.col("first")
    counts = each.groupBy("doc_id").agg(
        F.count("*").alias("n_repeated"),
        F.sum(goes.cast("bigint")).alias("n_removed"),
        F.sum(F.when(goes, F.col("n_words")).otherwise(0)).alias("words_removed"),
    )
    edges = found.where("doc_id > first").select(F.col("doc_id").alias("u"), F.col("first").alias("v")).distinct()
    reached = components(edges)
    whole = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).join(counts, "doc_id", "left")
    whole = whole.join(reached, whole["doc_id"] == reached["node"], "left")
    numbers = (F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in ("n_repeated", "n_removed", "words_removed"))
    return whole.select("doc_id", F.coalesce("component", "doc_id").alias("class_id"), *numbers)


def drop_repeats(docs: DataFrame, **options: float) -> DataFrame:
    """``docs`` without the paragraphs that go; the words of a line that stay are joined by a space where one is cut."""
    return cut_out(docs, passages(docs, **options).where("doc_id > first").select("doc_id", "start", "n_words").distinct())


def cut_out(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the words at ``gone`` (doc_id, start, n_words)."""
    gone = gone.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n_words")).alias("spans"))
    drop, of = fresh("_drop", docs), fresh("_of", docs)
    gone = gone.select(F.col("doc_id").alias(of), F.col("spans").alias(drop))
    at, width = text_at(docs), len(docs.columns)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = zip(utf8(batch.column(at)), batch.column(at), batch.column(drop).to_pylist(), strict=True)
            texts = [without(text, spans).decode() if spans else kept.as_py() for text, kept, spans in read]
            columns = [batch.column(i) for i in range(width)]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([batch.schema.field(i) for i in range(width)]))

    return docs.join(gone, docs["doc_id"] == gone[of], "left").drop(of).mapInArrow(rebuild, docs.schema)


def without(text: bytes, spans: list[dict[str, int]]) -> bytes:
    """The text without the words of the spans, and without lines that lose all their words."""
    gone = {k for s in spans for k in range(s["start"], s["start"] + s["n_words"])}
    lines, at = [], 0
    for line in text.split(b"\n"):
        words = line.split()
        kept = [w for k, w in enumerate(words, at) if k not in gone]
        at += len(words)
        if len(kept) == len(words):
            lines.append(line)
        elif kept:
            lines.append(b" ".join(kept))
    return b"\n".join(lines)

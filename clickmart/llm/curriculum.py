"""Mixing sources to target weights along a curriculum whose weights change over time.

Each source has a schedule: weights at points of the training time from 0 to 1, straight lines between them. Its integral
is the source's weight in the mix; what a source has been asked for by a time grows like the integral up to there. Sources
share the wanted number of words by weight; a target stops at ``max_repeats`` times the source's words and the rest is
shared again by weight among the others.

The documents of a source stand in an order given by a digest of doc_id and text. The mix takes them in that order, all
once before any a second time, and the last copy only as far as the target goes, in whole words. The words before a copy
are a demand of its source; the time at which the schedule has asked for so much is the copy's place in training.
``training_order`` sorts all copies by it over ranges.

Only DataFrame functions are used. Words before a document are summed in levels: within slices of about ``SLICE_ROWS``
documents, over the slices of a block, over blocks; so no source, however large, is one task. Equal rows are one row with
a count until the end. What is one row for each source is ordered in one task.

Edge cases: NULL and empty texts have size 0 and are never taken; documents without source are a source of their own,
last in order; a source without schedule weighs 1 all the time, one whose schedule is zero is not taken; rows that repeat
a doc_id are documents of their own, and rows equal in doc_id, source and text take what falls to each of them in any order;
an empty table gives an empty mix; other columns are left behind, in ``training_order`` they stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickmart.llm.common import fresh, settle

WORD = r"[^\x20\x09-\x0D]+"
SLICE_ROWS = 1024
SLICES_PER_BLOCK = 1024


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def digest_of(docs: DataFrame) -> Column:
    """What orders the documents of a source."""
    doc_id, text = docs["doc_id"].cast("bigint").cast("string"), docs["text"].cast("string")
    return F.md5(F.concat(F.coalesce(doc_id, F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))


def segments(schedules: DataFrame) -> DataFrame:
    """For each source its weight and the pieces of its schedule: from, weight there, slope and integral before.

    ``schedules`` has source, at (0 to 1) and weight (0 or more); before the first and after the last point the weight
    stays. Of points at the same time the largest weight counts.
    """
    points = schedules.select(
        F.col("source").cast("string").alias("of"), F.col("at").cast("double").alias("at"), F.col("weight").cast("double").alias("w")
    )
    points = points.where("at BETWEEN 0 AND 1 AND w >= 0").groupBy("of", "at").agg(F.max("w").alias("w"))
    ordered = Window.partitionBy("of").orderBy("at")
    ends = points.withColumns(
        {"first": F.row_number().over(ordered) == 1, "to": F.lead("at").over(ordered), "w_to": F.lead("w").over(ordered)}
    )
    to, w_to = F.coalesce("to", F.lit(1.0)), F.coalesce("w_to", "w")
    slope = F.when(to > F.col("at"), (w_to - F.col("w")) / (to - F.col("at"))).otherwise(0.0)
    own = F.struct(F.col("at"), F.col("w"), slope.alias("slope"), ((F.col("w") + w_to) / 2 * (to - F.col("at"))).alias("area"))
    start = F.struct(F.lit(0.0).alias("at"), F.col("w"), F.lit(0.0).alias("slope"), (F.col("w") * F.col("at")).alias("area"))
    both = F.when(F.col("first") & (F.col("at") > 0), F.array(start, own)).otherwise(F.array(own))
    pieces = ends.select("of", F.explode(both).alias("p")).select("of", "p.*")
    so_far = Window.partitionBy("of").orderBy("at")
    pieces = pieces.withColumn("before", F.coalesce(F.sum("area").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    piece = F.struct("before", "at", "w", "slope", "area")
    return pieces.groupBy("of").agg(F.max(F.col("before") + F.col("area")).alias("weight"), F.array_sort(F.collect_list(piece)).alias("pieces"))


def targets(sizes: DataFrame, schedules: DataFrame, share: float, max_repeats: int) -> DataFrame:
    """number, source, source_size, weight, pieces and target of each source; ``sizes`` has source and source_size.

    The level to which targets rise is found in one pass: sources in the order in which they reach their limit, and for
    each the level if those before it are full. One row for each source.
    """
    known = segments(schedules)
    constant = F.struct(*[F.lit(x).alias(n) for n, x in (("before", 0.0), ("at", 0.0), ("w", 1.0), ("slope", 0.0), ("area", 1.0))])
    joined = sizes.join(known, F.col("source").eqNullSafe(known["of"]), "left").select(
        F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))).alias("number"),
        "source",
        "source_size",
        F.coalesce("weight", F.lit(1.0)).alias("weight"),
        F.coalesce("pieces", F.array(constant)).alias("pieces"),
        (max_repeats * F.col("source_size")).cast("double").alias("most"),
        F.sum("source_size").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"),
    )
    weighty = joined.where("weight > 0").withColumn("full_at", F.col("most") / F.col("weight"))
    filling = Window.orderBy("full_at", "number")
    before = F.coalesce(F.sum("most").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = weighty.withColumn("level", (F.lit(float(share)) * F.col("all") - before) / open_weight)
    reached = levels.where("level <= full_at").agg(F.max("level").alias("level")).scalar()
    target = F.least(F.col("most"), F.coalesce(reached, F.lit(float("inf"))) * F.col("weight"))
    return joined.select(
        "number", "source", "source_size", "weight", "pieces", F.when(F.col("weight") > 0, target).otherwise(0.0).alias("target")
    )


def running(rows: DataFrame, slices: int) -> DataFrame:
    """``rows`` (number, slice, digest, doc_id, size, copies) with before: the words of the source before the row."""
    words = F.col("size") * F.col("copies")
    of_slices = settle(rows.groupBy("number", "slice").agg(F.sum(words).alias("words")))
    of_slices = of_slices.withColumn("block", F.col("slice").cast("bigint") / F.lit(SLICES_PER_BLOCK)).withColumn("block", F.floor("block"))
    earlier = lambda keys, *order: F.coalesce(
        F.sum("words").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    blocks = of_slices.groupBy("number", "block").agg(F.sum("words").alias("words"))
    blocks = blocks.select("number", "block", earlier(["number"], "block").alias("before_block"))
    within = of_slices.withColumn("before_slice", earlier(["number", "block"], "slice"))
    starts = within.join(blocks, ["number", "block"]).select("number", "slice", (F.col("before_block") + F.col("before_slice")).alias("start"))
    own = rows.withColumn("words", words)
    own = own.withColumn("inside", earlier(["number", "slice"], "digest", F.asc_nulls_last("doc_id"), "size")).drop("words")
    return own.join(starts, ["number", "slice"]).withColumn("before", F.col("start") + F.col("inside")).drop("start", "inside")


def time_of(demand: Column, target: Column, weight: Column, pieces: Column) -> Column:
    """The time from 0 to 1 at which the schedule has asked for ``demand`` of the ``target`` words."""
    asked = demand / target * weight
    piece = F.element_at(F.filter(pieces, lambda p: (p["before"] <= asked) & (p["area"] > 0)), -1)
    rest = asked - piece["before"]
    # The root of slope/2 x^2 + w x = rest that is exact for small slopes, too.
    x = 2 * rest / (piece["w"] + F.sqrt(piece["w"] * piece["w"] + 2 * piece["slope"] * rest))
    return F.when(rest > 0, piece["at"] + x).otherwise(piece["at"])


def mixture(docs: DataFrame, schedules: DataFrame, share: float = 1.0, max_repeats: int = 3) -> DataFrame:
    """For each row of ``docs``: doc_id, digest, source, size, source_size, target (of the source, in words), taken (words),
    and copies (pass, position in training time, words).

    ``share`` is the wanted size of the mix in sizes of all documents.
    """
    text = docs["text"].cast("string")
    rows = docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"), docs["source"].cast("string").alias("source"),
        words_of(text).alias("size"), digest_of(docs).alias("digest"),
    )
    rows = settle(rows.groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("copies")))
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("n"))
    sizes = settle(sizes)
    sources = settle(targets(sizes.select("source", "source_size"), schedules, share, max_repeats))
    slices = (sizes.agg(F.sum("n").alias("n")).first()["n"] or 0) // SLICE_ROWS + 1
    number = sources.select(F.col("source").alias("of"), "number")
    lead = F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint")  # 32 bits
    placed = rows.join(number, rows["source"].eqNullSafe(number["of"])).drop("of", "source")
    placed = placed.withColumn("slice", F.floor(lead * F.lit(slices) / F.lit(float(1 << 32))))
    found = running(placed, slices).join(sources, "number")
    # Equal rows follow each other in the order.
    found = found.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    start = F.col("before") + F.col("k") * F.col("size")
    whole = F.floor("target")

    def copy(n: int) -> Column:
        demand = F.lit(n) * F.col("source_size") + start
        words = F.greatest(F.least(whole - demand, F.col("size")), F.lit(0)).cast("bigint")
        position = time_of(demand, F.col("target"), F.col("weight"), F.col("pieces"))
        return F.when(words > 0, F.struct(F.lit(n + 1).alias("pass"), position.alias("position"), words.alias("words")))

    found = found.withColumn("copies", F.array_compact(F.array(*[copy(n) for n in range(max_repeats)])))
    taken = F.aggregate("copies", F.lit(0).cast("bigint"), lambda total, c: total + c["words"])
    return found.select("doc_id", "digest", "source", "size", "source_size", "target", taken.alias("taken"), "copies")


def training_order(docs: DataFrame, schedules: DataFrame, share: float = 1.0, max_repeats: int = 3) -> DataFrame:
    """A row of ``docs`` for every copy that the mix takes, with position, pass and words, sorted by position over ranges."""
    mixed = mixture(docs, schedules, share, max_repeats).select("doc_id", "source", "digest", F.explode("copies").alias("c"))
    own = {name: fresh(name, docs) for name in ("position", "pass", "words")}
    id_, of, key, same = (fresh(name, docs) for name in ("_doc_id", "_source", "_digest", "_same"))
    copies = mixed.select(
        F.col("doc_id").alias(id_), F.col("source").alias(of), F.col("digest").alias(key), *[F.col(f"c.{n}").alias(a) for n, a in own.items()]
    )
    texts = docs.withColumn(same, digest_of(docs)).dropDuplicates(["doc_id", "source", same])
    joined = texts.join(
        copies, (texts[same] == copies[key]) & texts["doc_id"].eqNullSafe(copies[id_]) & texts["source"].eqNullSafe(copies[of])
    )
    return joined.select(*docs.columns, *own.values()).orderBy(own["position"], "doc_id", own["pass"])

"""Quality rules and decontamination against brute force."""

from clickmart.llm import decontaminate, quality_rules
from tests.llm import brute
from tests.llm.conftest import BASE, LONG, ODD, expected, rows_of

COLUMNS = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
QUALITY = [
    *ODD,
    (20, (BASE + " ") * 3),
    (21, BASE + " " + BASE.replace("ten", "x") + " y"),
    (22, "\n".join([BASE, "same line", "same line", "same line ", "same line"])),
    (23, BASE + "..." + "\n" + BASE + "…"),
    (24, "12345 " * 25),
    (25, BASE + " Lorem ipsum"),
    (26, " ".join(f"{'x' * 40}{i}" for i in range(30))),
    (27, "w" * 6000 + " " + BASE),
]


def test_quality_measures(as_documents):
    assert rows_of(quality_rules.judge(as_documents(QUALITY)), *COLUMNS) == expected(brute.quality(QUALITY))


def test_quality_keeps_rows_whole(as_documents):
    docs = as_documents(QUALITY)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    good = [r[0] for r in brute.quality(QUALITY) if r[-1]]
    assert rows_of(kept, "doc_id") == expected((i,) for i in good) and len(good) == 4


def test_order_is_rejections_per_cost(as_documents):
    """A rule that rejects everything for nearly nothing comes before a dear one that rejects nothing."""
    dear = quality_rules.Rule("dear", ("n_repeat_words",), lambda m: False)
    cheap = quality_rules.Rule("cheap", ("n_symbols",), lambda m: True)
    assert [r.name for r in quality_rules.order_rules(as_documents([(i, LONG) for i in range(8)]), (dear, cheap))] == ["cheap", "dear"]
    judged = quality_rules.judge(as_documents([(i, LONG) for i in range(8)]), (dear, cheap))
    assert {(r["rejected_by"], r["rules_tried"]) for r in judged.collect()} == {("cheap", 1)}


def test_quality_of_nothing(as_documents):
    assert quality_rules.judge(as_documents([(1, "x")]).where("doc_id = 2")).count() == 0
    assert quality_rules.keep_good(as_documents([(1, "x")]).where("doc_id = 2")).count() == 0


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
HALVES = " ".join(ITEM.split()[10:]) + " and then " + " ".join(ITEM.split()[:10])
LEAKS = [
    *ODD,
    (30, f"Before. {ITEM.upper()}! after"),
    (31, f"{BASE} {HALVES} {BASE}"),
    (32, " ".join(ITEM.split()[:15])),
    (33, " ".join(ITEM.split()[:16])),
    (34, f"{ITEM} {ITEM} {LONG}"),
    (35, "a b a b a b a b a b a b a b"),
]
ITEMS = [(1, ITEM), (2, ITEM), (3, None), (4, "one two"), (5, "a b a b a b a b"), (None, BASE), (6, "a a a a a a a")]


def test_contamination(spark, as_documents):
    items = spark.createDataFrame([(*i, "extra") for i in ITEMS], "item_id bigint, text string, tiles string")
    found = decontaminate.contamination(as_documents(LEAKS), items)
    assert rows_of(found, "doc_id", "item_id", "coverage") == expected(brute.contamination([r for r in LEAKS if r[1] != LONG], ITEMS))
    in_blocks = decontaminate.contamination(as_documents(LEAKS), items, block_bytes=1)
    assert rows_of(in_blocks, "doc_id", "item_id", "coverage") == rows_of(found, "doc_id", "item_id", "coverage")
    docs = as_documents(LEAKS)
    clean = decontaminate.keep_clean(docs, items, block_bytes=50)
    assert clean.columns == docs.columns
    stays = [r for r in LEAKS if r[1] == LONG or not brute.contamination([r], ITEMS)]
    assert rows_of(clean, "doc_id", "text") == expected(stays)


def test_tiles_lie_on_equal_words(spark, as_documents):
    items = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    for row in decontaminate.contamination(as_documents(LEAKS), items, threshold=0.1).collect():
        words = brute.plain_words(next(t for i, t in LEAKS if i == row["doc_id"]))
        for a, b, n in row["tiles"]:
            assert ITEM.split()[a : a + n] == words[b : b + n] and n >= 5


def test_no_benchmark(spark, as_documents):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(as_documents(LEAKS), none).count() == 0
    assert decontaminate.keep_clean(as_documents(LEAKS), none).count() == len(LEAKS)

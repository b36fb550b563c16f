"""Benchmark items of fewer words than a seed."""

from clickmart.llm import decontaminate


def found(items, text, short=True):
    return list(decontaminate.Block(items, decontaminate.LEAST, short).matches(text))


def test_short_items_are_found_whole():
    items = [(1, b"one two"), (2, b"Three"), (3, b"one two"), (4, b""), (5, b"a b c d e f")]
    assert found(items, b"one two") == [(1, 1.0, [(0, 0, 2)]), (3, 1.0, [(0, 0, 2)])]
    assert sorted(i for i, *_ in found(items, b"so (One two!) and three, one two")) == [1, 2, 3]
    assert found(items, b"two one") == found(items, b"one x two") == found(items, b"") == []
    assert found(items, b"one two", short=False) == []


def test_longer_items_are_tiled_as_before():
    assert found([(5, b"a b c d e f"), (6, b"b")], b"x a b c d e f y") == [(6, 1.0, [(0, 2, 1)]), (5, 1.0, [(0, 1, 6)])]


def test_documents_with_a_short_item_go(spark, as_documents):
    items = spark.createDataFrame([(1, "one two")], "item_id bigint, text string")
    kept = decontaminate.keep_clean(as_documents([(1, "one two"), (2, "two one")]), items, short=True)
    assert [r["doc_id"] for r in kept.collect()] == [2]

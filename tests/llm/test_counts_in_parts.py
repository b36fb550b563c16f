"""The counts of pairs as one compressed row for each chunk and part."""

from collections import Counter

import numpy as np

from clickmart.llm import collocations as c


def test_what_is_squeezed_comes_back():
    random = np.random.default_rng(0)
    for n in (1, 2, 7, 2000):
        names = random.integers(-(2**63), 2**63, max(n // 3, 1))
        left, right, counts = random.choice(names, n), random.choice(names, n), random.integers(1, 2**40, n)
        back = c.loosened(c.squeezed(left, right, counts))
        assert sorted(zip(*map(np.ndarray.tolist, back), strict=True)) == sorted(
            zip(left.tolist(), right.tolist(), counts.tolist(), strict=True)
        )


def test_rows_follow_the_chunks_and_not_the_pairs(spark):
    """One row for each part that a chunk has, whatever the number of its pairs; sums as counted one by one."""
    random = np.random.default_rng(1)
    docs = [(i, " ".join(f"w{k}" for k in random.integers(0, 60, 400))) for i in range(40)]
    pairs = Counter()
    for _, text in docs:
        words = text.split()
        pairs.update(zip(words, words[1:], strict=False))
    df = spark.createDataFrame([(i, t, "en") for i, t in docs], "doc_id bigint, text string, lang string").coalesce(2)
    words = c.settle(c.chunks(df))
    names = {w: n for r in words.collect() for w, n in zip(r["words"], r["names"], strict=True)}
    frequent = spark.createDataFrame([(n,) for n in names.values()], "id bigint")
    held = spark.sparkContext.broadcast(c.filter_of(frequent))
    parted = c.settle(c.groups(words.select("names", "places"), c.words_in, held, 8))
    assert parted.count() <= 8 * words.count() and parted.count() < len(pairs) / 10
    found = {(r["left"], r["right"]): r["a"] for r in c.added_up(parted, 5).collect()}
    assert found == {(names[a], names[b]): n for (a, b), n in pairs.items() if n >= 5}

"""Collocations and lexical search against brute force."""

import math
import random
import re
from collections import Counter

import pytest

from clickmart.llm import collocations, lexical_search, queries
from tests.llm.brute import ascii_lower
from tests.llm.conftest import ODD, PLAIN, expected, rows_of

PHRASE_COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute_phrases(docs, least, longest=5, within=100, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text or "")):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, words[i : i + k]) for i in range(len(words) - k + 1))
    frequent = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, words), a in frequent.items():
        n = totals[lang]
        cuts = [(1000 * a * n // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        longer = (
            b for (other, held), b in frequent.items()
            if other == lang and len(held) > len(words) and any(held[i : i + len(words)] == words for i in range(len(held)))
        )
        if not any(100 * b >= within * a for b in longer):
            out.append((lang, -score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]], n))
    ranks, rows = Counter(), []
    for lang, score, a, phrase, l, r, n in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= top:
            rows.append((lang, ranks[lang], phrase.decode(), -a, l, r, n, -score))
    return rows


def random_docs(seed, n=400):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "É", "x'y", "tall", "a-b", "ship", "\x1f", "you"]
    docs = []
    for _ in range(n):
        text = " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randrange(0, 40)))
        text = text.replace("tall", "tall ship, of New York") if rng.random() < 0.5 else text.replace("you", "you.\tThe")
        docs.append((rng.choice(["en", "en", "fr", "", None, "und"]), text))
    return docs + [(None, t) for _, t in ODD] + [("en", None), ("fr", "  \t. , \n")]


def language_table(spark, docs):
    return spark.createDataFrame([(*d, 1, "k") for d in docs], "lang string, text string, n int, words string").repartition(4)


@pytest.mark.parametrize("least, within, top", [(20, 100, 2000), (5, 60, 2000), (8, 100, 7), (1, 100, 40)])
def test_phrases(spark, least, within, top):
    docs = random_docs(least, 150 if least == 1 else 400)
    if least == 1:
        docs = [d for d in docs if d[1] is None or len(d[1]) < 2000]
    found = collocations.collocations(language_table(spark, docs), least=least, within=within, top=top)
    assert found.columns == PHRASE_COLUMNS
    assert rows_of(found, "*") == expected(brute_phrases(docs, least, within=within, top=top))


def test_phrases_over_many_chunks_and_a_full_filter(spark, monkeypatch):
    """Neither small chunks nor a filter that lets nearly everything through change the result."""
    docs = random_docs(3)
    wanted = expected(brute_phrases(docs, 10))
    small = collocations.chunks
    monkeypatch.setattr(collocations, "chunks", lambda docs: small(docs, chunk_words=50))
    assert rows_of(collocations.collocations(language_table(spark, docs), least=10), "*") == wanted
    full = collocations.filter_of
    monkeypatch.setattr(collocations, "filter_of", lambda frequent: collocations.Filter(full(frequent).words[:1] | ~full(frequent).words[:1]))
    assert rows_of(collocations.collocations(language_table(spark, docs), least=10), "*") == wanted


def test_scores_are_exact(spark):
    """A product beyond 64 bits."""
    rows = [(1, 2, 3, "en", ["a", "b"], 5_000_000_000, [6_000_000_000], [7_000_000_000])]
    phrases = spark.createDataFrame(
        rows, "id bigint, left bigint, right bigint, lang string, words array<string>, a bigint, heads array<bigint>, tails array<bigint>"
    )
    totals = spark.createDataFrame([("en", 9_000_000_000_000)], "lang string, n bigint")
    (row,) = collocations.scored(phrases, 2, totals).collect()
    assert row["score"] == 1000 * 5_000_000_000 * 9_000_000_000_000 // (6_000_000_000 * 7_000_000_000)


def test_no_phrases(spark):
    assert collocations.collocations(language_table(spark, random_docs(1)).where("false")).count() == 0
    assert collocations.collocations(language_table(spark, random_docs(1)), least=10**6).count() == 0


def test_registered_phrases(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{PLAIN}/documents.parquet").select("lang", "text").collect()]
    found = queries.queries()["op12_phrase_collocations"](spark, PLAIN)
    assert found.columns == PHRASE_COLUMNS and rows_of(found, "*") == expected(brute_phrases(docs, 100))


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def brute_search(docs, items, top=10):
    found = [(i, Counter(terms(t))) for i, t in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    n_docs, length = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    rows = []
    for item_id, text in items:
        scores = []
        query = terms(text)
        for doc_id, c, n in found:
            m = 100 - 75 + (75 * n * n_docs) // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in query
            )
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, missing, doc_id) in enumerate(sorted(scores)[:top], 1):
            rows.append((item_id, rank, None if missing else doc_id, -score))
    return rows


ITEMS = [
    (1, "one TWO three é"), (2, None), (3, ""), (4, "zzzz nowhere"), (5, "a a a a one one"), (6, "word1x word2x word3x tail"),
    (6, "you'll Don't 12345"), (None, "ÉÀ word"), (2**62, "twenty nineteen more words that follow them"), (8, "the"),
]


def item_table(spark, items):
    return spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, rank int").repartition(2)


def search_docs():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["one", "two", "three", "the", "É"]
    docs = [(2**60 + k, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for k in range(300)]
    return ODD + docs + [(k, "one two three copies of a text") for k in range(5000, 5400)] + [(None, "one two three")] * 20


@pytest.mark.parametrize("bits, batch, top", [(12, 300_000, 10), (3, 40, 10), (1, 200, 3)])
def test_search(spark, as_documents, monkeypatch, bits, batch, top):
    """Any number of places and any batches give the same."""
    monkeypatch.setattr(lexical_search, "BATCH_TERMS", batch)
    docs = search_docs()
    found = lexical_search.search(as_documents(docs), item_table(spark, ITEMS), top=top, bits=bits)
    assert rows_of(found, "*") == expected(brute_search(docs, ITEMS, top))


def test_search_in_blocks(spark, as_documents):
    docs = search_docs()
    found = lexical_search.search(as_documents(docs), item_table(spark, ITEMS), block_items=3)
    assert rows_of(found, "*") == expected(brute_search(docs, ITEMS))


def test_bounds_are_never_less_than_scores():
    """The descending order stops early, so that few documents are scored."""
    docs = [(i, t) for i, t in search_docs() if terms(t)]
    block = lexical_search.Block([(i, (t or "").encode()) for i, t in ITEMS])
    stats = lexical_search.Statistics.__new__(lexical_search.Statistics)
    words = [lexical_search.terms(t.encode()) for _, t in docs]
    held = Counter(t for w in words for t in set(w))
    stats.documents, stats.length = len(docs), sum(map(len, words))
    stats.weights = {t: math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * held[t] + 1))) for t in block.vocabulary if held[t]}
    wanted = brute_search(docs, ITEMS, top=10**6)
    for bits in (12, 5, 2):
        searcher = lexical_search.Searcher(block, stats, 10, bits)
        searcher.start()
        seen = []
        inner = searcher.bounds
        searcher.bounds = lambda *a, inner=inner, seen=seen: seen.append(inner(*a)) or seen[-1]
        searcher.take([i for i, _ in docs], words)
        bounds = seen[0]
        for item_id, _, doc_id, score in wanted:
            for q in (q for q, i in enumerate(block.ids) if i == item_id):
                if doc_id is not None and sum(i == item_id for i in block.ids) == 1:
                    assert max(bounds[d, q] for d, (i, _) in enumerate(docs) if i == doc_id) >= score
    assert lexical_search.COORDINATE_BITS == 12


def test_search_in_nothing(spark, as_documents):
    assert lexical_search.search(as_documents(ODD).where("false"), item_table(spark, ITEMS)).count() == 0
    assert lexical_search.search(as_documents(ODD), item_table(spark, ITEMS).where("false")).count() == 0


def test_registered_search(spark, given):
    items = [tuple(r) for r in spark.read.parquet(f"{PLAIN}/benchmark.parquet").select("item_id", "text").collect()]
    found = queries.queries()["op13_lexical_search"](spark, PLAIN)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(found, "*") == expected(brute_search(given, items))

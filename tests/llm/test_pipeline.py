"""The corpus pipeline against brute force, stage by stage on what the one before kept."""

import hashlib
import random

import pytest

import corpus_pipeline
from clickmart.llm import queries, simhash_dedup
from tests.llm import brute
from tests.llm.conftest import LONG, ODD, expected, rows_of
from tests.llm.test_packing import check_sequences
from tests.llm.test_passages import random_words

ITEM = " ".join(random_words(77, 30))


def corpus():
    """A third of all documents are copies of one; others are near copies, share lines, leak, or are junk."""
    rng = random.Random(4)
    docs = [r for r in ODD if r[0] != 16 and r[1] != LONG]
    copy = " ".join(random_words(1, 80))
    for i in range(100, 220):
        words = random_words(i, rng.randrange(10, 120))
        if i % 3 == 0:
            text = copy
        elif i % 7 == 0:
            text = copy + f" {i}"
        elif i % 5 == 0:
            text = " ".join(words) + f"\nA line that many share with others\n{ITEM.title()}\n" + " ".join(words[:3])
        elif i % 11 == 0:
            text = "### " * 30 + " ".join(words)
        else:
            text = " ".join(words) + "\na line that many share with others\n" + " ".join(reversed(words))
        docs.append((i, text))
    return docs


def kept_lines(docs):
    holders = {}
    key = lambda x: brute.ascii_lower(x.strip(brute.WHITE))
    for i, t in docs:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders[key(line)] = min(i, holders.get(key(line), i))
    gone = lambda i, x: i is not None and len(key(x)) >= 10 and holders[key(x)] != i
    return [(i, t if t is None else "\n".join(x for x in t.split("\n") if not gone(i, x))) for i, t in docs]


def one_of_each(docs):
    """The first document of each group of fingerprints by doc_id, missing ones last, then by digest of the text."""
    groups = {}
    for (i, t), (_, _, group) in zip(docs, brute.simhash([(k, t) for k, (_, t) in enumerate(docs)]), strict=True):
        digest = hashlib.md5((t or "").encode()).hexdigest()
        groups.setdefault(group, {}).setdefault((i is None, i or 0, digest), (i, t))
    return [rows[min(rows)] for rows in groups.values()]


def brute_pipeline(docs, items):
    good = [d for d, q in zip(docs, brute.quality(docs), strict=True) if q[-1]]
    lines = kept_lines(good)
    one = one_of_each(lines)
    leaks = {(i, t) for i, t in one for _ in brute.contamination([(i, t)], items, short=True)}
    return [d for d in one if d not in leaks]


@pytest.fixture(scope="module")
def folder(spark, as_documents, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    as_documents(corpus()).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "one two")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_the_whole_pipeline(spark, folder):
    wanted = brute_pipeline(corpus(), [(1, ITEM), (2, None), (3, "one two")])
    assert 20 < len(wanted) < 100
    found = queries.queries()["pipeline"](spark, folder)
    pieces = brute.token_pieces(wanted, queries._tokenizer("word_bpe_49k.json"))
    assert rows_of(found, "doc_id", "piece", "start", "length", "ids_crc32") == expected(pieces)
    used, least = check_sequences(found.collect(), 4096)
    assert used <= least + 1


def test_no_text_is_lost_where_rows_share_a_doc_id(as_documents):
    """A doc_id on two texts ties nothing together; copies without doc_id go, too."""
    a, b, c, d = (" ".join(random_words(60 + k, 30)) for k in range(4))
    for docs in (
        [(1, a), (1, b), (2, b), (3, c)],
        [(1, a), (1, a), (None, a), (None, d), (None, d), (2, d + " x"), (2, b), (None, None), (5, ""), (5, None)],
        [(7, a), (7, b), (7, c), (None, c), (None, None)],
        corpus() + [(100, b), (100, c), (None, b)],
    ):
        found = simhash_dedup.keep_one(as_documents(docs), length=3, limit=2)
        assert found.columns == as_documents(docs).columns
        kept = [(r[0], r[1] or "") for r in rows_of(found, "doc_id", "text")]
        assert sorted(kept, key=repr) == sorted(((i, t or "") for i, t in one_of_each(docs)), key=repr)
        prints = lambda rows: {r[1] for r in brute.simhash(rows)}
        near = [int(p, 16) for p in prints(kept)]
        assert all(min((int(p, 16) ^ q).bit_count() for q in near) <= 2 for p in prints(docs[:10]))


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns, name
        assert dict(after.dtypes) == dict(docs.dtypes)


def test_stages_on_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


